"""Beam search to the end over a given table of log probabilities, all keys at once, a round a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decoding import most_candidates
from .stages import stage


def beam_search(start: DataFrame, table: DataFrame, keys: list[str], first: int, end: int, beam_size: int, most_steps: int, patience: float = 1.0) -> DataFrame:
    """(keys, tokens, score, finished): the sequences found for each row of ``start``, ``first`` and ``end`` included.

    ``table``: keys, step (from 0), prev, token, lp, the log probability of a token behind
    ``prev``.  A step takes the ``beam_size`` + 1 likeliest tokens of every beam and goes
    through all of a key's candidates by falling score (ties: earlier beam, then likelier,
    then smaller token) until ``beam_size`` have been kept; those that end before are finished.
    A key is done with ``beam_size`` x ``patience`` finished sequences, later ones being
    left out; after ``most_steps``, or where the table ends, its best unfinished ones (of
    equals the later) are ended by force until it has ``beam_size``.

    A key has ``beam_size`` live rows at most, so all groups are small; what a step reads
    is its own part of the table.
    """
    if patience < 1:
        raise ValueError("patience is at least 1")
    most = most_candidates(beam_size, patience)
    steps = stage(table.select(*keys, "step", "prev", "token", F.col("lp").cast("double").alias("lp")).where(F.col("lp").isNotNull() & F.col("step").between(0, most_steps - 1)), "search-table", "step")
    live = start.select(*keys).distinct().select(*keys, F.lit(0).alias("beam"), F.array(F.lit(first)).alias("tokens"), F.lit(0.0).alias("score"))
    live, done, left = stage(live, "search-live"), None, None
    of_beam = Window.partitionBy(*keys, "beam").orderBy(F.desc("lp"), "token")
    of_key = Window.partitionBy(*keys).orderBy(F.desc("score"), "beam", "place")
    both = lambda a, b: b if a is None else a.unionByName(b)
    for step in range(most_steps):
        if live.isEmpty():
            break
        now = steps.where(F.col("step") == step).select(*keys, F.col("prev").cast("int").alias("prev"), "token", "lp")
        met = live.withColumn("prev", F.element_at("tokens", -1)).join(now, [*keys, "prev"])
        met = met.withColumn("place", F.row_number().over(of_beam)).where(F.col("place") <= beam_size + 1)
        met = met.withColumns({"score": F.col("score") + F.col("lp"), "tokens": F.concat("tokens", F.array(F.col("token").cast("int")))})
        ends = F.col("token") == end
        saved = F.coalesce(F.count_if(~ends).over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = met.withColumns({"saved": saved, "rank": F.row_number().over(of_key)}).where(F.col("saved") < beam_size)
        met = stage(met.select(*keys, F.col("saved").cast("int").alias("beam"), "tokens", "score", ends.alias("ends"), "rank"), "search-step")
        new = met.where("ends").select(*keys, "tokens", "score", F.lit(step).alias("at"), "rank")
        in_order = Window.partitionBy(*keys).orderBy("at", "rank")
        done = stage(both(done, new).withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= most).drop("n"), "search-done")
        # a key whose table ends keeps its beams as they are
        left = both(left, live.join(met.select(*keys).distinct(), keys, "left_anti"))
        full = done.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= most).select(*keys)
        live = stage(met.where("not ends").select(*keys, "beam", "tokens", "score").join(full, keys, "left_anti"), "search-live")
    left = both(left, live)
    forced = left.select(*keys, F.concat("tokens", F.array(F.lit(end))).alias("tokens"), "score", F.lit(most_steps).alias("at"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("beam"))).alias("rank"))
    all_of_them = forced.withColumn("finished", F.lit(False))
    if done is not None:
        all_of_them = done.withColumn("finished", F.lit(True)).unionByName(all_of_them)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("finished"), "at", "rank"))
    return all_of_them.withColumn("n", n).where(F.col("finished") | (F.col("n") <= beam_size)).select(*keys, "tokens", "score", "finished")
