"""Steps that depend on the step before, in a number of rounds that grows with the logarithm of a clip's length.

No clip is ever gathered in one row or walked by one task: cuts that count are found by
pointer doubling, first-order recurrences by a parallel prefix over affine maps.
"""

from __future__ import annotations

from math import log10

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunks
from .stages import stage


def accepted_cuts(df: DataFrame, cut: Column, least: int) -> DataFrame:
    """(clip_id, frame_idx) of the cuts that count: each ``least`` frames or more after the last that counted (at first: frame 0).

    Every cut points to the first cut ``least`` frames on or later.  What counts is what is
    reached from the first cut at ``least`` or later; the set reached doubles its steps each
    round, and so do the pointers, until none is left.
    """
    least = max(1, least)
    cuts = df.where(F.coalesce(cut, F.lit(False)) & (F.col("frame_idx") > 0)).select("clip_id", F.col("frame_idx").cast("long").alias("at")).distinct()
    # the first cut at or after a place: of equal places the cut is the later one in falling order
    asked = lambda at, of: F.struct(at.alias("place"), of.alias("of"))
    none = F.lit(None).cast("long")
    events = cuts.select("clip_id", F.explode(F.array(asked(F.col("at"), none), asked(F.col("at") + least, F.col("at")))).alias("e")).select("clip_id", "e.*")
    begin = cuts.select("clip_id").distinct().select("clip_id", F.lit(least).cast("long").alias("place"), F.lit(-1).cast("long").alias("of"))
    chunk = chunks.chunk_of(chunks.SIZE, "place")
    rows = events.unionByName(begin).withColumns({"chunk": chunk, "cut": F.when(F.col("of").isNull(), F.col("place"))})
    later = Window.partitionBy("clip_id", "chunk").orderBy(F.desc("place"), F.asc_nulls_first("of"))
    rows = rows.withColumn("here", F.min("cut").over(later))
    # beyond the chunk: the first cut of the next chunk that has one, by a window over one row a chunk
    heads = rows.groupBy("clip_id", "chunk").agg(F.min("cut").alias("head"))
    after = Window.partitionBy("clip_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("clip_id", "chunk", F.min("head").over(after).alias("next_head"))
    links = rows.where("of is not null").join(heads, ["clip_id", "chunk"]).select("clip_id", "of", F.coalesce("here", "next_head").alias("to")).where("to is not null")
    links = stage(links, "cuts-links")
    reached = stage(links.where("of = -1").select("clip_id", F.col("to").alias("at")), "cuts-reached")
    jump = links.where("of >= 0")
    while not jump.isEmpty():
        more = reached.join(jump, (reached["clip_id"] == jump["clip_id"]) & (reached["at"] == jump["of"])).select(jump["clip_id"], F.col("to").alias("at"))
        reached = stage(reached.unionByName(more), "cuts-reached")
        on = jump.select("clip_id", F.col("of").alias("to"), F.col("to").alias("onward"))
        jump = stage(jump.join(on, ["clip_id", "to"]).select("clip_id", "of", F.col("onward").alias("to")), "cuts-jump")
    return reached.select("clip_id", F.col("at").cast("int").alias("frame_idx"))


def number_shots(df: DataFrame, cut: Column, least: int, out: str = "shot_no", size: int = chunks.SIZE) -> DataFrame:
    """(clip_id, frame_idx, ``out``): shot numbers from cut flags, by `accepted_cuts`; the numbers are counted chunk by chunk."""
    rows = df.select("clip_id", "frame_idx").withColumn("chunk", chunks.chunk_of(size))
    kept = accepted_cuts(df, cut, least).withColumns({"new": F.lit(1), "chunk": chunks.chunk_of(size)})
    per = kept.groupBy("clip_id", "chunk").agg(F.count("*").alias("n"))
    heads = rows.select("clip_id", "chunk").distinct().join(per, ["clip_id", "chunk"], "left")
    w = Window.partitionBy("clip_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("clip_id", "chunk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inside = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy("clip_id", "chunk").orderBy("frame_idx"))
    met = rows.join(kept, ["clip_id", "chunk", "frame_idx"], "left").withColumn("inside", inside).join(heads, ["clip_id", "chunk"])
    return met.select("clip_id", "frame_idx", (F.col("before") + F.col("inside")).cast("int").alias(out))


def recurrence(df: DataFrame, value: str, k: float, out: str = "restored", part: int = 64, size: int = chunks.SIZE) -> DataFrame:
    """(clip_id, frame_idx, ``out``): y[t] = value[t] + k * y[t - 1] over the frames of a clip; a null value counts as 0.

    Parts of ``part`` frames are summed from nothing by a window.  A part hands on the affine
    map y -> k ** n * y + end; the maps of all parts before are composed in rounds, each
    with what stands 1, 2, 4, ... parts before.
    """
    rows = chunks.placed(df.select("clip_id", "frame_idx", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")), size, out="at")
    if k == 0:
        return rows.select("clip_id", "frame_idx", F.col("x").alias(out))
    if abs(k) != 1:  # a part's powers of k stay far from what doubles can hold
        part = max(1, min(part, int(150 / abs(log10(abs(k))))))
    rows = rows.withColumns({"p": F.floor(F.col("at") / part), "i": F.col("at") % part})
    step = F.pow(F.lit(float(k)), F.col("i").cast("double"))
    own = F.sum(F.col("x") / step).over(Window.partitionBy("clip_id", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) * step
    rows = stage(rows.withColumn("own", own).drop("x"), "recurrence-parts")
    maps = rows.groupBy("clip_id", "p").agg(F.pow(F.lit(float(k)), F.count("*").cast("double")).alias("a"), F.max_by("own", "i").alias("b"))
    most = maps.agg(F.max("p").alias("p")).first()["p"] or 0
    maps, far = stage(maps, "recurrence-maps"), 1
    while far <= most:
        earlier = maps.select("clip_id", (F.col("p") + far).alias("p"), F.col("a").alias("a0"), F.col("b").alias("b0"))
        met = maps.join(earlier, ["clip_id", "p"], "left")
        maps = stage(met.select("clip_id", "p", F.coalesce(F.col("a") * F.col("a0"), "a").alias("a"), F.coalesce(F.col("a") * F.col("b0") + F.col("b"), "b").alias("b")), "recurrence-maps")
        far *= 2
    carry = maps.select("clip_id", (F.col("p") + 1).alias("p"), F.col("b").alias("carry"))
    met = rows.join(carry, ["clip_id", "p"], "left")
    return met.select("clip_id", "frame_idx", (F.col("own") + F.coalesce("carry", F.lit(0.0)) * step * k).alias(out))
