"""Rules on scores of next tokens, beams and their options.  Tokens are whole numbers; those from ``begin`` on are times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scores import log_softmax
from .once import once

NEVER = float("-inf")


def _from(logits: Column, lo: Column | int, hi: Column | int | None = None) -> Column:
    """Minus infinity at places from ``lo`` up to before ``hi``."""
    inside = lambda i: (i >= lo) & (i < hi) if hi is not None else i >= lo
    return F.transform(logits, lambda v, i: F.when(inside(i), F.lit(NEVER)).otherwise(v))


def log_sum(values: Column) -> Column:
    """log of the sum of exponentials; minus infinity of nothing."""

    def of(values: Column, top: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        return F.when(F.coalesce(top, F.lit(NEVER)) == NEVER, F.lit(NEVER)).otherwise(top + F.log(total))

    return once(values, lambda values: once(F.array_max(values), lambda top: of(values, top)))


def time_rules(logits: Column, said: Column, begin: int, end_token: int, no_times: int | None = None, most_first: int | None = None) -> Column:
    """Scores under the rules for times, given the tokens ``said`` so far.

    Times come in pairs, but for one before the end: after two (or a first one) none may
    follow, after one behind a word no word may.  The first token is no later than time
    ``most_first``.  Where all times together are likelier than any other token, only times stay.
    """

    def allowed(said: Column) -> Column:
        n = F.size(said)
        time_at = lambda back: F.coalesce(F.try_element_at(said, F.lit(-back)) >= begin, F.lit(False))
        # from which place to before which the rules leave nothing
        lo = F.when((n >= 1) & time_at(1), F.when((n < 2) | time_at(2), begin).otherwise(0))
        hi = F.when((n < 2) | time_at(2), F.size(logits)).otherwise(end_token)
        first = F.when(n == 0, begin + most_first + 1) if most_first is not None else F.lit(None).cast("int")
        return once(F.struct(lo.alias("lo"), hi.alias("hi"), first.alias("first")), hidden)

    def hidden(at: Column) -> Column:
        never = lambda i: (i == no_times if no_times is not None else F.lit(False)) | ((i >= at["lo"]) & (i < at["hi"])) | (i >= at["first"])
        return F.transform(logits, lambda v, i: F.when(never(i), F.lit(NEVER)).otherwise(v))

    def likelier(z: Column, chance: Column) -> Column:
        times, others = F.slice(chance, begin + 1, F.greatest(F.size(chance) - begin, F.lit(0))), F.slice(chance, 1, begin)
        return F.when(log_sum(times) > F.array_max(others), _from(z, 0, begin)).otherwise(z)

    return once(once(said, allowed), lambda z: once(log_softmax(z), lambda chance: likelier(z, chance)))


def checked_options(beam_size: Column, best_of: Column, temperature: Column, patience: Column, length_penalty: Column) -> Column:
    """True; an error that names the first rule broken.  Null options are not set."""
    rules = [
        (beam_size.isNotNull() & best_of.isNotNull(), "beam_size and best_of exclude each other"),
        ((temperature == 0) & best_of.isNotNull(), "best_of needs a temperature above 0"),
        (patience.isNotNull() & beam_size.isNull(), "patience needs beam_size"),
        (~length_penalty.between(0, 1), "length_penalty lies between 0 and 1"),
    ]
    out = None
    for broken, text in rules:
        error = F.raise_error(F.lit(text)).cast("boolean")
        out = F.when(broken, error) if out is None else out.when(broken, error)
    return out.otherwise(True)


def finished_beams(before: DataFrame, now: DataFrame, keys: list[str], score: str, most: int, tie: list[str]) -> DataFrame:
    """Finished sequences after a step: those there were, then the new ones by falling score, ``most`` a key; ``done`` says whether a key is full."""
    rows = before.withColumn("__new", F.lit(0)).unionByName(now.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("__new", F.when(F.col("__new") == 1, -F.col(score)), *tie)
    kept = rows.withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") <= most) | (F.col("__new") == 0))
    return kept.withColumn("done", F.count("*").over(Window.partitionBy(*keys)) >= most).drop("__new", "__rn")


def most_candidates(beam_size: int, patience: float | None = None) -> int:
    """Finished sequences that end a search."""
    most = round(beam_size * (patience or 1.0))
    if most < 1:
        raise ValueError("beam_size and patience leave no room for a finished sequence")
    return most


def rendered(tokens: Column, begin: int, words: Column) -> Column:
    """The tokens' words (``words`` holds them by place), with times of 0.02 s as <|1.08|>."""
    one = lambda t: F.when(t >= begin, F.concat(F.lit("<|"), F.format_string("%.2f", (t - begin) * 0.02), F.lit("|>"))).otherwise(F.coalesce(F.try_element_at(words, t + 1), F.lit("")))
    return F.array_join(F.transform(tokens, one), "")
