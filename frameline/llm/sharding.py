"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded hash inside each stratum (a source) and ranked; row r
of a stratum of n rows stands at (r - phase) / n, where the stratum's phase lies between
0 and 1, by a hash of its name: many strata of one row thus spread over the whole order
instead of meeting at its middle.  Sorted by that fractional rank, all strata are
interleaved in proportion, so cutting the order into equal runs gives every shard the
mixture of the whole.  Law: ``rows`` (counts at most one apart).

No stratum is ever ranked in one task.  The hash's range is cut into ``cells``; a row's
rank is the number of its stratum's rows in earlier cells plus its place in its own
cell.  The same is done once more for the fractional ranks, which are evenly spread
by their definition.  Only the columns handed in are moved, and the ranked rows are
written once to the shared folder.

Defined results: a null stratum is a stratum of its own; a null text has size 8; ties
of the hash go to the smaller key, and rows that are equal in all columns are
interchangeable (they share one cell); an empty table gives an empty result; fewer rows than shards leave
shards empty; columns of the input are kept, and a new column whose name is taken
raises ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells of the hash's range and of the fractional ranks.
CELLS = 2048


def _before(counts: DataFrame, by: list[str], cell: str, n: str, out: str) -> DataFrame:
    """Adds the sum of ``n`` over the earlier cells."""
    w = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def interleave(df: DataFrame, key: str, stratum: str, shards: int, seed: int = 42, cells: int = CELLS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Adds ``shard_col`` (0 to ``shards`` - 1) and ``slot_col`` (gapless from 0 in each shard) to all rows."""
    if clash := {c.lower() for c in df.columns} & {shard_col.lower(), slot_col.lower()}:
        raise ValueError(f"column names taken: {sorted(clash)}")
    if shards < 1:
        raise ValueError("shards must be positive")
    own = [common.col(c) for c in df.columns]
    name, mix, cell, n, at, rank, of, frac, place = (common.free_name(df, f"__{x}") for x in ("stratum", "mix", "cell", "n", "at", "rank", "of", "frac", "place"))
    text = common.col(stratum).cast("string")
    # all columns, so that rows without a key, or of one key, spread too; maps have no hash
    mixed = F.xxhash64(F.lit(seed), common.col(key), *common.hashable(df))
    in_cell = F.pmod(F.shiftrightunsigned(mixed, 40), F.lit(cells)).cast("int")
    rows = df.select(*own, F.coalesce(F.concat(F.lit("="), text), F.lit("")).alias(name), mixed.alias(mix), in_cell.alias(cell))

    counts = rows.groupBy(name, cell).agg(F.count("*").alias(n))
    offsets = _before(counts, [name], cell, n, at).withColumn(of, F.sum(n).over(Window.partitionBy(name))).drop(n)
    inside = F.row_number().over(Window.partitionBy(name, cell).orderBy(mix, common.col(key)))
    ranked = rows.join(offsets, [name, cell]).withColumn(rank, F.col(at) + inside)
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), F.col(name)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    ranked = ranked.withColumn(frac, (F.col(rank) - phase) / F.col(of)).drop(cell, at, rank, of)
    # written once: the counts and the places below read the same ranks
    ranked = common.stage(ranked.withColumn(cell, F.floor(F.col(frac) * cells).cast("int")), "sharding-ranked")

    counts = ranked.groupBy(cell).agg(F.count("*").alias(n))
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    # at most ``cells`` rows, whatever the input
    offsets = F.broadcast(_before(counts, [], cell, n, at).drop(n))
    inside = F.row_number().over(Window.partitionBy(cell).orderBy(frac, name, mix, common.col(key)))
    placed = ranked.join(offsets, cell).withColumn(place, F.col(at) + inside - 1)
    shard = F.expr(f"(`{place}` * {shards}) div {max(total, 1)}")
    # the first place of shard s is the smallest p with p * shards >= s * total
    first = F.expr(f"(`{shard_col}` * {total} + {shards - 1}) div {shards}")
    return placed.withColumn(shard_col, shard.cast("int")).withColumn(slot_col, F.col(place) - first).select(*own, shard_col, slot_col)


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def op2_sharding(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    text = F.col("text")
    narrow = docs.select("doc_id", "source", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    done = interleave(narrow, "doc_id", "source", shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
