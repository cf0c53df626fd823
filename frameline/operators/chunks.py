"""Long clips in chunks: windows with copied margins, runs put together over chunk edges, places counted chunk by chunk.

A window over a whole clip is sorted and walked by one task.  Here a clip is cut into
chunks of ``size`` frame numbers; what an operator needs of its neighbours is copied into
the chunk as a margin and left out of the result, so the task of a clip of any length
holds one chunk.  Frames are numbered without gaps, as operators over rows expect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import stage

#: Frames a chunk.
SIZE = 4096
CLIP = ("clip_id",)


def chunk_of(size: int, frame: Column | str = "frame_idx") -> Column:
    return F.floor((F.col(frame) if isinstance(frame, str) else frame) / F.lit(size)).cast("long")


def with_margins(df: DataFrame, radius: int, size: int = SIZE) -> DataFrame:
    """Adds ``chunk`` and ``own``: every row stands in its own chunk, and as a margin in those that begin or end within ``radius`` frames."""
    if radius < 0 or size < 1:
        raise ValueError("the radius must not be negative, and the size positive")
    at = F.col("frame_idx")
    inner = F.pmod(at, F.lit(size)).between(radius, size - 1 - radius)
    near = F.when(inner, F.array(chunk_of(size))).otherwise(F.sequence(chunk_of(size, at - radius), chunk_of(size, at + radius)))
    return df.withColumn("chunk", F.explode(near)).withColumn("own", F.col("chunk") == chunk_of(size))


def by_chunks(df: DataFrame, radius: int, op: Callable[[DataFrame, tuple[str, ...]], DataFrame], size: int = SIZE, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """``op`` of the whole table, run chunk by chunk.

    ``op`` takes a table and the names that its windows may not cross, looks at most
    ``radius`` frames to either side, and keeps the rows and the columns it is given.
    """
    return op(with_margins(df, radius, size), (*keys, "chunk")).where("own").drop("chunk", "own")


def true_runs(df: DataFrame, flag: Column, size: int = SIZE, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """(keys, start_frame, end_frame, n_frames) of the runs of true frames.

    Runs are found inside each chunk.  Only those that touch an edge of their chunk, two a
    chunk at most, may go on in the next one; they are put together by a window over them alone.
    """
    rows = df.where(flag).select(*keys, "frame_idx", chunk_of(size).alias("chunk"))
    island = F.col("frame_idx") - F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("frame_idx"))
    parts = rows.withColumn("island", island).groupBy(*keys, "chunk", "island").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n_frames")).drop("island")
    out = [*keys, "start_frame", "end_frame", "n_frames"]
    first, last = F.col("chunk") * size, (F.col("chunk") + 1) * size - 1
    edge = (F.col("start_frame") == first) | (F.col("end_frame") == last)
    w = Window.partitionBy(*keys).orderBy("start_frame")
    begins = F.coalesce(F.lag("end_frame").over(w) + 1 != F.col("start_frame"), F.lit(True))
    edges = parts.where(edge).withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(w))
    joined = edges.groupBy(*keys, "run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.sum("n_frames").alias("n_frames"))
    return parts.where(~edge).select(*out).unionByName(joined.select(*out))


def placed(df: DataFrame, size: int = SIZE, keys: tuple[str, ...] = CLIP, out: str = "place") -> DataFrame:
    """Adds the row's place (from 0) among those of its keys by frame, gaps or not: the rows of earlier chunks and the place in its own."""
    rows = df.withColumn("__chunk", chunk_of(size))
    n = rows.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy("frame_idx")) - 1
    met = rows.join(n.select(*keys, "__chunk", before.alias("__before")), [*keys, "__chunk"])
    return met.withColumn(out, F.col("__before") + inside).drop("__chunk", "__before")


def in_order(df: DataFrame, by: list[Column], out: str = "place", parts: int | None = None) -> DataFrame:
    """Adds the row's place (from 1) in the order ``by`` of the whole table: ranges are sorted each on their own and counted on."""
    ranges = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = stage(ranges.sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__i": inside}), "in-order")
    n = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return rows.join(n.select("__part", before.alias("__before")), "__part").withColumn(out, F.col("__before") + F.col("__i") + 1).drop("__part", "__i", "__before")
