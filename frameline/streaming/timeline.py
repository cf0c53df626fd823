"""Timeline operators on streams: windowed totals with late rows, shot numbers with carried state.  Face tracks are in `faces`, sinks in `sinks`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """Stream of the event files that arrive in a folder; the schema is that of the files already there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def window_totals(events: DataFrame, length: str = "10 minutes", late: str = "1 hour", threshold: float = 15.0) -> DataFrame:
    """Events and open ones by clip and time window; rows later than ``late`` are left out, as the state is bounded by it."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    sums = rows.groupBy(F.window("at", length), F.col("user_id").alias("clip_id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") >= threshold).alias("n_open"))
    return sums.select("clip_id", F.col("window.start").alias("start"), "n", "n_open")


def number_shots(frames: DataFrame, cut: Column, least: int, idle: str | None = None) -> DataFrame:
    """Shot numbers of frames that arrive in order by clip; a clip's state is two numbers.

    A cut counts only ``least`` frames after the last one that counted, across micro-batches.
    With ``idle`` (a length of time) a clip's state goes when no frame has come for that long;
    a clip that goes on after that begins with shot 0 again.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, at = state.get if state.exists else (0, 0)
        g = pd.concat(parts).sort_values("frame_idx")
        out = []
        for i, c in zip(g["frame_idx"], g["cut"]):
            if i > 0 and c and i - at >= least:
                now, at = now + 1, int(i)
            out.append(now)
        state.update((now, at))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame({"clip_id": g["clip_id"], "frame_idx": g["frame_idx"], "shot_no": out})

    rows = frames.select("clip_id", "frame_idx", F.coalesce(cut, F.lit(False)).alias("cut"))
    kind = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("clip_id").applyInPandasWithState(run, "clip_id bigint, frame_idx int, shot_no int", "now int, at int", "append", kind)
