"""Runs of true frames: finding, filtering, growing.  ``keys`` name what a run may not cross; rows are frames in ``frame_idx`` order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOT = ("clip_id", "shot_id")


def _island(flag: Column, keys) -> Column:
    """Equal within a run: the frame less its rank among the true frames of its keys."""
    return F.col("frame_idx") - F.row_number().over(Window.partitionBy(*keys, flag).orderBy("frame_idx"))


def true_runs(df: DataFrame, flag: Column, keys=SHOT) -> DataFrame:
    """(keys, start_frame, end_frame, n_frames), both ends inclusive."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    rows = df.where(flag).select(*keys, "frame_idx", (F.col("frame_idx") - F.row_number().over(w)).alias("island"))
    return rows.groupBy(*keys, "island").agg(F.min("frame_idx").alias("start_frame"), F.max("frame_idx").alias("end_frame"), F.count("*").alias("n_frames")).drop("island")


def consecutive_runs(df: DataFrame, value: str, keys=("clip_id",)) -> DataFrame:
    """Runs of integers that grow by one; a repeated integer starts a new run."""
    w = Window.partitionBy(*keys).orderBy(value)
    starts = F.lag(value).over(w).isNull() | (F.lag(value).over(w) + 1 != F.col(value))
    rows = df.select(*keys, value, F.when(starts, 1).otherwise(0).alias("starts"))
    ordered = Window.partitionBy(*keys).orderBy(value, "starts")  # of equal integers, the one that goes on first
    rows = rows.withColumn("run", F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "run").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("run")


def keep_runs(df: DataFrame, flag: Column, least: int, keys=SHOT, out: str = "kept") -> DataFrame:
    """Adds ``out``: true in runs of at least ``least`` frames."""
    rows = df.withColumn("__flag", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("__island", _island(F.col("__flag"), keys))
    n = F.count("*").over(Window.partitionBy(*keys, "__flag", "__island"))
    return rows.withColumn(out, F.col("__flag") & (n >= least)).drop("__flag", "__island")


def frames_of(seconds: float, fps: float) -> int:
    """Whole frames of a duration, half to even, at least one."""
    return max(1, round(seconds * fps))


def prune_short(df: DataFrame, flag: Column, seconds: float, fps: float, keys=SHOT, out: str = "kept") -> DataFrame:
    return keep_runs(df, flag, frames_of(seconds, fps), keys, out)


def dilate(df: DataFrame, flag: Column, radius: int, valid: Column | None = None, keys=SHOT, out: str = "dilated") -> DataFrame:
    """True within ``radius`` rows of a true frame of the same keys; frames that are not valid stay false."""
    near = F.max(F.coalesce(flag, F.lit(False))).over(Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-radius, radius))
    return df.withColumn(out, near if valid is None else near & valid)


def shot_ranges(df: DataFrame, keys=SHOT) -> DataFrame:
    """(keys, first_frame, end_excl, n_frames)."""
    return df.groupBy(*keys).agg(F.min("frame_idx").alias("first_frame"), (F.max("frame_idx") + 1).alias("end_excl"), F.count("*").alias("n_frames"))


def expand_to_shots(df: DataFrame, flag: Column, fps: float, least: float = 0.0, short_shot: float = 0.0, short_least: float | None = None, partial: float = 0.5, keys=SHOT, out: str = "speaking") -> DataFrame:
    """Fills shots whose longest run reaches ``least`` seconds (``short_least`` in shots under ``short_shot``); in others runs of ``partial`` seconds stay."""
    on = F.coalesce(flag, F.lit(False))
    rows = df.withColumn("__flag", on)
    rows = rows.withColumn("__island", _island(F.col("__flag"), keys))
    run = F.when(F.col("__flag"), F.count("*").over(Window.partitionBy(*keys, "__flag", "__island"))).otherwise(0)
    rows = rows.withColumn("__run", run)
    shot = Window.partitionBy(*keys)
    need = F.lit(frames_of(least, fps) if least > 0 else 1)
    if short_shot > 0 and short_least is not None:
        need = F.when(F.count("*").over(shot) < frames_of(short_shot, fps), frames_of(short_least, fps) if short_least > 0 else 1).otherwise(need)
    whole = F.max("__run").over(shot) >= need
    some = (F.col("__run") >= frames_of(partial, fps)) if partial > 0 else F.lit(False)
    return rows.withColumn(out, whole | some).drop("__flag", "__island", "__run")


def speaking_frames(df: DataFrame, motion: Column, present: Column, speech: DataFrame) -> DataFrame:
    """Frames with lip motion on which the primary face is present and ``speech`` (clip_id, frame_idx) says that someone speaks."""
    return df.where(motion & present).join(speech.select("clip_id", "frame_idx"), ["clip_id", "frame_idx"], "left_semi")
