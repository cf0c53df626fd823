"""Choosing and resampling rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_to(rows: DataFrame, anchors: DataFrame, group: str, id_col: str, distance, k: int, farthest: bool = False) -> DataFrame:
    """The ``k`` rows nearest to their group's anchor, without the anchor's rank 0; or the ``k`` farthest.

    ``anchors`` holds one row a group (``group``, ``anchor_id``, ``anchor``), so this is one pass over the rows.
    The limit stands on the row number itself, so that every task keeps its own best before the shuffle.
    """
    met = rows.join(anchors, group).withColumn("dist", distance)
    w = Window.partitionBy(group).orderBy(F.desc("dist") if farthest else F.col("dist"), id_col)
    skip = 0 if farthest else 1
    ranked = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + skip)
    return ranked.withColumn("rank", F.col("rank") - skip).where("rank >= 1")


#: What a reference frame is chosen by: columns and whether large values come first; the smallest pose is the frame itself.
REFERENCES = {
    "random": (),
    "pose_similarity": (("pose", False),),
    "pose_similarity_and_closed_mouth": (("pose", False), ("shut", False)),
    "pose_similarity_and_mouth_dissimilarity": (("pose", False), ("mouth", True)),
}


def reference_frames(rows: DataFrame, method: str, share: float, keys: list[str], drive: str, at: str = "frame_idx", reach: int = 25, apart: int = 5) -> DataFrame:
    """The frames that may serve as reference for the frame ``drive``: within the given share of the clip's frames by each of the method's columns, ``apart`` frames or more away; without a column, up to ``reach`` frames away."""
    if method not in REFERENCES:
        raise ValueError(f"unknown method: {method}")
    away = F.abs(F.col(at) - F.col(drive))
    if not REFERENCES[method]:
        return rows.where((away <= reach) & (away >= apart))
    most = F.floor(F.count("*").over(Window.partitionBy(*keys)) * share)
    marks, fine = {"__most": most}, F.lit(True)
    for column, falling in REFERENCES[method]:
        w = Window.partitionBy(*keys).orderBy(F.desc(column) if falling else F.col(column), at)
        skip = 1 if column == "pose" else 0
        marks[f"__{column}"] = F.row_number().over(w) - skip
        fine = fine & F.col(f"__{column}").between(1, F.col("__most"))
    return rows.withColumns(marks).where(fine & (away >= apart)).drop(*marks)


def eligible_clips(rows: DataFrame, points_col: str, width_col: str, least_frames: int, least_share: float, points: int, least_width: float, key: str = "clip_id") -> DataFrame:
    """Clips with enough frames, landmarks of the right number on enough of them, and a first face that is wide enough."""
    there = F.col(points_col).isNotNull()
    seen = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(there).alias("with_points"),
        F.count_if(there & (F.size(points_col) != points)).alias("odd"),
        F.min_by(width_col, F.when(there, F.col("frame_idx"))).alias("width"),
    )
    return seen.where((F.col("n") >= least_frames) & (F.col("with_points") >= least_share * F.col("n")) & (F.col("odd") == 0) & (F.col("width") >= least_width))


def newest(df: DataFrame, keys: list[str], step: str, keep: int) -> DataFrame:
    """The ``keep`` rows of each key with the largest step."""
    w = Window.partitionBy(*keys).orderBy(F.desc(step))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep).drop("rn")


def length_penalised_best(df: DataFrame, keys: list[str], log_prob: str, length: str, alpha: float | None = None, tie: str = "id") -> DataFrame:
    """The best candidate of each key by log-probability over a length penalty: the length, or ((5 + length) / 6) ** alpha."""
    penalty = F.col(length) if alpha is None else F.pow((F.col(length) + 5) / 6, F.lit(alpha))
    scored = df.withColumn("rank_score", F.col(log_prob) / penalty)
    w = Window.partitionBy(*keys).orderBy(F.desc("rank_score"), tie)
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def seeded_pick(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in a fixed pseudo-random order of their key: that of a digest of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def window_from(start: Column, length: int) -> Column:
    return F.sequence(start, start + (length - 1))


def source_frames(clips: DataFrame, target_fps: float) -> DataFrame:
    """clip_id, out_frame, src_frame: the nearest source frame of each frame at the target rate."""
    n_out = F.greatest(F.lit(1), F.bround(F.col("n_frames") / F.col("fps") * target_fps).cast("int"))
    rows = clips.where("n_frames > 0").withColumn("out_frame", F.explode(F.sequence(F.lit(0), n_out - 1)))
    src = F.least(F.col("n_frames") - 1, F.bround(F.col("out_frame") * F.col("fps") / target_fps).cast("int"))
    return rows.select("clip_id", "out_frame", src.alias("src_frame"))


def first_at_or_after(clips: DataFrame, target_fps: float) -> DataFrame:
    """clip_id, out_frame, src_frame: the first source frame not before each output time."""
    n_out = F.floor(F.col("n_frames") / F.col("fps") * target_fps).cast("int")
    rows = clips.withColumn("n_out", n_out).where("n_out > 0").withColumn("out_frame", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)))
    src = F.ceil(F.col("out_frame") * F.col("fps") / target_fps - 1e-9).cast("int")
    return rows.select("clip_id", "out_frame", src.alias("src_frame")).where(F.col("src_frame").isNotNull())


def cyclic_pairs(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, n: str, delay: int = 0) -> DataFrame:
    """Each left row with the right row at (left_at + delay) mod n of its key."""
    return left.withColumn("__at", F.pmod(F.col(left_at) + delay, F.col(n))).join(right.withColumnRenamed(right_at, "__at"), [key, "__at"]).withColumnRenamed("__at", right_at)


def boomerang(df: DataFrame, n: str, at: str = "frame_idx") -> DataFrame:
    """The frames, then the frames backwards: 2n rows a clip."""
    return df.unionByName(df.withColumn(at, (2 * F.col(n) - 1 - F.col(at)).cast("int")))


def pad_or_trim(values: Column, n: int) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def beam_step(beams: DataFrame, key: str, beam: str, total: str, log_probs: str, size: int, end_token: int) -> DataFrame:
    """(key, beam, token, score, finished): one step of a beam search over given log-probabilities.

    Each beam offers its ``size`` + 1 best tokens; of all offers, by falling score, those are
    taken that come before ``size`` unfinished ones are full.
    """
    offers = beams.select(key, beam, total, F.posexplode(log_probs).alias("token", "lp"))
    own = Window.partitionBy(key, beam).orderBy(F.desc("lp"), "token")
    offers = offers.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= size + 1).withColumn("score", F.col(total) + F.col("lp"))
    all_beams = Window.partitionBy(key).orderBy(F.desc("score"), beam, "token")
    unfinished = F.sum((F.col("token") != end_token).cast("int")).over(all_beams.rowsBetween(Window.unboundedPreceding, -1))
    taken = offers.withColumn("before", F.coalesce(unfinished, F.lit(0))).where(F.col("before") < size)
    return taken.select(key, beam, "token", "score", (F.col("token") == end_token).alias("finished"))


def ordered_values(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One array of ``value`` a key, in the given order; a key's values must fit in a row."""
    gathered = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*keys).agg(F.transform(gathered, lambda s: s["__v"]).alias(value))


def score_at(scores: Column, frame: Column, fps: float, score_fps: float) -> Column:
    """The score of a frame: the nearest one in time, the last one beyond the end; at equal rates its own, and minus infinity beyond the end.  Without scores minus infinity."""
    if abs(fps - score_fps) < 1e-6:
        at = frame
    else:
        at = F.least(F.greatest(F.bround(frame * score_fps / fps).cast("int"), F.lit(0)), F.size(scores) - 1)
    return F.coalesce(F.when(F.size(scores) > 0, F.try_element_at(scores, (at + 1).cast("int"))), F.lit(float("-inf")))


def mean_of_passes(scores: list[Column]) -> Column:
    """Mean of a row's scores to one decimal, half to even; nulls and values without end do not count, and without any other it is minus infinity.  The scores are added in the given order, so that ties of the rounding fall alike in every run."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) for c in scores]
    total, n = F.lit(0.0), F.lit(0)
    for c in finite:
        total, n = total + F.coalesce(c, F.lit(0.0)), n + c.isNotNull().cast("int")
    return F.when(n > 0, F.bround(total / n * 10) / 10).otherwise(float("-inf"))


def mean_of_window(value: str, length: int, keys: list[str], at: str = "frame_idx") -> Column:
    """Mean of ``value`` over the row's stretch of ``length`` places of its key, added in order of places; nulls do not count."""
    stretch = Window.partitionBy(*keys, F.floor(F.col(at) / length)).orderBy(at)
    return F.avg(value).over(stretch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def drawn_start(n: Column, length: int, draw: Column) -> Column:
    """A start from 0 to ``n - length`` for a draw from 0 up to 1."""
    return F.least(((n - length + 1) * draw).cast("int"), n - length)


def in_batches(df: DataFrame, keys: list[str], order: list[str], size: int, out: str = "batch") -> DataFrame:
    """Numbers the rows of each key in batches of ``size``, in order; the last one may be shorter."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(out, F.floor(at / size).cast("int"))
