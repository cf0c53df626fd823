"""Centred windows, filling, interpolation and ramps over frames; null scores are not sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..functions.once import once
from .runs import SHOT

BOX = ("x1", "y1", "x2", "y2")


def around(radius: int, keys=SHOT):
    return Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-radius, radius)


def temporal_max(df: DataFrame, value: str, radius: int = 2, keys=SHOT, out: str = "open_max") -> DataFrame:
    """Largest value around each frame that has one itself."""
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.max(value).over(around(radius, keys))))


def centred_mean(df: DataFrame, value: str, radius: int = 2, keys=("clip_id",), out: str = "mean") -> DataFrame:
    return df.withColumn(out, F.avg(value).over(around(radius, keys)))


def open_presence(df: DataFrame, value: str, threshold: float, radius: int, keys=SHOT, out: str = "present") -> DataFrame:
    """Mean around the frame reaches the threshold, over two samples at least."""
    w = around(radius, keys)
    return df.withColumn(out, F.coalesce((F.count(value).over(w) >= 2) & (F.avg(value).over(w) >= threshold), F.lit(False)))


def invalidate_unstable(df: DataFrame, value: str = "open_prob", least_iou: float = 0.35, out: str = "stable_prob") -> DataFrame:
    """Null beside a cut and on both sides of a jump of the box between adjacent frames of a clip."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    before = [F.lag(c).over(w) for c in BOX]
    cut = F.coalesce(F.lag("shot_id").over(w) != F.col("shot_id"), F.lit(False))
    jump = F.col("x1").isNotNull() & before[0].isNotNull() & (iou(box(), before) < least_iou)
    rows = df.withColumn("__cut", cut).withColumn("__jump", F.coalesce(jump, F.lit(False)))
    near_cut = F.max("__cut").over(w.rowsBetween(-1, 1))
    near_jump = F.col("__jump") | F.coalesce(F.lead("__jump").over(w), F.lit(False))
    return rows.withColumn(out, F.when(near_cut | near_jump, F.lit(None)).otherwise(F.col(value))).drop("__cut", "__jump")


def motion_gate(df: DataFrame, radius: int = 4, open_thr: float = 0.15, act_thr: float = 0.12, soft_mean: float = 0.75, soft_act: float = 0.05, mar_thr: float = 0.04, same_iou: float = 0.5, keys=SHOT) -> DataFrame:
    """Adds activity, mean_open, mar_activity and motion: lip motion around a frame, over neighbours whose box is the same face's.

    The neighbours' rows are gathered over the window (2 * radius + 1 at most), as which of them count depends on the frame's own box.
    """
    near = F.collect_list(F.struct("open_prob", "mar", *BOX)).over(around(radius, keys))
    rows = df.withColumn("__near", near)

    def same(s: Column) -> Column:
        return s["open_prob"].isNotNull() & (iou(box(), [s[c] for c in BOX]) >= same_iou)

    def mean_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)

    def deviation(a: Column, mean: Column) -> Column:
        square = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        return F.when(F.size(a) >= 3, F.sqrt(square / F.size(a))).otherwise(0.0)

    def measured(opens: Column, mars: Column) -> Column:
        """activity, mean_open, mar_activity and motion of one frame."""
        spread = lambda a: once(mean_of(a), lambda mean: F.round(deviation(a, mean), 9))
        mean = F.round(F.when(F.size(opens) >= 3, mean_of(opens)).otherwise(0.0), 9)
        return once(F.struct(spread(opens).alias("activity"), mean.alias("mean_open"), spread(mars).alias("mar_activity")), moving)

    def moving(m: Column) -> Column:
        act, mean = m["activity"], m["mean_open"]
        soft = (act >= max(1e-4, soft_act)) | (F.lit(mar_thr > 0) & (m["mar_activity"] >= mar_thr))
        hard = (act >= act_thr) & (mean >= act_thr)
        moves = F.when(F.lit(soft_mean > 0) & (mean >= soft_mean), soft).otherwise(hard)
        motion = F.coalesce((F.col("open_prob") >= open_thr) & moves, F.lit(False))
        return F.struct(act.alias("activity"), mean.alias("mean_open"), m["mar_activity"].alias("mar_activity"), motion.alias("motion"))

    def of_same(s: Column) -> Column:
        mars = F.filter(F.transform(s, lambda r: r["mar"]), lambda v: v.isNotNull())
        return once(F.transform(s, lambda r: r["open_prob"]), lambda opens: once(mars, lambda mars: measured(opens, mars)))

    # one expression whose parts are bound: a condition on ``motion`` that is pushed down repeats it once, not each part in each other
    own = F.col("open_prob").isNotNull() & F.col("x1").isNotNull()
    rows = rows.withColumn("__m", F.when(own, once(F.filter("__near", same), of_same)))
    rows = rows.withColumns({c: F.col("__m")[c] for c in ("activity", "mean_open", "mar_activity")})
    return rows.withColumn("motion", F.coalesce(F.col("__m")["motion"], F.lit(False))).drop("__near", "__m")


def active_track(tracks: DataFrame, radius: int = 4) -> DataFrame:
    """clip_id, frame_idx, track_id with the strongest motion around the frame, then the widest mean, then the widest now, then the first track.

    The window is over frame numbers, as a track may miss frames.
    """
    w = Window.partitionBy("clip_id", "shot_id", "track_id").orderBy("frame_idx").rangeBetween(-radius, radius)
    n = F.count("open_prob").over(w)
    rows = tracks.withColumn("__n", n).where("__n > 0")
    rows = rows.withColumn("act", F.when(F.col("__n") >= 2, F.round(F.stddev_pop("open_prob").over(w), 9)).otherwise(0.0)).withColumn("mean", F.round(F.avg("open_prob").over(w), 9))
    best = Window.partitionBy("clip_id", "frame_idx").orderBy(F.desc("act"), F.desc("mean"), F.desc(F.coalesce("open_prob", F.lit(0.0))), "track_id")
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("clip_id", "frame_idx", "track_id")


def fill(df: DataFrame, columns: list[str], keys=("clip_id",)) -> DataFrame:
    """Last known value; before the first, the first known one."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(ahead)) for c in columns})


def _between_keys(df: DataFrame, key_frame: Column, columns: list[str], keys) -> tuple[DataFrame, Column, Column]:
    """``df`` with the key frames before and after each row, as structs of frame number ``i`` and ``columns``."""
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    rows = df.withColumn("__k", F.when(key_frame, F.struct(F.col("frame_idx").alias("i"), *columns)))
    rows = rows.withColumn("__a", F.last("__k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first("__k", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return rows.drop("__k"), F.coalesce("__a", "__b"), F.coalesce("__b", "__a")


def interpolate_boxes(df: DataFrame, key_frame: Column, least_iou: float = 0.15, keys=("clip_id",)) -> DataFrame:
    """Boxes between key frames, rounded: linear, but the nearer key's where the keys' boxes overlap less than ``least_iou`` or one has none."""
    rows, a, b = _between_keys(df, key_frame, list(BOX), keys)
    t = F.when(b["i"] > a["i"], (F.col("frame_idx") - a["i"]) / (b["i"] - a["i"])).otherwise(0.0)
    blend = a["x1"].isNotNull() & b["x1"].isNotNull() & (iou([a[c] for c in BOX], [b[c] for c in BOX]) >= least_iou)
    out = {f"__{c}": F.when(blend, F.bround(a[c] + (b[c] - a[c]) * t)).when(t < 0.5, a[c]).otherwise(b[c]) for c in BOX}
    return rows.withColumns(out).drop(*BOX, "__a", "__b").withColumnsRenamed({f"__{c}": c for c in BOX})


def interpolate_mouths(df: DataFrame, key_frame: Column, mouth: str = "m", least_iou: float = 0.15, keys=("clip_id",)) -> DataFrame:
    """Mouth boxes (``mouth`` before the names of the box) between the key frames that have one, linear and not rounded.

    Where the keys' *face* boxes overlap less than ``least_iou``, the mouth steps: the earlier
    key's up to and with the whole middle frame, then the later one's.  A missing face does
    not step.  Outside the keys the nearest key's box stands.
    """
    own = [f"{mouth}{c}" for c in BOX]
    rows, a, b = _between_keys(df, key_frame & F.col(own[0]).isNotNull(), [*own, *BOX], keys)
    span = b["i"] - a["i"]
    apart = F.coalesce(a["x1"].isNotNull() & b["x1"].isNotNull() & (iou([a[c] for c in BOX], [b[c] for c in BOX]) < least_iou), F.lit(False))
    t = F.when(span > 0, (F.col("frame_idx") - a["i"]) / span).otherwise(0.0)
    early = F.col("frame_idx") <= a["i"] + F.floor(span / 2)
    out = {f"__{c}": F.when(F.col("frame_idx") == b["i"], b[c]).when(apart, F.when(early, a[c]).otherwise(b[c])).otherwise(a[c] + (b[c] - a[c]) * t) for c in own}
    return rows.withColumns(out).drop(*own, "__a", "__b").withColumnsRenamed({f"__{c}": c for c in own})


def ramp(df: DataFrame, flag: Column, frames: int = 5, keys=("clip_id",), out: str = "alpha") -> DataFrame:
    """Opacity in runs of true frames: up over the first ``frames``, down over the last, half the run at most."""
    rows = df.withColumn("__on", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("__r", F.col("frame_idx") - F.row_number().over(Window.partitionBy(*keys, "__on").orderBy("frame_idx")))
    run = Window.partitionBy(*keys, "__on", "__r")
    i, n = F.row_number().over(run.orderBy("frame_idx")), F.count("*").over(run)
    eff = F.least(F.lit(max(1, frames)), F.greatest(F.lit(1), F.floor(n / 2)))
    edge = F.least(F.lit(1.0), i / eff, (n - i + 1) / eff)
    value = F.when(~F.col("__on"), 0.0).when((n <= 1) | F.lit(frames <= 0), 1.0).otherwise(edge)
    return rows.withColumn(out, value).drop("__on", "__r")


def context_window(df: DataFrame, value: str, before: int, after: int, clamp: bool = False, keys=("clip_id",)) -> DataFrame:
    """(keys, frame_idx, at, value) around each frame: 0 outside the clip, or the edge's value if ``clamp``."""
    ends = df.groupBy(*keys).agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    steps = df.select(*keys, "frame_idx", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("at")).join(ends, list(keys))
    source = F.col("frame_idx") + F.col("at")
    steps = steps.withColumn("src", F.least(F.greatest(source, F.col("lo")), F.col("hi")) if clamp else source)
    values = df.select(*keys, F.col("frame_idx").alias("src"), F.col(value).alias("value"))
    return steps.join(values, [*keys, "src"], "left").select(*keys, "frame_idx", "at", F.coalesce("value", F.lit(0.0)).alias("value"))


def pre_emphasis(df: DataFrame, value: str, k: float = 0.97, keys=("clip_id",), out: str = "emphasised") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("frame_idx"))
    return df.withColumn(out, F.col(value) - k * F.coalesce(before, F.lit(0.0)))
