"""Order-dependent box operators: suppression, tracking, cuts, reuse of restored faces.

What can be folded over a bounded array, as suppression in a frame, is a built-in expression;
trackers, in `tracking`, take a clip's frames one by one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..functions.once import once

BOX = ["x1", "y1", "x2", "y2"]


def pair_iou(a: np.ndarray, b: np.ndarray, pixel: float = 0.0, slack: float = 0.0) -> np.ndarray:
    """IoU of every box of ``a`` with every one of ``b``; ``pixel`` is added to sides (1 counts whole pixels), ``slack`` to the union."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]) + pixel
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]) + pixel
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    size = lambda x: np.maximum(x[:, 2] - x[:, 0] + pixel, 0) * np.maximum(x[:, 3] - x[:, 1] + pixel, 0)
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.where(union > 0, inter / np.where(union > 0, union + slack, 1), 0.0)


def suppress(df: DataFrame, threshold: float, keys: list[str], score: str = "score", pixel: float = 1.0, slack: float = 0.0, tie: str = "det_id", frame: str = "frame_idx") -> DataFrame:
    """Keeps boxes by falling score (ties: smaller ``tie``), leaving out those that overlap a kept one by more than ``threshold``.

    ``keys`` and ``frame`` name what a box may suppress in.  The boxes of one frame are gathered
    in a row and folded; no task holds more than a frame.  Boxes without a score come last.
    """
    side = lambda b, lo, hi: F.greatest(b[hi] - b[lo] + pixel, F.lit(0.0))

    def overlap(a: Column, b: Column) -> Column:
        w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + pixel, F.lit(0.0))
        h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + pixel, F.lit(0.0))
        return once(w * h, lambda inter: once(a["size"] + b["size"] - inter, lambda union: F.when((union > 0) & ~F.isnan(union), inter / (union + slack)).otherwise(0.0)))

    def place(row: Column) -> Column:
        corners = F.struct(*[F.coalesce(row[c].cast("double"), F.lit(float("nan"))).alias(c) for c in BOX])
        return once(corners, lambda b: F.struct(*[b[c].alias(c) for c in BOX], (side(b, "x1", "x2") * side(b, "y1", "y2")).alias("size"), row.alias("row")))

    order = F.coalesce(-F.col(score).cast("double"), F.lit(float("nan")))
    found = F.array_sort(F.collect_list(F.struct(order.alias("order"), F.col(tie).alias("tie"), F.struct(*df.columns).alias("row"))))
    frames = df.groupBy(*dict.fromkeys([*keys, frame])).agg(F.transform(found, lambda s: place(s["row"])).alias("__found"))
    none = F.slice(F.col("__found"), 1, 0)
    kept = F.aggregate("__found", none, lambda kept, b: F.when(F.exists(kept, lambda k: overlap(k, b) > threshold), kept).otherwise(F.array_append(kept, b)))
    rows = frames.select(F.explode(kept).alias("__b"))
    return rows.select(*[F.col("__b")["row"][c].alias(c) for c in df.columns])


class Faces:
    """Live tracks of one shot, as arrays: names, boxes, frames of the last match."""

    def __init__(self, least_iou: float, most_missed: int):
        self.least_iou, self.most_missed, self.born = least_iou, most_missed, 0
        self.name, self.box, self.seen = np.zeros(0, np.int64), np.zeros((0, 4)), np.zeros(0, np.int64)

    def look(self, frame: int, found: np.ndarray) -> np.ndarray:
        """Gives the boxes of a frame to tracks; the track of each box.  Pairs are made by falling IoU, of equal ones the later track and box first."""
        near = pair_iou(self.box, found)
        track, box = np.nonzero(near >= self.least_iou)
        of_box, free = np.full(len(found), -1), np.ones(len(self.name), bool)
        for k in np.lexsort((box, track, near[track, box]))[::-1]:
            if free[track[k]] and of_box[box[k]] < 0:
                of_box[box[k]], free[track[k]] = track[k], False
        old = of_box >= 0
        self.box[of_box[old]], self.seen[of_box[old]] = found[old], frame
        fresh = np.flatnonzero(~old)
        of_box[fresh] = len(self.name) + np.arange(len(fresh))
        self.name = np.concatenate([self.name, self.born + np.arange(len(fresh))])
        self.box = np.concatenate([self.box, found[fresh]])
        self.seen = np.concatenate([self.seen, np.full(len(fresh), frame)])
        self.born += len(fresh)
        return self.name[of_box]

    def drop(self, frame: int) -> None:
        """Ends the tracks whose last match lies too far back."""
        live = frame - self.seen <= self.most_missed
        self.name, self.box, self.seen = self.name[live], self.box[live], self.seen[live]


def cut_between(distance: Column, difference: Column, hard: float = 0.45, soft: float = 0.30, least_difference: float = 25.0) -> Column:
    """Is there a cut before this frame?  A large distance alone, or a fair one with a large difference; a threshold of 0 or less turns the second off."""
    both = (distance >= soft) & (difference >= least_difference) if soft > 0 and least_difference > 0 else F.lit(False)
    return F.coalesce((distance >= hard) | both, F.lit(False))


def reuse_plan(df: DataFrame, keys: list[str], stride: int = 3, least_iou: float = 0.35) -> DataFrame:
    """Adds ``source``: the frame whose restored face each frame takes, itself or the last one restored.

    Every ``stride``-th frame of a key's frames is restored, the last one too, and those whose
    box or place is too far from the last restored one's.  As that starts anew at every
    ``stride``-th frame, groups of ``stride`` frames are folded on their own.
    """
    most_gap = max(stride * 3, 6)
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    rows = df.withColumns({"__j": F.row_number().over(w) - 1, "__last": F.lead("frame_idx").over(w).isNull()})
    rows = rows.withColumn("__block", F.floor(F.col("__j") / max(stride, 1)))
    gathered = rows.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "__last", *BOX))).alias("l"))

    def step(s: Column, f: Column) -> Column:
        last = F.element_at(s, -1)
        of = F.element_at(F.filter(s, lambda r: r["frame_idx"] == last["source"]), 1)
        again = f["__last"] | (f["frame_idx"] - last["source"] > most_gap) | (iou([of[c] for c in BOX], [f[c] for c in BOX]) < least_iou)
        source = F.when(again, f["frame_idx"]).otherwise(last["source"])
        return F.array_append(s, F.struct(f["frame_idx"].alias("frame_idx"), *[f[c].alias(c) for c in BOX], source.alias("source")))

    head = F.element_at("l", 1)
    start = F.array(F.struct(head["frame_idx"].alias("frame_idx"), *[head[c].alias(c) for c in BOX], head["frame_idx"].alias("source")))
    plan = gathered.select(*keys, F.explode(F.aggregate(F.slice("l", 2, max(stride, 1)), start, step)).alias("r"))
    return df.join(plan.select(*keys, "r.frame_idx", "r.source"), [*keys, "frame_idx"])
