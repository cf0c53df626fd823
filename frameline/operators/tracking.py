"""Face trackers in bounded memory: frames in order, one clip after another.

Spark sorts a clip's frames (with spilling) and hands them over one by one to a table
function, or its boxes in Arrow batches; a tracker holds the live tracks and, where the
clip's last frame matters, one frame.  A clip of any length is followed in the memory of one
frame or batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .boxes import BOX, Faces


def _boxes(flat: list[float] | None) -> np.ndarray:
    return np.array(flat or [], float).reshape(-1, 4)


def _flat() -> Column:
    """A frame's boxes by number, as one array of corners."""
    found = F.array_sort(F.collect_list(F.struct("det_id", *[F.col(c).cast("double").alias(c) for c in BOX])))
    return F.flatten(F.transform(found, lambda b: F.array(*[b[c] for c in BOX])))


class ManyFaces:
    """Follows all faces of a clip; `track_many` says how."""

    def __init__(self):
        self.faces: Faces | None = None
        self.place, self.shot, self.held = 0, None, None

    def eval(self, row: Row, stride: int, least_iou: float, most_missed: int) -> Iterator[tuple]:
        if self.held:
            yield from self._look(*self.held, False)
        self.held = (row, stride, least_iou, most_missed)

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self._look(*self.held, True)

    def _look(self, row: Row, stride: int, least_iou: float, most_missed: int, last: bool) -> Iterator[tuple]:
        cut = self.faces is None or row["shot_id"] != self.shot
        if cut:  # all tracks end, the numbers go on
            born = self.faces.born if self.faces else 0
            self.faces, self.shot = Faces(least_iou, most_missed), row["shot_id"]
            self.faces.born = born
        faces, frame = self.faces, row["frame_idx"]
        if cut or last or self.place % max(stride, 1) == 0 or not len(faces.name):
            found = _boxes(row["boxes"])
            names = faces.look(frame, found)
            faces.drop(frame)
        else:
            faces.drop(frame)
            names, found = faces.name, faces.box
        self.place += 1
        for name, corners in zip(names.tolist(), found.tolist()):
            yield (row["clip_id"], frame, name, *corners)


def _one_face(least_iou: float, most_diagonals: float, width: float, height: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Follows one face through rows (clip_id, frame_idx, det_id, box), sorted so, and gives (clip_id, frame_idx, det_id); `track_one` says how."""
    middle = np.array([width, height]) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = face = None  # the rows of a frame that may go on, the box that is followed
        clip: tuple | None = None
        for b in chain(batches, [None]):
            rows = b if held is None else held if b is None else pa.concat_batches([held, b])
            if rows is None or not rows.num_rows:
                continue
            keys = [x for c in rows.columns[:2] for x in (c.fill_null(0).to_numpy(zero_copy_only=False), c.is_null().to_numpy(zero_copy_only=False))]
            starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]).tolist()
            ends = [*starts[1:], rows.num_rows]
            if b is not None:
                held, starts = rows.slice(starts[-1]), starts[:-1]
            clips = list(zip(keys[0][starts].tolist(), keys[1][starts].tolist()))
            x1, y1, x2, y2 = corners = [c.to_numpy(zero_copy_only=False) for c in rows.columns[3:]]
            with np.errstate(all="ignore"):
                cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
                size = np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
                seed = (x2 - x1) * (y2 - y1) * np.maximum(0.2, 1 - np.hypot(cx - middle[0], cy - middle[1]) / np.hypot(*middle))
                reach = np.hypot(x2 - x1, y2 - y1)
            boxes = list(zip(*(c.tolist() for c in (*corners, size, cx, cy, reach))))
            picks = []
            for at, begin, end in zip(clips, starts, ends):
                if at != clip:
                    clip, face = at, None
                if face is None:
                    pick = begin + int(seed[begin:end].argmax())
                else:
                    pick = _follow(face, boxes, begin, end, least_iou)
                    if pick < 0:
                        away = np.hypot(cx[begin:end] - face[5], cy[begin:end] - face[6])
                        pick = begin + int(away.argmin()) if away.min() <= most_diagonals * max(1.0, face[7]) else -1
                face = boxes[pick] if pick >= 0 else None
                if pick >= 0:
                    picks.append(pick)
            if picks:
                yield rows.select([0, 1, 2]).take(pa.array(picks))

    return run


def _follow(face: tuple, boxes: list[tuple], begin: int, end: int, least_iou: float) -> int:
    """The box with the best IoU with ``face``, the first of equals; -1 if that is too small.  Plain numbers, as a frame has few boxes and arrays of a few cost more."""
    fx1, fy1, fx2, fy2, fsize = face[:5]
    best, pick = -1.0, -1
    for k in range(begin, end):
        x1, y1, x2, y2, size = boxes[k][:5]
        w = (fx2 if fx2 < x2 else x2) - (fx1 if fx1 > x1 else x1)
        h = (fy2 if fy2 < y2 else y2) - (fy1 if fy1 > y1 else y1)
        near = 0.0
        if w > 0 and h > 0:
            union = fsize + size - w * h
            near = w * h / union if union > 0 else 0.0
        if near > best:
            best, pick = near, k
    return pick if best >= least_iou else -1


def track_many(detections: DataFrame, frames: DataFrame, stride: int = 3, least_iou: float = 0.3, most_missed: int = 8) -> DataFrame:
    """(clip_id, frame_idx, track_id, box) of all faces.

    Boxes are detected every ``stride`` frames, at cuts, at both ends of the clip, and while
    nothing is tracked; between, live tracks hold their boxes.  A track ends ``most_missed``
    frames after its last match, and all end at a cut.
    """
    found = detections.groupBy("clip_id", "frame_idx").agg(_flat().alias("boxes"))
    rows = frames.select("clip_id", "frame_idx", "shot_id").join(found, ["clip_id", "frame_idx"], "left")
    kind = "clip_id bigint, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double"
    return F.udtf(ManyFaces, returnType=kind)(rows.asTable().partitionBy("clip_id").orderBy("frame_idx"), F.lit(stride), F.lit(float(least_iou)), F.lit(most_missed))


def track_one(df: DataFrame, least_iou: float = 0.15, most_diagonals: float = 1.5, width: float = 640, height: float = 480) -> DataFrame:
    """(clip_id, frame_idx, det_id) of one face followed through the frames: best IoU, else nearest centre, else lost and seeded anew at the next frame.

    A task holds an Arrow batch of sorted boxes and the one that is followed, whatever the clip's length.
    """
    kinds = {"clip_id": "bigint", "frame_idx": "int", "det_id": "int", **dict.fromkeys(BOX, "double")}
    rows = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    run = _one_face(float(least_iou), float(most_diagonals), float(width), float(height))
    return rows.repartition("clip_id").sortWithinPartitions(*kinds).mapInArrow(run, "clip_id bigint, frame_idx int, det_id int")
