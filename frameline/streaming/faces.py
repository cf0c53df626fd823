"""Face tracks on streams: a map of live tracks by clip, and event-time timers that forget clips.

A micro-batch reads and writes the tracks that it touches.  The state survives a restart
from the checkpoint, in the middle of a shot too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.boxes import BOX, Faces

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "clip_id bigint, frame_idx int, track_id int, x1 double, y1 double, x2 double, y2 double"


def use_rocksdb(spark: SparkSession) -> None:
    """State by key, column families and timers need this store; set it before the stream starts."""
    spark.conf.set(STORE, ROCKSDB)


class FaceTracks(StatefulProcessor):
    """State of a clip: counts and the last shot in one value, the live tracks in a map by number."""

    def __init__(self, stride: int, least_iou: float, most_missed: int, idle_ms: int | None):
        self.stride, self.least_iou, self.most_missed, self.idle_ms = stride, least_iou, most_missed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clip = handle.getValueState("clip", "seen int, born int, shot int")
        self.tracks = handle.getMapState("tracks", "track bigint", "x1 double, y1 double, x2 double, y2 double, frame int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, born, shot = self.clip.get() if self.clip.exists() else (0, 0, None)
        faces = Faces(self.least_iou, self.most_missed)
        faces.born = born
        before = {int(k[0]): tuple(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        faces.name = np.array(sorted(before), np.int64)
        faces.box = np.array([before[k][:4] for k in sorted(before)], float).reshape(-1, 4)
        faces.seen = np.array([before[k][4] for k in sorted(before)], np.int64)
        batch = pd.concat(rows).sort_values("frame_idx")
        out = []
        for f in batch.itertuples():
            cut = shot is None or f.shot_id != shot
            if cut:
                faces.drop(1 << 40)
            looks = cut or seen % max(self.stride, 1) == 0 or not len(faces.name)
            if looks:
                found = np.array([[b[c] for c in BOX] for b in (f.boxes if f.boxes is not None else [])], float).reshape(-1, 4)
                name, box = faces.look(f.frame_idx, found), found
                faces.drop(f.frame_idx)
            else:
                faces.drop(f.frame_idx)
                name, box = faces.name, faces.box
            out += [(key[0], f.frame_idx, int(n), *b) for n, b in zip(name, box)]
            seen, shot = seen + 1, int(f.shot_id)
        self.clip.update((seen, faces.born, shot))
        now = {int(n): (*map(float, b), int(at)) for n, b, at in zip(faces.name, faces.box, faces.seen)}
        for gone in before.keys() - now.keys():
            self.tracks.removeKey((gone,))
        for track, value in now.items():
            if before.get(track) != value:
                self.tracks.updateValue((track,), value)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(batch["at"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=["clip_id", "frame_idx", "track_id", *BOX])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a clip's last frame by ``idle``: the clip is forgotten."""
        self.clip.clear()
        self.tracks.clear()
        yield pd.DataFrame({c: [] for c in ["clip_id", "frame_idx", "track_id", *BOX]})

    def close(self) -> None:
        pass


def follow_faces(frames: DataFrame, stride: int = 3, least_iou: float = 0.3, most_missed: int = 8, at: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """(clip_id, frame_idx, track_id, box) of faces in frames that arrive in order by clip: clip_id, frame_idx, shot_id, boxes (an array of structs x1, y1, x2, y2).

    As `tracking.track_many`, but that the last frame of a clip is not known and so not looked at
    for its own sake.  With ``at`` (a time of each frame) a clip is forgotten when the
    watermark, ``late`` behind the newest frame, has passed its last one by ``idle_ms``; a
    clip that goes on after that begins anew.  Needs `use_rocksdb`.
    """
    rows = frames.select("clip_id", "frame_idx", "shot_id", "boxes", *([F.col(at).alias("at")] if at else []))
    if at:
        rows = rows.withWatermark("at", late)
    tracks = FaceTracks(stride, least_iou, most_missed, idle_ms if at else None)
    return rows.groupBy("clip_id").transformWithStateInPandas(tracks, OUT, "Append", "EventTime" if at else "None")
