"""Queries of the frame-timeline operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import boxes, intervals, runs, sampling, scans, tracking, windows
from ..sources import timeline as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "pipe_speaking_gate"
FPS = 25.0

VIEWS = """
WITH sv_base AS (
  SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
         event_type, floor(least(value, 100.0::DOUBLE)) / 100.0::DOUBLE AS open_prob, CAST(props->>'k' AS INTEGER) AS k
  FROM events),
sv_frames AS (
  SELECT clip_id, frame_idx, CAST(floor(frame_idx / 16) AS INTEGER) AS shot_id, event_type <> 'error' AS valid_face,
         CASE WHEN event_type <> 'error' THEN open_prob END AS open_prob,
         CASE WHEN event_type <> 'error' THEN k / 100.0::DOUBLE END AS mar,
         CASE WHEN event_type <> 'error' THEN CAST(30 * floor(frame_idx / 8) + k % 5 AS DOUBLE) END AS x1,
         CASE WHEN event_type <> 'error' THEN CAST(20 + k % 7 AS DOUBLE) END AS y1,
         CASE WHEN event_type <> 'error' THEN CAST(30 * floor(frame_idx / 8) + k % 5 + 40 AS DOUBLE) END AS x2,
         CASE WHEN event_type <> 'error' THEN CAST(20 + k % 7 + 40 AS DOUBLE) END AS y2
  FROM sv_base),
sv_segments AS (
  SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 AS INTEGER) AS pos,
         frame_idx / 25.0::DOUBLE AS seg_start, (frame_idx + 2 + k % 9) / 25.0::DOUBLE AS seg_end,
         CASE k % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender
  FROM sv_base WHERE event_type = 'view'),
sv_intervals AS (
  SELECT clip_id, k % 3 AS speaker_id, frame_idx / 25.0::DOUBLE AS t0, (frame_idx + 1 + k % 6) / 25.0::DOUBLE AS t1
  FROM sv_base WHERE event_type = 'click'),
sv_pos AS (
  SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY t0, t1, speaker_id) AS ipos
  FROM (SELECT DISTINCT clip_id, speaker_id, t0, t1 FROM sv_intervals)),
sv_clips AS (SELECT user_id AS clip_id, 25.0::DOUBLE AS fps, CAST(count(*) AS INTEGER) AS n_frames FROM events GROUP BY user_id),
sv_tracks AS (
  SELECT f.clip_id, f.frame_idx, f.shot_id, t.track_id, f.open_prob, x1 + t.dx AS x1, y1, x2 + t.dx AS x2, y2
  FROM sv_frames f CROSS JOIN (VALUES (0, 0.0::DOUBLE), (1, 12.0::DOUBLE), (2, 60.0::DOUBLE)) t(track_id, dx) WHERE valid_face),
mask AS (SELECT *, coalesce(open_prob >= 0.15, false) AS on_ FROM sv_frames),
isl AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id, shot_id, on_ ORDER BY frame_idx) AS g FROM mask),
runs AS (
  SELECT clip_id, shot_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_frames
  FROM isl WHERE on_ GROUP BY clip_id, shot_id, g)
"""


def iou_sql(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"(CASE WHEN {a}.x1 IS NULL OR {b}.x1 IS NULL OR {w} <= 0 OR {h} <= 0 THEN 0.0::DOUBLE ELSE {w} * {h} / ({size.format(a)} + {size.format(b)} - {w} * {h}) END)"


def query(name: str, sql: str | None = None, views: bool = True):
    """Registers a query, with its SQL over the stand-in views."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = (VIEWS if views else "") + sql
        return fn

    return add


def speaking(df: DataFrame) -> DataFrame:
    return df.withColumn("on_", F.coalesce(F.col("open_prob") >= 0.15, F.lit(False)))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaking(T.frames(spark, sf_dir))


def shot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.true_runs(mask(spark, sf_dir), F.col("on_"))


def six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# ---------------------------------------------------------------- runs


@query("run_1_true_runs", "SELECT clip_id, shot_id, start_frame, end_frame, n_frames FROM runs")
def run_1(spark, sf_dir):
    return shot_runs(spark, sf_dir).select("clip_id", "shot_id", "start_frame", "end_frame", "n_frames")


@query(
    "run_2_consecutive_runs",
    """, v AS (SELECT clip_id, k, lag(k) OVER (PARTITION BY clip_id ORDER BY k) AS p FROM sv_base),
    u AS (SELECT clip_id, k, CASE WHEN p IS NULL OR p + 1 <> k THEN 1 ELSE 0 END AS s FROM v),
    w AS (SELECT clip_id, k, sum(s) OVER (PARTITION BY clip_id ORDER BY k, s ROWS UNBOUNDED PRECEDING) AS r FROM u)
    SELECT clip_id, min(k) AS first, max(k) AS last FROM w GROUP BY clip_id, r""",
)
def run_2(spark, sf_dir):
    return runs.consecutive_runs(T.base(spark, sf_dir), "k")


@query(
    "run_3_keep_runs",
    "SELECT clip_id, shot_id, start_frame, end_frame, n_frames FROM runs WHERE n_frames >= 3",
)
def run_3(spark, sf_dir):
    kept = runs.keep_runs(mask(spark, sf_dir), F.col("on_"), 3)
    return runs.true_runs(kept, F.col("kept")).select("clip_id", "shot_id", "start_frame", "end_frame", "n_frames")


@query(
    "run_4_prune_short",
    "SELECT clip_id, frame_idx, on_ AND count(*) OVER (PARTITION BY clip_id, shot_id, on_, g) >= 4 AS kept FROM isl",
)
def run_4(spark, sf_dir):
    return runs.prune_short(mask(spark, sf_dir), F.col("on_"), 0.18, FPS).select("clip_id", "frame_idx", "kept")


@query(
    "run_5_dilate",
    "SELECT clip_id, frame_idx, valid_face AND bool_or(on_) OVER (PARTITION BY clip_id, shot_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM mask",
)
def run_5(spark, sf_dir):
    return runs.dilate(mask(spark, sf_dir), F.col("on_"), 2, F.col("valid_face")).select("clip_id", "frame_idx", "dilated")


BEST = """, met AS (SELECT r.*, s.pos, s.seg_start, s.seg_end, least((end_frame + 1) / 25.0::DOUBLE, seg_end) - greatest(start_frame / 25.0::DOUBLE, seg_start) AS overlap
  FROM runs r JOIN sv_segments s USING (clip_id)),
best AS (SELECT * FROM met WHERE overlap > 0 AND seg_end > seg_start QUALIFY row_number() OVER (PARTITION BY clip_id, start_frame ORDER BY overlap DESC, seg_start, pos) = 1),
fit AS (SELECT * FROM best WHERE overlap / greatest((end_frame + 1) / 25.0::DOUBLE - start_frame / 25.0::DOUBLE, 1e-6) >= 0.5)
"""


@query("jon_4_best_overlap", BEST + "SELECT clip_id, start_frame, end_frame, round(seg_start, 6) AS seg_start, round(seg_end, 6) AS seg_end, round(overlap, 6) AS overlap FROM fit")
def jon_4(spark, sf_dir):
    best = intervals.best_overlap(shot_runs(spark, sf_dir), T.segments(spark, sf_dir), FPS)
    return best.select("clip_id", "start_frame", "end_frame", *six("seg_start", "seg_end", "overlap"))


@query("jon_5_run_gender", BEST + "SELECT clip_id, start_frame, end_frame, gender FROM fit JOIN sv_segments USING (clip_id, pos)")
def jon_5(spark, sf_dir):
    return intervals.best_overlap(shot_runs(spark, sf_dir), T.segments(spark, sf_dir), FPS).select("clip_id", "start_frame", "end_frame", "gender")


@query(
    "run_6_expand_within_segments",
    BEST
    + """, lim AS (SELECT f.clip_id, greatest(0, start_frame - 25, CAST(round_even(seg_start * 25, 0) AS INTEGER), s0) AS lo,
    least(n - 1, end_frame + 25, least(n, CAST(round_even(seg_end * 25, 0) AS INTEGER)) - 1, s1) AS hi
    FROM fit f JOIN (SELECT clip_id, count(*) AS n FROM sv_frames GROUP BY 1) USING (clip_id)
    JOIN (SELECT clip_id, shot_id, min(frame_idx) AS s0, max(frame_idx) AS s1 FROM sv_frames GROUP BY 1, 2) USING (clip_id, shot_id)
    WHERE least(n, CAST(round_even(seg_end * 25, 0) AS INTEGER)) > greatest(0, CAST(round_even(seg_start * 25, 0) AS INTEGER)))
    SELECT clip_id, frame_idx FROM mask WHERE on_
    UNION SELECT m.clip_id, m.frame_idx FROM mask m JOIN lim l ON m.clip_id = l.clip_id AND m.frame_idx BETWEEN l.lo AND l.hi WHERE m.valid_face""",
)
def run_6(spark, sf_dir):
    frames = mask(spark, sf_dir)
    return intervals.expand_within_segments(frames, shot_runs(spark, sf_dir), T.segments(spark, sf_dir), F.col("on_"), FPS, 1.0, F.col("valid_face"))


@query(
    "run_7_expand_to_shots",
    """, r AS (SELECT *, CASE WHEN on_ THEN count(*) OVER (PARTITION BY clip_id, shot_id, on_, g) ELSE 0 END AS len FROM isl),
    s AS (SELECT *, max(len) OVER (PARTITION BY clip_id, shot_id) AS longest, count(*) OVER (PARTITION BY clip_id, shot_id) AS n FROM r)
    SELECT clip_id, frame_idx, longest >= CASE WHEN n < 12 THEN 3 ELSE 8 END OR len >= 5 AS speaking FROM s""",
)
def run_7(spark, sf_dir):
    grown = runs.expand_to_shots(mask(spark, sf_dir), F.col("on_"), FPS, least=0.32, short_shot=0.48, short_least=0.12, partial=0.2)
    return grown.select("clip_id", "frame_idx", "speaking")


# ---------------------------------------------------------------- intervals


@query("int_3_mask_to_intervals", "SELECT clip_id, shot_id, round(start_frame / 25.0::DOUBLE, 6) AS t0, round((end_frame + 1) / 25.0::DOUBLE, 6) AS t1 FROM runs")
def int_3(spark, sf_dir):
    return shot_runs(spark, sf_dir).select("clip_id", "shot_id", F.round(F.col("start_frame") / FPS, 6).alias("t0"), F.round((F.col("end_frame") + 1) / FPS, 6).alias("t1"))


@query(
    "int_4_segments_to_mask",
    """SELECT DISTINCT f.clip_id, f.frame_idx FROM sv_frames f JOIN sv_segments s ON f.clip_id = s.clip_id JOIN sv_clips c ON c.clip_id = f.clip_id
    WHERE f.frame_idx >= greatest(0, trunc(seg_start * fps)) AND f.frame_idx < least(n_frames, round_even(seg_end * fps, 0))""",
)
def int_4(spark, sf_dir):
    return intervals.segment_frames(T.segments(spark, sf_dir), T.clips(spark, sf_dir))


NEAR = """QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY greatest(0.0::DOUBLE, t0 - {b}, {a} - t1), abs((t0 + t1) * 0.5 - ({a} + {b}) * 0.5), ipos) = 1"""


@query("jon_7_nearest", "SELECT clip_id, pos AS seg_pos, speaker_id, round(greatest(0.0::DOUBLE, t0 - seg_end, seg_start - t1), 6) AS gap FROM sv_segments JOIN sv_pos USING (clip_id) " + NEAR.format(key="clip_id, pos", a="seg_start", b="seg_end"))
def jon_7(spark, sf_dir):
    near = intervals.nearest(T.segments(spark, sf_dir), T.intervals(spark, sf_dir), ["pos"], "seg_start", "seg_end")
    return near.select("clip_id", F.col("pos").alias("seg_pos"), "speaker_id", *six("gap"))


@query(
    "jon_6_speakers_overlapping",
    "SELECT clip_id, pos, count(DISTINCT speaker_id) AS n_speakers, min(speaker_id) AS only FROM sv_segments JOIN sv_intervals USING (clip_id) WHERE least(t1, seg_end) > greatest(t0, seg_start) GROUP BY clip_id, pos",
)
def jon_6(spark, sf_dir):
    return intervals.overlapping(T.segments(spark, sf_dir), T.intervals(spark, sf_dir), ["pos"], "seg_start", "seg_end")


SWITCH = """, inside AS (
  SELECT DISTINCT s.clip_id, s.pos, e.x AS at_ FROM sv_segments s JOIN (SELECT clip_id, t0 AS x FROM sv_intervals UNION SELECT clip_id, t1 FROM sv_intervals) e ON e.clip_id = s.clip_id AND e.x > s.seg_start AND e.x < s.seg_end
  UNION SELECT clip_id, pos, seg_start FROM sv_segments),
shown AS (
  SELECT i.clip_id, i.pos, i.at_, v.speaker_id FROM inside i JOIN sv_pos v ON v.clip_id = i.clip_id AND v.t0 <= i.at_ + 1e-6 AND i.at_ + 1e-6 < v.t1
  QUALIFY row_number() OVER (PARTITION BY i.clip_id, i.pos, i.at_ ORDER BY v.t1 - v.t0 DESC, v.ipos) = 1),
seen AS (
  SELECT i.*, coalesce(speaker_id, -2) AS now_, lag(coalesce(speaker_id, -2)) OVER (PARTITION BY i.clip_id, i.pos ORDER BY i.at_) AS before_
  FROM inside i LEFT JOIN shown USING (clip_id, pos, at_)),
switches AS (SELECT clip_id, pos, at_ FROM seen WHERE before_ IS NOT NULL AND before_ <> now_)
"""


@query("int_7_switch_points", SWITCH + 'SELECT clip_id, pos, round(at_, 6) AS "at" FROM switches')
def int_7(spark, sf_dir):
    return intervals.switch_points(T.segments(spark, sf_dir), T.intervals(spark, sf_dir)).select("clip_id", "pos", *six("at"))


SPLIT_SQL = (
    SWITCH
    + """, n AS (SELECT clip_id, pos, count(DISTINCT speaker_id) AS n FROM sv_segments JOIN sv_intervals USING (clip_id) WHERE least(t1, seg_end) > greatest(t0, seg_start) GROUP BY 1, 2),
cuts AS (SELECT DISTINCT clip_id, pos, round(c, 6) AS c FROM (
  SELECT clip_id, pos, seg_start AS c FROM sv_segments UNION ALL SELECT clip_id, pos, seg_end FROM sv_segments UNION ALL SELECT clip_id, pos, at_ FROM switches) JOIN n USING (clip_id, pos) WHERE n.n > 1),
pieces AS (
  SELECT clip_id, pos, c AS a, lead(c) OVER (PARTITION BY clip_id, pos ORDER BY c) AS b FROM cuts
  UNION ALL SELECT clip_id, pos, seg_start, seg_end FROM sv_segments s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.clip_id = s.clip_id AND n.pos = s.pos AND n.n > 1)),
p AS (SELECT * FROM pieces WHERE b - a >= 1e-4),
ov AS (SELECT clip_id, pos, a, count(DISTINCT speaker_id) AS n, min(speaker_id) AS only_ FROM p JOIN sv_intervals USING (clip_id) WHERE least(t1, b) > greatest(t0, a) GROUP BY 1, 2, 3),
near AS (SELECT clip_id, pos, a, speaker_id, greatest(0.0::DOUBLE, t0 - b, a - t1) AS gap FROM p JOIN sv_pos USING (clip_id) """
    + NEAR.format(key="clip_id, pos, a", a="a", b="b")
    + """),
assigned AS (SELECT clip_id, pos, a AS t_start, b AS t_end, CASE WHEN ov.n = 1 THEN only_ WHEN gap <= 0.5 THEN near.speaker_id ELSE -1 END AS speaker_id FROM p LEFT JOIN ov USING (clip_id, pos, a) LEFT JOIN near USING (clip_id, pos, a))
"""
)


@query("int_8_assign_split", SPLIT_SQL + "SELECT clip_id, pos, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, speaker_id FROM assigned")
def int_8(spark, sf_dir):
    return intervals.assign_split(T.segments(spark, sf_dir), T.intervals(spark, sf_dir)).select("clip_id", "pos", *six("t_start", "t_end"), "speaker_id")


@query(
    "int_9_chunks",
    """SELECT clip_id, CAST(s / 50 AS INTEGER) AS chunk_id, CAST(s AS INTEGER) AS start_frame, CAST(least(50, n_frames - s) AS INTEGER) AS frame_count, round(s / fps, 6) AS start_sec, round(least(50, n_frames - s) / fps, 6) AS duration_sec
    FROM (SELECT *, unnest(range(0, n_frames, 50)) AS s FROM sv_clips)""",
)
def int_9(spark, sf_dir):
    return intervals.chunk_plan(T.clips(spark, sf_dir), 2.0).select("clip_id", "chunk_id", "start_frame", "frame_count", *six("start_sec", "duration_sec"))


@query(
    "int_6_clip_to_windows",
    """, w AS (SELECT clip_id, CAST(s / 50 AS INTEGER) AS chunk_id, s / fps AS w0, (s + least(50, n_frames - s)) / fps AS w1 FROM (SELECT *, unnest(range(0, n_frames, 50)) AS s FROM sv_clips))
    SELECT clip_id, chunk_id, pos, round(greatest(seg_start, w0) - w0, 6) AS seg_start, round(least(seg_end, w1) - w0, 6) AS seg_end, gender
    FROM sv_segments JOIN w USING (clip_id) WHERE seg_start < w1 AND seg_end > w0 AND least(seg_end, w1) - w0 > greatest(seg_start, w0) - w0""",
)
def int_6(spark, sf_dir):
    plan = intervals.chunk_plan(T.clips(spark, sf_dir), 2.0)
    w = plan.select("clip_id", "chunk_id", F.col("start_sec").alias("w0"), ((F.col("start_frame") + F.col("frame_count")) / FPS).alias("w1"))
    return intervals.clip_to_windows(T.segments(spark, sf_dir), w).select("clip_id", "chunk_id", "pos", *six("seg_start", "seg_end"), "gender")


@query("int_10_effective_frames", "SELECT clip_id, CAST(greatest(1, least(n_frames, floor((n_frames - clip_id % 7) / 25.0::DOUBLE * fps + 1e-9))) AS INTEGER) AS frames FROM sv_clips")
def int_10(spark, sf_dir):
    seconds = (F.col("n_frames") - F.col("clip_id") % 7) / 25.0
    return T.clips(spark, sf_dir).select("clip_id", intervals.effective_frames(F.col("n_frames"), seconds, F.col("fps")).alias("frames"))


@query(
    "int_11_even_sample",
    """SELECT DISTINCT clip_id, start_frame, CAST(round_even(start_frame + (end_frame - start_frame) * i / 7.0::DOUBLE, 0) AS INTEGER) AS sample
    FROM (SELECT *, unnest(range(0, 8)) AS i FROM runs WHERE n_frames > 8)
    UNION SELECT clip_id, start_frame, CAST(unnest(range(start_frame, end_frame + 1)) AS INTEGER) FROM runs WHERE n_frames <= 8""",
)
def int_11(spark, sf_dir):
    sample = intervals.even_sample(F.col("start_frame"), F.col("end_frame"))
    return shot_runs(spark, sf_dir).select("clip_id", "start_frame", F.explode(sample).alias("sample"))


@query(
    "agg_4_gender_vote",
    "SELECT clip_id, CASE WHEN count(*) FILTER (gender = 'male') > count(*) FILTER (gender = 'female') THEN 'male' WHEN count(*) FILTER (gender = 'male') < count(*) FILTER (gender = 'female') THEN 'female' END AS gender FROM sv_segments GROUP BY clip_id",
)
def agg_4(spark, sf_dir):
    return intervals.gender_vote(T.segments(spark, sf_dir), ["clip_id"])


@query(
    "flt_11_gender_gate",
    BEST
    + """, v AS (SELECT clip_id, shot_id, CASE WHEN sum((k % 2)) * 2 > count(*) THEN 'male' WHEN sum((k % 2)) * 2 < count(*) THEN 'female' END AS seen FROM (SELECT b.clip_id, CAST(floor(b.frame_idx / 16) AS INTEGER) AS shot_id, b.k FROM sv_base b) GROUP BY 1, 2)
    SELECT clip_id, start_frame, end_frame FROM runs LEFT JOIN (SELECT clip_id, start_frame, gender FROM fit JOIN sv_segments USING (clip_id, pos)) USING (clip_id, start_frame) LEFT JOIN v USING (clip_id, shot_id)
    WHERE NOT coalesce(gender <> seen, false)""",
)
def flt_11(spark, sf_dir):
    votes = T.base(spark, sf_dir).select("clip_id", F.floor(F.col("frame_idx") / 16).cast("int").alias("shot_id"), F.when(F.col("k") % 2 == 1, "male").otherwise("female").alias("gender"))
    seen = intervals.gender_vote(votes, ["clip_id", "shot_id"]).withColumnRenamed("gender", "seen")
    found = shot_runs(spark, sf_dir)
    heard = intervals.best_overlap(found, T.segments(spark, sf_dir), FPS).select("clip_id", "start_frame", "gender")
    met = found.join(heard, ["clip_id", "start_frame"], "left").join(seen, ["clip_id", "shot_id"], "left")
    return met.where(~F.coalesce(F.col("gender") != F.col("seen"), F.lit(False))).select("clip_id", "start_frame", "end_frame")


# ---------------------------------------------------------------- windows

AROUND = "OVER (PARTITION BY clip_id, shot_id ORDER BY frame_idx ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"


@query("win_1_temporal_max", f"SELECT clip_id, frame_idx, CASE WHEN open_prob IS NOT NULL THEN max(open_prob) {AROUND.format(2)} END AS open_max FROM sv_frames")
def win_1(spark, sf_dir):
    return windows.temporal_max(T.frames(spark, sf_dir), "open_prob").select("clip_id", "frame_idx", "open_max")


GATE = (
    """, near AS (SELECT a.clip_id, a.frame_idx, a.open_prob, b.open_prob AS o, b.mar AS m FROM sv_frames a JOIN sv_frames b
  ON a.clip_id = b.clip_id AND a.shot_id = b.shot_id AND abs(a.frame_idx - b.frame_idx) <= 4 AND b.open_prob IS NOT NULL AND a.open_prob IS NOT NULL AND """
    + iou_sql("a", "b")
    + """ >= 0.5),
sums AS (SELECT clip_id, frame_idx, any_value(open_prob) AS open_prob, CASE WHEN count(o) >= 3 THEN round(stddev_pop(o), 9) ELSE 0 END AS activity, CASE WHEN count(o) >= 3 THEN round(avg(o), 9) ELSE 0 END AS mean_open,
  CASE WHEN count(m) >= 3 THEN round(stddev_pop(m), 9) ELSE 0 END AS mar_activity FROM near GROUP BY 1, 2),
gate AS (SELECT f.clip_id, f.frame_idx, f.shot_id, coalesce(s.open_prob >= 0.15 AND CASE WHEN mean_open >= 0.75 THEN activity >= 0.05 OR mar_activity >= 0.04 ELSE activity >= 0.12 AND mean_open >= 0.12 END, false) AS motion, activity
  FROM sv_frames f LEFT JOIN sums s USING (clip_id, frame_idx))
"""
)


@query("win_2_motion_gate", GATE + "SELECT clip_id, frame_idx, motion, round(activity, 6) AS activity FROM gate")
def win_2(spark, sf_dir):
    return windows.motion_gate(T.frames(spark, sf_dir)).select("clip_id", "frame_idx", "motion", *six("activity"))


@query("win_3_centred_mean", "SELECT clip_id, frame_idx, round(avg(open_prob) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM sv_frames")
def win_3(spark, sf_dir):
    return windows.centred_mean(T.frames(spark, sf_dir), "open_prob").select("clip_id", "frame_idx", *six("mean"))


@query(
    "win_4_active_track",
    """, t AS (SELECT *, CASE track_id WHEN 0 THEN open_prob WHEN 1 THEN mar ELSE (open_prob + mar) / 2 END AS p FROM (SELECT t.*, f.mar FROM sv_tracks t JOIN sv_frames f USING (clip_id, frame_idx))),
    a AS (SELECT *, count(p) OVER w AS n, stddev_pop(p) OVER w AS sd, avg(p) OVER w AS mean FROM t WINDOW w AS (PARTITION BY clip_id, shot_id, track_id ORDER BY frame_idx RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING))
    SELECT clip_id, frame_idx, track_id FROM a WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY CASE WHEN n >= 2 THEN round(sd, 9) ELSE 0 END DESC, round(mean, 9) DESC, coalesce(p, 0) DESC, track_id) = 1""",
)
def win_4(spark, sf_dir):
    mar = T.frames(spark, sf_dir).select("clip_id", "frame_idx", "mar")
    tracks = T.tracks(spark, sf_dir).join(mar, ["clip_id", "frame_idx"])
    moved = F.when(F.col("track_id") == 0, F.col("open_prob")).when(F.col("track_id") == 1, F.col("mar")).otherwise((F.col("open_prob") + F.col("mar")) / 2)
    return windows.active_track(tracks.withColumn("open_prob", moved))


@query("win_5_open_presence", f"SELECT clip_id, frame_idx, coalesce(count(open_prob) {AROUND.format(3)} >= 2 AND avg(open_prob) {AROUND.format(3)} >= 0.3, false) AS present FROM sv_frames")
def win_5(spark, sf_dir):
    return windows.open_presence(T.frames(spark, sf_dir), "open_prob", 0.3, 3).select("clip_id", "frame_idx", "present")


@query(
    "win_7_fill",
    """SELECT clip_id, frame_idx, coalesce(last_value(x1 IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), first_value(x1 IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS x1 FROM sv_frames""",
)
def win_7(spark, sf_dir):
    return windows.fill(T.frames(spark, sf_dir), ["x1"]).select("clip_id", "frame_idx", "x1")


LERP = (
    """, kf AS (SELECT *, frame_idx % 5 = 0 OR frame_idx = max(frame_idx) OVER (PARTITION BY clip_id) AS is_key FROM sv_frames),
ab AS (SELECT f.clip_id, f.frame_idx, max(a.frame_idx) AS ia FROM kf f JOIN kf a ON a.clip_id = f.clip_id AND a.is_key AND a.frame_idx <= f.frame_idx AND a.frame_idx > f.frame_idx - 5 GROUP BY 1, 2),
ba AS (SELECT f.clip_id, f.frame_idx, min(b.frame_idx) AS ib FROM kf f JOIN kf b ON b.clip_id = f.clip_id AND b.is_key AND b.frame_idx >= f.frame_idx AND b.frame_idx < f.frame_idx + 5 GROUP BY 1, 2),
e AS (SELECT ab.clip_id, ab.frame_idx, a, b, CASE WHEN ib > ia THEN (ab.frame_idx - ia) / (ib - ia)::DOUBLE ELSE 0 END AS t FROM ab JOIN ba USING (clip_id, frame_idx)
  JOIN kf a ON a.clip_id = ab.clip_id AND a.frame_idx = ia JOIN kf b ON b.clip_id = ab.clip_id AND b.frame_idx = ib)
SELECT clip_id, frame_idx, """
    + ", ".join(f"CASE WHEN {iou_sql('a', 'b')} >= 0.15 THEN round_even(a.{c} + (b.{c} - a.{c}) * t, 0) WHEN t < 0.5 THEN a.{c} ELSE b.{c} END AS {c}" for c in ("x1", "y1", "x2", "y2"))
    + " FROM e"
)


@query("win_9_interpolate", LERP)
def win_9(spark, sf_dir):
    rows = T.frames(spark, sf_dir)
    n = T.clips(spark, sf_dir).select("clip_id", "n_frames")
    key = (F.col("frame_idx") % 5 == 0) | (F.col("frame_idx") == F.col("n_frames") - 1)
    return windows.interpolate_boxes(rows.join(n, "clip_id"), key).select("clip_id", "frame_idx", *windows.BOX)


@query(
    "win_11_ramp",
    """, i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id, on_ ORDER BY frame_idx) AS h FROM mask),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, on_, h ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY clip_id, on_, h) AS n FROM i)
    SELECT clip_id, frame_idx, round(CASE WHEN NOT on_ THEN 0.0::DOUBLE WHEN n <= 1 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, i / least(5, greatest(1, floor(n / 2)))::DOUBLE, (n - i + 1) / least(5, greatest(1, floor(n / 2)))::DOUBLE) END, 6) AS alpha FROM r""",
)
def win_11(spark, sf_dir):
    return windows.ramp(mask(spark, sf_dir), F.col("on_")).select("clip_id", "frame_idx", *six("alpha"))


@query(
    "win_12_context_zero",
    """SELECT f.clip_id, f.frame_idx, CAST(f.i AS INTEGER) AS "at", coalesce(v.open_prob, 0.0::DOUBLE) AS value FROM (SELECT clip_id, frame_idx, unnest(range(-2, 3)) AS i FROM sv_frames) f LEFT JOIN sv_frames v ON v.clip_id = f.clip_id AND v.frame_idx = f.frame_idx + f.i""",
)
def win_12(spark, sf_dir):
    return windows.context_window(T.frames(spark, sf_dir), "open_prob", 2, 2)


@query(
    "win_13_context_clamped",
    """SELECT f.clip_id, f.frame_idx, CAST(f.i AS INTEGER) AS "at", coalesce(v.open_prob, 0.0::DOUBLE) AS value FROM (SELECT clip_id, frame_idx, unnest(range(-2, 3)) AS i FROM sv_frames) f JOIN sv_clips c USING (clip_id) LEFT JOIN sv_frames v ON v.clip_id = f.clip_id AND v.frame_idx = least(greatest(f.frame_idx + f.i, 0), n_frames - 1)""",
)
def win_13(spark, sf_dir):
    return windows.context_window(T.frames(spark, sf_dir), "open_prob", 2, 2, clamp=True)


@query(
    "flt_4_invalidate_unstable",
    """, p AS (SELECT *, lag(shot_id) OVER w AS s0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM sv_frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)),
    q AS (SELECT *, coalesce(s0 <> shot_id, false) AS cut, coalesce(px1 IS NOT NULL AND x1 IS NOT NULL AND """
    + "(CASE WHEN least(x2, px2) <= greatest(x1, px1) OR least(y2, py2) <= greatest(y1, py1) THEN 0.0::DOUBLE ELSE (least(x2, px2) - greatest(x1, px1)) * (least(y2, py2) - greatest(y1, py1)) / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - (least(x2, px2) - greatest(x1, px1)) * (least(y2, py2) - greatest(y1, py1))) END)"
    + """ < 0.35, false) AS jump FROM p)
    SELECT clip_id, frame_idx, CASE WHEN bool_or(cut) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) OR jump OR coalesce(lead(jump) OVER (PARTITION BY clip_id ORDER BY frame_idx), false) THEN NULL ELSE open_prob END AS stable_prob FROM q""",
)
def flt_4(spark, sf_dir):
    return windows.invalidate_unstable(T.frames(spark, sf_dir)).select("clip_id", "frame_idx", "stable_prob")


@query("prj_25_pre_emphasis", "SELECT clip_id, frame_idx, round(open_prob - 0.97::DOUBLE * coalesce(lag(open_prob) OVER (PARTITION BY clip_id ORDER BY frame_idx), 0), 6) AS emphasised FROM sv_base")
def prj_25(spark, sf_dir):
    return windows.pre_emphasis(T.base(spark, sf_dir), "open_prob").select("clip_id", "frame_idx", *six("emphasised"))


# ---------------------------------------------------------------- boxes and joins


@query("prj_1_area", "SELECT clip_id, frame_idx, coalesce(greatest(0, x2 - x1) * greatest(0, y2 - y1), 0.0::DOUBLE) AS area FROM sv_frames")
def prj_1(spark, sf_dir):
    return T.frames(spark, sf_dir).select("clip_id", "frame_idx", G.area(G.box()).alias("area"))


PAIRS = "FROM sv_tracks a JOIN sv_tracks b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.track_id = 0 AND b.track_id = 1"


def _pairs(spark, sf_dir):
    rows = T.tracks(spark, sf_dir)
    other = rows.where("track_id = 1").select("clip_id", "frame_idx", *[F.col(c).alias(f"o{c}") for c in windows.BOX])
    return rows.where("track_id = 0").join(other, ["clip_id", "frame_idx"])


@query("prj_2_iou", f"SELECT a.clip_id, a.frame_idx, round({iou_sql('a', 'b')}, 6) AS iou {PAIRS}")
def prj_2(spark, sf_dir):
    return _pairs(spark, sf_dir).select("clip_id", "frame_idx", F.round(G.iou(G.box(), G.box("o")), 6).alias("iou"))


@query("prj_4_center_distance", f"SELECT a.clip_id, a.frame_idx, round(sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)), 6) AS dist {PAIRS}")
def prj_4(spark, sf_dir):
    return _pairs(spark, sf_dir).select("clip_id", "frame_idx", F.round(G.center_distance(G.box(), G.box("o")), 6).alias("dist"))


@query("prj_5_scaled", "SELECT clip_id, frame_idx, round_even(x1 * 1.5, 0) AS x1, round_even(y1 * 0.75, 0) AS y1, round_even(x2 * 1.5, 0) AS x2, round_even(y2 * 0.75, 0) AS y2 FROM sv_frames WHERE valid_face")
def prj_5(spark, sf_dir):
    out = [c.alias(n) for c, n in zip(G.scaled(G.box(), 1.5, 0.75), windows.BOX)]
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *out)


@query(
    "prj_6_clamped",
    """, c AS (SELECT clip_id, frame_idx, least(greatest(x1, 0), 100) AS x1, least(greatest(y1, 0), 50) AS y1, least(greatest(x2, 0), 100) AS x2, least(greatest(y2, 0), 50) AS y2 FROM sv_frames WHERE valid_face)
    SELECT clip_id, frame_idx, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2 FROM (SELECT *, x2 - x1 > 1 AND y2 - y1 > 1 AS ok FROM c)""",
)
def prj_6(spark, sf_dir):
    out = [c.alias(n) for c, n in zip(G.clamped(G.box(), 100, 50), windows.BOX)]
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *out)


@query("prj_7_expanded", "SELECT clip_id, frame_idx, round(greatest(0, x1 - (x2 - x1) * 0.35::DOUBLE), 6) AS x1, round(greatest(0, y1 - (y2 - y1) * 0.55::DOUBLE), 6) AS y1, round(least(640, x2 + (x2 - x1) * 0.35::DOUBLE), 6) AS x2, round(least(480, y2 + (y2 - y1) * 0.45::DOUBLE), 6) AS y2 FROM sv_frames WHERE valid_face")
def prj_7(spark, sf_dir):
    out = [F.round(c, 6).alias(n) for c, n in zip(G.expanded(G.box(), 640, 480), windows.BOX)]
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *out)


@query(
    "prj_9_seed_score",
    "SELECT clip_id, frame_idx, round((x2 - x1) * (y2 - y1) * greatest(0.2::DOUBLE, 1 - sqrt(pow((x1 + x2) / 2 - 320, 2) + pow((y1 + y2) / 2 - 240, 2)) / 400.0::DOUBLE), 6) AS score FROM sv_frames WHERE valid_face",
)
def prj_9(spark, sf_dir):
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", F.round(G.seed_score(G.box(), 640, 480), 6).alias("score"))


@query("prj_20_soft_closed", "SELECT clip_id, frame_idx, round(CASE WHEN mar < 0.12::DOUBLE THEN open_prob * greatest(0, mar / 0.12::DOUBLE) ELSE open_prob END, 6) AS open_prob FROM sv_frames")
def prj_20(spark, sf_dir):
    return T.frames(spark, sf_dir).select("clip_id", "frame_idx", F.round(G.soft_closed(F.col("open_prob"), F.col("mar"), 0.12), 6).alias("open_prob"))


@query("prj_22_mean_std_transfer", ", s AS (SELECT clip_id, avg(open_prob) AS m, stddev_pop(open_prob) AS d, avg(mar) AS m2, stddev_pop(mar) AS d2 FROM sv_frames GROUP BY 1) SELECT clip_id, frame_idx, round((open_prob - m) / nullif(d, 0) * d2 + m2, 5) AS matched FROM sv_frames JOIN s USING (clip_id)")
def prj_22(spark, sf_dir):
    rows = T.frames(spark, sf_dir)
    s = rows.groupBy("clip_id").agg(F.avg("open_prob").alias("m"), F.stddev_pop("open_prob").alias("d"), F.avg("mar").alias("m2"), F.stddev_pop("mar").alias("d2"))
    matched = (F.col("open_prob") - F.col("m")) / F.nullif(F.col("d"), F.lit(0.0)) * F.col("d2") + F.col("m2")
    return rows.join(s, "clip_id").select("clip_id", "frame_idx", F.round(matched, 5).alias("matched"))


@query("prj_24_decibel", "SELECT clip_id, frame_idx, round(20 * log10(greatest(1e-5::DOUBLE, open_prob)), 6) AS db FROM sv_base")
def prj_24(spark, sf_dir):
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", F.round(G.decibel(F.col("open_prob")), 6).alias("db"))


@query("flt_1_min_area", "SELECT clip_id, frame_idx FROM sv_frames WHERE coalesce((x2 - x1) * (y2 - y1), 0) >= 0.005::DOUBLE * 640 * 480 AND y1 >= 23")
def flt_1(spark, sf_dir):
    return T.frames(spark, sf_dir).where((G.area(G.box()) >= 0.005 * 640 * 480) & (F.col("y1") >= 23)).select("clip_id", "frame_idx")


@query("flt_6_eligible", "SELECT clip_id, frame_idx FROM mask WHERE on_ AND valid_face AND x2 > x1 AND y2 > y1")
def flt_6(spark, sf_dir):
    return mask(spark, sf_dir).where("on_ and valid_face and x2 > x1 and y2 > y1").select("clip_id", "frame_idx")


@query("flt_8_valid_segments", "SELECT clip_id, pos, round(seg_start, 6) AS seg_start, round(seg_end, 6) AS seg_end FROM sv_segments WHERE seg_end - seg_start > 0.2")
def flt_8(spark, sf_dir):
    return T.segments(spark, sf_dir).where("seg_end - seg_start > 0.2D").select("clip_id", "pos", *six("seg_start", "seg_end"))


@query("jon_2_cyclic", "SELECT a.clip_id, a.frame_idx, b.frame_idx AS src, b.open_prob AS value FROM sv_base a JOIN sv_clips c USING (clip_id) JOIN sv_base b ON b.clip_id = a.clip_id AND b.frame_idx = (a.frame_idx + 3) % n_frames")
def jon_2(spark, sf_dir):
    left = T.base(spark, sf_dir).select("clip_id", "frame_idx").join(T.clips(spark, sf_dir), "clip_id")
    right = T.base(spark, sf_dir).select("clip_id", F.col("frame_idx").alias("src"), F.col("open_prob").alias("value"))
    return sampling.cyclic_pairs(left, right, "clip_id", "frame_idx", "src", "n_frames", 3).select("clip_id", "frame_idx", "src", "value")


@query("jon_3_boomerang", "SELECT clip_id, frame_idx, open_prob FROM sv_base UNION ALL SELECT clip_id, 2 * n_frames - 1 - frame_idx, open_prob FROM sv_base JOIN sv_clips USING (clip_id)")
def jon_3(spark, sf_dir):
    rows = T.base(spark, sf_dir).select("clip_id", "frame_idx", "open_prob").join(T.clips(spark, sf_dir).select("clip_id", "n_frames"), "clip_id")
    return sampling.boomerang(rows, "n_frames").select("clip_id", "frame_idx", "open_prob")


@query(
    "jon_10_primary_vote",
    f""", m AS (SELECT a.clip_id, a.frame_idx, b.track_id, {iou_sql("a", "b")} AS iou FROM sv_frames a JOIN sv_tracks b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx WHERE a.valid_face),
    best AS (SELECT * FROM m WHERE iou >= 0.1 QUALIFY row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY iou DESC, track_id) = 1)
    SELECT clip_id, track_id, round(sum(iou), 6) AS votes FROM best GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY sum(iou) DESC, min(frame_idx), track_id) = 1""",
)
def jon_10(spark, sf_dir):
    from pyspark.sql import Window

    face = T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *[F.col(c).alias(f"o{c}") for c in windows.BOX])
    met = T.tracks(spark, sf_dir).join(face, ["clip_id", "frame_idx"]).withColumn("iou", G.iou(G.box("o"), G.box())).where("iou >= 0.1")
    best = Window.partitionBy("clip_id", "frame_idx").orderBy(F.desc("iou"), "track_id")
    votes = met.withColumn("rn", F.row_number().over(best)).where("rn = 1").groupBy("clip_id", "track_id").agg(F.sum("iou").alias("v"), F.min("frame_idx").alias("first"))
    top = Window.partitionBy("clip_id").orderBy(F.desc("v"), "first", "track_id")
    return votes.withColumn("rn", F.row_number().over(top)).where("rn = 1").select("clip_id", "track_id", F.round("v", 6).alias("votes"))


@query("jon_13_resume", "SELECT f.clip_id, count(*) AS n FROM sv_frames f WHERE NOT EXISTS (SELECT 1 FROM sv_segments s WHERE s.clip_id = f.clip_id AND s.pos = 12) GROUP BY 1")
def jon_13(spark, sf_dir):
    done = T.segments(spark, sf_dir).where("pos = 12").select("clip_id").distinct()
    return T.frames(spark, sf_dir).join(done, "clip_id", "left_anti").groupBy("clip_id").agg(F.count("*").alias("n"))


@query("jon_16_overlay", "SELECT t.clip_id, t.frame_idx, t.track_id, CASE WHEN t.track_id = 0 THEN coalesce(f.mar, t.open_prob) ELSE t.open_prob END AS open_prob FROM sv_tracks t LEFT JOIN sv_frames f ON f.clip_id = t.clip_id AND f.frame_idx = t.frame_idx AND f.open_prob < 0.5")
def jon_16(spark, sf_dir):
    over = T.frames(spark, sf_dir).where("open_prob < 0.5D").select("clip_id", "frame_idx", "mar")
    met = T.tracks(spark, sf_dir).join(over, ["clip_id", "frame_idx"], "left")
    return met.select("clip_id", "frame_idx", "track_id", F.when(F.col("track_id") == 0, F.coalesce("mar", "open_prob")).otherwise(F.col("open_prob")).alias("open_prob"))


# ---------------------------------------------------------------- aggregates, samples, sets


@query("agg_1_true_frames", "SELECT clip_id, count(*) AS n_frames, count(*) FILTER (on_) AS speaking FROM mask GROUP BY 1")
def agg_1(spark, sf_dir):
    return mask(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("n_frames"), F.count_if("on_").alias("speaking"))


@query("agg_2_longest_run", "SELECT m.clip_id, m.shot_id, count(*) AS n_frames, coalesce(max(r.n), 0) AS longest FROM mask m LEFT JOIN (SELECT clip_id, shot_id, max(n_frames) AS n FROM runs GROUP BY 1, 2) r ON r.clip_id = m.clip_id AND r.shot_id = m.shot_id GROUP BY 1, 2")
def agg_2(spark, sf_dir):
    longest = shot_runs(spark, sf_dir).groupBy("clip_id", "shot_id").agg(F.max("n_frames").alias("longest"))
    return runs.shot_ranges(mask(spark, sf_dir)).join(longest, ["clip_id", "shot_id"], "left").select("clip_id", "shot_id", "n_frames", F.coalesce("longest", F.lit(0)).alias("longest"))


@query("agg_3_shot_ranges", "SELECT clip_id, shot_id, min(frame_idx) AS first_frame, max(frame_idx) + 1 AS end_excl FROM sv_frames GROUP BY 1, 2")
def agg_3(spark, sf_dir):
    return runs.shot_ranges(T.frames(spark, sf_dir)).select("clip_id", "shot_id", "first_frame", "end_excl")


@query(
    "agg_6_multiscale_mean",
    """, s AS (SELECT clip_id, frame_idx, unnest([1, 2, 3]) AS scale, open_prob FROM sv_frames),
    g AS (SELECT clip_id, CAST(floor(frame_idx / scale) AS INTEGER) * scale AS b, scale, avg(open_prob) AS m FROM s GROUP BY 1, 2, 3)
    SELECT s.clip_id, s.frame_idx, round(avg(g.m), 6) AS score FROM s JOIN g ON g.clip_id = s.clip_id AND g.scale = s.scale AND g.b = CAST(floor(s.frame_idx / s.scale) AS INTEGER) * s.scale GROUP BY 1, 2""",
)
def agg_6(spark, sf_dir):
    rows = T.frames(spark, sf_dir).select("clip_id", "frame_idx", "open_prob", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("scale"))
    rows = rows.withColumn("b", F.floor(F.col("frame_idx") / F.col("scale")))
    means = rows.groupBy("clip_id", "scale", "b").agg(F.avg("open_prob").alias("m"))
    return rows.join(means, ["clip_id", "scale", "b"]).groupBy("clip_id", "frame_idx").agg(F.round(F.avg("m"), 6).alias("score"))


@query("agg_7_mean_truncated", "SELECT clip_id, CAST(trunc(avg(x1)) AS INTEGER) AS x1 FROM sv_frames GROUP BY 1")
def agg_7(spark, sf_dir):
    return T.frames(spark, sf_dir).groupBy("clip_id").agg(F.avg("x1").cast("int").alias("x1"))


@query("agg_11_any_track", "SELECT clip_id, frame_idx, bool_or(open_prob >= 0.3 AND track_id > 0) AS any_on FROM sv_tracks GROUP BY 1, 2")
def agg_11(spark, sf_dir):
    return T.tracks(spark, sf_dir).groupBy("clip_id", "frame_idx").agg(F.bool_or((F.col("open_prob") >= 0.3) & (F.col("track_id") > 0)).alias("any_on"))


@query("agg_15_track_ids", "SELECT DISTINCT clip_id, track_id FROM sv_tracks")
def agg_15(spark, sf_dir):
    return T.tracks(spark, sf_dir).select("clip_id", "track_id").distinct()


@query(
    "top_1_knn",
    """WITH a AS (SELECT label, min(vec_id) AS anchor_id, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1)
    SELECT label, anchor_id, vec_id, round(dist, 4) AS dist, rank FROM (
      SELECT e.label, anchor_id, vec_id, list_distance(e.embedding::DOUBLE[], anchor::DOUBLE[]) AS dist, row_number() OVER (PARTITION BY e.label ORDER BY list_distance(e.embedding::DOUBLE[], anchor::DOUBLE[]), vec_id) - 1 AS rank FROM embeddings e JOIN a USING (label))
    WHERE rank BETWEEN 1 AND 5""",
    views=False,
)
def top_1(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings")
    anchors = rows.groupBy("label").agg(F.min("vec_id").alias("anchor_id"), F.min_by("embedding", "vec_id").alias("anchor"))
    got = sampling.nearest_to(rows, anchors, "label", "vec_id", G.euclidean(F.col("embedding"), F.col("anchor")), 5)
    return got.select("label", "anchor_id", "vec_id", F.round("dist", 4).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@query("top_6_newest", "SELECT clip_id, pos FROM sv_segments QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY pos DESC) <= 3")
def top_6(spark, sf_dir):
    return sampling.newest(T.segments(spark, sf_dir), ["clip_id"], "pos", 3).select("clip_id", "pos")


@query(
    "top_8_length_penalty",
    ", c AS (SELECT clip_id, frame_idx, ln(open_prob + 0.01::DOUBLE) * (1 + k % 7) AS lp, 1 + k % 7 AS len FROM sv_base) SELECT clip_id, frame_idx FROM c QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY round(lp / pow((len + 5) / 6.0::DOUBLE, 0.6::DOUBLE), 9) DESC, frame_idx) = 1",
)
def top_8(spark, sf_dir):
    rows = T.base(spark, sf_dir).withColumn("len", 1 + F.col("k") % 7)
    # rounded so that candidates which are equal but for the last bit tie
    rows = rows.withColumn("lp", F.round(F.log(F.col("open_prob") + 0.01) * F.col("len") / F.pow((F.col("len") + 5) / 6.0, F.lit(0.6)), 9)).withColumn("one", F.lit(1.0))
    return sampling.length_penalised_best(rows, ["clip_id"], "lp", "one", tie="frame_idx").select("clip_id", "frame_idx")


@query("smp_3_window", ", f AS (SELECT clip_id, min(frame_idx) AS s FROM mask WHERE on_ GROUP BY 1) SELECT clip_id, CAST(unnest(range(s, s + 5)) AS INTEGER) AS frame_idx FROM f")
def smp_3(spark, sf_dir):
    first = mask(spark, sf_dir).where("on_").groupBy("clip_id").agg(F.min("frame_idx").alias("s"))
    return first.select("clip_id", F.explode(sampling.window_from(F.col("s"), 5)).alias("frame_idx"))


@query(
    "rsm_1_nearest_frames",
    "SELECT clip_id, CAST(i AS INTEGER) AS out_frame, CAST(least(n_frames - 1, round_even(i * 25.0::DOUBLE / 10.0::DOUBLE, 0)) AS INTEGER) AS src_frame FROM (SELECT *, unnest(range(0, CAST(greatest(1, round_even(n_frames / 25.0::DOUBLE * 10.0::DOUBLE, 0)) AS BIGINT))) AS i FROM sv_clips)",
)
def rsm_1(spark, sf_dir):
    return sampling.source_frames(T.clips(spark, sf_dir), 10.0)


@query(
    "jon_11_as_of_frames",
    "SELECT clip_id, CAST(i AS INTEGER) AS out_frame, CAST(ceil(i * 25.0::DOUBLE / 12.0::DOUBLE - 1e-9) AS INTEGER) AS src_frame FROM (SELECT *, unnest(range(0, CAST(floor(n_frames / 25.0::DOUBLE * 12.0::DOUBLE) AS BIGINT))) AS i FROM sv_clips)",
)
def jon_11(spark, sf_dir):
    return sampling.first_at_or_after(T.clips(spark, sf_dir), 12.0)


@query("set_1_union", "SELECT clip_id, frame_idx FROM mask WHERE on_ UNION ALL SELECT clip_id, frame_idx FROM mask WHERE NOT valid_face")
def set_1(spark, sf_dir):
    rows = mask(spark, sf_dir)
    return rows.where("on_").select("clip_id", "frame_idx").unionByName(rows.where("not valid_face").select("clip_id", "frame_idx"))


@query("set_2_intersection", "SELECT clip_id, k FROM sv_base WHERE event_type = 'view' INTERSECT SELECT clip_id, k FROM sv_base WHERE event_type = 'click'")
def set_2(spark, sf_dir):
    rows = T.base(spark, sf_dir)
    return rows.where("event_type = 'view'").select("clip_id", "k").intersect(rows.where("event_type = 'click'").select("clip_id", "k"))


@query("set_3_complement", "SELECT clip_id, k FROM sv_base b WHERE NOT EXISTS (SELECT 1 FROM sv_base o WHERE o.clip_id = b.clip_id AND o.k = b.k AND o.event_type = 'click')")
def set_3(spark, sf_dir):
    rows = T.base(spark, sf_dir)
    return rows.select("clip_id", "k").join(rows.where("event_type = 'click'").select("clip_id", "k").distinct(), ["clip_id", "k"], "left_anti")


@query("set_4_first_seen", "SELECT clip_id, k, min(frame_idx) AS first_frame FROM sv_base GROUP BY 1, 2")
def set_4(spark, sf_dir):
    return T.base(spark, sf_dir).groupBy("clip_id", "k").agg(F.min("frame_idx").alias("first_frame"))


# ---------------------------------------------------------------- text


@query(
    "txt_8_timestamp",
    """SELECT clip_id, pos, printf('%02d:%02d.%03d', CAST(ms // 60000 % 60 AS INTEGER), CAST(ms // 1000 % 60 AS INTEGER), CAST(ms % 1000 AS INTEGER)) AS stamp,
    printf('%02d:%02d:%02d,%03d', CAST(ms // 3600000 AS INTEGER), CAST(ms // 60000 % 60 AS INTEGER), CAST(ms // 1000 % 60 AS INTEGER), CAST(ms % 1000 AS INTEGER)) AS long_stamp
    FROM (SELECT clip_id, pos, CAST(round_even(seg_start * 1000, 0) AS BIGINT) AS ms FROM sv_segments)""",
)
def txt_8(spark, sf_dir):
    at = F.col("seg_start")
    return T.segments(spark, sf_dir).select("clip_id", "pos", X.timestamp(at).alias("stamp"), X.timestamp(at, True, ",").alias("long_stamp"))


@query("txt_10_gender", "SELECT conv_id, turn, CASE WHEN lower(trim(role)) IN ('m', 'male', 'man') THEN 'male' WHEN lower(trim(role)) IN ('f', 'female', 'woman') THEN 'female' END AS gender FROM conversations", views=False)
def txt_10(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.gender(F.col("role")).alias("gender"))


@query("txt_7_compression")
def txt_7(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", F.round(X.compression_ratio("text"), 6).alias("ratio"))


@query("txt_3_normalised")
def txt_3(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", X.normalised(remove_diacritics=True)("text").alias("normal"))


@query("src_11_file_kind", "SELECT page_id, CASE WHEN lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'bmp', 'tif', 'tiff') THEN 'image' WHEN lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('avi', 'mp4', 'mov', 'flv', 'mkv') THEN 'video' ELSE 'unsupported' END AS kind FROM pages", views=False)
def src_11(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.file_kind(F.col("url")).alias("kind"))


@query(
    "snk_3_transcript",
    """SELECT clip_id, string_agg(line, chr(10) ORDER BY pos) AS vtt FROM (SELECT clip_id, pos, printf('%02d:%02d.%03d', CAST(a // 60000 % 60 AS INTEGER), CAST(a // 1000 % 60 AS INTEGER), CAST(a % 1000 AS INTEGER)) || ' --> ' || printf('%02d:%02d.%03d', CAST(b // 60000 % 60 AS INTEGER), CAST(b // 1000 % 60 AS INTEGER), CAST(b % 1000 AS INTEGER)) || ' ' || coalesce(gender, '?') AS line
    FROM (SELECT *, CAST(round_even(seg_start * 1000, 0) AS BIGINT) AS a, CAST(round_even(seg_end * 1000, 0) AS BIGINT) AS b FROM sv_segments)) GROUP BY clip_id""",
)
def snk_3(spark, sf_dir):
    line = F.concat(X.timestamp(F.col("seg_start")), F.lit(" --> "), X.timestamp(F.col("seg_end")), F.lit(" "), F.coalesce("gender", F.lit("?")))
    lines = T.segments(spark, sf_dir).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lines.select("clip_id", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("vtt"))


# ---------------------------------------------------------------- order-dependent


def detections(spark, sf_dir):
    rows = T.tracks(spark, sf_dir)
    return rows.select("clip_id", "frame_idx", F.col("track_id").alias("det_id"), *windows.BOX, (F.col("open_prob") * (F.col("track_id") + 1)).alias("score"))


def suppressed_sql(threshold: float, pixel: int, slack: str, least_before: float = 0.0) -> str:
    """The boxes that are kept of at most three a frame."""
    w, h = f"greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + {pixel})", f"greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + {pixel})"
    size = f"({{0}}.x2 - {{0}}.x1 + {pixel}) * ({{0}}.y2 - {{0}}.y1 + {pixel})"
    over = f"{w} * {h} / ({size.format('a')} + {size.format('b')} - {w} * {h} + {slack})"
    return f""", det AS (SELECT clip_id, frame_idx, track_id AS det_id, x1, y1, x2, y2, open_prob * (track_id + 1) AS score FROM sv_tracks WHERE open_prob * (track_id + 1) >= {least_before}),
    r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY score DESC, det_id) AS rn FROM det),
    o AS (SELECT a.clip_id, a.frame_idx, bool_or({over} > {threshold}) FILTER (a.rn = 1 AND b.rn = 2) AS o12, bool_or({over} > {threshold}) FILTER (a.rn = 1 AND b.rn = 3) AS o13, bool_or({over} > {threshold}) FILTER (a.rn = 2 AND b.rn = 3) AS o23
      FROM r a JOIN r b ON a.clip_id = b.clip_id AND a.frame_idx = b.frame_idx AND a.rn < b.rn GROUP BY 1, 2),
    kept AS (SELECT r.* FROM r LEFT JOIN o USING (clip_id, frame_idx) WHERE rn = 1 OR (rn = 2 AND NOT o12) OR (rn = 3 AND NOT o13 AND NOT (o23 AND NOT o12)))
    SELECT clip_id, frame_idx, det_id, x1, y1, x2, y2, score FROM kept"""


@query("top_10_suppress", suppressed_sql(0.4, 1, "1e-6"))
def top_10(spark, sf_dir):
    return boxes.suppress(detections(spark, sf_dir), 0.4, ["clip_id"], slack=1e-6)


@query("flt_3_confident_before_suppression", suppressed_sql(0.4, 1, "1e-6", 0.6))
def flt_3(spark, sf_dir):
    """Boxes that are sure enough go into the suppression; the others neither stay nor suppress."""
    return boxes.suppress(detections(spark, sf_dir).where("score >= 0.6D"), 0.4, ["clip_id"], slack=1e-6)


@query("top_11_suppress_plain", suppressed_sql(0.3, 0, "0") + " WHERE score > 0.5")
def top_11(spark, sf_dir):
    return boxes.suppress(detections(spark, sf_dir), 0.3, ["clip_id"], pixel=0.0).where("score > 0.5")


@query("trk_1_one_face")
def trk_1(spark, sf_dir):
    return tracking.track_one(detections(spark, sf_dir))


@query("trk_2_many_faces")
def trk_2(spark, sf_dir):
    return tracking.track_many(detections(spark, sf_dir), T.frames(spark, sf_dir))


@query("trk_2_streamed")
def trk_2_streamed(spark, sf_dir):
    """Looked for at every frame, so that all pairs are matched, and forgotten soon."""
    return tracking.track_many(detections(spark, sf_dir), T.frames(spark, sf_dir), stride=1, least_iou=0.5, most_missed=2)


@query("trk_3_stride", "SELECT clip_id, frame_idx FROM sv_frames JOIN sv_clips USING (clip_id) WHERE frame_idx % 3 = 0 OR frame_idx = n_frames - 1")
def trk_3(spark, sf_dir):
    return T.frames(spark, sf_dir).join(T.clips(spark, sf_dir), "clip_id").where("frame_idx % 3 = 0 or frame_idx = n_frames - 1").select("clip_id", "frame_idx")


def numbered_sql(flags: str, least: int) -> str:
    """Shot numbers from a table of cut flags (clip_id, frame_idx, cut), frame by frame."""
    return f""", {flags}, walk AS (
      SELECT clip_id, frame_idx, 0 AS n, 0 AS last FROM flags WHERE frame_idx = 0
      UNION ALL SELECT f.clip_id, f.frame_idx, CASE WHEN f.cut AND f.frame_idx - w.last >= {least} THEN w.n + 1 ELSE w.n END, CASE WHEN f.cut AND f.frame_idx - w.last >= {least} THEN f.frame_idx ELSE w.last END
      FROM walk w JOIN flags f ON f.clip_id = w.clip_id AND f.frame_idx = w.frame_idx + 1)
    SELECT clip_id, frame_idx, n AS shot_no FROM walk"""


RECURSIVE = VIEWS.replace("WITH sv_base", "WITH RECURSIVE sv_base", 1)


@query("win_6_number_shots", RECURSIVE + numbered_sql("flags AS (SELECT clip_id, frame_idx, event_type = 'purchase' AS cut FROM sv_base)", 5), views=False)
def win_6(spark, sf_dir):
    return scans.number_shots(T.base(spark, sf_dir), F.col("event_type") == "purchase", 5)


@query(
    "win_6_cuts_by_distance",
    RECURSIVE
    + numbered_sql("d AS (SELECT clip_id, frame_idx, abs(open_prob - lag(open_prob) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS dist, abs(k - lag(k) OVER (PARTITION BY clip_id ORDER BY frame_idx)) AS mae FROM sv_base), flags AS (SELECT clip_id, frame_idx, coalesce(dist >= 0.45 OR (dist >= 0.30 AND mae >= 25), false) AS cut FROM d)", 3),
    views=False,
)
def win_6_distance(spark, sf_dir):
    """Shots from distances of adjacent frames: large ones, or fair ones with a large difference."""
    from pyspark.sql import Window

    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    rows = T.base(spark, sf_dir).withColumns({"dist": F.abs(F.col("open_prob") - F.lag("open_prob").over(w)), "mae": F.abs(F.col("k") - F.lag("k").over(w))})
    return scans.number_shots(rows, boxes.cut_between(F.col("dist"), F.col("mae")), 3)


@query(
    "prj_26_undo_pre_emphasis",
    RECURSIVE
    + """, walk AS (SELECT clip_id, frame_idx, open_prob AS y FROM sv_base WHERE frame_idx = 0
      UNION ALL SELECT b.clip_id, b.frame_idx, b.open_prob + 0.97::DOUBLE * w.y FROM walk w JOIN sv_base b ON b.clip_id = w.clip_id AND b.frame_idx = w.frame_idx + 1)
    SELECT clip_id, frame_idx, round(y, 6) AS restored FROM walk""",
    views=False,
)
def prj_26(spark, sf_dir):
    return scans.recurrence(T.base(spark, sf_dir), "open_prob", 0.97).select("clip_id", "frame_idx", *six("restored"))


@query(
    "trk_4_reuse",
    f""", e AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) - 1 AS j, lead(frame_idx) OVER (PARTITION BY clip_id ORDER BY frame_idx) IS NULL AS last_ FROM mask WHERE on_ AND valid_face),
    b AS (SELECT *, j // 3 AS block, j % 3 AS i FROM e),
    one AS (SELECT b.clip_id, b.block, b.last_ OR b.frame_idx - a.frame_idx > 9 OR {iou_sql("a", "b")} < 0.35 AS again FROM b JOIN b a ON a.clip_id = b.clip_id AND a.block = b.block AND a.i = 0 WHERE b.i = 1),
    two AS (SELECT b.clip_id, b.block, a.frame_idx AS source, b.last_ OR b.frame_idx - a.frame_idx > 9 OR {iou_sql("a", "b")} < 0.35 AS again FROM b JOIN one o ON o.clip_id = b.clip_id AND o.block = b.block JOIN b a ON a.clip_id = b.clip_id AND a.block = b.block AND a.i = CASE WHEN o.again THEN 1 ELSE 0 END WHERE b.i = 2)
    SELECT b.clip_id, b.frame_idx, CASE b.i WHEN 0 THEN b.frame_idx WHEN 1 THEN CASE WHEN o.again THEN b.frame_idx ELSE a.frame_idx END ELSE CASE WHEN t.again THEN b.frame_idx ELSE t.source END END AS source
    FROM b LEFT JOIN one o USING (clip_id, block) LEFT JOIN two t USING (clip_id, block) LEFT JOIN b a ON a.clip_id = b.clip_id AND a.block = b.block AND a.i = 0""",
)
def trk_4(spark, sf_dir):
    """Which speaking frame's restored face each speaking frame takes."""
    return boxes.reuse_plan(mask(spark, sf_dir).where("on_ and valid_face"), ["clip_id"]).select("clip_id", "frame_idx", "source")


# ---------------------------------------------------------------- flagship


@query(
    "pipe_speaking_gate",
    GATE
    + """, gi AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id, shot_id, motion ORDER BY frame_idx) AS h FROM gate),
    gk AS (SELECT *, motion AND count(*) OVER (PARTITION BY clip_id, shot_id, motion, h) >= 3 AS kept FROM gi),
    gd AS (SELECT k.*, f.valid_face AND bool_or(kept) OVER (PARTITION BY k.clip_id, k.shot_id ORDER BY k.frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM gk k JOIN sv_frames f USING (clip_id, frame_idx)),
    gr AS (SELECT *, s AND NOT coalesce(lag(s) OVER (PARTITION BY clip_id, shot_id ORDER BY frame_idx), false) AS starts FROM gd)
    SELECT clip_id, count(*) AS n_frames, count(*) FILTER (s) AS speaking_frames, count(*) FILTER (starts) AS n_runs FROM gr GROUP BY 1""",
)
def speaking_gate(spark, sf_dir):
    """Lip motion, runs of three frames at least, grown by two on frames with a face; counted by clip."""
    from pyspark.sql import Window

    gate = windows.motion_gate(T.frames(spark, sf_dir))
    kept = runs.keep_runs(gate, F.col("motion"), 3)
    grown = runs.dilate(kept, F.col("kept"), 2, F.col("valid_face"))
    before = F.lag("dilated").over(Window.partitionBy(*runs.SHOT).orderBy("frame_idx"))
    starts = grown.withColumn("starts", F.col("dilated") & ~F.coalesce(before, F.lit(False)))
    return starts.groupBy("clip_id").agg(F.count("*").alias("n_frames"), F.count_if("dilated").alias("speaking_frames"), F.count_if("starts").alias("n_runs"))
