"""Queries of the operators for clips of any length: chunks with margins, sweeps, matching, scans, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import box, iou
from ..operators import boxes, chunks, intervals, matching, runs, scans, search, windows
from ..sources import timeline as T
from .registry import GATE, RECURSIVE, SPLIT_SQL, iou_sql, mask, numbered_sql, query, six

# ---------------------------------------------------------------- chunks


@query(
    "str_2_halo_windows",
    GATE
    + """, top AS (SELECT clip_id, frame_idx, CASE WHEN open_prob IS NOT NULL THEN max(open_prob) OVER (PARTITION BY clip_id, shot_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS open_max FROM sv_frames),
    wide AS (SELECT clip_id, frame_idx, bool_or(on_) OVER (PARTITION BY clip_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM mask)
    SELECT clip_id, frame_idx, open_max, dilated, motion, round(activity, 6) AS activity FROM top JOIN wide USING (clip_id, frame_idx) JOIN gate USING (clip_id, frame_idx)""",
)
def str_2(spark, sf_dir, size: int = 6):
    """Three windows chunk by chunk; margins are longer than half a chunk, and runs go through several."""

    def op(df, keys):
        shot = (*keys, "shot_id")
        df = windows.motion_gate(windows.temporal_max(df, "open_prob", keys=shot), keys=shot)
        return runs.dilate(df, F.col("on_"), 2, keys=keys)

    done = chunks.by_chunks(mask(spark, sf_dir), 4, op, size)
    return done.select("clip_id", "frame_idx", "open_max", "dilated", "motion", *six("activity"))


@query(
    "str_2_chunked_runs",
    """, w AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip_id, on_ ORDER BY frame_idx) AS h FROM mask)
    SELECT clip_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_frames FROM w WHERE on_ GROUP BY clip_id, h""",
)
def str_2_runs(spark, sf_dir, size: int = 3):
    return chunks.true_runs(mask(spark, sf_dir), F.col("on_"), size)


# ---------------------------------------------------------------- sweep


@query(
    "jon_8_sweep",
    SPLIT_SQL.replace("gap <= 0.5", "gap <= 0.12")
    + "SELECT clip_id, speaker_id, count(*) AS pieces, count(DISTINCT pos) AS segments, round(sum(t_end - t_start), 6) AS seconds FROM assigned GROUP BY clip_id, speaker_id",
)
def jon_8(spark, sf_dir):
    """Speaking time by speaker, with a narrower reach than `int_8`."""
    given = intervals.assign_split(T.segments(spark, sf_dir), T.intervals(spark, sf_dir), most_gap=0.12)
    return given.groupBy("clip_id", "speaker_id").agg(F.count("*").alias("pieces"), F.count_distinct("pos").alias("segments"), F.round(F.sum(F.col("t_end") - F.col("t_start")), 6).alias("seconds"))


# ---------------------------------------------------------------- matching

EDGES = """, edges AS (SELECT a.clip_id, a.frame_idx, a.track_id AS l, b.track_id AS r, """ + iou_sql("a", "b") + """ AS w
  FROM sv_tracks a JOIN sv_tracks b ON b.clip_id = a.clip_id AND b.frame_idx = a.frame_idx + 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_idx ORDER BY w DESC, l DESC, r DESC) AS k FROM edges WHERE w >= 0.3)
"""


@query(
    "jon_9_greedy_pairs",
    RECURSIVE
    + EDGES
    + """, walk AS (
      SELECT clip_id, frame_idx, k, l, r, w, true AS taken, [l] AS ls, [r] AS rs FROM ranked WHERE k = 1
      UNION ALL
      SELECT n.clip_id, n.frame_idx, n.k, n.l, n.r, n.w, NOT list_contains(p.ls, n.l) AND NOT list_contains(p.rs, n.r),
        CASE WHEN NOT list_contains(p.ls, n.l) AND NOT list_contains(p.rs, n.r) THEN list_append(p.ls, n.l) ELSE p.ls END,
        CASE WHEN NOT list_contains(p.ls, n.l) AND NOT list_contains(p.rs, n.r) THEN list_append(p.rs, n.r) ELSE p.rs END
      FROM walk p JOIN ranked n ON n.clip_id = p.clip_id AND n.frame_idx = p.frame_idx AND n.k = p.k + 1)
    SELECT clip_id, frame_idx, l AS "left", r AS "right", round(w, 6) AS overlap FROM walk WHERE taken""",
    views=False,
)
def jon_9(spark, sf_dir):
    """Faces of a frame and of the next one, one to one, by falling overlap of 0.3 or more."""
    faces = T.tracks(spark, sf_dir)
    here = faces.select("clip_id", "frame_idx", F.col("track_id").alias("left"), *[F.col(c).alias(f"a_{c}") for c in boxes.BOX])
    there = faces.select("clip_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("track_id").alias("right"), *boxes.BOX)
    edges = here.join(there, ["clip_id", "frame_idx"]).withColumn("overlap", iou([F.col(f"a_{c}") for c in boxes.BOX], box())).where("overlap >= 0.3")
    return matching.greedy_pairs(edges.select("clip_id", "frame_idx", "left", "right", "overlap"), ["clip_id", "frame_idx"], "left", "right", "overlap").select("clip_id", "frame_idx", "left", "right", *six("overlap"))


# ---------------------------------------------------------------- scans


@query("win_6_doubling", RECURSIVE + numbered_sql("flags AS (SELECT clip_id, frame_idx, event_type IN ('purchase', 'click') AS cut FROM sv_base)", 2), views=False)
def win_6_doubling(spark, sf_dir):
    return scans.number_shots(T.base(spark, sf_dir), F.col("event_type").isin("purchase", "click"), 2)


@query(
    "prj_26_scan",
    RECURSIVE
    + """, walk AS (SELECT clip_id, frame_idx, open_prob AS y, open_prob AS s FROM sv_base WHERE frame_idx = 0
      UNION ALL SELECT b.clip_id, b.frame_idx, b.open_prob + 0.97::DOUBLE * w.y, b.open_prob + w.s FROM walk w JOIN sv_base b ON b.clip_id = w.clip_id AND b.frame_idx = w.frame_idx + 1)
    SELECT clip_id, frame_idx, round(y, 6) AS restored, round(s, 6) AS summed FROM walk""",
    views=False,
)
def prj_26_scan(spark, sf_dir):
    """Inverse pre-emphasis, and the same with a factor of 1; parts of four frames, so that maps are composed over several rounds."""
    rows = T.base(spark, sf_dir)
    restored = scans.recurrence(rows, "open_prob", 0.97, part=4)
    summed = scans.recurrence(rows, "open_prob", 1.0, "summed", part=4)
    return restored.join(summed, ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", *six("restored", "summed"))


# ---------------------------------------------------------------- search


@query(
    "top_7_search",
    RECURSIVE
    + """, lp AS (SELECT clip_id, frame_idx AS step, p AS prev, t AS token, -((k * 7 + p * 13 + t * 29 + frame_idx) % 50 + 1) / 8.0::DOUBLE AS lp
      FROM (SELECT *, unnest(range(4)) AS t FROM (SELECT *, unnest(range(3)) AS p FROM sv_base))),
    walk AS (
      SELECT clip_id, 0 AS step, 0 AS beam, [0] AS tokens, 0.0::DOUBLE AS score, false AS done, 0 AS at_, 0 AS rank_ FROM sv_clips
      UNION ALL
      SELECT clip_id, step + 1, CAST(saved AS INTEGER), tokens, score, done, at_, CAST(rank_ AS INTEGER) FROM (
        SELECT *, count(*) FILTER (done) OVER (PARTITION BY clip_id ORDER BY at_, done DESC, rank_) AS n_done FROM (
          SELECT *, coalesce(count(*) FILTER (was_live AND NOT done) OVER (PARTITION BY clip_id ORDER BY was_live, score DESC, beam, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS saved,
                 CASE WHEN was_live THEN row_number() OVER (PARTITION BY clip_id ORDER BY was_live, score DESC, beam, place) ELSE old_rank END AS rank_ FROM (
            SELECT * FROM (
              SELECT w.clip_id, w.step, w.beam, NOT w.done AS was_live, w.rank_ AS old_rank, w.done OR l.token = 3 AS done, CASE WHEN w.done THEN w.at_ ELSE w.step END AS at_,
                     CASE WHEN w.done THEN w.tokens ELSE list_append(w.tokens, CAST(l.token AS INTEGER)) END AS tokens, w.score + coalesce(l.lp, 0.0) AS score,
                     row_number() OVER (PARTITION BY w.clip_id, w.done, w.beam, CASE WHEN w.done THEN w.tokens END ORDER BY l.lp DESC, l.token) AS place,
                     count(*) FILTER (w.done) OVER (PARTITION BY w.clip_id) AS were_done, count(l.token) OVER (PARTITION BY w.clip_id) AS goes_on
              FROM walk w LEFT JOIN lp l ON NOT w.done AND l.clip_id = w.clip_id AND l.step = w.step AND l.prev = w.tokens[len(w.tokens)] WHERE w.step < 14)
            WHERE were_done < 4 AND goes_on > 0 AND place <= 4 AND (done OR score IS NOT NULL))
        ) WHERE NOT was_live OR saved < 3
      ) WHERE NOT done OR n_done <= 4),
    last AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY clip_id)),
    ended AS (SELECT clip_id, CASE WHEN done THEN tokens ELSE list_append(tokens, 3) END AS tokens, score, done, row_number() OVER (PARTITION BY clip_id ORDER BY done DESC, CASE WHEN done THEN at_ END, CASE WHEN done THEN rank_ END, score DESC, beam DESC) AS n FROM last)
    SELECT clip_id, array_to_string(tokens, ' ') AS tokens, round(score, 6) AS score, done AS finished FROM ended WHERE done OR n <= 3""",
    views=False,
)
def top_7_search(spark, sf_dir):
    """Beams of three through fourteen steps at most, patience 1.3: four finished sequences end a clip's search."""
    rows = T.base(spark, sf_dir)
    tokens = rows.select("clip_id", "frame_idx", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("prev")).withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(3))))
    lp = -((F.col("k") * 7 + F.col("prev") * 13 + F.col("token") * 29 + F.col("frame_idx")) % 50 + 1) / 8.0
    table = tokens.select("clip_id", F.col("frame_idx").alias("step"), "prev", "token", lp.alias("lp"))
    found = search.beam_search(T.clips(spark, sf_dir), table, ["clip_id"], first=0, end=3, beam_size=3, most_steps=14, patience=1.3)
    return found.select("clip_id", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"), *six("score"), "finished")
