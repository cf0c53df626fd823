"""Further timeline queries: scores, landmarks, samples, resampling, filters and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import speech as S
from ..operators import intervals, sampling, scores, windows
from ..sources import timeline as T
from .registry import SPLIT_SQL, iou_sql, mask, query, shot_runs, six

LOGITS_SQL = "[open_prob, k / 50.0::DOUBLE, 0.5::DOUBLE]"


def logits():
    """Three logits of a row, from its columns."""
    return F.array(F.col("open_prob"), F.col("k") / 50.0, F.lit(0.5))


@query("mth_1_log_softmax", f"SELECT clip_id, frame_idx, round(open_prob - ln(exp(open_prob) + exp(k / 50.0::DOUBLE) + exp(0.5::DOUBLE)), 6) AS first FROM sv_base")
def mth_1(spark, sf_dir):
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", F.round(scores.log_softmax(logits())[0], 6).alias("first"))


@query("mth_2_suppressed_best", f"SELECT clip_id, frame_idx, CASE WHEN k / 50.0::DOUBLE >= 0.5 THEN 1 ELSE 2 END AS best FROM sv_base")
def mth_2(spark, sf_dir):
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", scores.best_place(scores.suppressed(logits(), [0])).alias("best"))


@query("mth_4_language_arg_max", f"SELECT clip_id, frame_idx, CAST(list_position({LOGITS_SQL}, list_max({LOGITS_SQL})) - 1 AS INTEGER) AS best FROM sv_base")
def mth_4(spark, sf_dir):
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", scores.best_place(logits()).alias("best"))


@query("agg_13_average_log_prob", "SELECT clip_id, round(sum(ln(open_prob + 0.01::DOUBLE)) / (count(*) + 1), 6) AS avg_lp FROM sv_base GROUP BY 1")
def agg_13(spark, sf_dir):
    sums = T.base(spark, sf_dir).groupBy("clip_id").agg(F.sum(F.log(F.col("open_prob") + 0.01)).alias("lp"), F.count("*").alias("n"))
    return sums.select("clip_id", F.round(scores.average_log_prob(F.col("lp"), F.col("n")), 6).alias("avg_lp"))


@query("agg_8_chunk_totals", "SELECT clip_id, CAST(floor(frame_idx / 50) AS INTEGER) AS chunk_id, count(*) AS frames, count(*) FILTER (on_) AS speaking FROM mask GROUP BY 1, 2")
def agg_8(spark, sf_dir):
    return mask(spark, sf_dir).groupBy("clip_id", F.floor(F.col("frame_idx") / 50).cast("int").alias("chunk_id")).agg(F.count("*").alias("frames"), F.count_if("on_").alias("speaking"))


@query("agg_10_tallies", "SELECT clip_id, count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female, count(*) FILTER (gender IS NULL) AS unclear, array_to_string(list(pos ORDER BY pos)[1:8], ',') AS preview FROM sv_segments GROUP BY 1")
def agg_10(spark, sf_dir):
    rows = T.segments(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("clip_id").orderBy("pos")))
    first = F.sort_array(F.collect_list(F.when(F.col("rn") <= 8, F.col("pos"))))
    return rows.groupBy("clip_id").agg(F.count_if(F.col("gender") == "male").alias("male"), F.count_if(F.col("gender") == "female").alias("female"), F.count_if(F.col("gender").isNull()).alias("unclear"), F.array_join(F.transform(first, lambda x: x.cast("string")), ",").alias("preview"))


@query("prj_8_crop_square", "SELECT clip_id, frame_idx, floor((x1 + x2) / 2) - floor(floor(greatest(x2 - x1, y2 - y1) / 2) * 1.2::DOUBLE) AS x1, floor((y1 + y2) / 2) + floor(floor(greatest(x2 - x1, y2 - y1) / 2) * 1.2::DOUBLE) AS y2 FROM sv_frames WHERE valid_face")
def prj_8(spark, sf_dir):
    c = G.crop_square(G.box(), 1.2)
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", c[0].cast("double").alias("x1"), c[3].cast("double").alias("y2"))


@query("prj_16_distance_box", "SELECT clip_id, frame_idx, x1 - mar AS x1, y1 - open_prob AS y1, x1 + 2 * mar AS x2, y1 + 3 * open_prob AS y2 FROM sv_frames WHERE valid_face")
def prj_16(spark, sf_dir):
    m, o = F.col("mar"), F.col("open_prob")
    out = scores.distance_box(F.col("x1"), F.col("y1"), [m, o, 2 * m, 3 * o])
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *[c.alias(n) for c, n in zip(out, windows.BOX)])


@query("prj_17_prior_round_trip", "SELECT clip_id, frame_idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM sv_frames WHERE valid_face")
def prj_17(spark, sf_dir):
    prior = [F.lit(100.0), F.lit(50.0), F.lit(30.0), F.lit(60.0)]
    back = scores.decode_box(prior, scores.encode_box(prior, G.box()))
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *[F.round(c, 6).alias(n) for c, n in zip(back, windows.BOX)])


def points():
    """Three landmarks of a frame, from its box."""
    return F.array(*[F.struct((F.col("x1") + dx).alias("x"), (F.col("y1") + F.col("mar") * dy).alias("y")) for dx, dy in ((0.0, 1.0), (8.0, 20.0), (3.0, 5.0))])


@query("prj_12_landmark_bounds", "SELECT clip_id, frame_idx, least(x1, x1) AS x1, round(y1 + mar, 6) AS y1, x1 + 8 AS x2, round(y1 + 20 * mar, 6) AS y2 FROM sv_frames WHERE valid_face")
def prj_12(spark, sf_dir):
    out = scores.bounds(points())
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", *[F.round(c, 6).alias(n) for c, n in zip(out, windows.BOX)])


@query("prj_13_shift_rescale", "SELECT clip_id, frame_idx, round(8 * 2.0::DOUBLE, 6) AS x, round(mar * 20 * 0.5::DOUBLE, 6) AS y FROM sv_frames WHERE valid_face")
def prj_13(spark, sf_dir):
    at = scores.rescaled(scores.shifted(points(), F.col("x1"), F.col("y1")), F.lit(2.0), F.lit(0.5))[1]
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("agg_9_landmark_distance", ", a AS (SELECT clip_id, x1, y1, mar FROM sv_frames WHERE valid_face QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) = 1) SELECT f.clip_id, f.frame_idx, round((sqrt(pow(f.x1 - a.x1, 2) + pow(f.y1 + f.mar - a.y1 - a.mar, 2)) + sqrt(pow(f.x1 - a.x1, 2) + pow(f.y1 + 20 * f.mar - a.y1 - 20 * a.mar, 2)) + sqrt(pow(f.x1 - a.x1, 2) + pow(f.y1 + 5 * f.mar - a.y1 - 5 * a.mar, 2))) / 3, 6) AS dist FROM sv_frames f JOIN a USING (clip_id) WHERE valid_face")
def agg_9(spark, sf_dir):
    rows = T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", points().alias("p"))
    anchor = rows.groupBy("clip_id").agg(F.min_by("p", "frame_idx").alias("a"))
    return rows.join(anchor, "clip_id").select("clip_id", "frame_idx", F.round(scores.mean_distance(F.col("p"), F.col("a")), 6).alias("dist"))


@query("prj_31_cosine", "WITH a AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 5) AS cosine FROM embeddings JOIN a USING (label)", views=False)
def prj_31(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings")
    anchor = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return rows.join(anchor, "label").select("vec_id", F.round(G.cosine(F.col("embedding"), F.col("anchor")), 5).alias("cosine"))


@query("prj_30_sinusoid", "SELECT DISTINCT frame_idx, round(sin(frame_idx), 6) AS s0, round(cos(frame_idx / 10000.0::DOUBLE), 6) AS c3  FROM sv_base")
def prj_30(spark, sf_dir):
    rows = T.base(spark, sf_dir).select("frame_idx").distinct()
    code = scores.sinusoid(F.col("frame_idx"), 8)
    return rows.select("frame_idx", F.round(code[0], 6).alias("s0"), F.round(code[7], 6).alias("c3"))


FIRST_FACE = "max(CASE WHEN track_id = 0 THEN {0} END) OVER (PARTITION BY clip_id, frame_idx)"


@query(
    "flt_5_primary_match",
    f""", t AS (SELECT clip_id, frame_idx, track_id, x1, y1, x2, y2, {FIRST_FACE.format("x1")} AS ox1, {FIRST_FACE.format("y1")} AS oy1, {FIRST_FACE.format("x2")} AS ox2, {FIRST_FACE.format("y2")} AS oy2 FROM sv_tracks),
    i AS (SELECT *, greatest(0, least(x2, ox2) - greatest(x1, ox1)) * greatest(0, least(y2, oy2) - greatest(y1, oy1)) AS inter FROM t)
    SELECT clip_id, frame_idx, track_id, CASE WHEN inter / ((x2 - x1) * (y2 - y1) + (ox2 - ox1) * (oy2 - oy1) - inter) >= 0.4 THEN 'kept' ELSE 'other face' END AS reason FROM i
    UNION ALL SELECT clip_id, frame_idx, NULL, 'no face' FROM sv_frames WHERE NOT valid_face""",
)
def flt_5(spark, sf_dir):
    """Detections by what becomes of them: kept, another face than the primary one, or no face in the frame."""
    rows = T.tracks(spark, sf_dir).join(T.frames(spark, sf_dir).select("clip_id", "frame_idx"), ["clip_id", "frame_idx"], "right")
    first = Window.partitionBy("clip_id", "frame_idx")
    rows = rows.withColumns({f"o{c}": F.max(F.when(F.col("track_id") == 0, F.col(c))).over(first) for c in windows.BOX})
    reason = F.when(F.col("track_id").isNull(), "no face").when(G.iou(G.box("o"), G.box()) >= 0.4, "kept").otherwise("other face")
    return rows.select("clip_id", "frame_idx", "track_id", reason.alias("reason"))


@query("flt_7_eligible_clips", "SELECT clip_id FROM sv_frames GROUP BY 1 HAVING count(*) >= 50 AND count(*) FILTER (valid_face) >= 0.75::DOUBLE * count(*) AND max(frame_idx) + 1 = count(*)")
def flt_7(spark, sf_dir):
    s = T.frames(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if("valid_face").alias("v"), F.max("frame_idx").alias("m"))
    return s.where("n >= 50 and v >= 0.75D * n and m + 1 = n").select("clip_id")


@query("flt_9_split_by_substring", "SELECT page_id, CASE WHEN contains(url, '1') OR contains(url, '7') THEN 'val' ELSE 'train' END AS split FROM pages", views=False)
def flt_9(spark, sf_dir):
    ids = F.array(F.lit("1"), F.lit("7"))
    return T.table(spark, sf_dir, "pages").select("page_id", F.when(F.exists(ids, lambda v: F.contains(F.col("url"), v)), "val").otherwise("train").alias("split"))


@query("top_2_smallest_openings", "SELECT clip_id, frame_idx, mar FROM sv_frames WHERE mar IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY mar, frame_idx) <= 3")
def top_2(spark, sf_dir):
    w = Window.partitionBy("clip_id").orderBy("mar", "frame_idx")
    return T.frames(spark, sf_dir).where("mar is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("clip_id", "frame_idx", "mar")


@query("top_4_first_maximum", "SELECT clip_id, shot_id, arg_max(frame_idx, (open_prob, -frame_idx)) AS frame_idx FROM sv_frames WHERE open_prob IS NOT NULL GROUP BY 1, 2")
def top_4(spark, sf_dir):
    return T.frames(spark, sf_dir).where("open_prob is not null").groupBy("clip_id", "shot_id").agg(F.max_by("frame_idx", F.struct("open_prob", -F.col("frame_idx"))).alias("frame_idx"))


@query(
    "smp_2_reference_frames",
    """, a AS (SELECT clip_id, frame_idx AS at_, x1 AS ax, y1 AS ay FROM sv_frames WHERE valid_face QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) = 1),
    c AS (SELECT f.clip_id, f.frame_idx, row_number() OVER (PARTITION BY clip_id ORDER BY sqrt(pow(x1 - ax, 2) + pow(y1 - ay, 2)), frame_idx) AS near, row_number() OVER (PARTITION BY clip_id ORDER BY mar, frame_idx) AS shut FROM sv_frames f JOIN a USING (clip_id) WHERE valid_face AND abs(frame_idx - at_) >= 5)
    SELECT clip_id, frame_idx FROM c WHERE near <= 20 AND shut <= 20""",
)
def smp_2(spark, sf_dir):
    """Frames among the 20 nearest in pose and the 20 most closed, five or more frames from the first."""
    rows = T.frames(spark, sf_dir).where("valid_face")
    anchor = rows.groupBy("clip_id").agg(F.min("frame_idx").alias("at"), F.min_by("x1", "frame_idx").alias("ax"), F.min_by("y1", "frame_idx").alias("ay"))
    far = rows.join(anchor, "clip_id").where(F.abs(F.col("frame_idx") - F.col("at")) >= 5)
    near = Window.partitionBy("clip_id").orderBy(F.sqrt(F.pow(F.col("x1") - F.col("ax"), 2) + F.pow(F.col("y1") - F.col("ay"), 2)), "frame_idx")
    shut = Window.partitionBy("clip_id").orderBy("mar", "frame_idx")
    return far.withColumn("n", F.row_number().over(near)).withColumn("s", F.row_number().over(shut)).where("n <= 20 and s <= 20").select("clip_id", "frame_idx")


@query("smp_1_seeded_pick", "SELECT * FROM sv_clips WHERE n_frames >= 50 ORDER BY md5('0:' || clip_id), clip_id LIMIT 5")
def smp_1(spark, sf_dir):
    return sampling.seeded_pick(T.clips(spark, sf_dir).where("n_frames >= 50"), "clip_id", 5)


@query("rsm_2_scores_back", ", s AS (SELECT clip_id, frame_idx, coalesce(open_prob, '-infinity'::DOUBLE) AS v FROM sv_frames WHERE frame_idx % 3 = 0) SELECT f.clip_id, f.frame_idx, v AS score FROM sv_frames f JOIN s ON s.clip_id = f.clip_id AND s.frame_idx = CAST(floor(f.frame_idx / 3) AS INTEGER) * 3 WHERE v >= 0")
def rsm_2(spark, sf_dir):
    rows = T.frames(spark, sf_dir).select("clip_id", "frame_idx", "open_prob")
    kept = rows.where("frame_idx % 3 = 0 and open_prob >= 0").select("clip_id", F.col("frame_idx").alias("src"), F.col("open_prob").alias("score"))
    return rows.withColumn("src", (F.floor(F.col("frame_idx") / 3) * 3).cast("int")).join(kept, ["clip_id", "src"]).select("clip_id", "frame_idx", "score")


@query("rsm_3_pad_or_trim", "SELECT clip_id, array_to_string([CASE WHEN i <= len(l) THEN l[i] ELSE 0 END FOR i IN range(1, 31)], ',') AS ks FROM (SELECT clip_id, list(k ORDER BY frame_idx) AS l FROM sv_base GROUP BY 1)")
def rsm_3(spark, sf_dir):
    own = Window.partitionBy("clip_id").orderBy("frame_idx")
    first = T.base(spark, sf_dir).withColumn("rn", F.row_number().over(own)).where("rn <= 30")  # what the trim keeps, whatever the frames' numbers
    rows = first.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "k"))).alias("l"))
    ks = sampling.pad_or_trim(F.transform("l", lambda s: s["k"].cast("double")), 30)
    return rows.select("clip_id", F.array_join(F.transform(ks, lambda v: v.cast("int").cast("string")), ",").alias("ks"))


@query("rsm_4_tumbling", "SELECT clip_id, CAST(floor(frame_idx / 30) AS INTEGER) AS part, count(*) AS n, round(sum(open_prob), 6) AS total FROM sv_base GROUP BY 1, 2")
def rsm_4(spark, sf_dir):
    return T.base(spark, sf_dir).groupBy("clip_id", F.floor(F.col("frame_idx") / 30).cast("int").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("open_prob"), 6).alias("total"))


@query("int_1_gaps", "SELECT s.clip_id, s.pos, min(round(greatest(0.0::DOUBLE, n.seg_start - s.seg_end, s.seg_start - n.seg_end), 6)) AS gap, max(round(greatest(0.0::DOUBLE, least(s.seg_end, n.seg_end) - greatest(s.seg_start, n.seg_start)), 6)) AS overlap FROM sv_segments s JOIN sv_segments n ON n.clip_id = s.clip_id AND n.pos = s.pos + 1 GROUP BY 1, 2")
def int_1(spark, sf_dir):
    w = Window.partitionBy("clip_id").orderBy("pos")
    rows = T.segments(spark, sf_dir).withColumn("a", F.lead("seg_start").over(w)).withColumn("b", F.lead("seg_end").over(w)).where("a is not null")
    own = (F.col("seg_start"), F.col("seg_end"), F.col("a"), F.col("b"))
    return rows.select("clip_id", "pos", F.round(G.interval_gap(*own), 6).alias("gap"), F.round(G.interval_overlap(*own), 6).alias("overlap"))


@query("set_5_ordered_chunks", "SELECT clip_id, CAST(floor(frame_idx / 50) AS INTEGER) AS chunk_id, frame_idx, row_number() OVER (PARTITION BY clip_id ORDER BY floor(frame_idx / 50), frame_idx) - 1 AS place FROM sv_base")
def set_5(spark, sf_dir):
    rows = T.base(spark, sf_dir).select("clip_id", F.floor(F.col("frame_idx") / 50).cast("int").alias("chunk_id"), "frame_idx")
    w = Window.partitionBy("clip_id").orderBy("chunk_id", "frame_idx")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("bigint"))


@query("src_14_parse_segments", "SELECT clip_id, count(*) AS n, round(max(seg_end), 6) AS last FROM sv_segments GROUP BY 1")
def src_14(spark, sf_dir):
    s = F.struct(F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "gender")
    text = T.segments(spark, sf_dir).groupBy("clip_id").agg(F.to_json(F.collect_list(s)).alias("v"))
    return text.withColumn("s", S.parse_segments(F.col("v"))).select("clip_id", F.size("s").cast("bigint").alias("n"), F.round(F.array_max(F.transform("s", lambda x: x["end"])), 6).alias("last"))


@query("src_10_numeric_order", "SELECT page_id, CAST(nullif(regexp_extract(url, '(\\d+)', 1), '') AS BIGINT) AS number FROM pages", views=False)
def src_10(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", r"(\d+)", 1), F.lit("")).cast("bigint").alias("number"))


@query("int_5_assigned_mask", SPLIT_SQL + ", own AS (SELECT * FROM assigned WHERE speaker_id = 1) SELECT DISTINCT f.clip_id, f.frame_idx FROM sv_frames f JOIN own p ON p.clip_id = f.clip_id JOIN sv_clips c ON c.clip_id = f.clip_id WHERE f.frame_idx >= greatest(0, trunc(t_start * fps)) AND f.frame_idx < least(n_frames, round_even(t_end * fps, 0))")
def int_5(spark, sf_dir):
    """Frames of the pieces given to speaker 1."""
    pieces = intervals.assign_split(T.segments(spark, sf_dir), T.intervals(spark, sf_dir)).where("speaker_id = 1")
    return intervals.segment_frames(pieces.select("clip_id", F.col("t_start").alias("seg_start"), F.col("t_end").alias("seg_end")), T.clips(spark, sf_dir))


@query(
    "win_10_interpolate_mouth",
    f""", f AS (SELECT *, CASE WHEN valid_face THEN x1 + 10 END AS mx1, CASE WHEN valid_face THEN y1 + 25 END AS my1, CASE WHEN valid_face THEN x2 - 10 END AS mx2, CASE WHEN valid_face THEN y2 END AS my2 FROM sv_frames),
    keys AS (SELECT * FROM f WHERE frame_idx % 5 = 0 AND mx1 IS NOT NULL),
    near AS (SELECT f.clip_id, f.frame_idx, (SELECT max(k.frame_idx) FROM keys k WHERE k.clip_id = f.clip_id AND k.frame_idx <= f.frame_idx) AS p, (SELECT min(k.frame_idx) FROM keys k WHERE k.clip_id = f.clip_id AND k.frame_idx >= f.frame_idx) AS q FROM f),
    ends AS (SELECT n.clip_id, n.frame_idx, coalesce(p, q) AS p, coalesce(q, p) AS q FROM near n),
    m AS (SELECT e.clip_id, e.frame_idx, p, q, {iou_sql("a", "b")} < 0.15 AS apart, e.frame_idx <= p + (q - p) // 2 AS early, CASE WHEN q > p THEN (e.frame_idx - p)::DOUBLE / (q - p) ELSE 0 END AS t, a.mx1 AS ax1, a.my1 AS ay1, a.mx2 AS ax2, a.my2 AS ay2, b.mx1 AS bx1, b.my1 AS by1, b.mx2 AS bx2, b.my2 AS by2
      FROM ends e LEFT JOIN keys a ON a.clip_id = e.clip_id AND a.frame_idx = e.p LEFT JOIN keys b ON b.clip_id = e.clip_id AND b.frame_idx = e.q)
    SELECT clip_id, frame_idx, {", ".join(f"round(CASE WHEN apart AND q > p THEN CASE WHEN early THEN a{c} ELSE b{c} END ELSE a{c} + (b{c} - a{c}) * t END, 6) AS m{c}" for c in windows.BOX)} FROM m""",
)
def win_10(spark, sf_dir):
    """Mouth boxes between every fifth frame that has one."""
    face = F.col("valid_face")
    rows = T.frames(spark, sf_dir).withColumns({"mx1": F.when(face, F.col("x1") + 10), "my1": F.when(face, F.col("y1") + 25), "mx2": F.when(face, F.col("x2") - 10), "my2": F.when(face, F.col("y2"))})
    return windows.interpolate_mouths(rows, F.col("frame_idx") % 5 == 0).select("clip_id", "frame_idx", *six("mx1", "my1", "mx2", "my2"))


@query("agg_5_run_votes", "SELECT clip_id, shot_id, count(*) AS n_runs, max(n_frames) AS longest, CAST(sum(n_frames) AS BIGINT) AS frames FROM runs GROUP BY 1, 2")
def agg_5(spark, sf_dir):
    return shot_runs(spark, sf_dir).groupBy("clip_id", "shot_id").agg(F.count("*").alias("n_runs"), F.max("n_frames").alias("longest"), F.sum("n_frames").alias("frames"))




@query(
    "top_7_beam_step",
    f""", o AS (SELECT clip_id, frame_idx AS beam, ln(open_prob + 0.01::DOUBLE) AS total, CAST(i AS INTEGER) AS token, list_extract({LOGITS_SQL}, i + 1) AS lp FROM (SELECT *, unnest(range(0, 3)) AS i FROM sv_base)),
    p AS (SELECT *, round(total + lp, 9) AS score FROM o QUALIFY row_number() OVER (PARTITION BY clip_id, beam ORDER BY lp DESC, token) <= 3),
    r AS (SELECT *, coalesce(sum(CASE WHEN token <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY score DESC, beam, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM p)
    SELECT clip_id, beam, token, round(score, 6) AS score, token = 1 AS finished FROM r WHERE before_ < 2""",
)
def top_7(spark, sf_dir):
    rows = T.base(spark, sf_dir)
    beams = rows.select("clip_id", F.col("frame_idx").alias("beam"), F.log(F.col("open_prob") + 0.01).alias("total"), logits().alias("lps"))
    return sampling.beam_step(beams, "clip_id", "beam", "total", "lps", 2, 1).select("clip_id", "beam", "token", *six("score"), "finished")


@query(
    "prj_19_margin_crop",
    "SELECT clip_id, frame_idx, x1, y1, x2, least(480.0::DOUBLE, y2 + greatest(0, 10 + 4 * (frame_idx % 7 - 3))) AS y2 FROM sv_frames WHERE valid_face",
)
def prj_19(spark, sf_dir):
    """The lower edge moved down by a margin that is never negative, within the frame."""
    margin = F.greatest(F.lit(0), 10 + 4 * (F.col("frame_idx") % 7 - 3))
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", "x1", "y1", "x2", F.least(F.lit(480.0), F.col("y2") + margin).alias("y2"))
