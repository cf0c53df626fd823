"""Queries over speech segments, gates, transcripts, scores of tokens, and micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decoding as D
from ..functions import geometry as G
from ..functions import speech as S
from ..operators import intervals, runs, sampling, scores, windows
from ..sources import timeline as T
from .more import LOGITS_SQL, logits
from .registry import GATE, detections, mask, query, six

# ---------------------------------------------------------------- segments as JSON

#: Each row's segment, in one of the forms, some of them not valid.
RAW = ", raw AS (SELECT clip_id, pos, seg_start, seg_end - CASE WHEN pos % 4 = 3 THEN 1 ELSE 0 END AS seg_end, gender, pos % 5 = 4 AS broken FROM sv_segments)"


def raw(spark, sf_dir) -> DataFrame:
    rows = T.segments(spark, sf_dir).withColumn("seg_end", F.col("seg_end") - F.when(F.col("pos") % 4 == 3, 1).otherwise(0))
    return rows.withColumn("broken", F.col("pos") % 5 == 4)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON list a clip: objects, lists of two, lists of three, and broken ones, from the last to the first."""
    a, b = F.col("seg_start").cast("string"), F.col("seg_end").cast("string")
    name = F.when(F.col("gender") == "male", '" M "').when(F.col("gender") == "female", '"Woman"').otherwise("null")
    named = F.concat(F.lit('{"start": '), a, F.lit(', "end": "'), b, F.lit('", "gender": '), name, F.lit("}"))
    listed = F.concat(F.lit("["), a, F.lit(", "), b, F.when(F.col("pos") % 3 == 1, F.concat(F.lit(", "), name)).otherwise(""), F.lit("]"))
    item = F.when(F.col("broken"), F.when(F.col("pos") % 2 == 0, '{"start": 1}').otherwise("[0.5]")).when(F.col("pos") % 3 == 0, named).otherwise(listed)
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("pos", item.alias("item"))), asc=False), lambda s: s["item"])
    return rows.groupBy("clip_id").agg(F.concat(F.lit(" ["), F.array_join(gathered, ", "), F.lit("]")).alias("v"))


PARSED_SQL = "SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY seg_start, pos DESC) - 1 AS INTEGER) AS place, round(seg_start, 6) AS start, round(seg_end, 6) AS end, CASE WHEN pos % 3 = 2 OR gender IS NULL THEN NULL WHEN gender = 'male' THEN 'male' ELSE 'female' END AS gender FROM raw WHERE seg_end > seg_start"


def parsed(rows: DataFrame, strict: bool) -> DataFrame:
    got = rows.select("clip_id", F.posexplode(S.parse_segments(F.col("v"), strict)).alias("place", "s"))
    return got.select("clip_id", "place", F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"), "s.gender")


@query("jsn_2_segment_forms", RAW + PARSED_SQL + " AND NOT broken")
def jsn_2(spark, sf_dir):
    """Segments as objects, pairs and triples; those that do not end after their start are left out, the rest is in order of time."""
    return parsed(as_json(raw(spark, sf_dir).where("not broken")), strict=True)


@query("flt_8_lenient_segments", RAW + PARSED_SQL + " AND NOT broken")
def flt_8_lenient(spark, sf_dir):
    """As strictly read, but with segments that lack a start or an end left out."""
    return parsed(as_json(raw(spark, sf_dir)), strict=False)


@query("flt_8_ordered_segments", RAW + "SELECT clip_id, round(seg_start, 6) AS start, round(seg_end, 6) AS end FROM raw WHERE seg_end > seg_start")
def flt_8(spark, sf_dir):
    """Valid segments of typed rows, strictly."""
    s = F.struct(F.col("seg_start").alias("start"), F.col("seg_end").alias("end"), "gender")
    rows = raw(spark, sf_dir).groupBy("clip_id").agg(F.collect_list(s).alias("l")).select("clip_id", F.explode(S.valid_segments(F.col("l"))).alias("s"))
    return rows.select("clip_id", F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"))


@query("jsn_1_unknown_or_none", "SELECT clip_id, CASE clip_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'no speech' ELSE 'speech' END AS state FROM sv_clips")
def jsn_1(spark, sf_dir):
    """Blank text is not known, an empty list is no speech."""
    text = F.when(F.col("clip_id") % 3 == 0, F.when(F.col("clip_id") % 2 == 0, "  ")).when(F.col("clip_id") % 3 == 1, "[]").otherwise("[[0, 1.5]]")
    got = S.parse_segments(text)
    return T.clips(spark, sf_dir).select("clip_id", F.when(got.isNull(), "unknown").when(F.size(got) == 0, "no speech").otherwise("speech").alias("state"))


# ---------------------------------------------------------------- gates


@query(
    "flt_12_final_gate",
    GATE
    + """, said AS (SELECT DISTINCT f.clip_id, f.frame_idx FROM sv_frames f JOIN sv_segments s ON f.clip_id = s.clip_id JOIN sv_clips c ON c.clip_id = f.clip_id WHERE f.frame_idx >= greatest(0, trunc(seg_start * fps)) AND f.frame_idx < least(n_frames, round_even(seg_end * fps, 0)))
    SELECT g.clip_id, g.frame_idx FROM gate g JOIN said USING (clip_id, frame_idx) JOIN sv_frames f USING (clip_id, frame_idx) WHERE motion AND valid_face""",
)
def flt_12(spark, sf_dir):
    """Frames with speech, the primary face, and lip motion."""
    return runs.speaking_frames(windows.motion_gate(T.frames(spark, sf_dir)), F.col("motion"), F.col("valid_face"), intervals.segment_frames(T.segments(spark, sf_dir), T.clips(spark, sf_dir))).select("clip_id", "frame_idx")


@query("flt_2_large_candidates", "SELECT clip_id, frame_idx, track_id FROM sv_tracks WHERE (x2 - x1) * (y2 - y1) * (track_id + 1) >= 0.01::DOUBLE * 640 * 480")
def flt_2(spark, sf_dir):
    """Candidates of every frame that are large enough; no least size keeps all."""
    rows = T.tracks(spark, sf_dir).withColumns({"x2": F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("track_id") + 1)})
    return rows.where(G.large_enough(G.box(), 640, 480, 0.01)).select("clip_id", "frame_idx", "track_id")


@query("jon_6_speakers_in_order", ", m AS (SELECT s.clip_id, s.pos, speaker_id, min(ipos) AS first FROM sv_segments s JOIN sv_pos USING (clip_id) WHERE least(t1, seg_end) > greatest(t0, seg_start) GROUP BY 1, 2, 3) SELECT clip_id, pos, string_agg(speaker_id::VARCHAR, ',' ORDER BY first) AS speakers FROM m GROUP BY 1, 2")
def jon_6(spark, sf_dir):
    """The speakers shown during each segment, the first seen first."""
    got = intervals.speakers_of(T.segments(spark, sf_dir), T.intervals(spark, sf_dir), ["pos"], "seg_start", "seg_end")
    return got.select("clip_id", "pos", F.array_join(F.transform("speakers", lambda s: s.cast("string")), ",").alias("speakers"))


@query("top_5_interval_order", "SELECT clip_id, speaker_id, round(t0, 6) AS t0, round(t1, 6) AS t1, CAST(ipos AS INTEGER) AS place FROM sv_pos")
def top_5(spark, sf_dir):
    return intervals.positioned(T.intervals(spark, sf_dir)).select("clip_id", "speaker_id", *six("t0", "t1"), F.col("ipos").alias("place"))


@query("top_9_first_frames", "SELECT clip_id, frame_idx, k FROM sv_base QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY frame_idx) <= 5")
def top_9(spark, sf_dir):
    """The first five frames of each clip."""
    w = Window.partitionBy("clip_id").orderBy("frame_idx")
    return T.base(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("clip_id", "frame_idx", "k")


# ---------------------------------------------------------------- transcripts


def spoken(spark, sf_dir):
    said = F.concat(F.lit(" "), F.coalesce("gender", F.lit("?")), F.lit(" --> "), F.col("pos").cast("string"), F.lit("\n"))
    return T.segments(spark, sf_dir).withColumnRenamed("pos", "at").withColumn("pos", F.col("at")).withColumn("said", said)


def _stamp_sql(ms: str, long: bool) -> str:
    h = f"printf('%02d:', CAST({ms} // 3600000 AS INTEGER)) || " if long else f"CASE WHEN {ms} >= 3600000 THEN printf('%02d:', CAST({ms} // 3600000 AS INTEGER)) ELSE '' END || "
    return h + f"printf('%02d:%02d{',' if long else '.'}%03d', CAST({ms} // 60000 % 60 AS INTEGER), CAST({ms} // 1000 % 60 AS INTEGER), CAST({ms} % 1000 AS INTEGER))"


def _entry_sql(form: str) -> str:
    said = "coalesce(gender, '?') || ' {} ' || pos"
    if form == "txt":
        return said.format("-->")
    times = f"{_stamp_sql('a', form == 'srt')} || ' --> ' || {_stamp_sql('b', form == 'srt')} || chr(10) || {said.format('->')} || chr(10)"
    return f"(pos + 1) || chr(10) || {times}" if form == "srt" else times


def _transcript(form: str):
    def run(spark, sf_dir):
        return S.transcript(spoken(spark, sf_dir), form, ["clip_id"], ["at"], "seg_start", "seg_end", "said")

    run.__doc__ = f"Segments as entries of a {form} transcript."
    return run


for _form in ("txt", "vtt", "srt"):
    query(f"snk_3_{_form}", f"SELECT clip_id, CAST(pos + 1 AS INTEGER) AS pos, {_entry_sql(_form)} AS entry FROM (SELECT *, CAST(round_even(seg_start * 1000, 0) AS BIGINT) AS a, CAST(round_even(seg_end * 1000, 0) AS BIGINT) AS b FROM sv_segments)")(_transcript(_form))


# ---------------------------------------------------------------- scores of tokens

SIX = "[k / 20.0::DOUBLE, open_prob * 3, (k % 7) / 2.0::DOUBLE, 1.5::DOUBLE, (k % 11) / 3.0::DOUBLE, open_prob * 4]"


def six_logits():
    k, o = F.col("k"), F.col("open_prob")
    return F.array(k / 20.0, o * 3, (k % 7) / 2.0, F.lit(1.5), (k % 11) / 3.0, o * 4)


@query("mth_1_all_log_softmax", f"SELECT clip_id, frame_idx, CAST(i AS INTEGER) AS place, round(l[i + 1] - ln(list_sum(list_transform(l, lambda v: exp(v)))), 6) AS log_prob FROM (SELECT clip_id, frame_idx, {SIX} AS l, unnest(range(6)) AS i FROM sv_base)")
def mth_1_all(spark, sf_dir):
    rows = T.base(spark, sf_dir).select("clip_id", "frame_idx", F.posexplode(scores.log_softmax(six_logits())).alias("place", "v"))
    return rows.select("clip_id", "frame_idx", "place", F.round("v", 6).alias("log_prob"))


@query(
    "mth_1_time_rules",
    f""", t AS (SELECT clip_id, frame_idx, {SIX} AS l, CASE frame_idx % 5 WHEN 0 THEN [] WHEN 1 THEN [1] WHEN 2 THEN [4] WHEN 3 THEN [1, 4] ELSE [4, 5] END AS said FROM sv_base),
    -- places: 0, 1 words, 2 the end, 3 never, 4 and 5 times
    m AS (SELECT clip_id, frame_idx, list_transform(range(6), lambda i: CASE WHEN i = 3 THEN NULL
      WHEN len(said) >= 1 AND said[len(said)] >= 4 AND (len(said) < 2 OR said[greatest(len(said) - 1, 1)] >= 4) AND i >= 4 THEN NULL
      WHEN len(said) >= 2 AND said[len(said)] >= 4 AND said[greatest(len(said) - 1, 1)] < 4 AND i < 2 THEN NULL
      WHEN len(said) = 0 AND i >= 5 THEN NULL ELSE l[i + 1] END) AS z FROM t),
    c AS (SELECT clip_id, frame_idx, z, coalesce(exp(z[5]), 0) + coalesce(exp(z[6]), 0) > exp(list_max(z[1:4])) AS only_times FROM m)
    SELECT clip_id, frame_idx, array_to_string(list_transform(range(6), lambda i: CASE WHEN z[i + 1] IS NULL OR (only_times AND i < 4) THEN '-' ELSE '+' END), '') AS kept FROM c""",
)
def mth_1_rules(spark, sf_dir):
    """Which of six tokens stay under the rules for times."""
    part = F.col("frame_idx") % 5
    kind = "array<int>"
    said = F.when(part == 0, F.array().cast(kind)).when(part == 1, F.array(F.lit(1))).when(part == 2, F.array(F.lit(4))).when(part == 3, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(4), F.lit(5)))
    z = D.time_rules(six_logits(), said, begin=4, end_token=2, no_times=3, most_first=0)
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", F.array_join(F.transform(z, lambda v: F.when(v == D.NEVER, "-").otherwise("+")), "").alias("kept"))


@query("mth_3_checked_options", "SELECT clip_id, frame_idx, true AS fine FROM sv_base")
def mth_3(spark, sf_dir):
    none = F.lit(None).cast("int")
    beam = F.when(F.col("k") % 2 == 0, F.lit(5))
    fine = D.checked_options(beam, none, F.lit(0.0), F.when(beam.isNotNull(), F.lit(1.5)), F.when(F.col("k") % 3 == 0, F.col("open_prob")))
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", fine.alias("fine"))


@query(
    "top_7_finished",
    f""", o AS (SELECT clip_id, frame_idx AS beam, ln(open_prob + 0.01::DOUBLE) AS total, CAST(i AS INTEGER) AS token, list_extract({LOGITS_SQL}, i + 1) AS lp FROM (SELECT *, unnest(range(0, 3)) AS i FROM sv_base)),
    p AS (SELECT *, round(total + lp, 9) AS score FROM o QUALIFY row_number() OVER (PARTITION BY clip_id, beam ORDER BY lp DESC, token) <= 3),
    r AS (SELECT *, coalesce(sum(CASE WHEN token <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY score DESC, beam, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM p),
    w AS (SELECT clip_id, beam, round(score, 6) AS score, 1 AS new_ FROM r WHERE before_ < 2 AND token = 1 UNION ALL SELECT clip_id, frame_idx, round(ln(open_prob + 0.01::DOUBLE), 6), 0 FROM sv_base WHERE k % 40 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY new_, CASE WHEN new_ = 1 THEN -score END, beam) AS rn FROM w)
    SELECT clip_id, beam, score, count(*) OVER (PARTITION BY clip_id) >= 3 AS done FROM k WHERE rn <= 3 OR new_ = 0""",
)
def top_7(spark, sf_dir):
    """Finished sequences after a step of beams of two, patience 1.5: three end a clip's search."""
    rows = T.base(spark, sf_dir)
    total = F.log(F.col("open_prob") + 0.01)
    beams = rows.select("clip_id", F.col("frame_idx").alias("beam"), total.alias("total"), logits().alias("lps"))
    step = sampling.beam_step(beams, "clip_id", "beam", "total", "lps", 2, 1).where("finished").select("clip_id", "beam", *six("score"))
    before = rows.where("k % 40 = 0").select("clip_id", F.col("frame_idx").alias("beam"), F.round(total, 6).alias("score"))
    return D.finished_beams(before, step, ["clip_id"], "score", D.most_candidates(2, 1.5), ["beam"])


def _best_sql(penalty: str) -> str:
    return f", c AS (SELECT clip_id, frame_idx, CAST(k AS DOUBLE) - 100 AS lp, 1 + frame_idx % 7 AS len FROM sv_base) SELECT clip_id, frame_idx FROM c QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY lp / {penalty} DESC, frame_idx) = 1"


def _candidates(spark, sf_dir):
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", (F.col("k") - 100.0).alias("lp"), (1 + F.col("frame_idx") % 7).alias("len"))


@query("top_8_by_length", _best_sql("len"))
def top_8_length(spark, sf_dir):
    return sampling.length_penalised_best(_candidates(spark, sf_dir), ["clip_id"], "lp", "len", tie="frame_idx").select("clip_id", "frame_idx")


@query("top_8_by_power", _best_sql("pow((len + 5) / 6.0::DOUBLE, 2.0::DOUBLE)"))
def top_8_power(spark, sf_dir):
    return sampling.length_penalised_best(_candidates(spark, sf_dir), ["clip_id"], "lp", "len", alpha=2.0, tie="frame_idx").select("clip_id", "frame_idx")


# ---------------------------------------------------------------- samples and micro-batches


@query("smp_3_drawn_window", ", s AS (SELECT clip_id, trunc((n_frames - 5 + 1) * ((clip_id * 37 % 101) / 101.0::DOUBLE)) AS s FROM sv_clips WHERE n_frames >= 5) SELECT clip_id, CAST(s + i AS INTEGER) AS frame_idx FROM s, (SELECT unnest(range(5)) AS i)")
def smp_3(spark, sf_dir):
    """Five frames in a row from a drawn start; the draw of a clip comes from its id."""
    start = sampling.drawn_start(F.col("n_frames"), 5, (F.col("clip_id") * 37 % 101) / 101.0)
    rows = T.clips(spark, sf_dir).where("n_frames >= 5")
    return rows.select("clip_id", F.explode(sampling.window_from(start, 5)).alias("frame_idx"))


@query("str_4_micro_batches", "SELECT clip_id, CAST(frame_idx // 8 AS INTEGER) AS batch, count(*) AS n, min(frame_idx) AS first FROM sv_base GROUP BY 1, 2")
def str_4(spark, sf_dir):
    """Frames of a clip in batches of eight, the last one as long as it gets."""
    rows = sampling.in_batches(T.base(spark, sf_dir), ["clip_id"], ["frame_idx"], 8)
    return rows.groupBy("clip_id", "batch").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"))


__all__ = ["detections", "mask"]
