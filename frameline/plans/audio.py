"""Queries over samples, spectrograms, feature windows and losses.  The stand-in samples of a clip are its frames' scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import geometry as G
from ..operators import sampling
from ..sources import timeline as T
from .registry import query, six

#: Four bands of a 16-sample window: band m takes frequency 2m whole and 2m + 1 by half.
BANDS = np.array([[1.0 if f == 2 * m else 0.5 if f == 2 * m + 1 else 0.0 for f in range(9)] for m in range(4)])


def samples(spark, sf_dir):
    rows = T.base(spark, sf_dir).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "open_prob"))).alias("l"))
    return rows.select("clip_id", F.transform("l", lambda s: s["open_prob"]).alias("s"))


@query(
    "prj_27_log_bands",
    """, s AS (SELECT clip_id, list(open_prob ORDER BY frame_idx) AS s FROM sv_base GROUP BY 1 HAVING count(*) > 8),
    p AS (SELECT clip_id, len(s) // 4 AS n, list_concat(list_reverse(s[2:9]), s, list_reverse(s)[2:9]) AS s FROM s),
    w AS (SELECT clip_id, unnest(range(n)) AS at_, s FROM p),
    f AS (SELECT clip_id, at_, f, pow(list_sum(list_transform(range(16), lambda i: s[at_ * 4 + i + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 16)) * cos(2 * pi() * i * f / 16))), 2) + pow(list_sum(list_transform(range(16), lambda i: s[at_ * 4 + i + 1] * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 16)) * sin(2 * pi() * i * f / 16))), 2) AS power FROM w, (SELECT unnest(range(8)) AS f)),
    b AS (SELECT clip_id, at_, f // 2 AS band, log10(greatest(sum(power * CASE f % 2 WHEN 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 1e-10)) AS l FROM f GROUP BY 1, 2, 3)
    SELECT clip_id, CAST(at_ AS INTEGER) AS at_, CAST(band AS INTEGER) AS band, round((greatest(l, max(l) OVER (PARTITION BY clip_id) - 8) + 4) / 4, 4) AS level FROM b""",
)
def prj_27(spark, sf_dir):
    got = A.log_mel(samples(spark, sf_dir), "s", ["clip_id"], size=16, hop=4, filters=BANDS)
    return got.select("clip_id", F.col("at").alias("at_"), F.posexplode("level").alias("band", "level")).withColumn("level", F.round("level", 4))


@query("prj_28_window_counts", ", n AS (SELECT clip_id, n_frames * 37 AS len FROM sv_clips), m AS (SELECT *, CASE WHEN len % 4 = 0 THEN (len + 24 - 16) // 4 + 1 ELSE (len + 24 - 16) // 4 + 2 END AS m FROM n) SELECT clip_id, CAST(m AS BIGINT) AS windows, 12 AS pad_left, CAST(12 + (m - 1) * 4 + 16 - (len + 24) AS BIGINT) AS pad_right, CAST((len // 4 + 1) * 4 - len AS BIGINT) AS tail FROM m")
def prj_28(spark, sf_dir):
    n = F.col("n_frames") * 37
    left, right = G.window_padding(n, 16, 4)
    return T.clips(spark, sf_dir).select("clip_id", G.window_count(n, 16, 4).alias("windows"), left.alias("pad_left"), right.alias("pad_right"), G.tail_padding(n, 4).alias("tail"))


@query("prj_29_peak_scaled", "SELECT clip_id, frame_idx, CAST(trunc((open_prob - 0.3::DOUBLE) * 32767 / greatest(0.01::DOUBLE, max(abs(open_prob - 0.3::DOUBLE)) OVER (PARTITION BY clip_id))) AS SMALLINT) AS sample FROM sv_base")
def prj_29(spark, sf_dir):
    return A.peak_scaled(T.base(spark, sf_dir).withColumn("v", F.col("open_prob") - 0.3), "v", ["clip_id"]).select("clip_id", "frame_idx", "sample")


@query(
    "prj_24_levels_and_back",
    """, d AS (SELECT clip_id, frame_idx, 20 * log10(greatest(1e-5::DOUBLE, open_prob)) - 10 AS db FROM sv_base),
    n AS (SELECT *, least(4, greatest(-4, 8 * (db + 100) / 100 - 4)) AS level, least(4, greatest(0, 4 * (db + 100) / 100)) AS plain FROM d)
    SELECT clip_id, frame_idx, round(level, 6) AS level, round(plain, 6) AS plain, round((level + 4) * 100 / 8 - 100, 6) AS db, round(pow(10, db * 0.05::DOUBLE), 6) AS amplitude FROM n""",
)
def prj_24(spark, sf_dir):
    """Levels on both scales, decibels back from the level, amplitudes back from decibels."""
    db = G.decibel(F.col("open_prob")) - 10
    level = G.normalised_level(db)
    out = {"level": level, "plain": G.normalised_level(db, symmetric=False), "db": G.level_of(level), "amplitude": G.amplitude(db)}
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", *[F.round(c, 6).alias(n) for n, c in out.items()])


@query("prj_21_cross_fade", ", a AS (SELECT clip_id, frame_idx, open_prob, mar, CASE WHEN frame_idx % 9 = 0 THEN 0.9995::DOUBLE WHEN frame_idx % 9 = 1 THEN 0.0005::DOUBLE ELSE (frame_idx % 9) / 10.0::DOUBLE END AS a FROM sv_frames WHERE valid_face) SELECT clip_id, frame_idx, round(CASE WHEN a >= 0.999 THEN open_prob WHEN a <= 0.001 THEN mar ELSE a * open_prob + (1 - a) * mar END, 9) AS mixed FROM a")
def prj_21(spark, sf_dir):
    part = F.col("frame_idx") % 9
    alpha = F.when(part == 0, 0.9995).when(part == 1, 0.0005).otherwise(part / 10)
    return T.frames(spark, sf_dir).where("valid_face").select("clip_id", "frame_idx", F.round(G.cross_fade(F.col("open_prob"), F.col("mar"), alpha), 9).alias("mixed"))


@query(
    "prj_31_agreement_loss",
    """WITH a AS (SELECT label, arg_min(embedding, vec_id) AS anchor FROM embeddings GROUP BY 1),
    c AS (SELECT vec_id, vec_id % 2 AS same, least(1, greatest(0, round(list_cosine_similarity(embedding::DOUBLE[], anchor::DOUBLE[]), 4))) AS d FROM embeddings JOIN a USING (label))
    SELECT vec_id, d AS agreement, round(-(same * CASE WHEN d > 0 THEN greatest(ln(greatest(d, 1e-300)), -100) ELSE -100 END + (1 - same) * CASE WHEN d < 1 THEN greatest(ln(greatest(1 - d, 1e-300)), -100) ELSE -100 END), 5) AS loss FROM c""",
    views=False,
)
def prj_31(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings")
    anchor = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    cosine = F.round(G.cosine(F.col("embedding"), F.col("anchor")), 4)
    met = rows.join(anchor, "label").select("vec_id", cosine.alias("c"), (F.col("vec_id") % 2).alias("same"))
    return met.select("vec_id", F.least(F.greatest("c", F.lit(0.0)), F.lit(1.0)).alias("agreement"), F.round(G.agreement_loss(F.col("c"), F.col("same")), 5).alias("loss"))


@query(
    "prj_32_losses",
    "SELECT clip_id, round(avg(abs(open_prob - mar)), 9) AS l1, round(avg(pow(1 - open_prob, 2) + pow(mar, 2)), 9) AS squares, round(-avg(least(open_prob - 1, 0)) - avg(least(-mar - 1, 0)), 9) AS hinge, round(avg(pow(1 - mar, 2)), 9) AS generated, round(avg(abs(open_prob - mar)) * 10, 9) AS features FROM sv_frames WHERE valid_face GROUP BY 1",
)
def prj_32(spark, sf_dir):
    real, made = F.col("open_prob"), F.col("mar")
    one, zero = F.lit(1.0), F.lit(0.0)
    losses = {
        "l1": F.avg(F.abs(real - made)),
        "squares": F.avg((one - real) * (one - real) + made * made),
        "hinge": -F.avg(F.least(real - 1, zero)) - F.avg(F.least(-made - 1, zero)),
        "generated": F.avg((one - made) * (one - made)),
        "features": F.avg(F.abs(real - made)) * 10,
    }
    return T.frames(spark, sf_dir).where("valid_face").groupBy("clip_id").agg(*[F.round(c, 9).alias(n) for n, c in losses.items()])


@query("prj_33_exact_div", "SELECT clip_id, frame_idx, CAST((frame_idx * 12) // 4 AS BIGINT) AS quotient FROM sv_base")
def prj_33(spark, sf_dir):
    return T.base(spark, sf_dir).select("clip_id", "frame_idx", G.exact_div(F.col("frame_idx") * 12, F.lit(4)).alias("quotient"))


# ---------------------------------------------------------------- feature windows


def listed(column):
    return F.array_join(F.transform(column, lambda i: i.cast("string")), ",")


@query("win_14_sparse_context", ", d AS (SELECT clip_id, frame_idx, n_frames AS n, list_transform(range(-2, 3), lambda t: CAST(trunc((frame_idx + t) * 50 / 30.0::DOUBLE) AS BIGINT)) AS c FROM sv_base JOIN sv_clips USING (clip_id)) SELECT clip_id, frame_idx, array_to_string(flatten(list_transform(c, lambda a: CASE WHEN a < 1 OR a > n - 1 THEN [least(greatest(a, 0), n - 1), least(greatest(a, 0), n - 1)] ELSE [a - 1, a] END)), ',') AS places FROM d")
def win_14(spark, sf_dir):
    rows = T.base(spark, sf_dir).join(T.clips(spark, sf_dir), "clip_id")
    return rows.select("clip_id", "frame_idx", listed(A.sparse_context_places(F.col("frame_idx"), F.col("n_frames"), 30.0)).alias("places"))


@query("win_15_all_chunks", ", c AS (SELECT clip_id, n_frames AS n, unnest(range(n_frames * 2 + 10)) AS i FROM sv_clips), k AS (SELECT *, trunc(i * 50 / 30.0::DOUBLE) AS start_ FROM c) SELECT clip_id, CAST(i AS INTEGER) AS chunk, array_to_string(list_transform(range(-4, 6), lambda o: CAST(least(greatest(start_ + o, 0), n - 1) AS BIGINT)), ',') AS places FROM k WHERE i <= (SELECT min(j.i) FROM k j WHERE j.clip_id = k.clip_id AND j.start_ > j.n)")
def win_15(spark, sf_dir):
    """Every chunk of features, those after the end too; the last one is the first that starts behind the features."""
    rows = T.clips(spark, sf_dir).withColumn("chunk", F.explode(A.chunk_frames(F.col("n_frames"), 30.0)))
    return rows.select("clip_id", "chunk", listed(A.context_places(F.col("chunk"), F.col("n_frames"), 30.0)).alias("places"))


@query(
    "win_16_padded_training_context",
    ", f AS (SELECT clip_id, n_frames, f, j, (n_frames // 4 + f * 3) * 2 + j - 4 AS at_ FROM sv_clips, (SELECT unnest(range(5)) AS f), (SELECT unnest(range(10)) AS j)) SELECT f.clip_id, CAST(f AS INTEGER) AS f, CAST(j AS INTEGER) AS j, coalesce(b.open_prob, 0) AS value FROM f LEFT JOIN sv_base b ON b.clip_id = f.clip_id AND b.frame_idx = f.at_ WHERE at_ + 4 >= 0 AND at_ < n_frames + 4",
)
def win_16(spark, sf_dir):
    values = T.base(spark, sf_dir).select("clip_id", F.col("frame_idx").alias("at"), F.col("open_prob").alias("value"))
    frames = T.clips(spark, sf_dir).select("clip_id", F.floor(F.col("n_frames") / 4).cast("int").alias("start"), F.lit(3).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("f"))
    return A.padded_context(values, frames, ["clip_id"], "start", "step", "value")


@query("win_17_mel_crop", ", s AS (SELECT clip_id, list(k ORDER BY frame_idx) AS l FROM sv_base GROUP BY 1), c AS (SELECT b.clip_id, b.frame_idx, l[CAST(trunc(80.0::DOUBLE * (frame_idx / 25.0::DOUBLE)) AS BIGINT) + 1 : CAST(trunc(80.0::DOUBLE * (frame_idx / 25.0::DOUBLE)) AS BIGINT) + 13] AS cut FROM sv_base b JOIN s USING (clip_id)) SELECT clip_id, frame_idx, CASE WHEN len(cut) = 13 THEN array_to_string(cut, ',') END AS crop FROM c")
def win_17(spark, sf_dir):
    rows = T.base(spark, sf_dir).select("clip_id", "frame_idx", "k")
    spec = rows.groupBy("clip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "k"))), lambda s: s["k"]).alias("l"))
    cut = A.mel_crop(F.col("l"), F.col("frame_idx"), 25.0, length=13)
    return rows.join(spec, "clip_id").select("clip_id", "frame_idx", F.when(cut.isNotNull(), listed(cut)).alias("crop"))


@query("rsm_5_seek_windows", ", n AS (SELECT clip_id, n_frames * 97 AS n FROM sv_clips) SELECT clip_id, CAST(s AS INTEGER) AS start, CAST(least(s + 3000, n) AS INTEGER) AS stop FROM (SELECT *, unnest(range(0, n, 3000)) AS s FROM n)")
def rsm_5(spark, sf_dir):
    rows = T.clips(spark, sf_dir).select("clip_id", F.explode(A.seek_windows(F.col("n_frames") * 97)).alias("w"))
    return rows.select("clip_id", "w.start", "w.stop")


@query(
    "agg_12_trimmed_windows",
    ", w AS (SELECT clip_id, frame_idx // 20 AS w, frame_idx % 20 AS i, k, least(20, n_frames - frame_idx // 20 * 20) AS n FROM sv_base JOIN sv_clips USING (clip_id)) SELECT clip_id, array_to_string(list(k ORDER BY w, i), ',') AS ks FROM w WHERE i < n // 2 GROUP BY 1",
)
def agg_12(spark, sf_dir):
    """The first half of every window of 20 features, put together again in order."""
    rows = T.base(spark, sf_dir).join(T.clips(spark, sf_dir), "clip_id").withColumns({"w": F.floor(F.col("frame_idx") / 20), "i": F.col("frame_idx") % 20})
    half = F.floor(F.least(F.lit(20), F.col("n_frames") - F.col("w") * 20) / 2)
    kept = sampling.ordered_values(rows.where(F.col("i") < half), ["clip_id"], ["w", "i"], "k")
    return kept.select("clip_id", listed(F.col("k")).alias("ks"))


@query(
    "rsm_2_scores_back_in_full",
    ", s AS (SELECT clip_id, list(open_prob ORDER BY frame_idx) AS l FROM sv_base WHERE frame_idx % 3 <> 1 GROUP BY 1) SELECT b.clip_id, b.frame_idx, l[CAST(least(greatest(round_even(b.frame_idx * 15.0::DOUBLE / 25, 0), 0), len(l) - 1) AS BIGINT) + 1] AS mapped, coalesce(CAST(l[b.frame_idx + 1] AS VARCHAR), 'none') AS padded FROM sv_base b JOIN s USING (clip_id)",
)
def rsm_2(spark, sf_dir):
    """Scores at 15 a second on frames at 25 (the last one serves beyond the end), and at one rate (no score beyond the end)."""
    rows = T.base(spark, sf_dir).select("clip_id", "frame_idx", "open_prob")
    scored = sampling.ordered_values(rows.where("frame_idx % 3 <> 1"), ["clip_id"], ["frame_idx"], "open_prob").withColumnRenamed("open_prob", "l")
    met = rows.join(scored, "clip_id")
    same = sampling.score_at(F.col("l"), F.col("frame_idx"), 25.0, 25.0)
    return met.select("clip_id", "frame_idx", sampling.score_at(F.col("l"), F.col("frame_idx"), 25.0, 15.0).alias("mapped"), F.when(same == float("-inf"), "none").otherwise(same.cast("string")).alias("padded"))


DURATIONS = [1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6]


@query(
    "agg_6_eleven_passes",
    f""", d AS (SELECT clip_id, frame_idx, unnest({DURATIONS}) AS d, unnest(range(11)) AS pass, open_prob, n_frames FROM sv_frames JOIN sv_clips USING (clip_id)),
    s AS (SELECT clip_id, frame_idx, CASE WHEN frame_idx < n_frames - 4 THEN avg(open_prob) OVER (PARTITION BY clip_id, pass, frame_idx // (d * 25)) END AS score FROM d)
    SELECT clip_id, frame_idx, coalesce(CAST(round_even(avg(score) * 10, 0) / 10 AS VARCHAR), 'none') AS score FROM s GROUP BY 1, 2""",
)
def agg_6(spark, sf_dir):
    """Scores of eleven passes over windows of 1 to 6 seconds; missing ones do not count, frames without any get none."""
    rows = T.frames(spark, sf_dir).select("clip_id", "frame_idx", "open_prob").join(T.clips(spark, sf_dir), "clip_id")
    rows = rows.withColumns({f"m{d}": sampling.mean_of_window("open_prob", d * 25, ["clip_id"]) for d in sorted(set(DURATIONS))})
    covered = F.col("frame_idx") < F.col("n_frames") - 4
    score = sampling.mean_of_passes([F.when(covered, F.col(f"m{d}")) for d in DURATIONS])
    got = rows.select("clip_id", "frame_idx", score.alias("score"))
    return got.select("clip_id", "frame_idx", F.when(F.col("score") == float("-inf"), "none").otherwise(F.col("score").cast("string")).alias("score"))


__all__ = ["samples", "six"]
