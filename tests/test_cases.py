"""Small cases worked out by hand, and order-dependent operators against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from frameline.functions import decoding as D
from frameline.functions import english as E
from frameline.functions import geometry as G
from frameline.functions import speech as S
from frameline.functions import text as X
from frameline.operators import boxes, intervals, runs, sampling, scans, tracking, windows
from frameline.sources import timeline as T


X_re = re.compile(r"[<\[][^>\]]*[>\]]|\([^)]+?\)")


def frames(spark, mask, shots=None, valid=None):
    shots = shots or "0" * len(mask)
    valid = valid or "1" * len(mask)
    rows = [(1, i, int(s), m == "1", v == "1") for i, (m, s, v) in enumerate(zip(mask, shots, valid))]
    return spark.createDataFrame(rows, "clip_id bigint, frame_idx int, shot_id int, on_ boolean, valid_face boolean")


def bits(df, col):
    return "".join("1" if r[col] else "0" for r in df.orderBy("frame_idx").collect())


def test_runs_split_at_shots(spark):
    got = runs.true_runs(frames(spark, "1101", "0111"), F.col("on_")).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 0), (1, 1), (3, 3)]


def test_consecutive_runs(spark):
    df = spark.createDataFrame([(1, v) for v in (3, 1, 2, 7, 7)], "clip_id bigint, v int")
    assert sorted((r["first"], r["last"]) for r in runs.consecutive_runs(df, "v").collect()) == [(1, 3), (7, 7), (7, 7)]


def test_keep_and_dilate(spark):
    assert bits(runs.keep_runs(frames(spark, "1110110", "0011111"), F.col("on_"), 2), "kept") == "1100110"
    assert bits(runs.dilate(frames(spark, "00100", "00011"), F.col("on_"), 1, F.col("valid_face")), "dilated") == "01100"


def test_expand_within_segment(spark):
    df = frames(spark, "".join("1" if 10 <= i <= 19 else "0" for i in range(60)))
    seg = spark.createDataFrame([(1, 0, 0.5, 4.0)], "clip_id bigint, pos int, seg_start double, seg_end double")
    got = intervals.expand_within_segments(df, runs.true_runs(df, F.col("on_")), seg, F.col("on_"), 10.0, 1.0, F.col("valid_face"))
    assert sorted(r.frame_idx for r in got.collect()) == list(range(5, 30))


def test_interpolation(spark):
    rows = [(1, i, *((0.0, 0.0, 10.0, 10.0) if i == 0 else (2.0, 0.0, 12.0, 10.0) if i == 2 else (None,) * 4)) for i in range(4)]
    df = spark.createDataFrame(rows, "clip_id bigint, frame_idx int, x1 double, y1 double, x2 double, y2 double")
    got = {r.frame_idx: tuple(r[c] for c in windows.BOX) for r in windows.interpolate_boxes(df, F.col("frame_idx").isin(0, 2)).collect()}
    assert got[1] == (1, 0, 11, 10) and got[3] == (2, 0, 12, 10)


def test_ramp(spark):
    got = [r.alpha for r in windows.ramp(frames(spark, "1111"), F.col("on_")).orderBy("frame_idx").collect()]
    assert got == [0.5, 1.0, 1.0, 0.5]


def test_segment_frames_round_half_even(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.1)], "clip_id bigint, seg_start double, seg_end double")
    clip = spark.createDataFrame([(1, 25.0, 50)], "clip_id bigint, fps double, n_frames int")
    assert sorted(r.frame_idx for r in intervals.segment_frames(seg, clip).collect()) == [0, 1]


@pytest.mark.parametrize("segment,want", [((0.5, 1.5), [(0.5, 1.0, 0), (1.0, 1.5, 1)]), ((2.4, 2.6), [(2.4, 2.6, 1)]), ((3.0, 3.2), [(3.0, 3.2, -1)])])
def test_assign_split(spark, segment, want):
    seg = spark.createDataFrame([(1, 0, *segment)], "clip_id bigint, pos int, seg_start double, seg_end double")
    seen = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0)], "clip_id bigint, speaker_id int, t0 double, t1 double")
    got = intervals.assign_split(seg, seen).orderBy("t_start").collect()
    assert [(r.t_start, r.t_end, r.speaker_id) for r in got] == want


def test_chunks_and_lengths(spark):
    clip = spark.createDataFrame([(1, 25.0, 130)], "clip_id bigint, fps double, n_frames int")
    got = intervals.chunk_plan(clip, 2.0).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.start_frame, r.frame_count) for r in got] == [(0, 0, 50), (1, 50, 50), (2, 100, 30)]
    assert spark.range(1).select(intervals.effective_frames(F.lit(100), F.lit(3.99), F.lit(25.0))).first()[0] == 99


def test_boxes(spark):
    a, b = ([F.lit(float(x)) for x in box] for box in ((0, 0, 10, 10), (5, 0, 15, 10)))
    assert round(spark.range(1).select(G.iou(a, b)).first()[0], 6) == 0.333333
    rows = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 1, 1.0, 0.0, 11.0, 10.0, 0.8), (1, 0, 2, 20.0, 20.0, 30.0, 30.0, 0.7)]
    df = spark.createDataFrame(rows, "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double, score double")
    assert sorted(r.det_id for r in boxes.suppress(df, 0.4, ["clip_id", "frame_idx"]).collect()) == [0, 2]


def test_text(spark):
    got = spark.range(1).select(X.timestamp(F.lit(61.2)), X.timestamp(F.lit(61.2), True, ","), X.gender(F.lit(" Male ")), X.frame_rate(F.lit("30000/1001")), X.file_kind(F.lit("a/B.PNG"))).first()
    assert (got[0], got[1], got[2], got[4]) == ("01:01.200", "00:01:01,200", "male", "image") and math.isclose(got[3], 30000 / 1001)
    with pytest.raises(Exception):
        spark.range(1).select(X.frame_rate(F.lit("0/0"))).collect()
    df = spark.createDataFrame([("Ça [noise] va (bien), œuf!",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.normalised(True)("t")).collect()][0].strip() == "ca va oeuf"


def test_gender_vote(spark):
    df = spark.createDataFrame([(1, "male"), (1, "male"), (1, "female"), (1, "female"), (2, None), (3, "male")], "k bigint, gender string")
    assert {r.k: r.gender for r in intervals.gender_vote(df, ["k"]).collect()} == {1: None, 2: None, 3: "male"}


def test_parse_segments(spark):
    df = spark.createDataFrame([('[{"start": 1, "end": 2.5}]',), ("[]",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(S.parse_segments(F.col("v"))).collect()]
    assert got[0][0].end == 2.5 and got[1] == [] and got[2] is None and got[3] is None


def test_manifest(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a.mp4 1\n\nb.mp4\n")
    got = T.read_manifest(spark, str(tmp_path / "m.txt"), "/data/", repeat=2).collect()
    assert sorted((r.path, r.copy) for r in got) == [("/data/a.mp4", 1), ("/data/a.mp4", 2), ("/data/b.mp4", 1), ("/data/b.mp4", 2)]


def test_shot_numbers_against_a_loop(spark):
    rng = random.Random(3)
    flags = [rng.random() < 0.4 for _ in range(60)]
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate(flags)], "clip_id bigint, frame_idx int, f boolean")
    want, now, at = [], 0, 0
    for i, f in enumerate(flags):
        if i and f and i - at >= 5:
            now, at = now + 1, i
        want.append(now)
    assert [r.shot_no for r in scans.number_shots(df, F.col("f"), 5).orderBy("frame_idx").collect()] == want


def test_trackers(spark):
    rows = [(1, i, k, 5.0 * i + 100 * k, 0.0, 5.0 * i + 100 * k + 40, 40.0) for i in range(8) for k in (0, 1)]
    det = spark.createDataFrame(rows, "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double")
    got = tracking.track_many(det, frames(spark, "1" * 8, "00001111"), stride=1).collect()
    by = {(r.frame_idx, r.track_id) for r in got}
    assert by == {(i, t) for i in range(4) for t in (0, 1)} | {(i, t) for i in range(4, 8) for t in (2, 3)}
    assert len({r.det_id for r in tracking.track_one(det).collect()}) == 1


def test_nearest_keeps_ties_in_order(spark):
    rows = spark.createDataFrame([(1, i, [float(x)]) for i, x in enumerate((0, 1, 1, 3))], "g bigint, i bigint, v array<double>")
    anchor = spark.createDataFrame([(1, 0, [0.0])], "g bigint, anchor_id bigint, anchor array<double>")
    got = sampling.nearest_to(rows, anchor, "g", "i", G.euclidean(F.col("v"), F.col("anchor")), 2).orderBy("rank").collect()
    assert [r.i for r in got] == [1, 2]


def test_pad_or_trim_takes_the_first_rows_of_a_whole_clip(spark, monkeypatch):
    from frameline.plans import registry

    rows = [(1, 50 + i, i) for i in range(45)] + [(2, 39 + i, 7) for i in range(3)]
    monkeypatch.setattr(T, "base", lambda *_: spark.createDataFrame(rows, "clip_id bigint, frame_idx int, k int"))
    got = {r.clip_id: r.ks for r in registry.QUERIES["rsm_3_pad_or_trim"](spark, "").collect()}
    assert got == {1: ",".join(map(str, range(30))), 2: ",".join(["7"] * 3 + ["0"] * 27)}


def test_parse_segments_errors(spark):
    for text in ("{}", "[1", "[[1]]", '[{"start": 1}]', "speech"):
        with pytest.raises(Exception, match="segment"):
            spark.createDataFrame([(text,)], "v string").select(S.parse_segments(F.col("v"))).collect()
    lenient = spark.createDataFrame([('[[3, 4, "f"], {"start": 1, "end": 2, "gender": "M"}, [5], [2, 2]]',)], "v string").select(S.parse_segments(F.col("v"), strict=False)).first()[0]
    assert [tuple(s) for s in lenient] == [(1.0, 2.0, "male"), (3.0, 4.0, "female")]


@pytest.mark.parametrize(
    "said,written",
    [
        ("one oh one", "101"),
        ("twenty twenty one", "2021"),
        ("nineteen eighty four", "1984"),
        ("two hundred and five", "205"),
        ("three and a half million people", "3500000 people"),
        ("ten per cent of one hundred and one point five percent", "10% of 101.5%"),
        ("double seven five", "775"),
        ("the twenty first of the nineteen sixties", "the 21st of the 1960s"),
        ("minus five", "-5"),
        ("five million dollars", "$5000000"),
        ("twenty dollars and seven cents", "$20.07"),
        ("zero point five dollars", "$0.5"),
        ("one and two", "one and 2"),
        ("and a half", ""),
        ("hundreds", "100s"),
    ],
)
def test_english_numbers(spark, said, written):
    got = spark.createDataFrame([(said,)], "t string").select(E.numbers(F.col("t"))).first()[0]
    assert got == written if said != "zero point five dollars" else got in ("$0.5", "¢5")


def test_english_text(spark):
    text = "Mr. Smith [laughs] won't pay $20 (twenty), uh, it's been   1,000 colours!"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(E.english("t", {"colours": "colors"})).collect()
    assert got[0][0].split() == "mister smith will not pay $20 it has been 1000 colors".split() and got[1][0] is None


def test_normalised_against_unicode_categories(spark):
    import unicodedata

    texts = ["Ça va, <b>œuf</b> (bis) — naïve №5 ǆ Straße ½", "a\u0301\u0327 \x1c\u2003x", "[all gone]", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fold in (True, False):
        got = [r[0] for r in df.select(X.normalised(remove_diacritics=fold)("t")).collect()]
        for t, g in zip(texts, got):
            bare = X_re.sub("", t.lower())
            form = unicodedata.normalize("NFKD" if fold else "NFKC", bare)
            want = "".join(X.FOLDS.get(c, "" if fold and unicodedata.category(c) == "Mn" else " " if unicodedata.category(c)[0] in "MSP" else c) if fold else " " if unicodedata.category(c)[0] in "MSP" else c for c in form).lower()
            assert g.split() == want.split(), (fold, t)


def test_options_and_strict_values(spark):
    one = spark.range(1)
    n, i = F.lit(None).cast("double"), F.lit(None).cast("int")
    for args in ((F.lit(5), F.lit(5), F.lit(1.0), n, n), (i, F.lit(5), F.lit(0.0), n, n), (i, i, F.lit(0.0), F.lit(1.0), n), (i, i, F.lit(0.0), n, F.lit(1.5))):
        with pytest.raises(Exception):
            one.select(D.checked_options(*args)).collect()
    assert one.select(D.checked_options(F.lit(5), i, F.lit(0.0), F.lit(2.0), F.lit(1.0))).first()[0]
    for bad in (X.strict_boolean(F.lit("true")), X.optional_number(F.lit("x")), G.exact_div(F.lit(7), F.lit(2))):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_sources_and_lists(spark, tmp_path):
    (tmp_path / "v/deep").mkdir(parents=True)
    for name in ("b.MP4", "a.mp4", "deep/c.mp4", "d.txt"):
        (tmp_path / "v" / name).write_bytes(b"x")
    got = [r.path.rsplit("/v/")[1] for r in T.list_files(spark, str(tmp_path / "v"), ["mp4"]).collect()]
    assert got == ["a.mp4", "b.MP4", "deep/c.mp4"]
    (tmp_path / "clip.json").write_text('{"mp4_path": "a.mp4",\n "frames": 2, "face_list": [[1, 2, 3, 4]], "landmark_list": [[[1, 2]]], "isvalid": true}')
    clip = T.read_clip_metadata(spark, str(tmp_path / "clip.json")).first()
    assert (clip.mp4_path, clip.frames, clip.face_list, clip.isvalid) == ("a.mp4", 2, [[1, 2, 3, 4]], True)
    (tmp_path / "s.json").write_text('{"sentence_list": [{"start": 500, "end": 1250}]}')
    assert [tuple(r) for r in T.read_sentences(spark, str(tmp_path / "s.json")).collect()] == [(0.5, 1.25)]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    T.write_resumable(rows.limit(1), None, "k", str(tmp_path / "out"))
    T.write_resumable(rows, spark.read.json(str(tmp_path / "out")), "k", str(tmp_path / "out"))
    assert sorted(r.v for r in spark.read.json(str(tmp_path / "out")).collect()) == ["x", "y"]
    T.write_lists(rows.withColumn("of", F.lit("all")), "of", "v", str(tmp_path / "list"))
    assert (tmp_path / "list" / "all.txt").read_text() == "x\ny\n"
    said = spark.createDataFrame([(1, 0.0, 1.0, " a --> b "), (1, 1.0, 2.5, "c")], "clip int, a double, b double, said string")
    S.write_transcripts(S.transcript(said, "vtt", ["clip"], ["a"], "a", "b", "said"), "vtt", "clip", str(tmp_path / "vtt"))
    text = (tmp_path / "vtt" / "1.vtt").read_text()
    assert text == "WEBVTT\n\n00:00.000 --> 00:01.000\na -> b\n\n00:01.000 --> 00:02.500\nc\n\n"


def test_frame_rates(spark):
    rate = lambda v: spark.createDataFrame([(v,)], "v string").select(X.frame_rate(F.col("v"))).first()[0]
    assert rate("30000/1001") == pytest.approx(29.97003) and rate("25") == 25.0
    for bad in ("", "0/0"):
        with pytest.raises(Exception):
            rate(bad)


def test_settings(spark):
    from frameline.sources import settings

    got = settings.settings(spark, {"X_GPU_IDS": "0, 2,", "X_LATENTSYNC_STEPS": "0", "X_COLOR_MATCH": " Yes ", "X_USE_LR_ASD": "on", "X_VAD_URL": ""}, {"use_vsdlm": "true", "vad_url": "http://v"}, "X_").first()
    assert (got.gpu_ids, got.latentsync_steps, got.color_match, got.use_lr_asd, got.use_vsdlm, got.vad_url, got.asd_threshold) == ([0, 2], 1, True, True, False, "http://v", None)
    assert len(settings.SETTINGS) == 41


def test_predictor(spark):
    import numpy as np

    from frameline.functions import predict

    @predict.predictor("mean of three")
    def make():
        return lambda x: np.asarray(x).mean(axis=1)

    rows = spark.createDataFrame([([1.0, 2.0, 6.0],), ([0.0, 0.0, 3.0],)], "x array<double>")
    assert [r[0] for r in rows.select(predict.predicted("mean of three", ["x"], "double", shapes=[[3]])).collect()] == [3.0, 1.0]
    with pytest.raises(ValueError):
        predict.predicted("none", ["x"], "double")


def test_log_mel_against_numpy(spark):
    import numpy as np

    from frameline.functions import audio as A

    rng = np.random.default_rng(3)
    x = rng.standard_normal(1600)
    got = A.log_mel(spark.createDataFrame([(1, x.tolist()), (2, [0.1] * 100)], "k int, s array<double>"), "s", ["k"]).orderBy("k", "at").collect()
    padded = np.pad(x, 200, mode="reflect")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    power = np.abs(np.stack([np.fft.rfft(padded[t * 160 : t * 160 + 400] * w) for t in range(10)])) ** 2
    log = np.log10(np.maximum(power @ A.mel_filters(16_000, 400, 80).T, 1e-10))
    want = (np.maximum(log, log.max() - 8) + 4) / 4
    assert len(got) == 10 and np.allclose(np.array([r.level for r in got]), want)  # the second row is too short for a window
    filters = A.mel_filters(16_000, 400, 80)
    assert filters.shape == (80, 201) and (filters >= 0).all() and (filters.sum(1) > 0).all()


def test_tracks_expire_and_hold(spark):
    box = [(0.0, 0.0, 10.0, 10.0), (50.0, 0.0, 60.0, 10.0)]
    rows = [(1, f, 0) for f in range(20)]
    found = [(1, f, d, *box[d]) for f in range(20) for d in range(2) if d == 0 or f == 0]
    frames_ = spark.createDataFrame(rows, "clip_id bigint, frame_idx int, shot_id int")
    dets = spark.createDataFrame(found, "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double")
    got = tracking.track_many(dets, frames_, stride=3, most_missed=4).toPandas()
    # the second face is seen at frame 0 alone: held at 1, 2 and 4, not shown at frame 3 (looked for there), gone after 4
    assert sorted(got[got.track_id == 1].frame_idx) == [0, 1, 2, 4] and sorted(got[got.track_id == 0].frame_idx) == list(range(20))


def test_without_the_corpus_operators(tmp_path):
    """The rest imports and answers where the corpus operators are not there."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for part in ("frameline", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (root / part).is_dir() else shutil.copy)(root / part, tmp_path / part)
    shutil.rmtree(tmp_path / "frameline/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert e.oracle_sql().keys() <= q.keys(); print(len(q))"
    for lost in ((), ("corpus_pipeline.py",)):
        for name in lost:
            (tmp_path / name).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert done.returncode == 0 and int(done.stdout) > 150, done.stderr[-800:]
