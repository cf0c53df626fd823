"""Operators for clips of any length against plain loops: chunks, range joins, matching, scans, trackers."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameline.operators import boxes, chunks, intervals, matching, runs, scans, search, tracking, windows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- chunks


def one_clip(spark, n, share=0.8, gap=0):
    rng = random.Random(7)
    rows = [(c, gap + i, i // 9, rng.random() if rng.random() < 0.9 else None, rng.random() < share) for c in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "clip_id bigint, frame_idx int, shot_id int, v double, f boolean")


@pytest.mark.parametrize("size,radius,gap", [(1, 3, 0), (5, 2, 0), (4, 9, 1000), (7, 0, 3), (4096, 2, 0)])
def test_chunks_with_margins(spark, size, radius, gap):
    df = one_clip(spark, 120, gap=gap)

    def op(d, keys):
        return runs.dilate(windows.temporal_max(d, "v", radius, keys=(*keys, "shot_id")), F.col("f"), radius, keys=keys)

    got = chunks.by_chunks(df, radius, op, size)
    assert got.columns == [*df.columns, "open_max", "dilated"]
    assert sorted(map(str, got.collect())) == sorted(map(str, op(df, ("clip_id",)).collect()))


def test_no_window_over_a_whole_clip(spark):
    done = chunks.by_chunks(one_clip(spark, 50), 2, lambda d, keys: runs.dilate(d, F.col("f"), 2, keys=keys), 8)
    windows_in = re.findall(r"Window \[.*", plan_of(done))
    assert windows_in and all("chunk#" in w.split("],")[1] for w in windows_in)
    with pytest.raises(ValueError):
        chunks.with_margins(done, -1)


@pytest.mark.parametrize("size", [1, 3, 64])
def test_runs_over_chunk_edges(spark, size):
    df = one_clip(spark, 150, share=0.93)  # runs go through many chunks
    got = sorted(map(tuple, chunks.true_runs(df, F.col("f"), size).collect()))
    assert got == sorted(map(tuple, runs.true_runs(df, F.col("f"), keys=("clip_id",)).collect()))
    assert chunks.true_runs(df.limit(0), F.col("f"), size).count() == 0


def test_places_without_a_window_over_the_clip(spark):
    frames = sorted(random.Random(2).sample(range(900), 200))
    df = spark.createDataFrame([(5, f) for f in frames], "clip_id bigint, frame_idx int")
    got = {r["frame_idx"]: r["place"] for r in chunks.placed(df, 16).collect()}
    assert got == {f: i for i, f in enumerate(frames)}


def test_places_in_a_whole_table(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, 1.0, 2.0, 3.0, rng.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v double, k int").repartition(7)
    got = {r["k"]: r["place"] for r in chunks.in_order(df, [F.asc_nulls_first("v"), F.asc("k")], parts=5).collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 1)}


# ---- beam search


def searched(table, first, end, size, most_steps, patience):
    """One key; ``table``: (step, prev) to [(token, lp)]."""
    live, done, most = [([first], 0.0)], [], round(size * patience)
    for step in range(most_steps):
        found = [(s + lp, b, r, t + [w]) for b, (t, s) in enumerate(live) for r, (w, lp) in enumerate(sorted(table.get((step, t[-1]), []), key=lambda x: (-x[1], x[0]))[: size + 1])]
        if not found:
            break
        new, ended = [], []
        for s, _, _, t in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if t[-1] == end:
                ended.append((t, s, True))
            else:
                new.append((t, s))
                if len(new) == size:
                    break
        done = (done + ended)[:most]
        live = new
        if len(done) >= most or not live:
            break
    if len(done) < size:
        rest = sorted(enumerate(live), key=lambda x: (x[1][1], x[0]), reverse=True)
        done += [(t + [end], s, False) for _, (t, s) in rest[: size - len(done)]]
    return sorted(done)


@pytest.mark.parametrize("size,most_steps,patience", [(1, 5, 1.0), (2, 12, 1.0), (3, 12, 2.0), (4, 3, 1.0)])
def test_beam_search_against_a_loop(spark, size, most_steps, patience):
    rng = random.Random(size)
    tables = {k: {(s, p): [(t, -rng.choice([0.5, 1.0, 2.0, 4.0 + t % 2])) for t in range(5) if rng.random() < 0.9] for s in range(rng.randrange(1, 14)) for p in range(4)} for k in range(12)}
    rows = [(k, s, p, t, lp) for k, table in tables.items() for (s, p), found in table.items() for t, lp in found]
    df = spark.createDataFrame(rows, "k int, step int, prev int, token int, lp double")
    start = spark.createDataFrame([(k,) for k in [*range(12), 99]], "k int")
    got = {}
    for r in search.beam_search(start, df, ["k"], 0, 4, size, most_steps, patience).collect():
        got.setdefault(r["k"], []).append((r["tokens"], r["score"], r["finished"]))
    assert {k: sorted(v) for k, v in got.items()} == {**{k: searched(t, 0, 4, size, most_steps, patience) for k, t in tables.items()}, 99: [([0, 4], 0.0, False)]}


# ---- ranges that meet


def test_ranges_of_any_length(spark):
    rng = random.Random(9)
    length = lambda: rng.choice([0.0, 0.5, 3.9, 4.0, 31.9, 32.0, 33.0, 500.0])
    mine = [(c, k, s, s + length()) for c in (1, 2) for k, s in enumerate([rng.randrange(0, 4000) / 4 for _ in range(60)])]
    theirs = [(c, s, s + length()) for c in (1, 2, 3) for s in [rng.randrange(-400, 4000) / 4 for _ in range(60)]]
    mine += [(1, 900, -5.0, 1e10), (1, 901, 3.0, float("inf")), (1, 902, float("nan"), 5.0), (1, 903, None, 5.0)]
    theirs += [(1, -1e10, 1e10), (2, 7.0, float("nan")), (1, 2e9, 2e9 + 1)]
    left = spark.createDataFrame(mine, "clip_id bigint, k int, a double, b double")
    right = spark.createDataFrame(theirs, "clip_id bigint, t0 double, t1 double")
    sound = lambda *x: all(v is not None and abs(v) <= 1e15 for v in x)  # noqa: E731  nan compares false
    for touch in (False, True):
        got = sorted((r["clip_id"], r["k"], r["t0"], r["t1"]) for r in intervals.meeting(left, right, "a", "b", "t0", "t1", touch).collect())
        meets = (lambda a, b, t0, t1: t0 <= b and t1 >= a) if touch else (lambda a, b, t0, t1: t0 < b and t1 > a)
        assert got == sorted((c, k, t0, t1) for c, k, a, b in mine for d, t0, t1 in theirs if c == d and sound(a, b, t0, t1) and meets(a, b, t0, t1))


def test_a_very_long_segment_is_assigned(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1e10), (1, 1, 2.0, 3.0)], "clip_id bigint, pos int, seg_start double, seg_end double")
    ivs = spark.createDataFrame([(1, 5, 0.0, 4.0), (1, 6, 4.0, 9.0), (1, 5, 1e9, 1e9 + 2)], "clip_id bigint, speaker_id int, t0 double, t1 double")
    got = sorted(map(tuple, intervals.assign_split(seg, ivs).collect()))
    assert got == [(1, 0, 0.0, 4.0, 5), (1, 0, 4.0, 9.0, 6), (1, 0, 9.0, 1e9, 5), (1, 0, 1e9, 1e9 + 2, 5), (1, 0, 1e9 + 2, 1e10, 5), (1, 1, 2.0, 3.0, 5)]
    plan = plan_of(intervals._pairs(seg, ivs, 0.5))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert intervals.assign_split(seg.limit(0), ivs).count() == 0
    assert {r["speaker_id"] for r in intervals.assign_split(seg, ivs.limit(0)).collect()} == {intervals.NOBODY}


# ---- matching


def test_greedy_pairs_against_a_loop(spark):
    rng = random.Random(12)
    edges = [(g, x, y, rng.choice([0.1, 0.5, 0.5, rng.random()])) for g in range(12) for x in range(6) for y in range(5) if rng.random() < 0.7]
    edges += edges[:9] + [(3, 1, 1, None), (99, None, 1, 0.5), (50, 1, 1, 0.2)]
    want, used = set(), set()
    for g, x, y, w in sorted((e for e in edges if e[3] is not None and e[1] is not None), key=lambda e: (-e[3], -e[1], -e[2])):
        if (g, "l", x) not in used and (g, "r", y) not in used:
            used |= {(g, "l", x), (g, "r", y)}
            want.add((g, x, y, w))
    df = spark.createDataFrame([e for e in edges if e[1] is not None], "g int, x int, y int, w double")
    got = list(map(tuple, matching.greedy_pairs(df, ["g"], "x", "y", "w").collect()))
    assert len(got) == len(want) and set(got) == want
    assert matching.greedy_pairs(df.limit(0), ["g"], "x", "y", "w").count() == 0


# ---- scans


def accepted(at, least):
    out, last = [], 0
    for f in at:
        if f - last >= least:
            out.append(f)
            last = f
    return out


def test_cuts_by_doubling(spark):
    cuts = spark.range(1, 200_001).select(F.lit(1).cast("long").alias("clip_id"), (F.col("id") * 2).cast("int").alias("frame_idx"), F.lit(True).alias("f"))
    got = scans.accepted_cuts(cuts, F.col("f"), 7)
    assert sorted(r["frame_idx"] for r in got.collect()) == accepted(range(2, 400_001, 2), 7)
    rng = random.Random(5)
    rows = [(c, f, rng.random() < 0.5) for c in range(6) for f in sorted(rng.sample(range(9000), 40 * c))]
    df = spark.createDataFrame(rows, "clip_id bigint, frame_idx int, f boolean")
    for least in (0, 1, 30, 5000):
        got = sorted((r["clip_id"], r["frame_idx"]) for r in scans.accepted_cuts(df, F.col("f"), least).collect())
        assert got == sorted((c, f) for c in range(6) for f in accepted([y for x, y, z in rows if x == c and z and y > 0], max(1, least)))


@pytest.mark.parametrize("k", [0.97, 1.0, -0.5, 0.0, 1e-9])
def test_recurrence_of_a_long_clip(spark, k):
    n = 1_000_000 if k == 0.97 else 30_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").cast("int").alias("frame_idx"), F.when(F.col("id") % 11 != 5, F.col("id") % 7 / 7.0 - 0.3).alias("x"))
    got = scans.recurrence(df, "x", k, "y", part=64 if n > 100_000 else 16).toPandas().sort_values("frame_idx")["y"].to_numpy()
    x, want, y = np.arange(n) % 7 / 7.0 - 0.3, np.zeros(n), 0.0
    x[np.arange(n) % 11 == 5] = 0
    for t in range(n):
        y = x[t] + k * y
        want[t] = y
    assert len(got) == n and np.allclose(got, want, rtol=1e-9, atol=1e-9)


# ---- trackers


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def followed(frames, found, stride, least, missed):
    """frames: (frame, shot) in order; found: boxes by frame."""
    out, tracks, born, shot = [], {}, 0, None
    for place, (f, s) in enumerate(frames):
        cut = place == 0 or s != shot
        shot = s
        if cut:
            tracks = {}
        if cut or place == len(frames) - 1 or place % max(stride, 1) == 0 or not tracks:
            here = found.get(f, [])
            pairs = sorted(((iou(b, h), t, k) for t, (b, _) in tracks.items() for k, h in enumerate(here)), reverse=True)
            of, gone = {}, set()
            for near, t, k in pairs:
                if near >= least and t not in gone and k not in of:
                    of[k] = t
                    gone.add(t)
            for k in range(len(here)):
                if k not in of:
                    of[k], born = born, born + 1
                tracks[of[k]] = (here[k], f)
            shown = [(of[k], here[k]) for k in range(len(here))]
            tracks = {t: v for t, v in tracks.items() if f - v[1] <= missed}
        else:
            tracks = {t: v for t, v in tracks.items() if f - v[1] <= missed}
            shown = [(t, b) for t, (b, _) in tracks.items()]
        out += [(f, t, *b) for t, b in shown]
    return out


@pytest.mark.parametrize("n,stride,missed", [(400, 1, 2), (400, 3, 8), (400, 0, 0), (60_000, 3, 8)])
def test_tracks_against_a_loop(spark, n, stride, missed):
    rng = random.Random(n + stride)
    frames = [(f, f // 70) for f in range(n) if rng.random() < 0.97]
    found = {f: [(x := 40.0 * k + rng.randrange(0, 24), y := float(rng.randrange(0, 9)), x + 30, y + 30) for k in range(rng.choice([0, 1, 2, 3, 3]))] for f, _ in frames if rng.random() < 0.9}
    rows = spark.createDataFrame([(4, f, s) for f, s in frames], "clip_id bigint, frame_idx int, shot_id int")
    dets = spark.createDataFrame([(4, f, k, *b) for f, bs in found.items() for k, b in enumerate(bs)], "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double")
    got = sorted(tuple(r)[1:] for r in tracking.track_many(dets.repartition(5), rows.repartition(5), stride, 0.3, missed).collect())
    assert got == sorted(followed(frames, found, stride, 0.3, missed))


def test_trackers_of_nothing(spark):
    rows = spark.createDataFrame([(4, 0, 0)], "clip_id bigint, frame_idx int, shot_id int")
    dets = spark.createDataFrame([], "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double")
    assert tracking.track_many(dets, rows).count() == 0 and tracking.track_one(dets).count() == 0
    assert boxes.Faces(0.3, 8).look(0, np.zeros((0, 4))).size == 0
