"""What the findings of round 3 named: plans without wide joins, expressions computed once a row, small batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import oracle
from frameline.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_landmarks_are_not_joined_to_frames(spark):
    df = registry.QUERIES["flt_7_eligible_clips_in_full"](spark, SF)
    assert "Join" not in plan_of(df) and "BroadcastExchange" not in plan_of(df)


@pytest.mark.parametrize("name", ["mth_1_time_rules", "flt_12_final_gate"])
def test_parts_are_not_repeated_in_each_other(spark, name):
    """Whatever the optimiser inlines, the expression stays short, so a row's work does."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") < 60


@pytest.mark.parametrize("name", ["smp_2_pose_similarity", "smp_2_pose_similarity_and_closed_mouth", "smp_2_pose_similarity_and_mouth_dissimilarity", "top_3_mouth_opening"])
def test_landmarks_are_neither_joined_nor_sorted(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "Join" not in plan and "min_by" not in plan


def test_suppression_holds_one_frame_at_a_time(spark):
    from frameline.operators import boxes

    kind = "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double, score double"
    rows = [(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 0, 1, 1.0, 0.0, 11.0, 10.0, 0.9), (1, 0, 2, 2.0, 0.0, 12.0, 10.0, float("nan")), (1, 0, 3, None, 0.0, 12.0, 10.0, None), (1, 1, 0, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 1, 1, 50.0, 0.0, 60.0, 10.0, 0.5)]
    got = boxes.suppress(spark.createDataFrame(rows, kind), 0.4, ["clip_id"])
    assert "FlatMapGroups" not in plan_of(got) and got.schema == spark.createDataFrame(rows, kind).schema
    assert sorted((r.frame_idx, r.det_id) for r in got.collect()) == [(0, 1), (0, 3), (1, 0), (1, 1)]


def test_texts_are_changed_in_slices(monkeypatch):
    import pyarrow as pa

    from frameline.functions import text as X

    monkeypatch.setattr(X, "SLICE_BYTES", 64)
    texts = ["plain " * 20, None, "é", "", "ﬁ", "x" * 500, "å" * 100, None] * 9
    got = X._in_slices(pa.array(texts), lambda x: x.upper()).to_pylist()
    assert got == [x if x is None or x.isascii() else x.upper() for x in texts]
    assert len(X._in_slices(pa.array([], pa.string()), str.upper)) == 0


def test_the_search_keeps_no_steps_that_it_cannot_reach(spark, monkeypatch):
    from frameline.operators import search

    kept, real = {}, search.stage

    def stage(df, name, by=None):
        done = real(df, name, by)
        kept.setdefault(name, done)
        return done

    monkeypatch.setattr(search, "stage", stage)
    table = spark.range(40).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("step"), F.lit(0).alias("prev"), F.lit(0).alias("token"), F.lit(-1.0).alias("lp"))
    got = search.beam_search(spark.range(1).select(F.lit(1).alias("k")), table, ["k"], 0, 9, 1, 3).collect()
    assert [r.tokens for r in got] == [[0, 0, 0, 0, 9]]
    assert sorted(r.step for r in kept["search-table"].collect()) == [0, 1, 2]


def test_ties_of_passes_fall_as_sums_in_order_do(spark, tmp_path):
    """Eleven passes are added in their order, the values of a window in the order of frames, however rows are joined and spread."""
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id in (237, 687, 824, 1305)")
    copies = events.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("event_id", F.col("event_id") + F.col("c") * 100_000).drop("c")
    copies.repartition(7, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    rows, counts, n = {}, {}, {}
    for r in sorted(copies.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        at = n[r.user_id] = n.get(r.user_id, -1) + 1
        score = None if r.event_type == "error" else int(min(r.value, 100.0)) / 100.0
        rows[r.user_id, at] = [(r.user_id, d, at // (d * 25)) for d in (1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6)]
        for key in set(rows[r.user_id, at]) if score is not None else ():
            total, k = counts.get(key, (0.0, 0))
            counts[key] = total + score, k + 1
    want = {}
    for (clip, at), keys in rows.items():
        means = [counts[k][0] / counts[k][1] for k in keys if k in counts] if at < n[clip] - 3 else []
        total = 0.0
        for m in means:
            total += m
        want[clip, at] = str(round(total / len(means) * 10) / 10) if means else "none"
    spread = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "29", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in spread}
    try:
        for k, v in spread.items():
            spark.conf.set(k, v)
        got = {(r.clip_id, r.frame_idx): r.score for r in registry.QUERIES["agg_6_eleven_passes"](spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) > 10_000
    assert got == want


def one_face_in_arrays(frames: list[list[tuple]], least_iou: float = 0.15, most_diagonals: float = 1.5) -> list[int | None]:
    """The place of the box that is followed in each frame of a clip, all boxes of a frame in arrays."""
    import numpy as np

    from frameline.operators.boxes import pair_iou

    face, out = None, []
    for found in frames:
        box = np.array(found, float)
        centre = (box[:, :2] + box[:, 2:]) / 2
        if face is None:
            middle = np.array([320.0, 240.0])
            seed = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]) * np.maximum(0.2, 1 - np.hypot(*(centre - middle).T) / np.hypot(*middle))
            pick = int(seed.argmax())
        else:
            near, away = pair_iou(face[None], box)[0], np.hypot(*(centre - (face[:2] + face[2:]) / 2).T)
            reach = most_diagonals * max(1.0, np.hypot(*(face[2:] - face[:2])))
            pick = int(near.argmax()) if near.max() >= least_iou else int(away.argmin()) if away.min() <= reach else -1
        face = box[pick] if pick >= 0 else None
        out.append(pick if pick >= 0 else None)
    return out


@pytest.mark.parametrize("batch", ["1", "3", "10000"])
def test_one_face_is_followed_over_batches_without_gathered_frames(spark, batch):
    """Frames that are cut over batches, missing corners, missing numbers and a missing clip; nothing is gathered by frame or sent row by row."""
    import random

    from frameline.operators import tracking

    draw = random.Random(5)
    coordinate = lambda: draw.choice([None, float("nan"), 0.0]) if draw.random() < 0.02 else float(draw.randrange(0, 500, 20))
    rows, want = [], []
    for clip in (None, 1, 2, 3):
        frames = []
        for frame in (None, *range(60)):
            found = []
            for k in range(draw.randrange(1, 5)):
                x, y, side = coordinate(), coordinate(), float(draw.choice([30, 60, 90]))
                found.append((None if k == 0 and draw.random() < 0.1 else k, x, y, None if x is None else x + side, None if y is None else y + side))
            rows += [(clip, frame, *b) for b in found]
            frames.append((frame, found))
        picks = one_face_in_arrays([[b[1:] for b in found] for _, found in frames])
        want += [(clip, frame, found[p][0]) for (frame, found), p in zip(frames, picks) if p is not None]
    draw.shuffle(rows)
    kind = "clip_id bigint, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = tracking.track_one(spark.createDataFrame(rows, kind))
        assert "collect_list" not in plan_of(df) and "UDTF" not in plan_of(df)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 100


def test_lines_share_their_words():
    """A line's end between two signs is a seam: words on its sides are encoded once; all texts come out as the library gives them."""
    import public_tokenizers

    from frameline.llm.tokenfile import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = Encoder(f.read())
    texts = ["x one.\nTwo three", "x three\none. Two", "", " ", "a", "a  b", "a\n\nb c", "a b\n", "x don't\n'tis\n12é", "x a\tb\nc", "x <|endoftext|>\nz"]
    assert e.encode(texts) == e._ids(texts) and e.encode(texts[::-1]) == e._ids(texts[::-1]) and e.encode([]) == []
    assert {"Two", "one."} <= e.known["\n"].keys() and "Two" in e.known[" "]


def test_letters_go_past_the_splitter():
    """Words of letters and end signs go to the library's model as pieces, not through its splitter; all texts come out as the library gives them."""
    import random

    import public_tokenizers

    from frameline.llm.tokenfile import Encoder

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.signs = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.signs += sum(map(len, texts))
            return self.tokenizer.encode_batch_fast(texts, **how)

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = Encoder(f.read())
    whole, e.tokenizer = e._ids, Counted(e.tokenizer)
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdéñßÀЖ東ªa", k=draw.randint(1, 12))) + draw.choice(["", "", ".", "!!", ",\nNew"]) for _ in range(300)) for _ in range(20)]
    got = e.encode(texts)
    assert e.tokenizer.signs < sum(map(len, texts)) / 20
    assert got == whole(texts) and e.encode(texts) == got
    for seam in ("\u0085", "\u00a0", "\u2028", "\u3000", "\x1f", "\x0b", "\r", "\n\n", "  ", "\t"):
        odd = [f"one{x}two three{y}" for x in (seam, seam + " ", " " + seam, seam + "\n", "\n" + seam, f" {seam} ") for y in ("", seam, " " + seam)]
        assert e.encode(odd) == whole(odd) and e.encode([x[3:] for x in odd]) == whole([x[3:] for x in odd])


def test_added_tokens_may_span_letters_and_signs():
    import json

    import public_tokenizers

    from frameline.llm.tokenfile import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append(spec["added_tokens"][0] | {"id": 50257, "content": "oo.", "special": False})
    e, texts = Encoder(json.dumps(spec)), ["a foo. too. oo.", "foo oo\nboo.!"]
    assert e.by_words and e.encode(texts) == e._ids(texts)


def test_widths_of_whole_bytes_are_written_as_bits():
    """The format is the same whichever way a block is packed: the low bits of one id after another."""
    import numpy as np

    from frameline.llm import tokenfile

    for width in (8, 16, 32):
        row = np.random.default_rng(width).integers(0, 1 << width, (1, 100)).astype(np.uint32)
        row[0, :2] = 0, (1 << width) - 1
        bits = "".join(f"{x:0{width}b}"[::-1] for x in row[0].tolist())
        (block,) = tokenfile.pack(row, 100.0)
        assert block[tokenfile.HEAD.size :] == bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        assert (tokenfile.unpack([memoryview(block)]) == row[0]).all()
