"""Corpus operators against plain loops, libraries and held-out labels, with nulls, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameline.llm import ann, bpe, common, graph, jaccard, langid, lm, media, mixing, quality, sharding, tokencount
from frameline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " \t\n", "one", "One two three", "a b c d e f g h", "a b c d e f g h", "Ünïcode ſtraße İ 東京 naïve 12345", "x" * 5000, "<|endoftext|> it's we'll  don't", "word " * 3000]
WORDS = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def docs(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def empty(spark):
    return docs(spark).limit(0)


# ---- sharding


def test_sharding_is_even_and_keeps_the_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.4 else f"s{i % 7}" if i % 11 else None, i * 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, rank int")
    got = sharding.interleave(df, "doc_id", "source", 24, cells=16).toPandas()
    assert len(got) == 3000 and (got["rank"] == got["doc_id"] * 2).all()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(n) == 24
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    share = got.assign(s=got["source"].fillna("")).groupby(["s", "shard"]).size().unstack(0)
    assert (share.max() - share.min()).max() <= 3


def test_sharding_of_little(spark):
    df = docs(spark).select("doc_id", "source")
    assert sharding.interleave(df.limit(0), "doc_id", "source", 4).count() == 0
    got = sharding.interleave(df.unionAll(df), "doc_id", "source", 40).toPandas()
    assert len(got) == 2 * len(TEXTS) and got.groupby("shard").size().max() == 1
    with pytest.raises(ValueError):
        sharding.interleave(df.withColumn("Shard", F.lit(1)), "doc_id", "source", 4)


def test_sharding_query(spark):
    got = QUERIES["op2_sharding"](spark, SF).toPandas()
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all() and got["doc_id"].is_unique


# ---- token counts


def greedy(word: bytes, pieces: set[bytes]) -> int:
    s, n = b" " + word, 0
    while s:
        k = next((k for k in range(len(s), 0, -1) if s[:k] in pieces), 0)
        if not k:
            return 1
        s, n = s[k:], n + 1
    return n


def test_token_counts_against_greedy_matching(spark):
    rng = random.Random(5)
    pieces = {bytes(rng.choices(b" abcd", k=rng.randint(1, 5))) for _ in range(150)} | {b" ", b"a", b"b", b"c"}
    match = tokencount.LongestMatch(sorted(pieces))
    for _ in range(3000):
        w = bytes(rng.choices(b"abcd", k=rng.randint(1, 14)))
        assert match.count(w) == greedy(w, pieces), w
    vocabulary = tokencount.read_vocabulary(tokencount.default_vocabulary())
    known = set(vocabulary)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokencount.token_counts(docs(spark).withColumn("n", F.lit(1)), vocabulary).collect()}
    for i, t in enumerate(TEXTS):
        ws = (t or "").encode().split()
        assert got[i] == (len(ws), sum(greedy(w, known) for w in ws))
    assert tokencount.token_counts(empty(spark), vocabulary).count() == 0


# ---- quality


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_quality_of_odd_texts(spark):
    labelled = docs(spark).withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    voter = quality.fit(labelled, sample_docs=8, rank=4, neighbours=3)
    got = quality.score(docs(spark).withColumn("score_", F.lit(1)), voter).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS) and got[5].score == got[6].score and got[0].score == got[1].score
    assert quality.score(empty(spark), voter).count() == 0
    nothing = quality.fit(labelled.limit(0))
    assert {r.score for r in quality.score(docs(spark), nothing).collect()} == {0.5}


def test_quality_reads_long_words_to_their_end():
    ask = lambda *texts: quality.features(list(texts), quality._Slots())
    for head, ends in (("x" * 64, ("7", "?")), ("a1" * 4, ("B!", "%%"))):  # behind 64 characters, behind 8 runs
        f = ask(head, *(head + e for e in ends))
        assert not any(np.array_equal(f[i], f[j]) for i in range(3) for j in range(i))
    assert quality.shapes("Some") == ["Ba"] and quality.parts_of(["x" * 130, "y"]) == ["x" * 64, "x" * 64, "xx", "y"]


# ---- language model


def test_lm_base_against_counts(spark):
    train = docs(spark).where("doc_id % 3 <> 0")
    got = {r.doc_id: r for r in lm.score(docs(spark).select("doc_id", "text"), train.select("text")).collect()}
    token = {i: [*WORDS(t), None] for i, t in enumerate(TEXTS)}
    c = Counter(w for i, ws in token.items() if i % 3 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in token.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert np.isfinite(r.score) and r.score < 0
    assert got[5].score == got[6].score


def test_lm_score_token_by_token(spark):
    """The score of whole documents by loops over tokens, from the counts of the training texts and the fitted weights."""
    docs_ = common.table(spark, SF, "documents").select("doc_id", "text").repartition(3)
    train = docs_.where("doc_id % 7 <> 2").select("text")
    model, pairs, *_ = lm.fit(train)
    got = {r.doc_id: r for r in lm.score(docs_, train).collect()}
    train_words = [WORDS(r.text) for r in train.collect()]
    c = Counter(w for ws in train_words for w in ws)
    n, v = sum(c.values()) + len(train_words), len(c) + 1
    order = {w.decode(): i for i, w in enumerate(model.words)}
    bucket = lambda w: order[w] if w in order and order[w] < lm.OWN else lm.OWN + zlib.crc32(w.encode()[-3:]) % (lm.BOS - lm.OWN)
    cls = lambda w: order[w] // lm.BLOCK if w in order and order[w] < lm.HEAD else lm.BLOCKS + zlib.crc32(w.encode()[-3:]) % lm.SUFFIXES
    seen, totals = Counter(), [Counter(), Counter()]
    for ws in train_words:
        for before, w in zip([None, *ws], ws):
            if before != w and w in order and cls(w) >= lm.BLOCKS:
                seen[before, w] += 1
    room, of = Counter({k: 1 for k in range(lm.SUFFIXES)}), Counter()
    for w, k in c.items():
        if cls(w) >= lm.BLOCKS:
            room[cls(w) - lm.BLOCKS] += k + 1
    for (before, w), k in seen.items():
        totals[0][cls(w)] += k
        totals[1][cls(w)] += k if k > 2 else 0
        of[before, cls(w)] += k if k > 1 else 0
    chance = {k: min(0.9, max(1e-6, (totals[1][k] + 0.5) / (totals[0][k] + 1))) for k in range(lm.BLOCKS, lm.BLOCKS + lm.SUFFIXES)}

    def softmax(kind, one, two, outcome):
        _, _, group = lm.SIZES[kind]
        bias, a, b = model.weights[kind]
        z = (bias + a[one] + b[two])[outcome // group * group : (outcome // group + 1) * group]
        return (z[outcome % group] - np.log(np.exp(z).sum())) / np.log(10)

    hits = 0
    for r in docs_.collect()[::9]:
        ws, want = WORDS(r.text), 0.0
        for i, w in enumerate([*ws, None]):
            one = bucket(ws[i - 1]) if i else lm.BOS
            two = bucket(ws[i - 2]) if i > 1 else lm.BOS
            k = lm.END_CLASS if w is None else lm.REPEAT if i and ws[i - 1] == w else cls(w)
            want += softmax(0, one, two, k)
            if k < lm.BLOCKS:
                want += softmax(1, one % lm.COARSE, two % lm.COARSE, order[w])
            elif k < lm.END_CLASS:
                pair = (ws[i - 1] if i else None, w)
                if seen[pair] > 1:
                    hits += 1
                    want += np.log10(chance[k]) + np.log10(seen[pair] / of[pair[0], k])
                else:
                    want += np.log10(1 - chance[k]) + np.log10((c[w] + 1) / room[k - lm.BLOCKS])
        assert got[r.doc_id].score == pytest.approx(want, rel=2e-5), r.doc_id
        assert got[r.doc_id].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws) + np.log10((len(train_words) + 1) / (n + v + 1)), rel=1e-9)
    assert hits > 100 and pairs.count() >= 1


def test_lm_beats_its_base_and_knows_what_it_has_seen_twice(spark):
    got = QUERIES["op5_lm"](spark, SF).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()
    rng = random.Random(4)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(120)]
    twice = texts[:20]
    rows = docs(spark, texts + twice).select("doc_id", "text")
    scored = lm.score(rows, rows.select("text")).toPandas().set_index("doc_id")["score"]
    both = scored.loc[[*range(20), *range(120, 140)]]
    once = scored.loc[range(20, 120)].to_numpy()
    assert (both.to_numpy()[:, None] > once[None, :]).mean() > 0.9


def test_lm_of_little(spark):
    rows = docs(spark).select("doc_id", "text", F.lit(1).alias("a.b"))
    assert lm.score(rows.limit(0), rows.select("text")).count() == 0
    none = lm.score(rows.unionAll(rows), rows.select("text").limit(0)).toPandas()
    assert len(none) == 2 * len(TEXTS) and np.isfinite(none["score"]).all() and (none["train_tokens"] == 0).all()
    with pytest.raises(ValueError):
        lm.score(rows.withColumn("Score", F.lit(1)), rows.select("text"))


# ---- language


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_langid"](spark, sf).join(common.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95


def test_segmentations_are_all_summed():
    seg = langid.Segmenter(["a", "b", "ab", "ba", "aba"])
    prob = np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2]])

    def total(w):
        return 1.0 if not w else sum(prob[seg.index[w[:k]], 0] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in seg.index)

    words = ["a", "ab", "abab", "bababa"]
    assert np.allclose(np.exp(seg.log_likelihood(words, prob))[:, 0], [total(w) for w in words])


def test_language_of_odd_texts(spark):
    pieces = ["a", "b", "one", "two"]
    langs, prob = langid.train(docs(spark).where("lang is not null"), pieces)
    got = langid.predict(docs(spark), langs, prob, pieces).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[5].score == got[6].score
    assert langid.predict(empty(spark), langs, prob, pieces).count() == 0
    none = langid.train(empty(spark), pieces)
    assert {r.lang_pred for r in langid.predict(docs(spark), *none, pieces).collect()} == {"und"}


# ---- mixing


def test_mixing_rates_against_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 50)
    tokens = rng.integers(1, 500, 50)
    cells = spark.createDataFrame([(float(t), *map(float, q)) for t, q in zip(tokens, p)], "tokens double, p0 double, p1 double, p2 double")
    want, total = np.array([0.6, 0.3, 0.1]), float(tokens.sum())
    history = mixing.fit_rates(cells, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, total, rounds=80)
    x = np.array([r[0] for r in cells.select(mixing.rate_of([F.col("p0"), F.col("p1"), F.col("p2")], history)).collect()])
    assert (x >= 0).all() and np.abs((x * tokens) @ p / total - want).max() < 2e-3


def test_mixing_is_the_least_squares_fit_with_production_parameters(spark):
    cells = lambda rows: spark.createDataFrame(rows, "tokens double, p0 double, p1 double, p2 double")
    p = [F.col("p0"), F.col("p1"), F.col("p2")]
    rng = np.random.default_rng(6)
    bins = [(float(t), *map(float, q / q.sum())) for t, q in zip(rng.integers(1, 500, 60), rng.dirichlet([3, 0.6, 0.6], 60) + [0, 0, 0.013])]
    for purest in ([], [(40.0, 0.97, 0.02, 0.01)]):  # out of reach for the first, met by one small bin in the second
        rows = bins + purest + [(0.0, 1.0, 0.0, 0.0)]
        df, (tokens, q) = cells(rows), (np.array(rows)[:, 0], np.array(rows)[:, 1:])
        want, total = np.array([0.97, 0.02, 0.01]), tokens.sum()
        push = mixing.fit_rates(df, ["clean", "poor", "toxic"], mixing.TARGETS, float(total))
        x = np.array([r[0] for r in df.select(mixing.rate_of(p, push)).collect()]) * (tokens > 0)
        # the best mix of one, two or three bins is the best of all: three domains
        best = np.inf
        n = int((tokens > 0).sum())
        for k in range(n):
            for j in range(k + 1):
                a = q[[j, k]].T if j < k else q[[k]].T
                y = np.linalg.lstsq(a, want, rcond=None)[0]
                if (y >= 0).all():
                    best = min(best, np.linalg.norm(a @ y - want))
        gap = (x * tokens) @ q / total - want
        assert (x >= 0).all() and np.linalg.norm(gap) <= best * 1.001 + 2e-5


def test_mixing_moves_towards_the_targets(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_mixing"](spark, sf).toPandas()
    n, rated = got["n_tokens"], got["n_tokens"] * got["rate"]
    for d, w in mixing.TARGETS.items():
        assert abs((rated * got[f"p_{d}"]).sum() / n.sum() - w) <= abs((n * got[f"p_{d}"]).sum() / n.sum() - w) + 1e-6
    assert np.allclose(got[["p_clean", "p_poor", "p_toxic"]].sum(axis=1), 1) and (got["rate"] >= 0).all()


def test_mixing_of_odd_texts(spark):
    labelled = docs(spark).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain"))
    got = mixing.mix(docs(spark).withColumn("p0", F.lit(1)), labelled, {"a": 1.0, "b": 3.0}).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS) and got[0].n_tokens == 0 and got[5].rate == got[6].rate
    assert mixing.mix(empty(spark), labelled.limit(0), {"a": 1.0, "b": 1.0}).count() == 0
    assert mixing.mix(docs(spark), labelled.limit(0), {"a": 1.0, "b": 1.0}).count() == len(TEXTS)


# ---- n-gram join


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = WORDS(t)
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed: int, groups: int, copies: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([5, 12, 40, 120]))]
        for _ in range(rng.randint(1, copies)):
            ws = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else f"e{rng.random()}" for w in base]
            rows.append((len(rows), " ".join(ws) + (f" {passage}" if rng.random() < 0.3 else "")))
    return rows


@pytest.mark.parametrize("seed,groups,copies", [(1, 40, 5), (2, 3, 60)])
def test_join_against_all_pairs(spark, monkeypatch, seed, groups, copies):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    monkeypatch.setattr(jaccard, "COLD", 4)
    rows = near_copies(seed, groups, copies) + [(10_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df.withColumn("n", F.lit(1))).collect()}
    assert got == brute_components(rows)


def test_join_of_nothing(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    twice = docs(spark).unionAll(docs(spark))
    assert jaccard.jaccard_components(twice).count() == 2 * len(TEXTS)


def test_trie_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.choice(10_000, 80, replace=False)
    sets = [np.unique(np.concatenate([base[rng.random(80) > 0.08], rng.choice(10_000, rng.integers(0, 6))])).astype(np.uint64) for _ in range(60)]
    root, degree = jaccard.trie_links(sets, 85)
    want = [[j for j in range(60) if j != i and 100 * len(np.intersect1d(a, sets[j])) >= 85 * len(np.union1d(a, sets[j]))] for i, a in enumerate(sets)]
    assert degree == [len(w) for w in want]
    assert all(root[i] == root[j] for i, w in enumerate(want) for j in w)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for e in edges for k in e if e[0] != e[1]}


# ---- search


def test_search_recall_and_scores(spark):
    rows = common.table(spark, SF, "embeddings").select("vec_id", "embedding")
    x = rows.orderBy("vec_id").toPandas()
    v = np.stack(x["embedding"]).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = ann.search(rows, rows.where("vec_id % 5 = 0")).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(g["vec_id"]))
        assert np.allclose(g.sort_values("rank")["score"], s[g.sort_values("rank")["vec_id"]]) and sorted(g["rank"]) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * len(got)


def test_search_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 4)
    bad = [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [1.0, float("inf")]), (105, [1.0]), (None, [1.0, 0.0])]
    rows = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(30)] + [(50, [4.0, -3.0])] + bad, "vec_id bigint, embedding array<double>")
    got = ann.search(rows, rows.where("vec_id in (0, 7, 50, 100, 101)"), lists=2, probe_share=1.0).toPandas()
    top = {q: list(g.sort_values("rank")["vec_id"]) for q, g in got.groupby("query_id")}
    assert top == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4], 50: [0, 1, 2, 3, 4]}
    assert ann.search(rows.limit(0), rows.limit(0)).count() == 0
    assert ann.search(rows.where("vec_id = 101"), rows).count() == 0


def test_search_repeated_ids_extreme_sizes_and_other_columns(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.1e-200]), (3, [5e-324, 5e-324]), (4, [1.0, -1.0]), (4, [1.0, -1.0]), (5, [-1.0, -0.5]), (5, [1.0, 0.5]), (5, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id bigint, embedding array<double>, rank string, `a.b` double")
    got = ann.search(df, df, lists=2, probe_share=1.0).toPandas()
    assert not got.duplicated(["query_id", "vec_id"]).any() and not got.duplicated(["query_id", "rank"]).any()
    one = got[got.query_id == 1].sort_values("rank")
    assert list(one["vec_id"]) == [3, 2, 5, 4] and np.allclose(one["score"], [1.0, 2.1 / np.sqrt(2 * 2.21), 1.5 / np.sqrt(2 * 1.25), 0.0], atol=1e-12)


def test_shortlist_decides_by_codes(spark):
    """With a shortlist of a twentieth of the rows, codes alone keep nine tenths of the true neighbours."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(rows, rows.where("vec_id % 50 = 0"), shortlist=60, probe_share=0.9).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(g["vec_id"]))
    assert hits >= 0.9 * len(got) and len(got) == 150


# ---- media


def test_media_round_trip(spark):
    folder = common.fresh_path(spark, "media")
    index = media.store(docs(spark).repartition(2), folder)
    got = {r.doc_id: r for r in media.features(media.metadata(index, folder), folder).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.width, r.height, r.bit_depth) == (192, len(padded) // 192, 8) and r.media_sha256 == r.digest and r.media_bytes == r.length
    assert got[5].digest == got[6].digest and got[0].feature == got[1].feature
    assert media.store(empty(spark), folder).count() == 0
    import tarfile
    from pathlib import Path

    names = {m.name for f in Path(folder.removeprefix("file://")).glob("*.tar") for m in tarfile.open(f).getmembers()}
    assert names == {r.digest for r in got.values()}
    with pytest.raises(ValueError):
        media.store(docs(spark).withColumn("Digest", F.lit(1)), folder)


# ---- byte-pair encoding


def test_encoding_against_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    some = common.table(spark, SF, "documents").select("text").limit(60).toPandas()["text"].tolist()
    texts = [*TEXTS, *some]
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    got = bpe.round_trip(docs(spark, texts).withColumn("n", F.lit(1)), bpe.default_tokenizer()).orderBy("doc_id").collect()
    for r, w in zip(got, want):
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == w.ids
        assert r.decoded == t.decode(w.ids, skip_special_tokens=False)
    assert bpe.encode(empty(spark), bpe.default_tokenizer()).count() == 0


def test_vocabulary_stays_outside_the_repository():
    assert json.load(open(bpe.default_tokenizer()))["model"]["vocab"] and "repo" not in bpe.default_tokenizer()


# ---- pipeline


def test_pipeline_keeps_clean_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    documents = common.table(spark, sf, "documents")
    kept = documents
    for name, stage in pipeline.STAGES[:3]:
        kept = common.stage(stage(spark, kept, sf), f"test-{name}")
        assert kept.columns == documents.columns
    labels = common.table(spark, sf, "labels").toPandas().set_index("doc_id")["quality"]
    ids = set(kept.toPandas()["doc_id"])
    first = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in documents.collect()]).items() if i == c}
    clean = first & set(labels[labels == 1].index)
    assert len(clean & ids) >= 0.95 * len(clean)
    assert len(ids) == kept.count()


def test_pipeline_leaves_one_of_near_copies_on_five_words(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100)]
        for c in range(4):
            ws = list(base)
            for k in rng.sample(range(4, 96), c):  # two changed words: at most 0.848 on four words, 0.811 on five
                ws[k] = f"e{rng.random()}"
            texts.append(" ".join(ws))
    texts += [" ".join(f"t{k}" for k in range(100)), " ".join(f"x{k}" if k in (30, 60) else f"t{k}" for k in range(100))]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id for r in pipeline.unique(spark, docs(spark, texts), SF).collect()}
    assert got == set(root) and len(texts) - 1 not in got


def brute_groups(texts: list[str | None], n: int, percent: int) -> list[int]:
    """For each text the place of the first text of its group."""
    sets = []
    for t in texts:
        w = WORDS(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if root[a] != root[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_one_of_each_with_repeated_and_null_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "x")
    rows = [(3, base, "a", 1.0), (2, near, "b", 2.0), (2, "another text of the same id", "c", 3.0), (None, base, "d", 4.0), (None, "only here", "e", 5.0), (7, "only here too", "f", 6.0), (7, "only here too", "g", 7.0), (7, "only here too", "g", 7.0), (9, None, "h", 8.0), (10, " ", "i", 9.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string, __key double")
    got = [tuple(r) for r in jaccard.one_of_each(df, n=5, percent=80).collect()]
    again = [tuple(r) for r in jaccard.one_of_each(df.repartition(4), n=5, percent=80).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))  # the same rows at every run
    kept = sorted(((r[0], r[1]) for r in got), key=str)
    assert kept == sorted([(2, near), (2, "another text of the same id"), (None, "only here"), (7, "only here too"), (9, None), (10, " ")], key=str)


def test_any_column_name_and_repeated_rows(spark):
    odd = docs(spark).select("doc_id", "text", F.lit(1).alias("a.b"), F.lit("x").alias("c0"), F.lit(2.0).alias("Some name`s"))
    odd = odd.unionAll(odd)
    pieces = ["a", "b", "one", "two"]
    langs, prob = langid.train(docs(spark).where("lang is not null"), pieces)
    voter = quality.fit(docs(spark).withColumn("quality", (F.col("doc_id") % 2).cast("int")), sample_docs=8, rank=4, neighbours=3)
    labelled = docs(spark).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain"))
    folder = common.fresh_path(spark, "media")
    done = {
        "tokens": tokencount.token_counts(odd, [b" ", b"a", b"one"]),
        "lang": langid.predict(odd, langs, prob, pieces),
        "quality": quality.score(odd, voter),
        "media": media.features(media.metadata(media.store(odd, folder), folder), folder),
        "bpe": bpe.decode(bpe.encode(odd, bpe.default_tokenizer()), bpe.default_tokenizer()),
        "mixing": mixing.mix(odd, labelled, {"a": 1.0, "b": 3.0}),
        "sharding": sharding.interleave(odd, "doc_id", "c0", 3),
        "lm": lm.score(odd, odd.select("text")),
    }
    for name, df in done.items():
        rows = df.collect()
        assert len(rows) == 2 * len(TEXTS) and {"doc_id", "a.b", "c0", "Some name`s"} <= set(df.columns), name
        if name not in ("sharding", "media"):  # there equal rows stand in different places
            values = {}
            for r in rows:
                d = {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}
                assert values.setdefault(r["doc_id"], str(d)) == str(d), name
    for clash, run in (("N_tokens", lambda d: tokencount.token_counts(d, [b" "])), ("Lang_pred", lambda d: langid.predict(d, langs, prob, pieces)), ("SCORE", lambda d: quality.score(d, voter)), ("IDS", lambda d: bpe.encode(d, bpe.default_tokenizer())), ("Rate", lambda d: mixing.mix(d, labelled, {"a": 1.0}))):
        with pytest.raises(ValueError):
            run(docs(spark).withColumn(clash, F.lit(1)))


def test_voting_against_brute_force():
    rng = np.random.default_rng(5)
    x = np.abs(rng.standard_normal((60, quality.DIM))).astype(np.float32) * (rng.random((60, quality.DIM)) < 0.01)
    x[10:20] = x[10]  # ties
    labels = (rng.random(60) < 0.5).astype(float)
    for neighbours in (1, 7):
        voter = quality.voter_of(x.copy(), labels, 8, neighbours)
        weights = np.vstack([x[:30], np.zeros((1, quality.DIM), np.float32)])
        v = voter.project(weights).astype(np.float64)
        got = voter.score(weights)
        for i, u in enumerate(v):
            if not weights[i].any():
                assert got[i] == labels.mean()
                continue
            sims = (voter.project(weights[i : i + 1]) @ voter.vectors.T)[0].astype(np.float64)
            order = sorted(range(60), key=lambda k: (-np.float32(sims[k]), k))[:neighbours]
            w = np.maximum(sims[order], 0)
            assert got[i] == pytest.approx((w @ labels[order]) / w.sum(), abs=1e-4), (neighbours, i)


def test_letters_are_those_of_category_l():
    assert not any(map(langid.has_letter, ("½ ² ① Ⅷ 123 _", "", None, "!?")))
    assert all(map(langid.has_letter, ("a", "½ x", "東", "ª")))


def test_long_words_are_summed_whole():
    pieces = ["a", "b", "ab", "ba", "aba", "bab" * 5]
    seg = langid.Segmenter(pieces)
    prob = np.random.default_rng(2).dirichlet(np.ones(len(pieces) + 1), 2).T
    word = "abbabab" * 90 + "é"

    def total(k):
        from fractions import Fraction

        a = [Fraction(1)] + [Fraction(0)] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - seg.longest), e):
                p = seg.index.get(word[s:e], seg.unknown if s == e - 1 else None)
                if p is not None:
                    a[e] += a[s] * Fraction(float(prob[p, k]))
        from math import log

        return log(a[-1].numerator) - log(a[-1].denominator)

    assert np.allclose(seg.log_likelihood(["ab", word], prob)[1], [total(0), total(1)], rtol=1e-10)
    counts = seg.expected([word], np.ones((1, 2)), prob)
    lengths = np.array([*map(len, pieces), 1])
    assert np.allclose(lengths @ counts, len(word))  # the expected pieces cover the word


def test_sharding_spreads_many_small_strata(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    got = sharding.interleave(rows, "doc_id", "source", 24)
    phase = (F.pmod(F.xxhash64(F.lit(42), F.lit("phase"), F.concat(F.lit("="), F.col("source"))), F.lit(1 << 20)) + 0.5) / (1 << 20)
    most = rows.groupBy(F.floor((1 - phase) * sharding.CELLS).alias("cell")).count().agg(F.max("count")).first()[0]
    n = got.groupBy("shard").count().toPandas()["count"]
    assert most < 60 and n.max() - n.min() <= 1


def test_codec_refuses_uncovered_symbols(tmp_path):
    spec = json.load(open(bpe.default_tokenizer()))
    spec["model"] |= {"vocab": {"a": 0, "b</w>": 1, "a</w>": 2}, "merges": []}
    spec["added_tokens"] = [{**spec["added_tokens"][0], "id": 3, "content": "[X]"}]
    codec = bpe.Codec(json.dumps(spec))
    assert np.frombuffer(codec.encode_batch(["ab [X] aa"])[0], "<u4").tolist() == [0, 1, 3, 0, 2]
    with pytest.raises(ValueError):
        codec.encode_batch(["ac"])


def test_pipeline_whole(spark):
    """run() against the library and plain loops, stage by stage, and on an empty table and rows without ids."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    documents = common.table(spark, SF, "documents")
    by_name, kept = dict(pipeline.STAGES), documents
    for name in ("language", "quality"):
        kept = common.stage(by_name[name](spark, kept, SF), f"test-{name}")
    rows = kept.orderBy("doc_id").collect()
    root = brute_groups([r.text for r in rows], 5, 80)
    first = {rows[k].doc_id for k in set(root)}
    kept = common.stage(by_name["unique"](spark, kept, SF), "test-unique")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first)
    rated = mixing.mix(kept, mixing.labelled_documents(spark, SF, kept), mixing.TARGETS)
    want = {r.doc_id: r.n for r in rated.select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id")).alias("n")).collect()}
    got = pipeline.run(spark, SF).toPandas()
    assert Counter(got["doc_id"]) == Counter({k: n for k, n in want.items() if n})
    t = Tokenizer.from_file(bpe.default_tokenizer())
    texts = {r.doc_id: r.text for r in kept.collect()}
    for _, r in got.drop_duplicates("doc_id").iterrows():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    none, odd = documents.limit(0), documents.limit(40).withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))).withColumn("__lang", F.lit("x"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        done = stage(spark, odd, SF)
        assert done.count() >= 0 and (name == "token_ids" or done.columns == odd.columns), name
