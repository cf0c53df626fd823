"""Quality by voting of the nearest labelled documents in a latent-semantic space.

Features are hashed terms (lower-case words) and hashed outlines of words (runs of
letters, capitals, digits and signs), with log term weights and inverse document
frequencies, and two counts that reading order shows: words that repeat the one
before, and line ends.  A truncated singular-value decomposition of the labelled
documents gives the latent space.  The labelled vectors are broadcast: at most
``sample_docs`` of them (a documented bound), ``rank`` numbers each.  Every document
meets all of them in exact blocked cosine products; the nearest ``neighbours`` vote
with their similarity (those below 0: not at all) as weight.

Defined results: a null text is the empty text and gets the share of label 1 among
the labelled; texts are read whole; without labelled documents the score is 0.5;
ties in similarity go to the labelled document with the smaller id; equal texts get
equal scores, and repeated rows are scored one by one; repeated labelled rows vote
once each; an empty table gives an empty result; input columns are kept under any
name, and a new column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Slots of the hashed outlines and terms.
SHAPES, TERMS = 2048, 4096
DIM = SHAPES + TERMS
#: Terms weigh this much beside outlines.
TERM_WEIGHT = 0.5
CACHE_WORDS = 200_000
#: Longer words are read in parts of this many characters, and outlines in parts of this many runs; all of them count.
PART, RUNS = 64, 8
_PLAIN = re.compile(r"([A-ZÀ-ÖØ-Þ]?)[a-zß-öø-ÿ]+([^\w\s]?)")
_RUNS = re.compile(r"([a-zß-öø-ÿ]+)|([A-ZÀ-ÖØ-Þ]+)|([0-9]+)|([^\W\d_]+)|(.)", re.S)


def shapes(word: str) -> list[str]:
    """Outlines of a word, of 8 runs each: a run of lower-case letters is a, of capitals A (one: B), of digits 0, of other letters x; signs stay."""
    out, last = [], ""
    for m in _RUNS.finditer(word):
        k = m.lastindex
        now = ("a", "B" if len(m.group()) == 1 else "A", "0", "x", m.group())[k - 1]
        if now != last:
            out.append(now)
        last = now
    return ["".join(out[i : i + RUNS]) for i in range(0, len(out), RUNS)]


def parts_of(words: list[str]) -> list[str]:
    """The words, those over PART characters in parts."""
    if max(map(len, words)) <= PART:
        return words
    return [w[i : i + PART] for w in words for i in range(0, len(w), PART)]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SHAPES


def _term(word: str) -> int:
    return SHAPES + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % TERMS


#: A repeated word counts in several slots, so that repetition outweighs the words' outlines.
_REPEAT = [_slot(f"\0repeat{k}") for k in range(4)]
_LINE = _slot("\0line")


@cache
def _plain_slot(capital: bool, sign: str) -> int:
    """The slot of the outline that most words have: small letters, perhaps behind a capital or before a sign."""
    return _slot(("Ba" if capital else "a") + sign)


class _Slots(dict):
    """Word to the slots of its term and its outlines."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE_WORDS:
            self.clear()
        m = _PLAIN.fullmatch(word)
        s = self[word] = (_term(word), _plain_slot(m[1] != "", m[2])) if m else (_term(word), *map(_slot, shapes(word)))
        return s


def features(texts: list[str | None], known: _Slots) -> np.ndarray:
    """Weights[text, slot]: log of 1 and the share of words per thousand."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        words = (t or "").split()
        if not words:
            continue
        parts = parts_of(words)
        out[i] = np.bincount(np.fromiter(chain.from_iterable(map(known.__getitem__, parts)), np.int64), minlength=DIM)
        out[i, _REPEAT] += sum(map(str.__eq__, words, words[1:]))
        out[i, _LINE] += t.count("\n")
        out[i] *= 1000.0 / len(parts)
    out = np.log1p(out)
    out[:, SHAPES:] *= TERM_WEIGHT
    return out


class Voter:
    def __init__(self, idf: np.ndarray, space: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.idf, self.space, self.vectors, self.labels, self.neighbours = idf, space, vectors, labels, neighbours
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def project(self, weights: np.ndarray) -> np.ndarray:
        v = (weights * self.idf) @ self.space
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, sims: np.ndarray) -> np.ndarray:
        """Which labelled documents vote, by row: the ``neighbours`` most similar, ties to those that stand first."""
        k = min(self.neighbours, sims.shape[1])
        cut = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        chosen = sims >= cut
        for i in np.flatnonzero(chosen.sum(1) > k):
            tied = np.flatnonzero(sims[i] == cut[i])
            chosen[i, tied[k - int((sims[i] > cut[i]).sum()) :]] = False
        return chosen

    def score(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(weights), 0.5)
        sims = self.project(weights) @ self.vectors.T
        w = np.where(self.nearest(sims), np.maximum(sims, 0.0), 0.0).astype(np.float64)
        total = w.sum(1)
        vote = (w @ self.labels) / np.maximum(total, 1e-300)
        return np.where((weights.any(1)) & (total > 0), np.clip(vote, 0, 1), self.prior)


def latent_space(x: np.ndarray, rank: int, rounds: int = 3, seed: int = 9) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration on ``rank`` + 16 directions."""
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ np.linalg.qr(x @ q)[0])[0]
    return np.ascontiguousarray(q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :rank], np.float32)


def voter_of(x: np.ndarray, labels: np.ndarray, rank: int, neighbours: int) -> Voter:
    """Learns the space from the labelled documents' weights, which are changed in place; rows in the order in which ties are broken."""
    idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 0.3
    x *= idf
    space = latent_space(x, rank) if len(x) else np.zeros((DIM, rank), np.float32)
    v = x @ space
    return Voter(idf, space, np.ascontiguousarray(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)), labels, neighbours)


def fit(labelled: DataFrame, sample_docs: int = 4000, rank: int = 48, neighbours: int = 15, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id") -> Voter:
    """Learn from at most ``sample_docs`` labelled rows, drawn by a hash of the id; the driver holds ``sample_docs`` x DIM numbers."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(id_col, text_col, F.col(label_col).cast("double").alias("y"))
    n = rows.count()
    drawn = common.stage(rows.where(common.hash_below(F.col(id_col), min(1.0, sample_docs / max(n, 1)))), "quality-sample")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        known = _Slots()
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                b = whole.slice(i, 250)
                x = features(b[text_col].to_pylist(), known)
                # a text's slots and weights: as many as it has words
                at = [np.flatnonzero(r).astype("<u2") for r in x]
                put = [r[k].astype("<f2").tobytes() for r, k in zip(x, at)]
                yield pa.RecordBatch.from_arrays([b[id_col], b["y"], pa.array([k.tobytes() for k in at], pa.binary()), pa.array(put, pa.binary())], names=["id", "y", "slots", "weights"])

    got = drawn.mapInArrow(turn, "id bigint, y double, slots binary, weights binary").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(sample_docs).toPandas().sort_values("id", kind="stable")
    x = np.zeros((len(got), DIM), np.float32)
    row = None
    for row, slots, weights in zip(x, got["slots"], got["weights"]):
        row[np.frombuffer(slots, "<u2")] = np.frombuffer(weights, "<f2")
    labels = got.y.to_numpy().copy()
    del got
    voter = voter_of(x, labels, rank, neighbours)
    del x, row
    common.forget()  # the sample's numbers go back to the system
    return voter


def score(df: DataFrame, voter: Voter, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the weighted vote of each whole text."""
    shared, at = df.sparkSession.sparkContext.broadcast(voter), common.place_of(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        common.forget()
        known = _Slots()
        for whole in batches:
            for i in range(0, whole.num_rows, 250):
                b = whole.slice(i, 250)
                yield b, [pa.array(shared.value.score(features(b[at].to_pylist(), known)))]
        known.clear()
        common.forget()

    return common.add_columns(df, f"`{score_col}` double", run)


def fitted(spark, sf_dir: str, docs: DataFrame) -> Voter:
    """Learn from labelled rows whose id remainder modulo 5 is not 0."""
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "quality").where(F.col("quality").isNotNull())
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return fit(docs.select("doc_id", "text").where(common.id_remainder(F.col("doc_id"), 5) != 0).join(labels, "doc_id"))


def op4_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, fitted(spark, sf_dir, docs))
    return done.select("doc_id", (common.id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
