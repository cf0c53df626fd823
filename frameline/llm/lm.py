"""A hashed maximum-entropy language model with class-factored softmax.

P(token | history) = P(class | history) * P(word | class, history).  The history is
seen through hashed features: the word before (n-gram) and the one before that (skip).
Classes: blocks of the most frequent words; suffix-hash classes for all other words;
the text's end; and REPEAT, a token equal to the one before.

Inside a block of frequent words a second softmax with the same two features (hashed
more coarsely) picks the word.  Inside a suffix class a two-way softmax first decides
between PAIR and OTHER.  PAIR: the word follows the word before, as it does at least
twice in training; such pairs are hashed features with a weight of their own, and the
pairs of one first word and class share the probability by their counts.  OTHER: words
have their add-one share of the class's training tokens.  The table of pairs has no
fixed size: it is a distributed table that grows with the training texts.  A repeated
token is read as REPEAT only and a word that is in the table as PAIR only, so the
probabilities of all texts add up to slightly less than one.

Training sees every training token in one pass: each task counts its sparse
(feature, feature, outcome) cells and pairs in numpy, packs them by feature value or by
range of the pairs' hashes, and Spark brings the packs of one value or range together.
Gradient rounds run over the summed cells, one row a feature value, their gradients
added by Spark.  PAIR's chance in a class is the optimum of its two-way softmax, counted
as if each token were left out of the counts (pairs seen three times or more).  Scoring
looks the pairs of all documents up range by range.  Word counts stay a distributed
table; words too rare for the broadcast head (at most ``KNOWN`` words) are joined, and
take no part in pairs as second word.

Defined results: a null text is the empty text, one end token; texts are scored
whole; with no training rows every count is 0 and the score is finite; equal texts
get equal scores up to the rounding of sums; repeated rows are scored separately; an
empty table gives an empty result; other columns are kept under any name, and a new
column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HEAD, BLOCK, SUFFIXES = 1024, 32, 32
#: Words with their counts in the broadcast, at most.
KNOWN = 100_000
CACHE_WORDS = 50_000
#: Documents taken at once, and distinct words a task counts before it hands them on.
SLICE, COUNTED = 250, 150_000
BUCKETS, OWN, BOS = 256, 192, 255
COARSE = 32
BLOCKS = HEAD // BLOCK
END_CLASS, REPEAT = BLOCKS + SUFFIXES, BLOCKS + SUFFIXES + 1
CLASSES = REPEAT + 1
#: Bits of a known word's index in a pair's hash; training tokens of a range of pairs, about; pairs a task holds before it packs them.
INDEX_BITS, RANGE_TOKENS, HELD = 17, 4_000_000, 1_500_000
#: Bits of the word before and the class in a pair's hash, and bytes of the whole: two first words meet with a chance of 2 ** -31.
FEATURE_BITS, KEY_BYTES = 31, 6
#: Groups that the packs of one feature value are summed in first.
SALTS = 64


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _suffix(word: bytes) -> int:
    return zlib.crc32(word[-3:])


class Vocabulary:
    """Per word index: feature bucket, class, place in the head, log10(count + 1)."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.index = {w: i for i, w in enumerate(words)}
        self.size = len(words)
        n = len(words) + CACHE_WORDS + 300_000
        self.bucket, self.cls = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.log_count, self.hash = np.zeros(n), np.zeros(n, np.uint64)
        self.log_count[: self.size] = np.log10(np.array(counts, np.float64) + 1)
        self.extra: list[bytes] = []
        for i, w in enumerate(words):
            self._place(i, w)

    def _place(self, i: int, w: bytes) -> None:
        s = _suffix(w)
        self.hash[i] = xxhash.xxh3_64_intdigest(w)
        self.bucket[i] = i if i < OWN and i < self.size else OWN + s % (BOS - OWN)
        self.cls[i] = i // BLOCK if i < HEAD and i < self.size else BLOCKS + s % SUFFIXES

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Indices; words outside the broadcast get indices from ``size`` on, kept for a while."""
        get = self.index.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for j in np.flatnonzero(out < 0):
            w = words[j]
            i = self.index.get(w)
            if i is None:
                i = self.index[w] = self.size + len(self.extra)
                self.extra.append(w)
                if i >= len(self.cls):
                    self.bucket, self.cls, self.log_count, self.hash = (np.concatenate([a, np.zeros(len(a), a.dtype)]) for a in (self.bucket, self.cls, self.log_count, self.hash))
                self._place(i, w)
            out[j] = i
        return out

    def trim(self) -> None:
        if len(self.extra) > CACHE_WORDS:
            for w in self.extra:
                del self.index[w]
            self.extra = []


def events(vocab: Vocabulary, split: list[list[bytes]]):
    """Flat arrays over all tokens with their ends: word index (-1: end), class, both features; and where each text starts."""
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(starts[-1])
    ids = np.full(total, -1, np.int64)
    inside = np.ones(total, bool)
    inside[starts[1:] - 1] = False
    ids[inside] = vocab.look_up([w for s in split for w in s])
    bucket = np.where(inside, vocab.bucket[ids], BOS).astype(np.int64)
    one = np.concatenate([[BOS], bucket[:-1]])  # after an end the next text begins, and an end's bucket is BOS
    two = np.concatenate([[BOS], one[:-1]])
    two[starts[:-1]] = BOS
    cls = np.where(inside, vocab.cls[ids], END_CLASS).astype(np.int64)
    same = inside & np.concatenate([[False], ids[1:] == ids[:-1]])
    cls[same] = REPEAT
    return ids, cls, one, two, starts


def pairs_of(vocab: Vocabulary, ids: np.ndarray, cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the tokens that a pair may explain, the pairs' hashes): 31 bits for the word before and the class, then the word's index."""
    words = np.where(ids >= 0, vocab.hash[ids], np.uint64(0))
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]])
    before[starts[:-1]] = 0
    at = np.flatnonzero((cls >= BLOCKS) & (cls < END_CLASS) & (ids < vocab.size))
    f = (before[at] ^ (cls[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    f ^= f >> np.uint64(32)
    f *= np.uint64(0xD6E8FEB86659FD93)
    return at, ((f >> np.uint64(64 - FEATURE_BITS)) << np.uint64(INDEX_BITS) | ids[at].astype(np.uint64)).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Hashes of pairs in 6 bytes each."""
    return keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpack(raw: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :KEY_BYTES] = flat
    return out.view("<i8").ravel()


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of pairs; the word takes part, so that a frequent first word is spread."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(ranges)).astype(np.int64)


def feature_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of first words and classes."""
    return range_of(keys >> INDEX_BITS, ranges)


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with their summed numbers."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(n, first)


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(w binary, c long) over all texts: counted in each task, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "c"])

        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                for t in whole.slice(i, SLICE)[0].to_pylist():
                    seen.update(tokens(t))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()
        seen.clear()
        pa.default_memory_pool().release_unused()

    return texts.select(text_col).mapInArrow(run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


PACKS = "kind int, first int, salt int, at binary, n binary"


def _counted(texts: DataFrame, shared, text_col: str, ranges: int) -> DataFrame:
    """Packs of training counts: kind 0 for classes, 1 for words inside their blocks (``first``: the n-gram feature's value), 2 for pairs (``first``: a range of first words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared)
        sums = {k: np.zeros((n, n * outcomes), np.int32) for k, (n, outcomes, _) in SIZES.items()}
        held: list[np.ndarray] = []
        salt = TaskContext.get().partitionId() % SALTS  # which group sums a pack first; a task that runs again must choose the same

        def packed(kind: int, first: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            """One row for each value of ``first``, which is in order."""
            cuts = np.flatnonzero(np.diff(first)) + 1
            code = pack if kind == 2 else lambda a: a.astype("<i4").tobytes()
            rows = [(int(f[0]), code(a), c.astype("<u4").tobytes()) for f, a, c in zip(np.split(first, cuts), np.split(at, cuts), np.split(n, cuts)) if len(f)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([0 if kind == 2 else int(salt)] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "first", "salt", "at", "n"])

        def pairs() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            r = feature_range(keys, ranges)
            order = np.argsort(r, kind="stable")
            yield from packed(2, r[order], keys[order], n[order])
            held.clear()

        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                vocab.trim()
                ids, cls, one, two, starts = events(vocab, [tokens(t) for t in whole.slice(i, SLICE)[0].to_pylist()])
                cell, n = np.unique((one * BUCKETS + two) * CLASSES + cls, return_counts=True)
                sums[0].reshape(-1)[cell] += n.astype(np.int32)
                head = cls < BLOCKS
                cell, n = np.unique(((one[head] % COARSE) * COARSE + two[head] % COARSE) * HEAD + ids[head], return_counts=True)
                sums[1].reshape(-1)[cell] += n.astype(np.int32)
                held.append(pairs_of(vocab, ids, cls, starts)[1])
                if sum(map(len, held)) > HELD:
                    yield from pairs()
        yield from pairs()
        for kind, a in sums.items():
            first, at = np.nonzero(a)
            yield from packed(kind, first, at, a[first, at])
        pa.default_memory_pool().release_unused()

    return texts.select(text_col).mapInArrow(run, PACKS)


def _vocabulary(shared) -> Vocabulary:
    tag, words, counts = shared.value
    return common.kept(f"vocabulary {tag}", lambda: Vocabulary(words, counts))


#: Of each kind of softmax: values of a feature, outcomes, outcomes that share a softmax.
SIZES = {0: (BUCKETS, CLASSES, CLASSES), 1: (COARSE, HEAD, BLOCK)}


def log_softmax(kind: int, w: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray) -> np.ndarray:
    """log P[first, second, outcome] for some values of the first feature and all of the second."""
    n, outcomes, group = SIZES[kind]
    bias, one, two = w
    z = (bias + one[first][:, None, :] + two[None, :, :]).reshape(len(first), n, outcomes // group, group)
    z = z - z.max(-1, keepdims=True)
    return (z - np.log(np.exp(z).sum(-1, keepdims=True))).reshape(len(first), n, outcomes)


def _merged_packs(packs: DataFrame, shared, ranges: int) -> DataFrame:
    """Rows (kind, first, at, n) with the packs of one value, salt and kind summed.

    Kinds 0 and 1 stay sparse cells.  Kind 2 gives pairs seen twice or more: ``first`` is the
    range they are looked up in, ``n`` log10 of their share among the pairs of their first
    word and class.  Kind 3 gives the class totals of a range: all tokens, and tokens of
    pairs seen three times or more.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        kind, first = key[0].as_py(), key[1].as_py()
        at, n = group["at"].to_pylist(), np.frombuffer(b"".join(group["n"].to_pylist()), "<u4").astype(np.int64)
        if kind < 2:
            at, n = merged(np.frombuffer(b"".join(at), "<i4"), n)
            rows = [(kind, first, at.astype("<i4").tobytes(), n.astype("<f8").tobytes())]
        else:
            keys, n = merged(unpack(at), n)
            cls = _vocabulary(shared).cls[keys & ((1 << INDEX_BITS) - 1)].astype(np.int64) - BLOCKS
            totals = np.stack([np.bincount(cls, n, SUFFIXES), np.bincount(cls, np.where(n > 2, n, 0), SUFFIXES)])
            keys, n = keys[n > 1], n[n > 1]
            f, of = np.unique(keys >> INDEX_BITS, return_inverse=True)
            share = np.log10(n / np.bincount(of, n, len(f))[of])
            r = range_of(keys, ranges)
            order = np.lexsort((keys, r))
            r, keys, share = r[order], keys[order], share[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            rows = [(2, int(a[0]), pack(b), c.astype("<f4").tobytes()) for a, b, c in zip(np.split(r, cuts), np.split(keys, cuts), np.split(share, cuts)) if len(a)]
            rows.append((3, first, totals.astype("<f8").tobytes(), b""))
        return pa.table([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.array([x[3] for x in rows], pa.binary())], names=["kind", "first", "at", "n"])

    return packs.groupBy("kind", "first", "salt").applyInArrow(run, "kind int, first int, at binary, n binary")


def _summed(cells: DataFrame) -> DataFrame:
    """One row for each value of the first feature: its dense counts of (second feature, outcome), whose number is fixed."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        kind, first = key[0].as_py(), key[1].as_py()
        n, outcomes, _ = SIZES[kind]
        a = np.zeros(n * outcomes)
        for at, c in zip(group["at"].to_pylist(), group["n"].to_pylist()):
            a[np.frombuffer(at, "<i4")] += np.frombuffer(c, "<f8")
        return pa.table({"kind": pa.array([kind], pa.int32()), "first": pa.array([first], pa.int32()), "counts": pa.array([a.astype(np.float32).tobytes()], pa.binary())})

    return cells.groupBy("kind", "first").applyInArrow(run, "kind int, first int, counts binary")


def fit_weights(cells: DataFrame, rounds: int = 8, rate: float = 0.7, smooth: float = 0.5) -> dict[int, tuple]:
    """Gradient rounds over the summed cells; the gradients of all rows are added by Spark."""
    spark = cells.sparkSession
    packed = common.stage(_summed(cells), "lm-cells")
    weights = {k: (np.zeros(o), np.zeros((n, o)), np.zeros((n, o))) for k, (n, o, _) in SIZES.items()}
    for step in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums: dict = {}
            for b in batches:
                for kind, first, raw in zip(b["kind"].to_pylist(), b["first"].to_pylist(), b["counts"].to_pylist()):
                    n, outcomes, group = SIZES[kind]
                    c = np.frombuffer(raw, np.float32).reshape(n, outcomes)
                    p = np.exp(log_softmax(kind, now.value[kind], np.array([first])))[0]
                    e = p * np.repeat(c.reshape(n, -1, group).sum(-1), group, axis=1)
                    if kind not in sums:
                        sums[kind] = np.zeros((2, 2, SIZES[kind][0], outcomes))
                    s = sums[kind]
                    s[0, 0, first] += c.sum(0)
                    s[1, 0, first] += e.sum(0)
                    s[0, 1] += c
                    s[1, 1] += e
            for kind, s in sums.items():
                flat = s.reshape(2, -1)
                at = np.flatnonzero(flat.any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(flat[0, at]), pa.array(flat[1, at])], names=["kind", "at", "seen", "expected"])

        got = packed.mapInArrow(gradient, "kind int, at int, seen double, expected double").groupBy("kind", "at").agg(F.sum("seen").alias("seen"), F.sum("expected").alias("expected")).toPandas()
        for kind, (n, outcomes, _) in SIZES.items():
            g = got[got.kind == kind]
            seen, expected = np.zeros(2 * n * outcomes), np.zeros(2 * n * outcomes)
            seen[g["at"]], expected[g["at"]] = g.seen, g.expected
            # the gradient, scaled by its own curvature; both features push at once, hence the halves after the first round
            move = np.clip((seen - expected) / (expected + seen + 2 * smooth) * 2, -1.5, 1.5).reshape(2, n, outcomes)
            bias, one, two = weights[kind]
            if step == 0:
                all_seen = seen.reshape(2, n, outcomes)[0].sum(0)
                bias = np.log((all_seen + smooth) / (all_seen.sum() + smooth * outcomes))
                weights[kind] = (bias, one, two)
            else:
                weights[kind] = (bias, one + rate * move[0], two + rate * 0.7 * move[1])
    return weights


class Model:
    """What scoring needs besides the distributed tables: the broadcast vocabulary, weights, and totals."""

    def __init__(self, words, freq, total: int, types: int, ends: int, room: np.ndarray, weights: dict, pair_chance: np.ndarray):
        self.words, self.freq, self.total, self.types, self.ends = words, freq, total, types, ends
        self.room, self.weights = np.log10(room), weights  # add-one room of each suffix class
        self.pair, self.other = np.log10(pair_chance), np.log10(1 - pair_chance)
        self.all_room, self.end_count = np.log10(total + types + 1), np.log10(ends + 1)
        self.tag = common.uuid.uuid4().hex

    def tables(self) -> list[np.ndarray]:
        """log10 P[one, two, outcome], for both softmaxes."""
        out = []
        for kind, (n, outcomes, _) in SIZES.items():
            a = np.empty((n, n, outcomes), np.float32)
            for k in range(n):
                a[k] = log_softmax(kind, self.weights[kind], np.array([k]))[0] / np.log(10)
            out.append(a.reshape(n * n, outcomes))
        return out


def fit(train: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame, DataFrame, int]:
    """(model, pair table, counts of the words outside the broadcast, ranges of pairs)."""
    spark = train.sparkSession
    counts = common.stage(word_counts(train, text_col), "lm-counts")
    ends = train.count()
    rung = F.floor(F.log2("c") * 4).cast("int")
    rungs = sorted(((r["r"], r["v"], r["n"]) for r in counts.groupBy(rung.alias("r")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()), reverse=True)
    n_words, v_words = sum(r[2] for r in rungs), sum(r[1] for r in rungs)
    least, left = None, KNOWN
    for r, v, _ in rungs:  # whole rungs of counts, as long as they fit
        if v > left:
            break
        least, left = r, left - v
    known = counts.where(rung >= least) if least is not None else counts.limit(0)
    top = sorted(((bytes(r["w"]), r["c"]) for r in known.collect()), key=lambda x: (-x[1], x[0]))
    words, freq = [w for w, _ in top], [c for _, c in top]
    shared = spark.sparkContext.broadcast((common.uuid.uuid4().hex, words, freq))
    in_class = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy((F.crc32(F.substring("w", -3, 3)) % SUFFIXES).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    room = np.array([sum(in_class.get(k, (0, 0))) + 1 for k in range(SUFFIXES)], np.float64)
    for w, c in top[:HEAD]:
        room[_suffix(w) % SUFFIXES] -= c + 1
    ranges = max(1, -(-n_words // RANGE_TOKENS))
    packs = common.stage(_merged_packs(_counted(train, shared, text_col, ranges), shared, ranges), "lm-packs")
    weights = fit_weights(packs.where("kind < 2"))
    totals = np.zeros((2, SUFFIXES))
    for r in packs.where("kind = 3").select("at").toLocalIterator():  # one short row a range
        totals += np.frombuffer(r["at"], "<f8").reshape(2, SUFFIXES)
    chance = np.clip((totals[1] + 0.5) / (totals[0] + 1), 1e-6, 0.9)
    model = Model(words, freq, n_words + ends, v_words + (ends > 0), ends, room, weights, chance)
    pairs = packs.where("kind = 2").select(F.col("first").alias("rng"), F.col("at").alias("keys"), F.col("n").alias("shares"))
    return model, pairs, counts.where(rung < least) if least is not None else counts, ranges


def _pair_gains(asked: DataFrame, pairs: DataFrame, shared, ranges: int) -> DataFrame:
    """(#row, gain): what a document's score gains by its tokens that pairs explain.  ``asked``: #row, keys."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                b = whole.slice(i, 2000)
                parts = b[1].to_pylist()
                keys, row = unpack(parts), np.repeat(np.arange(len(parts)), [len(x) // KEY_BYTES for x in parts])
                r = range_of(keys, ranges)
                order = np.argsort(r, kind="stable")
                keys, row, r = keys[order], row[order], r[order]
                cuts = np.flatnonzero(np.diff(r)) + 1
                ids, rows = b[0].to_numpy(), []
                for x, y, z in zip(np.split(r, cuts), np.split(keys, cuts), np.split(row, cuts)):
                    if len(x):
                        own, of = np.unique(z, return_inverse=True)  # the documents that have tokens in this range
                        rows.append((int(x[0]), ids[own].astype("<i8").tobytes(), pack(y), of.astype("<u2").tobytes()))
                some = [int(ids[0]) if len(ids) else 0] * len(rows)  # names the batch, whose gains come together again
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([x[0] for x in rows], pa.int32()), *[pa.array([x[k] for x in rows], pa.binary()) for k in (1, 2, 3)]], names=["some", "rng", "ids", "keys", "row"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = unpack(right["keys"].to_pylist())
        share = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(x, "<f4") for x in right["shares"].to_pylist()]])
        order = np.argsort(known, kind="stable")
        known, share = known[order], share[order]
        model = shared.value
        vocab = common.kept(f"pairs {model.tag}", lambda: Vocabulary(model.words, model.freq))
        out: list[tuple[int, bytes, bytes]] = []
        for batch, ids, keys, row in zip(*(left[c].to_pylist() for c in ("some", "ids", "keys", "row"))) if len(known) else ():
            keys = unpack([keys])
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            word = keys[hit] & ((1 << INDEX_BITS) - 1)
            cls = vocab.cls[word].astype(np.int64) - BLOCKS
            gain = share[at[hit]] + model.pair[cls] - (model.other[cls] + vocab.log_count[word] - model.room[cls])
            row, ids = np.frombuffer(row, "<u2")[hit], np.frombuffer(ids, "<i8")
            sums, hits = np.bincount(row, gain, len(ids)), np.unique(row)
            if len(hits):
                out.append((batch, ids[hits].astype("<i8").tobytes(), sums[hits].astype("<f8").tobytes()))
        return pa.table({"some": pa.array([x[0] for x in out], pa.int64()), "ids": pa.array([x[1] for x in out], pa.binary()), "sums": pa.array([x[2] for x in out], pa.binary())})

    def total(group: pa.Table) -> pa.Table:
        """The gains of one batch of documents, over all ranges."""
        ids, of = np.unique(np.frombuffer(b"".join(group["ids"].to_pylist()), "<i8"), return_inverse=True)
        return pa.table({"#row": pa.array(ids), "#pairs": pa.array(np.bincount(of, np.frombuffer(b"".join(group["sums"].to_pylist()), "<f8"), len(ids)))})

    dealt = asked.mapInArrow(deal, "some bigint, rng int, ids binary, keys binary, row binary")
    # one row a batch and range, so that the rows do not grow with documents x ranges
    met = dealt.groupBy("rng").cogroup(pairs.groupBy("rng")).applyInArrow(meet, "some bigint, ids binary, sums binary")
    return met.groupBy("some").applyInArrow(total, "`#row` bigint, `#pairs` double")


def score(docs: DataFrame, train: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score, score to ``docs``, learned from the texts of ``train``."""
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    common.refuse(docs, new)
    fitted, pairs, counted, ranges = fit(train, text_col)
    model, text_at = docs.sparkSession.sparkContext.broadcast(fitted), common.place_of(docs, text_col)
    extra = "`#n` bigint, `#known` bigint, `#base` double, `#score` double, `#keys` binary, `#words` array<binary>, `#times` array<int>, `#fresh` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        m = model.value
        vocab, (by_class, by_word) = common.kept(f"scorer {m.tag}", lambda: (Vocabulary(m.words, m.freq), m.tables()))
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                vocab.trim()
                split = [tokens(t) for t in b[text_at].to_pylist()]
                ids, cls, one, two, starts = events(vocab, split)
                s = by_class[one * BUCKETS + two, cls].astype(np.float64)
                head = np.flatnonzero(cls < BLOCKS)
                s[head] += by_word[(one[head] % COARSE) * COARSE + two[head] % COARSE, ids[head]]
                tail = np.flatnonzero((cls >= BLOCKS) & (cls < END_CLASS))
                s[tail] += vocab.log_count[ids[tail]] + (m.other - m.room)[cls[tail] - BLOCKS]
                base = np.where(ids < 0, m.end_count, vocab.log_count[ids]) - m.all_room
                is_known = np.where(ids < 0, int(m.ends > 0), ids < vocab.size)
                at, keys = pairs_of(vocab, ids, cls, starts)
                cuts = np.searchsorted(at, starts)
                asked = pa.array([pack(keys[x:y]) for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())
                rare = np.flatnonzero(ids >= vocab.size)
                doc_of = np.searchsorted(starts, rare, "right") - 1
                # a rare word's occurrences, and those that are not repetitions and so count for the score
                pair, times = np.unique(np.stack([doc_of, ids[rare]]), axis=1, return_counts=True) if len(rare) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                fresh = np.zeros(len(times), np.int64)
                if len(rare):
                    key = pair[0] * (1 << 40) + pair[1]
                    mine = cls[rare] != REPEAT
                    np.add.at(fresh, np.searchsorted(key, doc_of[mine] * (1 << 40) + ids[rare[mine]]), 1)
                offsets = np.searchsorted(pair[0], np.arange(len(split) + 1)).astype(np.int32)
                names = pa.array([vocab.extra[k - vocab.size] for k in pair[1].tolist()], pa.binary())
                yield b, [
                    pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat(is_known.astype(np.int64), starts[:-1])),
                    pa.array(np.add.reduceat(base, starts[:-1])),
                    pa.array(np.add.reduceat(s, starts[:-1])),
                    asked,
                    pa.ListArray.from_arrays(offsets, names),
                    pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(fresh.astype(np.int32))),
                ]

    part = common.stage(common.add_columns(docs, extra, run).withColumn("#row", F.monotonically_increasing_id()).drop(text_col), "lm-scored")
    rare = part.select("#row", F.explode(F.arrays_zip(F.col("#words").alias("w"), F.col("#times").alias("t"), F.col("#fresh").alias("f"))).alias("x")).select("#row", "x.w", "x.t", "x.f")
    gain = F.log10(F.col("c") + 1)
    found = rare.join(counted, "w").groupBy("#row").agg(
        F.sum("t").alias("#found"),
        F.sum(F.col("t") * gain).alias("#gain"),
        F.sum(F.col("f") * gain).alias("#gain_fresh"),
    )
    hits = _pair_gains(part.where(F.octet_length("#keys") > 0).select("#row", "#keys"), pairs, model, ranges)
    zero = F.lit(0)
    return part.join(found, "#row", "left").join(hits, "#row", "left").select(
        *[common.col(c) for c in docs.columns if c != text_col],
        F.col("#n").alias("n_tokens"),
        (F.col("#known") + F.coalesce("#found", zero)).alias("n_known"),
        F.lit(fitted.total).cast("long").alias("train_tokens"),
        (F.col("#base") + F.coalesce("#gain", zero)).alias("base_score"),
        (F.col("#score") + F.coalesce("#gain_fresh", zero) + F.coalesce("#pairs", zero)).alias("score"),
    )


def op5_lm(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", common.id_remainder(F.col("doc_id"), 7) == 2)
    return score(docs, docs.where(~F.col("held_out")).select("text"))
