"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's likelihood is the sum, over all ways to cut it into pieces, of the products
of their probabilities: a forward pass.  The probabilities come from expected piece
counts (forward and backward passes, a few rounds) over labelled documents.

All pieces of the vocabulary take part and words of any length are summed whole.  A
batch's words are walked through the vocabulary's trie together, one depth at a time;
the passes rescale a sliding window of the longest piece, so long words do not
underflow.

Learning may use a bounded sample: ``sample_docs`` documents a language are expected
at most (a documented bound; ids are drawn by hash).  Scoring covers whole texts.

Defined results: a null text, or one without a letter (Unicode category L), is ``und``
with score 0; ties go to the alphabetically first language; with no labelled document
every text is ``und``; equal texts get equal results, and repeated rows are answered
one by one; an empty table gives an empty result; input columns are kept under any
name, and a new column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CACHE_WORDS = 200_000
#: Words taken at once; fewer where they are long.
WORDS, LETTERS = 4000, 200_000
_LETTER = re.compile(r"[^\W\d_]")


def words_of(text: str | None) -> list[str]:
    """Lower-case words, the white space gone."""
    return (text or "").lower().split()


def has_letter(text: str | None) -> bool:
    """Is there a character of category L?  The pattern also takes numbers such as ½, so its finds are looked at."""
    return any(unicodedata.category(m.group())[0] == "L" for m in _LETTER.finditer(text or ""))


def portions(words: list[str]) -> Iterator[list[str]]:
    """The words in lists of about `LETTERS` letters and `WORDS` words at most."""
    now, letters = [], 0
    for w in words:
        if now and (len(now) == WORDS or letters + len(w) > LETTERS):
            yield now
            now, letters = [], 0
        now.append(w)
        letters += len(w)
    if now:
        yield now


class Segmenter:
    """Finds every piece at every place of a set of words, and sums over all segmentations."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)  # one shared piece for letters the vocabulary lacks
        letters = sorted({c for p in pieces for c in p})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.wide = len(letters) + 1  # the last number stands for all other letters
        number = {c: k for k, c in enumerate(letters)}
        node: dict[str, int] = {"": 0}
        keys, to, whole = [], [], [-1]
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in node:
                    node[p[:k]] = len(node)
                    keys.append(node[p[: k - 1]] * self.wide + number[p[k - 1]])
                    to.append(node[p[:k]])
                    whole.append(-1)
            if p:
                whole[node[p]] = self.index[p]
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        self.keys, self.to, self.whole = np.array(keys, np.int64)[order], np.array(to, np.int64)[order], np.array(whole, np.int64)

    def spans(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Arrays (word, start, end, piece) of all pieces at all places; each word's stand together."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        at = np.minimum(np.searchsorted(self.letters, code), max(len(self.letters) - 1, 0))
        letter = np.where(self.letters[at] == code, at, self.wide - 1) if len(self.letters) else np.full(n, self.wide - 1)
        word = np.repeat(np.arange(len(words)), length)
        start = np.arange(n) - np.repeat(np.cumsum(length) - length, length)
        left = np.repeat(length, length) - start  # letters from here to the word's end
        place, node, single = np.arange(n), np.zeros(n, np.int64), np.full(n, self.unknown)
        found = []
        for depth in range(self.longest):
            if not len(self.keys):
                break
            key = node * self.wide + letter[place + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[k] == key
            place, node = place[there], self.to[k[there]]
            piece = self.whole[node]
            is_piece = piece >= 0
            if depth == 0:
                single[place[is_piece]] = piece[is_piece]
            else:
                found.append((place[is_piece], np.full(int(is_piece.sum()), depth + 1), piece[is_piece]))
            more = left[place] > depth + 1
            place, node = place[more], node[more]
            if not len(place):
                break
        where = np.concatenate([np.arange(n), *[f[0] for f in found]])
        wide = np.concatenate([np.ones(n, np.int64), *[f[1] for f in found]])
        piece = np.concatenate([single, *[f[2] for f in found]])
        order = np.argsort(word[where], kind="stable")
        where, wide, piece = where[order], wide[order], piece[order]
        return word[where], start[where], start[where] + wide, piece

    def forward(self, length: np.ndarray, spans, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, alpha, scale): the summed products up to place k of word w are alpha * exp(scale) at row first[w] + k, by language."""
        w, s, e, p = spans
        first = np.cumsum(length + 1) - length - 1
        alpha, scale = np.zeros((int((length + 1).sum()), prob.shape[1])), np.zeros((int((length + 1).sum()), prob.shape[1]))
        alpha[first] = 1.0
        now = np.zeros((len(length), prob.shape[1]))
        most = int(length.max(initial=0))
        order = np.argsort(e, kind="stable")
        w, s, e, p = w[order], s[order], e[order], p[order]
        cut = np.searchsorted(e, np.arange(1, most + 2))
        by_length = np.argsort(-length, kind="stable")
        long_ones = -length[by_length]
        every = max(16, self.longest)
        for k in range(1, most + 1):
            at = slice(cut[k - 1], cut[k])
            ws = w[at]
            one = np.flatnonzero(np.diff(ws, prepend=-1))
            row = first[ws[one]] + k
            alpha[row] = np.add.reduceat(alpha[first[ws] + s[at]] * prob[p[at]], one, axis=0)
            if most > every:
                scale[row] = now[ws[one]]
                if k % every == 0:  # the window of the longest piece is brought back to 1
                    live = by_length[: int(np.searchsorted(long_ones, -k))]
                    window = first[live][:, None] + np.arange(k - self.longest + 1, k + 1)
                    f = np.maximum(alpha[window].max(1), 1e-290)
                    alpha[window] /= f[:, None]
                    now[live] += np.log(f)
                    scale[window] = now[live][:, None]
        return first, alpha, scale

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        length = np.fromiter(map(len, words), np.int64, len(words))
        first, alpha, scale = self.forward(length, self.spans(words), prob)
        end = first + length
        return np.log(np.maximum(alpha[end], 1e-300)) + scale[end]

    def expected(self, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected piece counts[piece, language] of words with weight[word, language]."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        w, s, e, p = spans = self.spans(words)
        first, alpha, up = self.forward(length, spans, prob)
        # the backward pass is the forward pass of the words read from their ends
        _, beta, down = self.forward(length, (w, length[w] - e, length[w] - s, p), prob)
        before, after, end = first[w] + s, first[w] + length[w] - e, first[w] + length[w]
        size = np.exp(up[before] + down[after] - up[end])
        share = alpha[before] * prob[p] * beta[after] / np.maximum(alpha[end], 1e-300) * size * weight[w]
        return np.stack([np.bincount(p, share[:, k], minlength=len(prob)) for k in range(prob.shape[1])], 1)


def _normal(counts: np.ndarray, smooth: float) -> np.ndarray:
    c = counts + smooth
    return c / c.sum(0)


def train(labelled: DataFrame, pieces: list[str], sample_docs: int = 1500, rounds: int = 2, smooth: float = 0.05, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages and prob[piece, language].  Only word counts of the sample and piece sums move; both are bounded by the sample and the vocabulary."""
    spark = labelled.sparkSession
    there = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(k for k in there if k is not None)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample_docs / there[k]) * 1e6))])
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1_000_000)) < share[F.col(lang_col)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                seen: Counter = Counter()
                for text, lang in zip(b["t"].to_pylist(), b["l"].to_pylist()):
                    seen.update((w, lang) for w in words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "l", "n"])

    at = {k: i for i, k in enumerate(langs)}
    words = drawn.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).mapInArrow(count, "w string, l string, n bigint")
    words = common.stage(words.groupBy("w", "l").agg(F.sum("n").cast("double").alias("n")), "langid-words")
    shared, key = spark.sparkContext.broadcast(pieces), common.uuid.uuid4().hex
    prob = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    for k in range(rounds + 1):
        now = spark.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            seg, total = common.kept(key, lambda: Segmenter(shared.value)), 0
            for b in batches:
                ws, ls, ns = b["w"].to_pylist(), b["l"].to_pylist(), b["n"].to_pylist()
                weight = np.zeros((len(ws), len(langs)))
                weight[np.arange(len(ws)), [at[x] for x in ls]] = ns
                done = 0
                for part in portions(ws):
                    total = total + seg.expected(part, weight[done : done + len(part)], now.value)
                    done += len(part)
            if not isinstance(total, int):
                i, j = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["p", "l", "c"])

        sums = np.zeros_like(prob)
        got = words.mapInArrow(expect, "p int, l int, c double").groupBy("p", "l").agg(F.sum("c").alias("c")).toPandas()
        sums[got.p.to_numpy(), got.l.to_numpy()] = got.c.to_numpy()
        prob = _normal(sums, smooth)
    return langs, prob


class _Logs:
    """Words and their log likelihoods by language, at most about ``CACHE_WORDS`` of them."""

    def __init__(self, langs: list[str], prob: np.ndarray, pieces: list[str]):
        self.seg, self.prob, self.row = Segmenter(pieces), prob, {}
        self.logs = np.zeros((CACHE_WORDS, len(langs)))

    def learn(self, words: set[str]) -> None:
        new = list(words - self.row.keys())
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row.clear()
            new = list(words)
        if len(new) > len(self.logs):  # one slice of texts with more words than the table has rows
            self.logs = np.zeros((len(new), self.logs.shape[1]))
        for part in portions(new):
            n = len(self.row)
            self.logs[n : n + len(part)] = self.seg.log_likelihood(part, self.prob)
            self.row.update(zip(part, range(n, n + len(part))))


def predict(df: DataFrame, langs: list[str], prob: np.ndarray, pieces: list[str], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the likeliest language of each whole text and its posterior under equal priors."""
    shared = df.sparkSession.sparkContext.broadcast((langs, prob, pieces))
    key, at = common.uuid.uuid4().hex, common.place_of(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        langs = shared.value[0]
        known = common.kept(key, lambda: _Logs(*shared.value))
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                texts = batch[at].to_pylist()
                split = [words_of(t) for t in texts]
                if langs:
                    known.learn(set().union(*split))
                best, score = [], []
                for text, ws in zip(texts, split):
                    if not langs or not has_letter(text):
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = known.logs[np.fromiter(map(known.row.__getitem__, ws), np.int64, len(ws))].sum(0)
                    k = int(total.argmax())
                    best.append(langs[k])
                    score.append(float(1.0 / np.exp(total - total[k]).sum()))
                yield batch, [pa.array(best, pa.string()), pa.array(score, pa.float64())]

    return common.add_columns(df, f"`{lang_out}` string, `{score_out}` double", run)


def read_pieces(path: str) -> list[str]:
    """The lower-case pieces of a sentence-piece file, the word mark taken off."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({q for p in own if (q := p.replace("▁", "").lower())})


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fitted(docs: DataFrame, pieces_path: str | None = None):
    """Languages, probabilities and pieces learned from rows whose id remainder modulo 5 is not 0."""
    pieces = read_pieces(pieces_path or default_pieces())
    own = docs.where((common.id_remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return *train(own, pieces), pieces


def op6_langid(spark, sf_dir: str, pieces_path: str | None = None) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    langs, prob, pieces = fitted(docs, pieces_path)
    done = predict(docs.select("doc_id", "text"), langs, prob, pieces)
    return done.select("doc_id", (common.id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
