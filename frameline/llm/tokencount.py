"""Token counts by a linear longest-match automaton.

Words are counted greedily: the longest vocabulary piece, then the longest at the
rest, and so on.  The vocabulary is a trie with failure links; each node knows how
many pieces are popped when it fails and how many when the word ends there, so a
word costs one pass over its bytes and no piece is ever built.

Vocabulary: byte strings.  A word is read as ``marker + word``; pieces with the
marker can only stand first.  A word that greedy matching cannot cover counts as
one unknown token.

Defined results: a null or white-space text has no words and no tokens; texts are
counted whole; equal texts have equal counts, and repeated rows are counted one by
one; an empty table gives an empty result; input columns are kept under any name, and
a new column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Distinct words whose lengths a task keeps at once.
CACHE_WORDS = 300_000


class LongestMatch:
    """The automaton; ``count(word)`` is the number of greedy pieces of ``marker + word``."""

    def __init__(self, pieces: Iterable[bytes], marker: bytes = b" "):
        step: dict[int, int] = {}
        is_piece, depth, size = {0: False}, {0: 0}, 1
        order: list[tuple[int, int, int]] = []  # (parent, byte, node)
        for piece in pieces:
            at = 0
            for b in piece:
                to = step.get(at << 8 | b)
                if to is None:
                    to = step[at << 8 | b] = size
                    depth[to] = depth[at] + 1
                    order.append((at, b, to))
                    size += 1
                at = to
            if at:
                is_piece[at] = True
        fail, popped = [-1] * size, [0] * size
        for at, b, to in sorted(order, key=lambda x: depth[x[0]]):
            if is_piece.get(to):
                fail[to], popped[to] = 0, 1  # the whole string is one piece; nothing is left over
                continue
            n, z = popped[at], fail[at]
            while z >= 0 and (nxt := step.get(z << 8 | b)) is None:
                n += popped[z]
                z = fail[z]
            if z >= 0:
                fail[to], popped[to] = nxt, n
        at_end = [0] * size  # pieces still to pop when the word ends at a node, or -1
        for v in [0, *(to for _, _, to in sorted(order, key=lambda x: depth[x[2]]))]:
            n, z = 0, v
            while z > 0:
                n, z = n + popped[z], fail[z]
            at_end[v] = n if z == 0 else -1
        self.step, self.fail, self.popped, self.at_end, self.marker = step, fail, popped, at_end, marker

    def count(self, word: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        at = n = 0
        for b in self.marker + word:
            to = step.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = step.get(at << 8 | b)
            at = to
        end = self.at_end[at]
        return n + end if end >= 0 else 1


class _Lengths(dict):
    """Word to token count; unknown words are counted when first asked for."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(word)
        return n


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file: one base64 piece and its rank a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def token_counts(df: DataFrame, pieces: list[bytes], marker: bytes = b" ", text_col: str = "text", words_col: str = "n_words", tokens_col: str = "n_tokens") -> DataFrame:
    """Adds the number of words and of greedy pieces of each whole text.  ``pieces`` is broadcast: a vocabulary, of fixed size."""
    shared = df.sparkSession.sparkContext.broadcast((pieces, marker))
    key, at = common.uuid.uuid4().hex, common.place_of(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        known = common.kept(key, lambda: _Lengths(LongestMatch(*shared.value)))
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                if len(known) > CACHE_WORDS:
                    known.clear()
                split = [(t or "").encode().split() for t in batch[at].to_pylist()]
                words = pa.array(np.fromiter(map(len, split), np.int64, len(split)))
                tokens = pa.array(np.fromiter((sum(map(known.__getitem__, s)) for s in split), np.int64, len(split)))
                yield batch, [words, tokens]

    return common.add_columns(df, f"`{words_col}` bigint, `{tokens_col}` bigint", run)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_token_counts(spark, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, read_vocabulary(vocabulary_path or default_vocabulary())).select("doc_id", "n_words", "n_tokens")
