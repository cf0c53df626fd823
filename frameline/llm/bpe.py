"""Byte-pair encoding by last-token states over a prefix trie of distinct words.

The encoding of a string is fixed by the last token of each of its prefixes:
``enc(p) = enc(p minus last) + [last]``.  The distinct words of a batch form a
trie; visiting its nodes depth first (which is the words' sorted order, the path
to the current node being the stack) computes every shared prefix's last token
once.  A token may be last after a prefix exactly if it and the prefix's own last
token stand side by side unmerged, which `_Merges.stays_apart` decides from the
ranks along the two facing edges.

Defined results: a null text is the empty text, which has no tokens; texts of any
length are encoded whole; equal texts give equal ids, and repeated rows are encoded
one by one; an empty table gives an empty result; a symbol that no token of the model
covers raises ``ValueError``; all input columns are kept under any name, and a new
column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct raw words whose ids a task keeps at once.
CACHE_WORDS = 120_000
#: Below this code point, letters and their lower-case forms are the same in every Unicode version.
_STABLE = "ɐ"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD_SPACE = re.compile("[\\x1c-\\x1f]")


class _Merges:
    """Ranks and facing edges of the merge tree; no texts."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[left, right] = r
            self.parts.setdefault(left + right, (left, right))
        #: A merged token that its own letters never merge to is no candidate.
        self.usable = {t: i for t, i in self.vocab.items() if t not in self.parts or self._reachable(t)}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """Symbols that ever stand at one edge of ``token``, each with the rank that absorbs it."""
        out, absorbed = [(token, 1 << 60)], 1 << 60
        while token in self.parts:
            pair = self.parts[token]
            absorbed, token = self.rank[pair], pair[side]
            out.append((token, absorbed))
        return out

    def _crossed(self, left: str, right: str, before: int) -> bool:
        """Does a merge of rank under ``before`` join the facing edges?  At equal rank the left one goes first."""
        rank = self.rank
        facing = self._edge(right, 0)
        for s, s_gone in self._edge(left, 1):
            for u, u_gone in facing:
                m = rank.get((s, u), before)
                if m < before and m < s_gone and m <= u_gone:
                    return True
        return False

    def _reachable(self, token: str) -> bool:
        todo = [token]
        while todo:
            pair = self.parts.get(todo.pop())
            if pair:
                if self._crossed(*pair, self.rank[pair]):
                    return False
                todo += pair
        return True

    def stays_apart(self, left: str, right: str) -> bool:
        return not self._crossed(left, right, 1 << 60)


class WordTrie:
    """Encodes sets of distinct words (strings over the model's own symbols).

    A node's state is its last token and the longest vocabulary suffix that ends
    there; the latter comes from an automaton with failure links, so a node costs a
    few lookups whatever the word's length.
    """

    def __init__(self, model: dict):
        m = self.m = _Merges(model)
        end = m.end
        self.name = {i: t for t, i in m.usable.items()}
        self.pack = {i: i.to_bytes(4, "little") for i in m.usable.values()}
        self.step: dict[tuple[int, str], int] = {}
        whole, count = {}, 1
        for t, i in m.usable.items():
            at, last = 0, t.endswith(end) if end and t != end else False
            letters = [*t[: -len(end)]] if last else [*t]
            if last:
                letters[-1] += end
            for c in letters:
                to = self.step.get((at, c))
                if to is None:
                    to = self.step[at, c] = count
                    count += 1
                at = to
            whole[at] = (i, len(letters))
        self.fail = [0] * count
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * count  # (token, letters) that end here, longest first
        below: list[list[tuple[str, int]]] = [[] for _ in range(count)]
        for (at, c), to in self.step.items():
            below[at].append((c, to))
        row = [0]
        for at in row:
            for c, to in below[at]:
                if at:
                    f = self.fail[at]
                    while f and (f, c) not in self.step:
                        f = self.fail[f]
                    self.fail[to] = self.step.get((f, c), 0)
                self.ends[to] = ((whole[to],) if to in whole else ()) + self.ends[self.fail[to]]
                row.append(to)
        self.apart: dict[int, bool] = {}

    def _advance(self, node: int, letter: str) -> int:
        step, fail = self.step, self.fail
        to = step.get((node, letter))
        while to is None and node:
            node = fail[node]
            to = step.get((node, letter))
        return to or 0

    def _last(self, node: int, i: int, last: list[int]) -> tuple[int, int]:
        """Last token, and its letters, of a prefix of ``i`` letters that led to ``node``; (-1, i) if none fits."""
        apart = self.apart
        for t, n in self.ends[node]:
            if n == i:
                return t, n
            before = last[i - n]
            if before >= 0:
                key = before << 32 | t
                fits = apart.get(key)
                if fits is None:
                    if len(apart) > 100_000:
                        apart.clear()
                    fits = apart[key] = self.m.stays_apart(self.name[before], self.name[t])
                if fits:
                    return t, n
        return -1, i

    def encode(self, words) -> Iterator[tuple[str, bytes]]:
        """Depth-first over the trie of ``words``: sorted order, keeping the states of the common prefix."""
        before, nodes, last, width, end = "", [0], [-1], [0], self.m.end
        advance, find, pack = self._advance, self._last, self.pack
        for word in sorted(words):
            n = len(word) - 1
            if n < 0:
                yield word, b""
                continue
            keep = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                keep += 1
            keep = min(keep, n)
            del nodes[keep + 1 :], last[keep + 1 :], width[keep + 1 :]
            for i in range(keep, n):
                node = advance(nodes[i], word[i])
                t, w = find(node, i + 1, last)
                nodes.append(node)
                last.append(t)
                width.append(w)
            before = word[:n]  # the last letter's state belongs to the word's end, not to the path
            t, w = find(advance(nodes[n], word[n] + end), n + 1, last)
            out, i = [], n + 1
            while i and t >= 0:
                out.append(pack[t])
                i -= w
                if i:
                    t, w = last[i], width[i]
            if i:
                raise ValueError(f"the model has no token for a symbol of {word!r}")
            out.reverse()
            yield word, b"".join(out)


class Codec:
    """Texts to packed ids and back, as the tokenizer file's pipeline defines them."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        # only the file's normaliser and splitter are asked, for words outside the plain letters
        self.tokenizer = Tokenizer.from_str(json.dumps({**spec, "model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.trie = WordTrie(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # a special token can only stand where the first two characters of one do
        self.marks = re.compile("|".join(map(re.escape, sorted({t[:2] for t in self.special})))) if self.special else None
        self.to_byte = _byte_letters()
        top = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.names = [b""] * top
        for t, i in [*spec["model"]["vocab"].items(), *self.special.items()]:
            self.names[i] = t.encode()
        self.known: dict[str, bytes] = {}

    def _pieces(self, raw: str) -> list[str | int]:
        """Normalised pieces of one white-space-free word, in the model's symbols; an int is a special token."""
        if self.split_special and self.marks.search(raw):
            parts = self.split_special.split(raw)
            if len(parts) > 1:
                return [y for x in parts for y in ([self.special[x]] if x in self.special else self._pieces(x) if x else [])]
        if max(raw) < _STABLE and unicodedata.is_normalized("NFC", raw) and not _SPECIAL_CASES.search(raw):
            found = _PIECE.findall(raw.lower())
            return found if raw.isascii() else ["".join(map(self.to_byte.__getitem__, x.encode())) for x in found]
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(raw))]

    def learn(self, raw_words: set[str]) -> None:
        """Encode the words not known yet, all in one trie."""
        new = {w: self._pieces(w) for w in raw_words if w not in self.known}
        ids = dict(self.trie.encode({p for ps in new.values() for p in ps if isinstance(p, str)}))
        for w, ps in new.items():
            self.known[w] = ids[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else b"".join(ids[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in ps)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, n = [], len(texts)
        for at in range(0, n, 1024):
            split = [(_SPACE.split(t) if _ODD_SPACE.search(t) else t.split()) if t else [] for t in texts[at : at + 1024]]
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            fresh = set().union(*split)
            fresh.discard("")
            self.learn(fresh)
            self.known[""] = b""
            get = self.known.__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out

    def decode(self, packed: bytes | None) -> str:
        """Token strings joined by spaces, which is the file's rule when it names no decoder."""
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b" ".join(map(self.names.__getitem__, ids)).decode()


#: Letters outside the plain classes of `_PIECE` below U+0250 take the library's own path.
_SPECIAL_CASES = re.compile("[\\x00-\\x1f\\x80-\\x9f\\xa0\\xaa\\xad\\xb2\\xb3\\xb9\\xba\\xbc-\\xbe\\u0130\\u0149\\u01c4-\\u01cc\\u01f0-\\u01f3]")


def _byte_letters() -> list[str]:
    """Byte to letter, as byte-level vocabularies write them: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, k = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + k))
        k += b not in own
    return out


def _mapped(df: DataFrame, extra: str, fn, tokenizer_path: str) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as f:  # read on the driver only; bounded by the vocabulary
        shared, key = df.sparkSession.sparkContext.broadcast(f.read()), common.uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        codec = common.kept(key, lambda: Codec(shared.value))
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield part, fn(codec, part)

    return common.add_columns(df, extra, run)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: the text's ids as packed little-endian unsigned 32-bit integers."""
    at = common.place_of(df, text_col)
    return _mapped(df, f"`{ids_col}` binary", lambda c, b: [pa.array(c.encode_batch(b[at].to_pylist()), pa.binary())], tokenizer_path)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the text that the packed ids decode to; null ids decode to the empty text."""
    at = common.place_of(df, ids_col)
    return _mapped(df, f"`{out_col}` string", lambda c, b: [pa.array([c.decode(x) for x in b[at].to_pylist()], pa.string())], tokenizer_path)


def round_trip(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`encode` and `decode` in one pass over the batches."""
    at = common.place_of(df, text_col)

    def both(c: Codec, b: pa.RecordBatch) -> list[pa.Array]:
        ids = c.encode_batch(b[at].to_pylist())
        return [pa.array(ids, pa.binary()), pa.array([c.decode(x) for x in ids], pa.string())]

    return _mapped(df, f"`{ids_col}` binary, `{out_col}` string", both, tokenizer_path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = round_trip(docs, tokenizer_path or default_tokenizer())
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
