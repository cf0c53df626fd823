"""Token ids in files of patched frame-of-reference blocks.

Texts are put in order of their ids by a range partitioning; a task encodes its range and
writes one file, front to back.  A file is

    "FLT1", then blocks, then the starts of the blocks (unsigned 64 bits each), then for
    each document its id (signed 64 bits), whether it has one (8 bits) and the place of its
    first token in the file (unsigned 64 bits), then a trailer: where the starts begin, the
    numbers of blocks, documents, ids and of ids a block (unsigned 64 bits each), "FLT1";

all little-endian.  A block holds `BLOCK` ids, the last one what is left: the minimum
(32 bits), how many ids (16), the width (8), how many exceptions (16), places (16 each)
and high parts (32 each) of the exceptions, and the low ``width`` bits of every id less the
minimum.  The width is that of the value at a given percentile of the block; what needs
more bits is an exception.  As the starts of the blocks are known, any document can be
read by range reads of the trailer and its own blocks.

The texts are encoded by the tokenizer's library.  For byte-level tokenizers that split as
the usual pattern does, a text falls apart at every single space or line's end between two
other signs, so that distinct words are encoded once, many together, and kept for later
texts, whose ids are put together by place.  Letters, with the white space before them, are
one piece to the library, which merges them by its model alone; words of other signs go
through its splitter too, and other texts and tokenizers are given to it whole.

Defined results: a null text is the empty text, which has only the end id; null ids come
first; documents of one id are ordered by a hash of their texts, so that an id with very
many texts is cut over several files (equal rows stay together); texts are encoded whole;
an empty table gives no file and an empty result; columns other than the two named are not
read, whatever they are called; a file that is cut short or is no such file raises
``ValueError``.  A file's name holds a random part and the manifest names the files of the
attempts that counted, so a task that runs again leaves an unnamed file at worst.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .media import _files

MAGIC = b"FLT1"
HEAD, TRAILER = struct.Struct("<IHBH"), struct.Struct("<QQQQQ4s")
#: Ids a block.
BLOCK = 1024
#: Widths of whole bytes, whose low bits are plain numbers in a row.
WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
#: Share of a block's ids, in percent, whose bits all fit the width.
PERCENTILE = 98.0
#: Blocks that are packed together.
TOGETHER = 64
#: Bytes of texts that one file holds, about.
FILE_BYTES = 64 << 20
#: Ids that one task reads back, about.
READ_IDS = 4_000_000
#: Texts that are encoded together.
TEXTS = 2000
#: Distinct words, and letters of them, that a task keeps.
WORDS, LETTERS = 800_000, 16 << 20
#: Distinct words that are encoded together.
TOGETHER_WORDS = 500
#: Signs that may end a word.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The sign that byte-level vocabularies write for each byte: its own if it can be seen, the next from U+0100 otherwise.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = np.zeros(256, "<u2")
SHOWN[SEEN] = SEEN
SHOWN[SHOWN == 0] = 256 + np.arange(256 - len(SEEN))
#: ASCII signs that are white space to some rule.
WHITE = np.zeros(256, bool)
WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


def all_letters() -> str:
    return "".join(c for c in map(chr, range(0x110000)) if c.isalpha())


# ---- blocks


def pack(rows: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of equally many ids each (32 bits, one row a block)."""
    n = rows.shape[1]
    low = rows.min(axis=1)
    off = rows - low[:, None]
    k = min(n - 1, max(0, int(np.ceil(n * percentile / 100)) - 1))
    width = np.frexp(np.partition(off, k, axis=1)[:, k].astype(np.float64))[1]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        if w in WHOLE:
            packed = off[mine].astype(WHOLE[w]).view(np.uint8)
        else:
            bits = np.unpackbits(np.ascontiguousarray(off[mine], "<u4").view(np.uint8).reshape(len(mine), n, 4), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(bits.reshape(len(mine), n * w), axis=1, bitorder="little")
        high = off[mine] >> w if w < 32 else np.zeros_like(off[mine])
        for i, body, over in zip(mine.tolist(), packed, high):
            at = np.flatnonzero(over)
            out[i] = HEAD.pack(int(low[i]), n, w, len(at)) + at.astype("<u2").tobytes() + over[at].astype("<u4").tobytes() + body.tobytes()
    return out


def unpack(blocks: list[memoryview]) -> np.ndarray:
    """The ids of consecutive blocks, one after another."""
    heads = [HEAD.unpack_from(b) for b in blocks]
    out: list[np.ndarray | None] = [None] * len(blocks)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, w, _) in enumerate(heads):
        groups.setdefault((n, w), []).append(i)
    for (n, w), mine in groups.items():
        size = -(-n * w // 8)
        body = [np.frombuffer(blocks[i], np.uint8, size, HEAD.size + 6 * heads[i][3]) for i in mine]
        if w in WHOLE:
            ids = np.stack(body).view(WHOLE[w]).astype("<u4")
        else:
            bits = np.zeros((len(mine), n, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(np.stack(body), axis=1, count=n * w, bitorder="little").reshape(len(mine), n, w)
            ids = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        for i, row in zip(mine, ids):
            low, _, _, x = heads[i]
            if x:
                at = np.frombuffer(blocks[i], "<u2", x, HEAD.size)
                row[at] |= np.frombuffer(blocks[i], "<u4", x, HEAD.size + 2 * x) << np.uint32(w)
            out[i] = row + np.uint32(low)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Writer:
    """One file, front to back; holds some blocks and the index."""

    def __init__(self, out, percentile: float = PERCENTILE, block: int = BLOCK):
        if not 1 <= block < 1 << 16:
            raise ValueError("a block holds 1 to 65,535 ids")
        self.out, self.percentile, self.block = out, percentile, block
        self.out.write(MAGIC)
        self.at, self.n_ids, self.held, self.waiting = len(MAGIC), 0, 0, []
        self.starts = array("Q")
        self.ids, self.known, self.first = array("q"), array("B"), array("Q")  # 17 bytes a document

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.first.append(self.n_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= TOGETHER * self.block:
            self._flush(False)

    def _flush(self, all_of_them: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        full = len(ids) // self.block * self.block
        for at in range(0, full, TOGETHER * self.block):
            self._put(ids[at : min(full, at + TOGETHER * self.block)].reshape(-1, self.block))
        if all_of_them and full < len(ids):
            self._put(ids[None, full:])
        self.waiting, self.held = [ids[full:].copy()], len(ids) - full

    def _put(self, rows: np.ndarray) -> None:
        done = pack(rows, self.percentile)
        for b in done:
            self.starts.append(self.at)
            self.at += len(b)
        self.out.write(b"".join(done))

    def close(self) -> int:
        """Ends the file; its bytes."""
        self._flush(True)
        parts = ((self.starts, "<u8"), (self.ids, "<i8"), (self.known, "u1"), (self.first, "<u8"))
        index = b"".join(np.array(x).astype(kind).tobytes() for x, kind in parts)
        self.out.write(index + TRAILER.pack(self.at, len(self.starts), len(self.ids), self.n_ids, self.block, MAGIC))
        self.out.close()
        return self.at + len(index) + TRAILER.size


class Reader:
    """Documents of one file by range reads; ``file`` has ``read_at(size, at)`` and ``size()``."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = bytes(file.read_at(TRAILER.size, size - TRAILER.size)) if size > TRAILER.size else b""
        if tail[-4:] != MAGIC or bytes(file.read_at(4, 0)) != MAGIC:
            raise ValueError("not a file of token blocks")
        self.end, n, docs, self.n_ids, self.block, _ = TRAILER.unpack(tail)
        if self.end + 8 * n + 17 * docs + TRAILER.size != size:
            raise ValueError("the file's index does not fit its length")
        index = bytes(file.read_at(8 * n + 17 * docs, self.end))
        self.starts = np.append(np.frombuffer(index, "<u8", n), np.uint64(self.end))
        self.ids = np.frombuffer(index, "<i8", docs, 8 * n)
        self.known = np.frombuffer(index, "u1", docs, 8 * n + 8 * docs).astype(bool)
        self.first = np.append(np.frombuffer(index, "<u8", docs, 8 * n + 9 * docs), np.uint64(self.n_ids)).astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` to before ``stop``."""
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        data = memoryview(bytes(self.file.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))))
        cut = (self.starts[a : b + 1] - self.starts[a]).astype(int).tolist()
        return unpack([data[i:j] for i, j in zip(cut, cut[1:])])[start - a * self.block : stop - a * self.block]

    def documents(self, begin: int, end: int, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of the first token, tokens) of the documents that begin from place ``begin`` to before ``end``."""
        a, b = (int(np.searchsorted(self.first[:-1], x)) for x in (begin, end))
        while a < b:
            to = max(a + 1, min(b, int(np.searchsorted(self.first, self.first[a] + at_once, "right")) - 1))
            base = int(self.first[a])
            got = self.tokens(base, int(self.first[to]))
            for d in range(a, to):
                yield (int(self.ids[d]) if self.known[d] else None), int(self.first[d]), got[self.first[d] - base : self.first[d + 1] - base]
            a = to


# ---- encoding


class Encoder:
    """Texts to ids, as the library encodes them without special tokens added."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words come once each; its own cache only costs time
        spec = json.loads(tokenizer_json)
        split = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        added = spec.get("added_tokens") or []
        self.by_words = plain and all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
        # letters are one piece, whatever stands beside them, if the library takes for letters what Python does
        self.by_letters = self.by_words and not any(t["content"][0].isalpha() for t in added) and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(all_letters())) == 1
        # the same model, for pieces that are cut already
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        # by the white space that a word follows: which ids begin with it, and the places of words, it included
        self.begins = {lead: np.zeros(max(names.values()) + 1, bool) for lead in " \n"}
        for lead, sign in ((" ", "Ġ"), ("\n", "Ċ")):
            self.begins[lead][[i for t, i in names.items() if t[0] == sign]] = True
        self.known: dict[str, dict[str, int]] = {" ": {}, "\n": {}}
        self.signs: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        for places in (*self.known.values(), self.signs):
            places.clear()
        # place p of the kept ids is ids[ends[p] : ends[p + 1]]
        self.ids, self.ends, self.letters = np.empty(0, np.uint32), np.zeros(1, np.int64), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = self._ids(texts)
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def _keep(self, places: dict[str, int], words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.ends) - 1
        places.update(zip(words, range(n, n + len(words))))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, ids])
        self.letters += sum(map(len, words))

    def _kept(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the places, one after another, and how many each has."""
        begin = self.ends[places]
        size = self.ends[places + 1] - begin
        end = np.cumsum(size)
        return self.ids[np.repeat(begin - end + size, size) + np.arange(end[-1] if len(end) else 0)], size

    def _learn(self, places: dict[str, int], words: list[str], lead: str, letters: bool) -> None:
        """Keeps the ids of each word after a space or a line's end; the words do not hold it, so a token that begins with it begins a word."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), TOGETHER_WORDS):
            part = words[at : at + TOGETHER_WORDS]
            text = lead + lead.join(part)
            if letters:  # a space belongs to the letters after it, a line's end does not
                text = SHOWN[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
                text = text.replace("Ġ", " Ġ") if lead == " " else text.replace("Ċ", " Ċ ")
            (done,) = (self.pieces if letters else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
            raw = np.array(done.ids, np.uint32)
            begin = np.flatnonzero(self.begins[lead][raw])
            if len(begin) == len(part):
                size = np.diff(begin, append=len(raw))
            else:
                raw, size = self._each([lead + w for w in part])
            ids.append(raw)
            sizes.append(size)
        self._keep(places, words, np.concatenate(ids), np.concatenate(sizes))

    def _know(self, new: list[str], lead: str) -> None:
        """Keeps the ids of distinct words that are not known yet and hold no white space at either end."""
        known, plain, others, loose, ended, bases, ends = self.known[lead], [], [], [], [], [], []
        for w in new:
            # letters and the signs that end a word are pieces of their own
            b = w.rstrip(SIGNS)
            if not self.by_letters or not b.isalpha():
                (loose if lead in w else others).append(w)
            elif len(b) == len(w):
                plain.append(w)
            else:
                ended.append(w)
                bases.append(b)
                ends.append(w[len(b) :])
        self._learn(known, others, lead, False)
        self._learn(known, plain, lead, True)
        self._learn(known, list({b for b in bases if b not in known}), lead, True)
        self._keep(known, loose, *self._each([lead + w for w in loose]))
        signs = list({*ends} - self.signs.keys())
        self._keep(self.signs, signs, *self._each(signs))
        parts = np.empty((len(ended), 2), np.int64)
        parts[:, 0], parts[:, 1] = _places(known, bases), _places(self.signs, ends)
        ids, size = self._kept(parts.ravel())
        self._keep(known, ended, ids, size.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_words:
            return self._ids(column.to_pylist())
        if sum(map(len, self.known.values())) > WORDS or self.letters > LETTERS:
            self._clear()
        words, edge = _words(column)
        coded = words.dictionary_encode()
        at, lines = coded.indices.to_numpy(), pc.starts_with(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        bodies = pc.utf8_slice_codeunits(coded.dictionary, 1).to_numpy(zero_copy_only=False)
        place = np.empty(len(bodies), np.int64)
        for lead, mine in ((" ", ~lines), ("\n", lines)):
            place[mine] = np.fromiter(map(self.known[lead].get, bodies[mine].tolist(), repeat(-1)), np.int64, mine.sum())
        # white space of other kinds beside a seam, or at a text's end: such texts go whole
        fresh = np.flatnonzero(place < 0)
        odd = np.zeros(len(bodies) + 1, bool)
        odd[fresh[[w != w.strip() for w in bodies[fresh].tolist()]]] = True
        whole = np.zeros(len(column), bool)
        if odd.any():
            odds = np.concatenate([[0], np.cumsum(odd[at])])
            whole = odds[edge[1:]] > odds[edge[:-1]]
        led = np.repeat(~whole, np.diff(edge))  # words that follow a seam
        begin = edge[:-1][np.diff(edge) > 0]
        led[begin] = False
        first = self._ids([column[i].as_py() if w else words[e].as_py() if e < f else "" for i, (w, e, f) in enumerate(zip(whole.tolist(), edge.tolist(), edge[1:].tolist()))])
        at, used = at[led], np.zeros(len(bodies), bool)
        used[at] = True
        for lead, mine in ((" ", ~lines), ("\n", lines)):
            new = np.flatnonzero(used & mine & (place < 0))
            fresh = bodies[new].tolist()
            self._know(fresh, lead)
            place[new] = _places(self.known[lead], fresh)
        ids, size = self._kept(place[at])
        end = np.concatenate([[0], np.cumsum(size)])
        ids = ids.astype("<u4").tobytes()
        cut = (4 * end[np.concatenate([[0], np.cumsum(led)])[edge]]).tolist()
        return [f + ids[i:j] for f, i, j in zip(first, cut, cut[1:])]


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before each single space and line's end between two other signs, and which pieces are whose: text i has those from edge[i] to before edge[i + 1]."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    signs = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data else np.empty(0, np.uint8)
    edge = edge - edge[0]
    black, cut = ~WHITE[signs], np.zeros(len(signs) + 1, bool)
    cut[1:-2] = ((signs == 0x20) | (signs == 0x0A))[1:-1] & black[:-2] & black[2:]
    # a text's first and last signs are between no two of its own
    cut[edge[1:][edge[1:] > 0] - 1] = False
    cut[edge] = True
    cut[len(signs)] = False
    at = np.flatnonzero(cut)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(signs))), pa.py_buffer(signs))
    return words, np.searchsorted(at, edge)


def _places(places: dict[str, int], words: list[str]) -> np.ndarray:
    return np.fromiter(map(places.__getitem__, words), np.int64, len(words))


# ---- tables


def write(df: DataFrame, folder: str, tokenizer_json: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, percentile: float = PERCENTILE, block: int = BLOCK) -> DataFrame:
    """Writes the files; returns the manifest (part, file, n_docs, n_ids, n_bytes, start), one row a file in order of ids."""
    text = F.coalesce(common.col(text_col), F.lit(""))
    docs = df.select(common.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    by = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    ranges = docs.repartitionByRange(max(1, -(-size // file_bytes)), *by).sortWithinPartitions(*by)
    shared, key = df.sparkSession.sparkContext.broadcast(tokenizer_json), uuid.uuid4().hex
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, name = TaskContext.get().partitionId(), None, ""
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                if writer is None:
                    fs, root = _files(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"ids-{part:06d}-{uuid.uuid4().hex}.flt"
                    writer = Writer(fs.open_output_stream(f"{root}/{name}"), percentile, block)
                ids, texts = (b[k].slice(at, TEXTS) for k in (0, 1))
                for i, raw in zip(ids.to_pylist(), common.kept(key, lambda: Encoder(shared.value)).encode(texts)):
                    writer.add(i, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            n = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids], "n_bytes": [n]})

    made = common.stage(ranges.mapInArrow(run, "part long, file string, n_docs long, n_ids long, n_bytes long"), "tokenfile-manifest")
    # first within bundles of a thousand files, then over the bundles: no task holds all files
    made = made.withColumn("bundle", F.floor(F.col("part") / 1000))
    before = lambda *by: Window.partitionBy(*by).orderBy("part" if by else "bundle").rowsBetween(Window.unboundedPreceding, -1)
    bundles = made.groupBy("bundle").agg(F.sum("n_ids").alias("n")).select("bundle", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before("bundle")), F.lit(0))
    return made.join(bundles, "bundle").withColumn("start", F.col("base") + inside).drop("bundle", "base")


def read(manifest: DataFrame, folder: str, read_ids: int = READ_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document from the files, ids packed as little-endian unsigned 32-bit integers."""
    return _read(manifest, folder, "ids binary", pa.binary(), lambda ids: ids.tobytes(), read_ids)


def checksums(manifest: DataFrame, folder: str, read_ids: int = READ_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document from the files."""
    return _read(manifest, folder, "ids_crc32 bigint", pa.int64(), lambda ids: zlib.crc32(ids.tobytes()), read_ids)


def _read(manifest: DataFrame, folder: str, new: str, kind: pa.DataType, fn, read_ids: int) -> DataFrame:
    last = F.greatest(F.lit(0), F.floor((F.col("n_ids") - 1) / read_ids))
    work = manifest.select("file", "start", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("slice"))
    tasks = manifest.agg(F.sum(last + 1).alias("n")).first()["n"] or 1
    names = ["doc_id", "start", "n_tokens", new.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        for b in batches:
            for file, base, part in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{root}/{file}") as f:
                    rows, held = [], 0
                    for doc, at, ids in Reader(f).documents(part * read_ids, (part + 1) * read_ids):
                        rows.append((doc, base + at, len(ids), fn(ids.astype("<u4"))))
                        held += len(ids)
                        if held > 1 << 20 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), kind))], names=names)

    return work.repartition(int(tasks)).mapInArrow(run, f"doc_id long, start long, n_tokens long, {new}")


def op12_tokenfile(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(tokenizer_path, encoding="utf-8") as f:  # on the driver only
        tokenizer = f.read()
    folder = common.fresh_path(spark, "tokenfile")
    return checksums(write(common.table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2), folder)
