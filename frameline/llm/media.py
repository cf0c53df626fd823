"""Media columns: content-addressed images in tar shards, read back by byte ranges.

A payload (the text's UTF-8 bytes, padded with spaces to a positive multiple of 192)
becomes an 8-bit grey image, 192 samples a row, as lossless PNG.  Every task writes
its images into one tar shard in the shared folder; a member's name is the SHA-256 of
its bytes, and equal payloads of a task are stored once.  Rows carry the digest, the
shard, the member's offset and its length, never the bytes.  The metadata columns
(width, height, bit depth) come from a range read of a member's first 33 bytes; the
features from a range read of the member, decoded again.

A shard's name holds a random part, and the rows are committed by Spark with the name
that their own attempt wrote, so a task that is run again leaves no row that points
to a broken shard; the shards of attempts that failed stay in the folder, unnamed.  A
shard is written once, front to back.

Defined results: a null text is the empty text, one row of spaces; texts are stored
whole; equal texts give equal digests, metadata and features, whatever shard holds
them, and repeated rows are answered one by one; there is nothing to rank, so no ties
arise; an empty table gives an empty result; other columns of the input are kept under
any name, and a new column whose name is taken raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and image header: all that the metadata columns need.
HEADER_BYTES = 33
BLOCK = 512
#: Bytes of media that one task reads back, about.
READ_BYTES = 32 << 20
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
NEW = ["n_bytes", "digest", "shard", "offset", "length"]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes and the number of bytes before padding."""
    raw = (text or "").encode()
    return raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image of the payload's bytes; no row filter, as the bytes are text."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first `HEADER_BYTES` bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of an image written by `to_png`."""
    width, height, _ = read_header(data[:HEADER_BYTES])
    at, body = 8, b""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            body += part
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written by this store")
    return rows[:, 1:].tobytes()


def _files(uri: str):
    """File system and path of a folder, by any scheme that Arrow reads."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


class _Shard:
    """One tar file, written front to back."""

    def __init__(self, folder: str):
        fs, root = _files(folder)
        fs.create_dir(root, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.out = fs.open_output_stream(f"{root}/{self.name}")
        self.at = 0
        self.there: dict[bytes, tuple[str, int, int]] = {}

    def add(self, payload: bytes) -> tuple[str, int, int]:
        """(digest, offset of the bytes, length)."""
        key = hashlib.sha256(payload).digest()
        if key not in self.there:
            data = to_png(payload)
            digest = hashlib.sha256(data).hexdigest()
            info = tarfile.TarInfo(digest)
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.out.write(head + data + bytes(-len(data) % BLOCK))
            self.there[key] = (digest, self.at + len(head), len(data))
            self.at += len(head) + len(data) + -len(data) % BLOCK
        return self.there[key]

    def close(self) -> None:
        self.out.write(bytes(2 * BLOCK))
        self.out.close()


def store(df: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Writes the payloads; returns the rows without the text, with n_bytes, digest, shard, offset, length.

    The rows are dealt out by shard and place, ``READ_BYTES`` of media a part, so that the
    range reads are spread by the media's size and not by that of the index.
    """
    at = common.place_of(df, text_col)
    common.refuse(df.select(*[common.col(c) for k, c in enumerate(df.columns) if k != at]), NEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        shard = None
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                shard = shard or _Shard(folder)
                padded = [payload_of(t) for t in b[at].to_pylist()]
                put = [shard.add(p) for p, _ in padded]
                yield b, [pa.array([n for _, n in padded], pa.int64()), pa.array([x[0] for x in put], pa.string()), pa.array([shard.name] * len(put), pa.string()), pa.array([x[1] for x in put], pa.int64()), pa.array([x[2] for x in put], pa.int64())]
        if shard:
            shard.close()

    done = common.add_columns(df, "n_bytes bigint, digest string, shard string, offset bigint, length bigint", run)
    index = common.stage(done.drop(text_col), "media-index")
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    return index.repartition(max(1, -(-total // READ_BYTES)), "shard", F.floor(F.col("offset") / READ_BYTES))


def _ranges(index: DataFrame, folder: str, new: str, size, fn) -> DataFrame:
    """Adds what ``fn`` makes of a range read of ``size(length)`` bytes; a task keeps one shard open and reads a range once in a batch."""
    kinds = [KINDS[f.dataType.simpleString()] for f in StructType.fromDDL(new).fields]
    at = [common.place_of(index, c) for c in ("shard", "offset", "length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        fs, root = _files(folder)
        name, file = None, None
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                done: dict[tuple, tuple] = {}
                keys = list(zip(*(b[k].to_pylist() for k in at)))
                for key in sorted(set(keys)):
                    if key[0] != name:
                        if file:
                            file.close()
                        name, file = key[0], fs.open_input_file(f"{root}/{key[0]}")
                    done[key] = fn(file.read_at(size(key[2]), key[1]))
                yield b, [pa.array([done[k][j] for k in keys], kind) for j, kind in enumerate(kinds)]
        if file:
            file.close()

    return common.add_columns(index, new, run)


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bit_depth, from the members' first bytes alone."""
    return _ranges(index, folder, "width int, height int, bit_depth int", lambda n: min(n, HEADER_BYTES), read_header)


def _histogram(payload: bytes) -> str:
    """Shares, in thousandths, of the samples in 16 bands of grey."""
    n = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
    return ",".join(map(str, n * 1000 // len(payload)))


def features(index: DataFrame, folder: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes."""
    def read(data: bytes) -> tuple:
        payload = from_png(data)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), _histogram(payload)

    new = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return _ranges(index, folder, new, lambda n: n, read)


def op9_media(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = common.fresh_path(spark, "media")
    done = features(metadata(store(docs, folder), folder), folder)
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset")
