"""What the corpus operators share: stage tables, the shared folder, table readers, Arrow steps.

Stage tables go to the folder in ``spark.checkpoint.dir``.  They are plain
Parquet, so a lost executor costs a re-read and never a re-computation.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``; bytes.split() uses the same set.
WORD_RULE = r"[^\x20\x09-\x0D]+"
SPACE_RULE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; without one, a local folder in local mode, where all tasks see it, and an error elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="frameline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text, modulo ``k``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k), F.lit(0))


def hash_below(doc_id: Column, fraction: float, seed: int = 7) -> Column:
    """True for a fixed pseudo-random ``fraction`` of ids, however small; the same ids at every run."""
    if fraction >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 1) < F.lit(int(fraction * (1 << 63)))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def col(name: str) -> Column:
    """The column of that name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(df: DataFrame) -> list[Column]:
    """All columns but maps and variants, which have no hash."""
    return [col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def refuse(df: DataFrame, new: Iterable[str]) -> None:
    """``ValueError`` if ``df`` has a column of one of the names."""
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in new}:
        raise ValueError(f"column names taken: {sorted(clash)}")


def place_of(df: DataFrame, name: str) -> int:
    """Where the column stands; its exact name goes before one of other case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def add_columns(df: DataFrame, new: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """``df`` with the columns of the DDL text ``new``, filled by ``run`` in Arrow batches.

    ``run`` takes batches whose columns are known by place only, so that any name may
    stand in ``df``, and gives slices of them, each with its new columns.
    """
    fields = StructType.fromDDL(new).fields
    refuse(df, (f.name for f in fields))
    safe = [f"c{k}" for k in range(len(df.columns) + len(fields))]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cols in run(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=safe)

    schema = StructType([StructField(s, f.dataType, True) for s, f in zip(safe, [*df.schema.fields, *fields])])
    return df.toDF(*safe[: len(df.columns)]).mapInArrow(whole, schema).toDF(*df.columns, *(f.name for f in fields))


_KEPT: dict = {}


def forget() -> None:
    """Drops what earlier tasks of this worker process kept, and hands free memory back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def kept(key: str, make: Callable):
    """The value under ``key``, made at first use.  A worker process keeps one value: what another operator or run left goes first."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]
