"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to length 1, so that the nearest by distance is the nearest by
cosine.  Coarse centroids (k-means) cut the space into lists; a row's residual is
coded by a product quantiser.  A query visits its ``probes`` nearest lists and ranks
their rows by asymmetric distance tables, on codes alone; the ``shortlist`` best of all
lists together are reranked exactly, in double precision on the original vectors,
which are fetched by id.  ``probes`` is a share of the lists; its default holds recall
above 0.9 even on vectors without clusters, where coarse centroids tell little
(clustered vectors do with far fewer).

Centroids and codebooks are learned on at most ``sample`` vectors (a bound, drawn by a
hash of the id); every row is indexed.  A list is cut into blocks by a hash of the id
and the queries that visit it into blocks of their own, so a list that holds a third
of all rows, or is visited by as many queries, is many groups of bounded size.  Codes
and not vectors are copied to the blocks, and each block hands on a query's
``shortlist`` best at most.

Defined results: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, neither as query nor as candidate; vectors
of any magnitude are compared by direction; a query's own row (its id) is no candidate;
a repeated id is one candidate, with its best score, and one query, with the smallest of
its vectors; null ids take no part; ties go to the smaller id; fewer candidates than
asked for give fewer rows; with no usable vectors the result is empty; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows and queries of one group, about.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024
#: Vectors of the sample that the codebooks are learned on.
BOOK_ROWS = 10_000


def usable(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision, scaled by a power of two so that the largest component lies between 1/2 and 1)."""
    vec = vec.cast(pa.list_(pa.float64()))
    right = np.array(pa.compute.list_value_length(vec).fill_null(-1)) == dim
    at = np.flatnonzero(right)
    x = np.asarray(vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)  # null components become NaN
    most = np.abs(x).max(1, initial=0)
    fine = np.isfinite(x).all(1) & (most > 0)
    x = x[fine]
    half = -np.frexp(most[fine])[1] // 2  # in two steps, as the whole power may not be a double
    return at[fine], np.ldexp(np.ldexp(x, half[:, None]), (-np.frexp(most[fine])[1] - half)[:, None])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centroids and the codebooks of ``parts`` slices of the residuals."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, codes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        self.coarse = _kmeans(x, lists, 8, rng)
        rest = x - self.coarse[_nearest(x, self.coarse)]
        self.cuts = [s for s in np.array_split(np.arange(self.dim), parts) if len(s)]
        self.books = [_kmeans(rest[:BOOK_ROWS, s], codes, 5, rng) for s in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of vectors of length 1."""
        lists = _nearest(x, self.coarse)
        rest = x - self.coarse[lists]
        return lists, np.stack([_nearest(rest[:, s], b) for s, b in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def visited(self, q: np.ndarray, probes: int) -> np.ndarray:
        d = (self.coarse**2).sum(1) / 2 - q @ self.coarse.T
        return np.argsort(d, axis=1, kind="stable")[:, :probes]

    def tables(self, q: np.ndarray, k: int) -> np.ndarray:
        """Asymmetric distances[part, query, code] from the queries' residuals to list ``k``'s codes."""
        rest = q - self.coarse[k]
        out = np.zeros((len(self.cuts), len(q), max(map(len, self.books))))
        for j, (s, b) in enumerate(zip(self.cuts, self.books)):
            out[j, :, : len(b)] = (b**2).sum(1) - 2 * rest[:, s] @ b.T
        return out


def train(df: DataFrame, id_col: str, vec_col: str, lists: int, sample: int = 20_000, parts: int = 32, codes: int = 256) -> Index | None:
    """From at most ``sample`` rows; None if no row is usable.  The driver holds ``sample`` vectors."""
    n = df.count()
    size = df.select(F.size(vec_col).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not size:
        return None
    dim = size[0]["n"]
    drawn = df.where(common.hash_below(F.col(id_col), min(1.0, sample / max(n, 1)), seed=29)).select(id_col, vec_col)
    got = drawn.orderBy(F.xxhash64(F.lit(31), id_col), id_col).limit(sample).toArrow()
    x = usable(got[vec_col].combine_chunks(), dim)[1]
    if not len(x):  # the sample may miss the few usable rows of a small table
        x = usable(df.select(vec_col).where(F.size(vec_col) == dim).limit(sample).toArrow()[vec_col].combine_chunks(), dim)[1]
    if not len(x):
        return None
    return Index(unit(x), max(1, min(lists, len(x))), parts, codes)


def _best(ids: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Row by row the places of the k smallest, ties to the smaller id; ``ids`` ascend."""
    if near.shape[1] > 4 * k:
        cut = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
        masked = np.where(near <= cut, near, np.inf)  # ties at the cut stay in, so the stable sort below decides
        width = int((near <= cut).sum(1).max())
        if width <= 8 * k:
            some = np.sort(np.argpartition(masked, width - 1, axis=1)[:, :width], axis=1)
            order = np.argsort(np.take_along_axis(masked, some, 1), axis=1, kind="stable")[:, :k]
            return np.take_along_axis(some, order, 1)
    return np.argsort(near, axis=1, kind="stable")[:, :k]


def search(rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, lists: int | None = None, probe_share: float = 0.8, shortlist: int | None = None, sample: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), ``id_col``, score: each query's ``k`` nearest rows found.

    ``shortlist``: rows reranked for a query; by default a twentieth of the rows, 32 to 256.
    """
    spark = rows.sparkSession
    rows, queries = (d.select(common.col(id_col).cast("bigint").alias("id"), common.col(vec_col).cast("array<double>").alias("v")).where("id is not null") for d in (rows, queries))
    queries = queries.where("v is not null").groupBy("id").agg(F.min("v").alias("v"))
    n = rows.count()
    shortlist = shortlist or int(min(256, max(32, n // 20)))
    lists = lists or int(min(4096, max(8, 2 ** round(np.log2(max(n, 1) ** 0.5 / 4)))))
    model = train(rows, "id", "v", lists, sample)
    empty = spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    if model is None:
        return empty
    probes = max(1, int(np.ceil(probe_share * len(model.coarse))))
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                at, x = usable(b["v"], m.dim)
                where, codes = m.encode(unit(x)) if len(at) else (np.zeros(0, int), np.zeros((0, len(m.cuts)), np.uint8))
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), pa.array(where.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "list", "code"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                at, x = usable(b["v"], m.dim)
                x = unit(x)
                to = m.visited(x, probes) if len(at) else np.zeros((0, probes), int)
                row = np.repeat(np.arange(len(at)), to.shape[1])
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at[row])), pa.array(to.ravel().astype(np.int32)), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()).take(pa.array(row))], names=["id", "list", "v"])

    index = common.stage(rows.mapInArrow(place, "id bigint, list int, code binary"), "ann-index")
    visits = common.stage(queries.mapInArrow(visit, "id bigint, list int, v binary"), "ann-visits")

    # groups of bounded size: list x row block x query block
    sizes = index.groupBy("list").agg(F.count("*").alias("n")).withColumn("rb", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).drop("n")
    asked = visits.groupBy("list").agg(F.count("*").alias("n")).withColumn("qb", F.ceil(F.col("n") / BLOCK_QUERIES).cast("int")).drop("n")
    grid = F.broadcast(sizes.join(asked, "list"))  # one row a list, at most 4096
    block = lambda seed, of: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(of)).cast("int")
    left = index.join(grid, "list").withColumn("r", block(41, "rb")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("list", "r", "q", "id", "code")
    right = visits.join(grid, "list").withColumn("q", block(43, "qb")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1))).select("list", "r", "q", "id", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Each query's ``shortlist`` nearest of a block by the codes, its own id left out."""
        m, out = shared.value, [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "near": np.zeros(0)})]
        if not len(a) or not len(b):
            return out[0]
        a = a.drop_duplicates(["id", "code"]).sort_values("id", kind="stable")
        ids, code = a["id"].to_numpy(), np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1)
        step = max(1, 4_000_000 // len(a))
        for i in range(0, len(b), step):
            part = b.iloc[i : i + step]
            own = part["id"].to_numpy()
            table = m.tables(np.frombuffer(b"".join(part["v"]), np.float32).reshape(len(part), -1).astype(np.float64), int(a["list"].iat[0]))
            near = np.zeros((len(part), len(a)))
            for j in range(len(table)):
                near += table[j][:, code[:, j]]
            near[own[:, None] == ids[None, :]] = np.inf
            some = _best(ids, near, min(shortlist, len(a)))
            got = np.take_along_axis(near, some, 1)
            keep = np.isfinite(got)
            out.append(pd.DataFrame({"query_id": np.repeat(own, keep.sum(1)), "id": ids[some][keep], "near": got[keep]}))
        return pd.concat(out)

    keys = ["list", "r", "q"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id bigint, id bigint, near double")
    w = Window.partitionBy("query_id").orderBy("near", "id")
    short = met.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= shortlist).select("query_id", "id").distinct()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = shared.value.dim
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                at, y = usable(b["q"], dim)
                b = b.take(pa.array(at))
                of, x = usable(b["v"], dim)
                y = y[of]
                cosine = np.einsum("nd,nd->n", y, x) / (np.sqrt(np.einsum("nd,nd->n", y, y)) * np.sqrt(np.einsum("nd,nd->n", x, x)))
                yield pa.RecordBatch.from_arrays([b["query_id"].take(pa.array(of)), b["id"].take(pa.array(of)), pa.array(cosine)], names=["query_id", "id", "score"])

    fetched = short.join(rows, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = fetched.select("query_id", "id", "q", "v").mapInArrow(exact, "query_id bigint, id bigint, score double").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
