"""Centroid clustering: plain Lloyd rounds in whole numbers.

Every component x becomes floor(scale * x), and all that follows is integer arithmetic,
so the result does not depend on how rows are dealt out.  The integer vectors are
written once as a stage table.  A round broadcasts the centroids (k vectors, a bound
that no input moves); `mapInPandas` takes, a block of rows at a time, the sum of squared
differences to each centroid in NumPy, and argmin picks the lowest number among the
nearest.  A partition gives one row a centroid, its integer sums and count, and these
rows, k a partition, meet in a `groupBy`.  Only k sums reach the driver.

Defined results: vectors of another length, or null, or with a null or non-finite
component, take no part, and neither do those with a component outside +-2^27 after
scaling, as their squared distances might not fit a long.  Each row counts for itself:
repeated rows are vectors of their own, and rows of one id are ordered by their
components where the start is drawn; a null id stands for the empty text there.  With
fewer vectors than k there are as many centroids as vectors; equal distances go to the
smaller number; an empty centroid stays where it is; an empty table gives an empty
result; a sum of distances that does not fit a long is null.  Other columns of the input
are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Components after scaling lie within this, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
#: Rows whose differences are held at once.
BLOCK = 4096


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of whole numbers."""
    x = common.col(vector_col)
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    sound = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(LARGEST)))
    # guarded twice: what is filtered out must not be cast either
    return df.where(x.isNotNull() & sound).select(common.col(id_col).cast("long").alias("vec_id"), F.when(sound, scaled).cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of ``seed:vec_id``, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()], np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid."""
    # 32 bits are enough where no sum of squares can leave them
    reach = int(max(np.abs(rows).max(initial=0), np.abs(centroids).max(initial=0)))
    kind = np.int32 if rows.shape[1] * (2 * reach) ** 2 < 1 << 31 else np.int64
    rows, centroids = rows.astype(kind), centroids.astype(kind)
    far = np.empty((len(rows), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        d = rows - centre
        far[:, c] = np.einsum("ij,ij->i", d, d)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(rows)), best]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for b in batches:
        for at in range(0, len(b), BLOCK):
            part = b.iloc[at : at + BLOCK]
            yield part, np.vstack(part["v"].to_numpy()).astype(np.int64)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each non-empty centroid's vectors."""
    k, size = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{j}" for j in range(size)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for _, rows in _blocks(batches):
            best, _ = nearest(rows, shared.value)
            count += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            there, first = np.unique(best[order], return_index=True)
            total[there] += np.add.reduceat(rows[order], first, axis=0)
        there = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": there.astype(np.int32), "n": count[there], **{s: total[there, j] for j, s in enumerate(names)}})

    parts = vectors.select("v").mapInPandas(run, "cluster int, n long, " + ", ".join(f"{s} long" for s in names))
    # decimals: sums of all partitions may leave a long
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(28,0)")).alias(s) for s in names])
    out = {r["cluster"]: (r["n"], [int(r[s]) for s in names]) for r in merged.collect()}
    shared.unpersist()
    return out


def lloyd(vectors: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds over a table of (vec_id, v)."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for c, (n, total) in _sums(vectors, centroids).items():
            centroids[c] = [s // n for s in total]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, rows in _blocks(batches):
            best, far = nearest(rows, shared.value)
            yield pd.DataFrame({"vec_id": part["vec_id"].astype("Int64"), "cluster": best.astype(np.int32), "distance": far})

    return vectors.mapInPandas(run, "vec_id long, cluster int, distance long")


def _fits(total: Column) -> Column:
    """A decimal total as a long, null where it does not fit."""
    return F.when(total <= F.lit((1 << 63) - 1), total).cast("long")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a kept vector."""
    if min(size, k, scale) < 1 or rounds < 0:
        raise ValueError("size, k and scale must be positive, rounds not negative")
    if size * (4 * LARGEST * LARGEST) >= 1 << 63:
        raise ValueError("vectors this long may have squared distances that fit no long")
    vectors = common.stage(whole_numbers(df, id_col, vector_col, size, scale), "clusters-vectors")
    centroids = lloyd(vectors, k, rounds, seed)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    done = common.stage(assign(vectors, centroids), "clusters-assigned")
    sums = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = [(c, sums[c], sum(sums.values()), digest[c]) for c in sums]
    told = df.sparkSession.createDataFrame(about, "cluster int, own decimal(38,0), total decimal(38,0), centroid_sha256 string")
    return done.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", _fits(F.col("own")).alias("cluster_inertia"), _fits(F.col("total")).alias("inertia"), "centroid_sha256")


def op11_lloyd(spark, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def lloyd_sql(size: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256) -> str:
    """The same rows by SQL: one assignment and one mean a round."""
    floor_div = "((s - ((s % n) + n) % n) // n)"
    ctes = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        "vectors AS (SELECT row_number() OVER () AS id, vec_id, v FROM kept)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS w FROM vectors QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT id, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM vectors, c{r})")
        ctes.append(f"a{r} AS (SELECT id, min_by(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM d{r} GROUP BY id)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT c, list({floor_div} ORDER BY j) AS w FROM (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r} a JOIN vectors USING (id)) GROUP BY c, j) GROUP BY c)")
            ctes.append(f"c{r + 1} AS (SELECT c, coalesce(m.w, o.w) AS w FROM c{r} o LEFT JOIN m{r} m USING (c))")
    last = rounds
    return "WITH " + ",\n".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in ctes) + (
        f"\nSELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{last} JOIN vectors USING (id) JOIN c{last} USING (c)"
    )
