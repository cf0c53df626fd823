"""Connected components of an edge table, by alternating large and small stars.

Every round connects larger neighbours to a node's smallest one; both stars are a
minimum by key (summed in the tasks first) and a join back, so no neighbourhood is
ever gathered, however large.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame) -> bool:
    """Does every u have one v, and is no v a u?  Then each v is its component's root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("as_u")), F.struct(F.col("v").alias("x"), F.lit(0).alias("as_u")))).alias("e")).select("e.*")
    seen = ends.groupBy("x").agg(F.sum("as_u").alias("c"), (F.min("as_u") == 0).alias("as_v"))
    worst = seen.agg(F.max("c").alias("most"), F.bool_or((F.col("c") > 0) & F.col("as_v")).alias("chained")).first()
    return worst["most"] is None or (worst["most"] <= 1 and not worst["chained"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every end of an edge; root is the smallest id of its component.  Edges with a null end or equal ends are ignored."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("differ")).where("differ").select("u", "v").distinct()
    now = common.stage(pairs, "graph")
    while not _stars(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.stage(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "graph")
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
