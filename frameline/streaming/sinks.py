"""A sink between a stream and what is downstream: every micro-batch once, the last row included.

The stream's source bounds what is read at once (files a batch), and the sink is written
before the next batch is read: a producer never runs ahead of its consumer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that any path that Spark reads will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(path: str, write: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: writes batch n to ``path``/batch=n and leaves out a batch that is written already.

    A batch is written when its folder has the mark that Spark puts there at the commit; what a
    failed attempt left without one is replaced.  So a batch that is replayed after a
    restart changes nothing, and none is lost.
    """
    def put(batch: DataFrame, folder: str) -> None:
        batch.write.mode("overwrite").parquet(folder)

    def run(batch: DataFrame, number: int) -> None:
        folder = f"{path.rstrip('/')}/batch={number}"
        if not _exists(batch.sparkSession, f"{folder}/_SUCCESS"):
            (write or put)(batch, folder)

    return run


def written(spark: SparkSession, path: str) -> DataFrame:
    """What `once` has written, with the number of its batch; folders without the mark are not read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    folders = sorted(f.getPath().getParent().toString() for f in found)
    if not folders:
        raise FileNotFoundError(f"no batch is written below {path}")
    return spark.read.option("basePath", path).parquet(*folders).withColumn("batch", F.col("batch").cast("long"))
