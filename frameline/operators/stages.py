"""Tables between rounds, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df``, in folders by the values of ``by`` if it is given, below ``spark.checkpoint.dir`` and reads it back: a lost executor costs a read, never the rounds before.

    In local mode without that setting a folder of this machine serves; elsewhere that is an error.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="frameline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
