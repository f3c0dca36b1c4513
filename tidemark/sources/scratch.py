"""The folder that driver and executors share, for tables that cut a lineage and for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``; only a local session without one (a
    laptop) gets a temporary folder of its own; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back, so a
    lost executor costs a re-read and not a re-computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """Marks a side of a join: joined by a shuffle, never sent whole to the driver and to every task. Spark takes a stored table
    for as large as its compressed files, but ids and counts are many times that in memory; and rounds would send one again and again."""
    return df.hint("merge")
