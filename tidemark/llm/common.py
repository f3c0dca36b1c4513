"""Shared helpers of the text operators: table access, shared scratch tables and
distributed union-find."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z only, as the contracts ask; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A whole input table, with only the named columns read from Parquet."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only a local session without one (tests, a laptop) gets one; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Open scopes of each thread.
_local = threading.local()


@contextmanager
def scratch_scope():
    """Collects the paths of the tables that ``save`` writes inside the scope, so that they can
    be dropped once what was derived from them is written."""
    scopes = _local.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield scopes[-1]
    finally:
        scopes.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables wherever the shared folder lies."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    paths.clear()


def free_name(taken: list[str], name: str) -> str:
    """``name``, made longer until no column has it, in whatever case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of at most ``rows`` rows, so that a task holds few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def save(df: DataFrame, dictionary: bool = True) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it
    back, so a lost executor costs a re-read and not a re-computation. ``dictionary`` off
    spares the attempt to encode columns of distinct values."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    for held in _local.__dict__.get("scopes", [])[-1:]:
        held.append(path)
    df.write.option("parquet.enable.dictionary", str(dictionary).lower()).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two long columns ``a`` and ``b``. Returns (node, component) for every
    node that has an edge to another node; component is the smallest node reachable.
    A hub may own any share of the edges: minima are pre-aggregated before the shuffle
    and the joins back are plain equi-joins, which AQE splits when skewed. Null ends and
    self-loops are ignored; repeated edges count once; no edges give no rows.
    """
    pairs = save(edges.select("a", "b").dropna().select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        pairs = save(small.where("u <> v").distinct())
    centres = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def _stars(pairs: DataFrame) -> bool:
    """Is every u tied once, to a v that is no u? Then the v are the smallest of their components."""
    n, distinct = pairs.agg(F.count("*"), F.count_distinct("u")).first()
    return n == distinct and not pairs.select(F.col("v").alias("u")).distinct().join(pairs, "u", "left_semi").take(1)
