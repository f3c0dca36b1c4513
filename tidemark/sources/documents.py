"""Sources and sinks: JSON documents, media identity, catalogs, versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("prob", T.DoubleType())])
BREATH = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = False) -> DataFrame:
    """JSON documents by an explicit schema, one a file or, with ``lines``, one a line; a byte order mark is skipped; what
    can't be read is kept in ``_corrupt_record``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if "_corrupt_record" not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="PERMISSIVE")


def optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """A stream that may be missing: without a path an empty table of its schema."""
    return read_json(spark, path, schema).drop("_corrupt_record") if path else spark.createDataFrame([], schema)


def read_words(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Words of recordings, one JSON list a file or, with ``lines``, a line, on the millisecond clock; invalid rows stay
    in, marked: a word needs a text and 0 <= start <= end. Many short lists belong in few files."""
    rows = read_json(spark, path, WORD, lines).withColumn("source", F.input_file_name())
    ok = F.col("word").isNotNull() & (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & F.col("_corrupt_record").isNull()
    return rows.select("source", F.round(F.col("start") * 1000).cast("long").alias("t_ini"), F.round(F.col("end") * 1000).cast("long").alias("t_fin"), F.col("word").alias("text"), F.col("prob").alias("asr_prob"), F.coalesce(ok, F.lit(False)).alias("valid"))


def fingerprint(media: DataFrame) -> DataFrame:
    """Content identity of media rows: size, content hash and a digest of the inventory; the path
    is no part of it."""
    inventory = F.sha2(F.to_json(F.struct("duration", "tracks")), 256)
    return media.withColumn("identity", F.sha2(F.concat_ws("|", F.col("size").cast("string"), F.col("sampled_hash"), inventory), 256))


def sampled_hash(content, size, block: int = 8 << 20):
    """Digest of the first, middle and last block of a binary column and its size: the identity of
    large files without reading all of them into a hash."""
    middle = F.greatest(F.lit(1), F.floor((size - block) / 2) + 1).cast("int")
    last = F.greatest(F.lit(1), size - block + 1).cast("int")
    parts = [F.substring(content, F.lit(1), F.lit(block)), F.substring(content, middle, F.lit(block)), F.substring(content, last, F.lit(block))]
    return F.sha2(F.concat(*parts, F.encode(size.cast("string"), "utf-8")), 256)


def scan(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Files below a root with their stamp and content hash (path, size, modified, digest)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def changed(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files that are new, or whose stamp differs from the catalog's."""
    return found.join(catalog, ["path", "size", "modified"], "left_anti")


def discover(catalog: DataFrame, identity, near: str) -> DataFrame:
    """Entries of one identity, nearest path first, one per content digest."""
    common = F.size(F.array_intersect(F.split("path", "/"), F.split(F.lit(near), "/")))
    rows = catalog.where(F.col("identity") == identity).withColumn("distance", F.size(F.split("path", "/")) - common)
    w = Window.partitionBy("digest").orderBy("distance", "path")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").orderBy("distance", "path")


def legacy_match(masters: DataFrame, media: DataFrame, tolerance: float) -> DataFrame:
    """Masters without identity matched by file name and duration."""
    m = media.select(F.col("name").alias("m_name"), F.col("duration").alias("m_duration"), "media_id")
    return masters.join(m, (F.lower("name") == F.lower("m_name")) & (F.abs(F.col("duration") - F.col("m_duration")) <= tolerance)).drop("m_name")


def write_events(events: DataFrame, path: str, by: tuple[str, ...] = ("media_id", "stream")) -> None:
    """Partitioned event store; rows of one partition value are brought together first."""
    events.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_chunks(chunks: DataFrame, events: DataFrame, path: str, bin_width=None) -> None:
    """Each chunk's slice of the events, one folder a chunk."""
    from ..operators.joins import overlap_join

    right = events.withColumnsRenamed({"t_ini": "r_ini", "t_fin": "r_fin"})
    rows = overlap_join(chunks.select("media_id", "chunk_id", "t_ini", "t_fin"), right, ["media_id"], bin_width=bin_width)
    write_events(rows, path, ("media_id", "chunk_id"))


def save_version(df: DataFrame, root: str, revision: int) -> str:
    """Appends one immutable revision of a document table; readers take the latest."""
    path = f"{root}/revision={revision}"
    df.write.mode("errorifexists").parquet(path)
    return path


def run_step(spark: SparkSession, root: str, step: str, params: dict, make, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """One step keyed by its parameters and the content of its ``inputs``: computed once, read afterwards,
    and computed anew when they change. ``make`` takes the inputs by name."""
    from .steps import Step, run_graph

    inputs = inputs or {}
    tables, _ = run_graph(spark, root, [Step(step, make, inputs=tuple(inputs), params=params)], inputs)
    return tables[step]
