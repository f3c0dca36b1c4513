"""Event tables of the engine, derived from the driver's tables.

A recording is one user of ``events``; its tracks are the event types; an event lasts as long
as its value says. The clock is whole milliseconds since the first of January 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"
MS_PER_CENT = 6000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, media_id, track_id, t_ini, t_fin, value, k)"""
    t = F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'{ORIGIN}', cast(ts as timestamp_ntz))")
    length = F.round(F.col("value") * 100).cast("long") * MS_PER_CENT
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("media_id"), F.col("event_type").alias("track_id"), t.alias("t_ini"), (t + length).alias("t_fin"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations on a synthetic clock: a turn lasts 60 ms a character, and begins 400 ms
    before the turns before it have ended."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").where("text is not null")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text") * F.lit(60)
    start = F.coalesce(F.sum(size - 400).over(w), F.lit(0))
    return c.select("conv_id", "turn", "role", "text", start.cast("long").alias("t_ini"), (start + size).cast("long").alias("t_fin"))


EV_SQL = f"""ev AS (SELECT event_id, user_id AS media_id, event_type AS track_id,
  (epoch_us(ts) - 1704067200000000) // 1000 AS t_ini,
  (epoch_us(ts) - 1704067200000000) // 1000 + CAST(round(value * 100) AS BIGINT) * {MS_PER_CENT} AS t_fin,
  value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

UT_SQL = """ut AS (SELECT conv_id, turn, role, text,
  CAST(coalesce(sum(length(text) * 60 - 400) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t_ini,
  CAST(coalesce(sum(length(text) * 60 - 400) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) * 60 AS BIGINT) AS t_fin
  FROM conversations WHERE text IS NOT NULL)"""
