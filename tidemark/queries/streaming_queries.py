"""Streaming operators run to the end of the events on hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..sources.timeline import read
from ..streaming import events as st
from .registry import query


def drained(out: DataFrame, name: str) -> DataFrame:
    """All results of a stream in append mode over the input there is. Each batch has a folder of its
    own, written over when the batch is retried, so nothing is written twice."""
    spark, path = out.sparkSession, scratch_path(out.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark.createDataFrame([], out.schema).write.parquet(f"{path}/batch=-1")
    out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


def stream(spark, d) -> DataFrame:
    """The events, then one late marker without a user that lets the watermark pass all of them."""
    schema = read(spark, d, "events").schema
    path = scratch_path(spark, "stream-end")
    end = read(spark, d, "events").agg(F.max("ts").alias("ts")).where("ts is not null")
    end.select(*[(F.col("ts") + F.expr("interval 30 days") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.unionByName(spark.readStream.schema(schema).parquet(path))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def micros(c: str):
    """Microseconds of the wall clock, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


@query(
    "streaming_sessions",
    """WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events),
 n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, epoch_us(min(ts)) AS t_ini, epoch_us(max(ts)) + 21600000000 AS t_fin, count(*) AS n, max(value) AS peak FROM n GROUP BY user_id, g""",
)
def streaming_sessions(spark, d):
    out = st.sessions(stream(spark, d), "user_id", "ts", "6 hours", "1 day")
    return drained(out, "sessions").select("user_id", micros("t_ini").alias("t_ini"), micros("t_fin").alias("t_fin"), "n", "peak")


@query(
    "streaming_hopping_stats",
    """WITH w AS (SELECT event_type, value, epoch_us(ts) // 21600000000 - h AS k FROM events, range(0, 4) t(h))
 SELECT event_type, k * 21600000000 AS t_ini, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS peak FROM w GROUP BY 1, 2""",
)
def streaming_hopping_stats(spark, d):
    out = st.hopping_stats(stream(spark, d), "event_type", "ts", "24 hours", "6 hours", "1 day")
    rows = drained(out, "hopping")
    return rows.select("event_type", micros("t_ini").alias("t_ini"), "n", F.round("mean", 6).alias("mean"), "peak")


@query(
    "streaming_wake_spans",
    """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'signup' AS wake, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
 r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ini, CAST(NULL AS BIGINT) AS fin, CAST(0 AS BIGINT) AS c, CAST(NULL AS BIGINT) AS x_ini, CAST(NULL AS BIGINT) AS x_fin, CAST(NULL AS BIGINT) AS x_n, CAST(NULL AS VARCHAR) AS cause FROM (SELECT DISTINCT user_id FROM o) UNION ALL
  SELECT user_id, n, CASE WHEN goes THEN ini WHEN wake THEN t END, CASE WHEN goes THEN greatest(fin, t) WHEN wake THEN t END, CASE WHEN goes THEN c + 1 ELSE 0 END, CASE WHEN why IS NOT NULL THEN ini END, CASE WHEN why IS NOT NULL THEN fin END, CASE WHEN why IS NOT NULL THEN c END, why
  FROM (SELECT *, ini IS NOT NULL AND why IS NULL AS goes FROM (SELECT o.*, ini, fin, c, CASE WHEN t - fin >= 43200000 THEN 'silence' WHEN t - ini > 259200000 THEN 'limit' END AS why FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))),
 z AS (SELECT user_id, x_ini, x_fin, x_n, cause FROM r WHERE cause IS NOT NULL UNION ALL SELECT user_id, arg_max(ini, n), arg_max(fin, n), arg_max(c, n), 'silence' FROM (SELECT user_id, coalesce(ini, -1) AS ini, coalesce(fin, -1) AS fin, c, n FROM r) GROUP BY 1)
 SELECT user_id, x_ini * 1000 AS t_ini, x_fin * 1000 AS t_fin, x_n AS n, cause FROM z WHERE x_ini >= 0""",
)
def streaming_wake_spans(spark, d):
    out = st.wake_spans(stream(spark, d), "user_id", "ts", "event_type", "signup", 12 * 3_600_000, 72 * 3_600_000, "1 day")
    rows = drained(out, "wake")
    return rows.select("user_id", micros("t_ini").alias("t_ini"), micros("t_fin").alias("t_fin"), "n", "cause")
