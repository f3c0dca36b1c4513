"""Streaming forms of the sequence operators, for event streams that never end.

Every state is bounded by the watermark: sessions close, and wake spans end, when it passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive, by an explicit schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: an event at most ``gap`` after the last joins (the gap is inclusive)."""
    windowed = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return windowed.agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(key, F.col("w.start").alias("t_ini"), F.col("w.end").alias("t_fin"), "n", "peak")


def hopping_stats(events: DataFrame, key: str, ts: str, size: str, hop: str, late: str) -> DataFrame:
    """Mean, deviation and peak of the value in hopping windows."""
    windowed = events.withWatermark(ts, late).groupBy(key, F.window(ts, size, hop).alias("w"))
    out = windowed.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.max("value").alias("peak"))
    return out.select(key, F.col("w.start").alias("t_ini"), F.col("w.end").alias("t_fin"), "n", "mean", "sd", "peak")


def first_of_each(events: DataFrame, id_col: str, ts: str, late: str) -> DataFrame:
    """Events without those whose id was seen before, within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])


def wake_spans(events: DataFrame, key: str, ts: str, kind: str, wake: str, end_gap_ms: int, max_ms: int, late: str) -> DataFrame:
    """Spans that a wake event opens: they end at a gap, at the limit, or when the watermark has
    passed both. A wake event inside a span is absorbed. Rows of a batch are taken in time order."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            out.append((name[0], pd.Timestamp(start, unit="ms"), pd.Timestamp(last, unit="ms"), n, "silence"))
            start = None
        rows = pd.concat(list(frames)) if not state.hasTimedOut else pd.DataFrame(columns=[ts, kind])
        for r in rows.sort_values(ts).itertuples():
            t = int(getattr(r, ts).value // 1_000_000)
            if start is not None and (t - last >= end_gap_ms or t - start > max_ms):
                out.append((name[0], pd.Timestamp(start, unit="ms"), pd.Timestamp(last, unit="ms"), n, "silence" if t - last >= end_gap_ms else "limit"))
                start = None
            if start is not None:
                last, n = max(last, t), n + 1
            elif getattr(r, kind) == wake:
                start, last, n = t, t, 0
        if start is None:
            state.remove()
        else:
            state.update((start, last, n))
            state.setTimeoutTimestamp(max(last + end_gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "t_ini", "t_fin", "n", "cause"])

    kind_of = dict(events.dtypes)[key]
    grouped = events.withWatermark(ts, late).select(key, ts, kind).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {kind_of}, t_ini timestamp, t_fin timestamp, n long, cause string", "start long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
