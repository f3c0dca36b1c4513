"""Silence analysis: cuts proposed where no track of a recording has anything.

Union of all padded events, its complement inside the recording, margins, the neighbours of
each gap, and how unusual its length is. With an envelope the loud gaps stay, switched off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import complement, union
from ..operators.joins import asof
from ..operators.stats import level, noise_floor, zscore


def bounds_of(events: DataFrame, tail=3_600_000) -> DataFrame:
    """(media_id, lo, hi): from 0 to ``tail`` after the last event."""
    return events.groupBy("media_id").agg(F.lit(0).cast("long").alias("lo"), (F.max("t_fin") + F.lit(tail)).alias("hi"))


def gate(cuts: DataFrame, buckets: DataFrame, id_col: str, over_floor_db: float = 12.0, least_dbfs: float = -55.0) -> DataFrame:
    """Adds enabled and confidence: a cut whose level is well above its track's noise is off."""
    by = ["media_id"]
    loud = level(cuts, buckets, by, id_col).join(noise_floor(buckets, by), by, "left")
    active = F.coalesce((F.col("level_dbfs") - F.col("floor_dbfs") > over_floor_db) & (F.col("level_dbfs") > least_dbfs), F.lit(False))
    flags = loud.select(*by, id_col, (~active).alias("enabled"), F.when(active, 0.4).otherwise(0.9).alias("confidence"))
    return cuts.join(flags, [*by, id_col])


def analyse_silence(events: DataFrame, bounds: DataFrame, min_gap, keep_before, keep_after, min_cut, pad_before=0, pad_after=0) -> DataFrame:
    """(media_id, t_ini, t_fin, gap, leading, trailing, prev_id, next_id, gap_z). No margin is kept
    before a leading or after a trailing gap."""
    by = ["media_id"]
    speech = events.select(*by, F.greatest(F.lit(0), F.col("t_ini") - F.lit(pad_before)).alias("t_ini"), (F.col("t_fin") + F.lit(pad_after)).alias("t_fin"))
    gaps = complement(union(speech, by), by, bounds, min_gap).withColumnsRenamed({"t_ini": "a", "t_fin": "b"})
    gaps = gaps.withColumn("t_ini", F.when(F.col("leading"), F.col("a")).otherwise(F.col("a") + F.lit(keep_before)))
    gaps = gaps.withColumn("t_fin", F.when(F.col("trailing"), F.col("b")).otherwise(F.col("b") - F.lit(keep_after)))
    gaps = gaps.where(F.col("t_fin") - F.col("t_ini") >= F.lit(min_cut))
    near = events.select(*by, "event_id", F.col("t_ini").alias("w_ini"), F.col("t_fin").alias("w_fin"))
    gaps = asof(gaps, near, by, "a", "w_fin", ["event_id"], True, prefix="prev_")
    gaps = asof(gaps, near, by, "b", "w_ini", ["event_id"], False, prefix="next_")
    gaps = zscore(gaps.withColumn("gap", F.col("b") - F.col("a")), by, "gap")
    return gaps.select(*by, "t_ini", "t_fin", "gap", "leading", "trailing", F.col("prev_event_id").alias("prev_id"), F.col("next_event_id").alias("next_id"), F.round("gap_z", 6).alias("gap_z"))
