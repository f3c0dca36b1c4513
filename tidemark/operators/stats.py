"""Statistics over event tables: baselines, tiers, ranks, envelopes and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .intervals import overlap_length
from .joins import overlap_join


def zscore(df: DataFrame, by: list[str], value: str, name: str | None = None) -> DataFrame:
    """Adds mean, population deviation (0 counts as 1) and z of each row in its timeline.

    The baseline is aggregated and joined back, so it is combined before the shuffle and a
    hot timeline is no single window; nulls stay null."""
    name = name or value
    base = df.groupBy(*by).agg(F.avg(value).alias(f"{name}_mu"), F.stddev_pop(value).alias(f"{name}_sd"))
    sd = F.when(F.coalesce(F.col(f"{name}_sd"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"{name}_sd"))
    return df.join(base, by).withColumn(f"{name}_z", (F.col(value) - F.col(f"{name}_mu")) / sd)


#: Pieces that the values of a stream are dealt into when they are ranked.
PIECES = 64


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, c, below, n): each value of a stream, how often it occurs, how many values are smaller and how many
    there are. Nulls (and, of doubles, NaN) don't count.

    Equal values are counted before the shuffle. Approximate percentiles, which only say where to cut, deal a stream into
    PIECES pieces; the counts run inside the pieces, and the pieces' totals are carried over. So ranks are exact and no stream is sorted in one task.
    The approximation may differ each time it is made, so it is made once and stored: counts and totals must mean the same pieces."""
    rows = df.select(*by, F.col(value).alias("value")).where("value IS NOT NULL")
    if dict(rows.dtypes)["value"] in ("double", "float"):
        rows = rows.where(~F.isnan("value"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx("value", [i / PIECES for i in range(1, PIECES)], 1000).alias("cuts"), F.count("*").alias("n"))
    cuts = stored(cuts, "cuts")
    counts = rows.groupBy(*by, "value").agg(F.count("*").alias("c")).join(cuts, by).withColumn("piece", F.size(F.filter("cuts", lambda x: x < F.col("value"))))
    inside = Window.partitionBy(*by, "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "piece").agg(F.sum("c").alias("total")).select(*by, "piece", F.sum("total").over(line).alias("before"))
    counts = counts.withColumn("below", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(totals, [*by, "piece"])
    return counts.select(*by, "value", "c", (F.col("below") + F.coalesce("before", F.lit(0))).alias("below"), "n")


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, names): linear percentiles of each stream, by name; streams without values are left out."""
    counts = value_counts(df, by, value)
    picked = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        for at, k in ((f"{name}_lo", F.floor(place)), (f"{name}_hi", F.ceil(place))):
            picked.append(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("c")), F.col("value"))).cast("double").alias(at))
    found = counts.groupBy(*by).agg(F.max("n").alias("n"), *picked)
    between = lambda name, share: F.col(f"{name}_lo") + (F.lit(share) * (F.col("n") - 1) - F.floor(F.lit(share) * (F.col("n") - 1))) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
    return found.select(*by, "n", *(between(name, share).alias(name) for name, share in shares.items()))


def robust_baseline(df: DataFrame, by: list[str], value: str, floor=0.0) -> DataFrame:
    """(by, median, scale, p95): scale is 1.4826 times the median absolute deviation, floored."""
    mid = exact_percentiles(df, by, value, {"median": 0.5, "p95": 0.95}).drop("n")
    away = df.join(mid, by).select(*by, F.abs(F.col(value) - F.col("median")).alias("away"))
    away = exact_percentiles(away, by, "away", {"mad": 0.5}).drop("n")
    return mid.join(away, by).select(*by, "median", F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(floor)).alias("scale"), "p95")


def robust_z(df: DataFrame, by: list[str], value: str, floor=0.0) -> DataFrame:
    base = robust_baseline(df, by, value, floor)
    return df.join(base, by).withColumn(f"{value}_rz", (F.col(value) - F.col("median")) / F.when(F.col("scale") == 0, F.lit(0.1)).otherwise(F.col("scale")))


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Linear p50, p80, p95 and the number of values of each stream."""
    return exact_percentiles(df, by, value, {"p50": 0.5, "p80": 0.8, "p95": 0.95}).select(*by, "p50", "p80", "p95", "n")


def tiers(df: DataFrame, by: list[str], value: str, least: int = 5) -> DataFrame:
    """Adds tier 0 to 3: null is 0, a stream of fewer than ``least`` values 1, else by p80 and p95."""
    limits = percentiles(df, by, value)
    v = F.col(value)
    tier = F.when(v.isNull(), 0).when(F.coalesce("n", F.lit(0)) < least, 1).when(v >= F.col("p95"), 3).when(v >= F.col("p80"), 2).otherwise(1)
    return df.join(limits, by, "left").withColumn("tier", tier)


def ranked_pool(df: DataFrame, by: list[str], value: str, least=None) -> DataFrame:
    """Adds the share of a stream's values that are not above each value; only then is filtered."""
    counts = value_counts(df, by, value).select(*by, F.col("value").alias(value), ((F.col("below") + F.col("c")) / F.col("n")).alias("rank"))
    ranked = df if least is None else df.where(F.col(value) >= F.lit(least))
    return ranked.join(counts, [*by, value]).select(*df.columns, "rank")


def upper_median(df: DataFrame, by: list[str], value: str, order: list, last: int | None = None) -> DataFrame:
    """The upper of the two middle values (no average), over the ``last`` rows of each group."""
    rows = df
    if last is not None:
        rows = df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= last)
    w = Window.partitionBy(*by).orderBy(value)
    ranked = rows.withColumn("__k", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    return ranked.where(F.col("__k") == F.floor(F.col("__n") / 2)).select(*by, F.col(value).alias("upper_median"), F.col("__n").alias("n"))


def envelope(samples: DataFrame, by: list[str], position: str, value: str, total: str, buckets: int) -> DataFrame:
    """Exactly ``buckets`` rows per timeline: minimum, maximum and RMS of the samples at
    ``position`` in 0..total-1; buckets without samples are silence."""
    b = F.floor(F.col(position) * F.lit(buckets) / F.col(total)).cast("long")
    full = samples.groupBy(*by, b.alias("bucket")).agg(F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n"))
    grid = samples.select(*by).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    zero = {"v_min": 0.0, "v_max": 0.0, "rms": 0.0, "n": 0}
    return grid.join(full, [*by, "bucket"], "left").na.fill(zero)


def noise_floor(buckets: DataFrame, by: list[str], percentile: float = 0.2) -> DataFrame:
    """Per track the percentile of 20 log10(rms) over audible buckets, else -60 dB."""
    db = 20 * F.log10(F.when(F.col("rms") > 1e-5, F.col("rms")))
    return buckets.groupBy(*by).agg(F.coalesce(F.percentile(db, F.lit(percentile)), F.lit(-60.0)).alias("floor_dbfs"))


def level(gaps: DataFrame, buckets: DataFrame, by: list[str], id_col: str, bin_width=None) -> DataFrame:
    """Mean energy of the buckets (r_ini, r_fin, rms) inside each gap, in dBFS; null without any."""
    hit = overlap_join(gaps.select(*by, id_col, "t_ini", "t_fin"), buckets.select(*by, "r_ini", "r_fin", "rms"), by, bin_width=bin_width)
    db = 10 * F.log10(F.greatest(F.avg(F.col("rms") * F.col("rms")), F.lit(1e-12)))
    return gaps.select(*by, id_col).join(hit.groupBy(*by, id_col).agg(db.alias("level_dbfs")), [*by, id_col], "left")


def curve(events: DataFrame, by: list[str], value: str, step, bin_width=None) -> DataFrame:
    """On a grid of ``step`` the number of events that meet each cell and their largest value."""
    cell = F.explode(F.sequence(F.floor(F.col("t_ini") / step), F.floor(F.greatest("t_ini", F.col("t_fin") - 1) / step)))
    return events.select(*by, value, cell.alias("cell")).groupBy(*by, "cell").agg(F.count("*").alias("n"), F.max(value).alias("peak"))


def span_summary(spans: DataFrame, events: DataFrame, by: list[str], span_id: str, group: str, value: str, bin_width=None) -> DataFrame:
    """Per span and group: events that overlap it, their largest value and common time."""
    e = events.select(*by, F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), group, value)
    hit = overlap_join(spans.select(*by, span_id, "t_ini", "t_fin"), e, by, bin_width=bin_width)
    return hit.groupBy(*by, span_id, group).agg(F.count("*").alias("n"), F.max(value).alias("peak"), F.sum(overlap_length("t_ini", "t_fin", "r_ini", "r_fin")).alias("shared"))


def activity(samples: DataFrame, by: list[str], value: str, group: str, z: str) -> DataFrame:
    """Mean over channel groups of the largest clipped z/8 at each time."""
    part = samples.groupBy(*by, group).agg(F.max(F.least(F.greatest(F.col(z) / 8, F.lit(0.0)), F.lit(1.0))).alias("a"))
    return part.groupBy(*by).agg(F.avg("a").alias("activity"))


def emphasis(level_z, dur_z, contrast_db):
    """Logistic emphasis of a word from its level, length and local contrast."""
    bounded = F.least(F.greatest(contrast_db / 6, F.lit(-3.0)), F.lit(3.0))
    return 1 / (1 + F.exp(-(0.72 * level_z + 0.18 * dur_z + 0.10 * bounded)))


def median_box(df: DataFrame, by: list[str], cols: tuple[str, str, str, str] = ("x", "y", "w", "h"), margin: float = 0.15) -> DataFrame:
    """Median rectangle of each group, grown by ``margin`` of its size on every side."""
    m = df.groupBy(*by).agg(*(F.median(c).alias(c) for c in cols))
    x, y, w, h = map(F.col, cols)
    return m.select(*by, (x - w * margin).alias("x"), (y - h * margin).alias("y"), (w * (1 + 2 * margin)).alias("w"), (h * (1 + 2 * margin)).alias("h"))


def word_levels(words: DataFrame, buckets: DataFrame, by: list[str], id_col: str, context, bin_width=None) -> DataFrame:
    """Per word its level, the local floor (a tenth percentile of the buckets around it), their
    contrast, z of level and length, and the emphasis. buckets: r_ini, r_fin, rms."""
    own = level(words, buckets, by, id_col, bin_width)
    wide = words.select(*by, id_col, (F.col("t_ini") - F.lit(context)).alias("t_ini"), (F.col("t_fin") + F.lit(context)).alias("t_fin"))
    near = overlap_join(wide, buckets.select(*by, "r_ini", "r_fin", "rms"), by, bin_width=bin_width)
    db = 20 * F.log10(F.greatest("rms", F.lit(1e-6)))
    floor = near.groupBy(*by, id_col).agg(F.percentile(db, F.lit(0.1)).alias("local_floor_db"))
    out = words.withColumn("dur", F.col("t_fin") - F.col("t_ini")).join(own, [*by, id_col]).join(floor, [*by, id_col], "left")
    out = zscore(zscore(out, by, "level_dbfs"), by, "dur").withColumn("contrast_db", F.col("level_dbfs") - F.col("local_floor_db"))
    return out.withColumn("emphasis", emphasis(F.col("level_dbfs_z"), F.col("dur_z"), F.col("contrast_db")))
