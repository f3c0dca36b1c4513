"""Queries of the sequence and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as sq
from ..operators import stats as st
from ..sources.timeline import EV_SQL, timeline
from . import fold_sql
from .registry import query

HOUR = 3_600_000
BIN = 12 * HOUR
BY = ["media_id"]

#: Samples: every event is one sample of its track's curve; value 0 to 9 of k stands for absent.
SA_SQL = "sa AS (SELECT media_id, event_id, t_ini AS t, CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS x, value FROM ev)"


def samples(ev):
    return ev.select("media_id", "event_id", F.col("t_ini").alias("t"), F.when(F.col("k") % 10 != 0, F.col("k").cast("double")).alias("x"), "value")


@query(
    "pause_extraction",
    f"""WITH {EV_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id) AS n FROM ev),
 p AS (SELECT *, max(t_fin) OVER w AS reach, arg_max(track_id, t_fin * 1000000 - n) OVER w AS prev_text FROM o WINDOW w AS (PARTITION BY media_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 g AS (SELECT media_id, coalesce(reach, 0) AS g_ini, t_ini AS g_fin, t_ini - coalesce(reach, 0) AS dur, prev_text, track_id AS next_text FROM p WHERE t_ini - coalesce(reach, 0) >= 600000),
 z AS (SELECT media_id, avg(dur) AS mu, stddev_pop(dur) AS sd FROM g GROUP BY 1)
 SELECT media_id, g_ini, g_fin, dur, prev_text, next_text, false AS ends_sentence, round((dur - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 6) AS dur_z FROM g JOIN z USING (media_id)""",
)
def pause_extraction(spark, d):
    out = sq.pauses(timeline(spark, d), BY, "track_id", 600_000, order=["event_id"])
    return out.select("media_id", "g_ini", "g_fin", "dur", "prev_text", "next_text", "ends_sentence", F.round("dur_z", 6).alias("dur_z"))


@query(
    "sessionize_gap",
    f"""WITH {EV_SQL}, s AS (SELECT *, CASE WHEN t_ini - lag(t_ini) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) > 21600000 OR lag(t_ini) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) IS NULL THEN 1 ELSE 0 END AS b FROM ev),
 n AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS session FROM s) SELECT media_id, CAST(session AS BIGINT) AS session, min(t_ini) AS t_first, max(t_ini) AS t_last, count(*) AS n FROM n GROUP BY 1, 2""",
)
def sessionize_gap(spark, d):
    s = sq.sessions(timeline(spark, d), BY, "t_ini", 6 * HOUR, ["event_id"])
    return s.groupBy("media_id", "session").agg(F.min("t_ini").alias("t_first"), F.max("t_ini").alias("t_last"), F.count("*").alias("n"))


REGION_SQL = """r0 AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE t_fin > t_ini),
 r1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach + 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id) AS i FROM r0),
 r2 AS (SELECT media_id, greatest(0, min(t_ini) - 1800000) AS t_ini, max(t_fin) + 1800000 AS t_fin FROM r1 GROUP BY media_id, i),
 r3 AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r2),
 r4 AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin) AS i FROM r3),
 re AS (SELECT media_id, min(t_ini) AS t_ini, max(t_fin) AS t_fin FROM r4 GROUP BY media_id, i)"""


@query("speech_regions", f"WITH {EV_SQL}, {REGION_SQL} SELECT * FROM re")
def speech_regions(spark, d):
    return sq.speech_regions(timeline(spark, d), BY, HOUR, HOUR // 2)


@query(
    "hop_windows",
    f"WITH {EV_SQL}, {REGION_SQL}, x AS (SELECT DISTINCT media_id, unnest(range(t_ini // 7200000, greatest(t_ini // 7200000, (t_fin + 7199999) // 7200000 - 1) + 1)) AS k FROM re) SELECT media_id, k, k * 7200000 AS w_ini FROM x",
)
def hop_windows(spark, d):
    return sq.hop_windows(sq.speech_regions(timeline(spark, d), BY, HOUR, HOUR // 2), BY, 2 * HOUR).withColumn("k", F.col("k").cast("long"))


@query(
    "split_long_spans",
    f"WITH {EV_SQL}, s AS (SELECT media_id, event_id, t_ini, t_fin, unnest(range(0, greatest(1, (t_fin - t_ini - 1800000 + 12599999) // 12600000))) AS part FROM ev WHERE t_fin > t_ini) SELECT media_id, event_id, CAST(part AS BIGINT) AS part, t_ini + part * 12600000 AS p_ini, least(t_ini + part * 12600000 + 14400000, t_fin) AS p_fin FROM s",
)
def split_long_spans(spark, d):
    out = sq.split_long(timeline(spark, d), BY, 4 * HOUR, HOUR // 2)
    return out.select("media_id", "event_id", F.col("part").cast("long").alias("part"), "p_ini", "p_fin")


@query(
    "repeat_filter",
    f"""WITH {EV_SQL}, o AS (SELECT *, CASE WHEN track_id = lag(track_id) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) THEN 0 ELSE 1 END AS b FROM ev),
 r AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS run FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY media_id, run ORDER BY t_ini, event_id) AS repeat_no FROM r)
 SELECT media_id, event_id, track_id, CAST(repeat_no AS INTEGER) AS repeat_no FROM n WHERE repeat_no <= 2 AND value >= 5""",
)
def repeat_filter(spark, d):
    return sq.repeat_filter(timeline(spark, d), BY, "t_ini", "track_id", "value", 5.0, 2, ["event_id"]).select("media_id", "event_id", "track_id", "repeat_no")


@query(
    "label_runs",
    f"""WITH {EV_SQL}, o AS (SELECT *, CASE WHEN track_id = lag(track_id) OVER w AND t_ini - lag(t_ini) OVER w <= 43200000 THEN 0 ELSE 1 END AS b FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini, event_id)),
 r AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS run FROM o) SELECT media_id, CAST(run AS BIGINT) AS run, min(track_id) AS track_id, min(t_ini) AS t_ini, max(t_ini) AS t_fin, count(*) AS n FROM r GROUP BY 1, 2""",
)
def label_runs(spark, d):
    return sq.runs(timeline(spark, d).drop("t_fin").withColumnRenamed("t_ini", "t"), BY, "t", "track_id", 12 * HOUR, ["event_id"])


@query(
    "label_spans",
    f"""WITH {EV_SQL}, o AS (SELECT *, CASE WHEN track_id = lag(track_id) OVER w AND t_ini - lag(t_ini) OVER w <= 43200000 THEN 0 ELSE 1 END AS b FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini, event_id)),
 r AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS run FROM o), s AS (SELECT media_id, run, min(track_id) AS track_id, min(t_ini) AS a, max(t_ini) AS b FROM r GROUP BY 1, 2),
 m AS (SELECT *, max(b) OVER (PARTITION BY media_id, track_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, track_id ORDER BY a, b) AS g FROM m)
 SELECT media_id, track_id, min(a) AS t_ini, max(b) AS t_fin FROM i GROUP BY media_id, track_id, g HAVING max(b) - min(a) >= 3600000""",
)
def label_spans(spark, d):
    ev = timeline(spark, d).drop("t_fin").withColumnRenamed("t_ini", "t")
    return sq.label_spans(ev, BY, "t", "track_id", 12 * HOUR, 24 * HOUR, HOUR, ["event_id"])


@query(
    "hysteresis_regions",
    f"""WITH {EV_SQL}, {SA_SQL}, g AS (SELECT *, coalesce(x > 40, false) AS go, coalesce(t - lag(t) OVER w > 172800000, false) OR lag(x) OVER w IS NULL AS hole, coalesce(lag(coalesce(x > 40, false)) OVER w, false) AS was, lead(t) OVER w AS nt, lead(x) OVER w AS nx FROM sa WINDOW w AS (PARTITION BY media_id ORDER BY t)),
 r AS (SELECT *, sum(CASE WHEN NOT was OR hole THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t) AS run FROM g),
 l AS (SELECT *, min(CASE WHEN x >= 70 AND value >= 10 THEN t END) OVER (PARTITION BY media_id, run) AS since FROM r WHERE go),
 s AS (SELECT media_id, run, min(t) AS a, max(t) AS b, max(x) AS z, arg_max(t, x * 1e12 - t) AS tp, max(value) AS v, count(*) AS n, arg_max(coalesce(nt IS NOT NULL AND (nx IS NULL OR nt - t > 172800000), false), t) AS h FROM l WHERE t >= since GROUP BY 1, 2),
 q AS (SELECT *, CASE WHEN coalesce(lag(h) OVER w OR a - lag(b) OVER w > 43200000, true) THEN 1 ELSE 0 END AS apart FROM s WINDOW w AS (PARTITION BY media_id ORDER BY a)),
 i AS (SELECT *, sum(apart) OVER (PARTITION BY media_id ORDER BY a) AS region FROM q)
 SELECT media_id, min(a) AS t_ini, max(b) AS t_fin, arg_max(tp, z * 1e12 - tp) AS t_peak, max(z) AS z_max, max(v) AS value_max, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY media_id, region HAVING max(b) - min(a) >= 3600000""",
)
def hysteresis_regions(spark, d):
    return sq.hysteresis(samples(timeline(spark, d)), BY, "t", "x", "value", 70, 40, 10, 48 * HOUR, 12 * HOUR, HOUR)


@query(
    "episodes",
    f"""WITH {EV_SQL}, o AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE value > 60),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach + 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id) AS g FROM o)
 SELECT media_id, min(t_ini) AS t_ini, max(t_fin) AS t_fin, max(value) AS z_max, count(*) AS n, string_agg(track_id, '>' ORDER BY event_id, track_id) AS apexes FROM i GROUP BY media_id, g""",
)
def episodes(spark, d):
    return sq.episodes(timeline(spark, d).where("value > 60"), BY, HOUR, "event_id", "track_id", "value")


@query(
    "peak_clusters",
    f"""WITH {EV_SQL}, c AS (SELECT *, cume_dist() OVER (PARTITION BY track_id ORDER BY value) AS rank FROM ev), p AS (SELECT * FROM c WHERE value >= 80),
 s AS (SELECT *, CASE WHEN t_ini - lag(t_ini) OVER w <= 10800000 THEN 0 ELSE 1 END AS b FROM p WINDOW w AS (PARTITION BY media_id ORDER BY t_ini, event_id)),
 n AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS session FROM s)
 SELECT media_id, CAST(session AS BIGINT) AS session, min(t_ini) AS t_first, max(t_ini) AS t_last, count(*) AS n, count(DISTINCT track_id) AS kinds, count(DISTINCT track_id) >= 2 AS multi FROM n GROUP BY 1, 2""",
)
def peak_clusters(spark, d):
    pool = st.ranked_pool(timeline(spark, d), ["track_id"], "value", 80)
    return sq.peak_clusters(pool, BY, "t_ini", 3 * HOUR, "track_id", ["event_id"])


@query(
    "derivative",
    f"WITH {EV_SQL}, {SA_SQL} SELECT media_id, t, round(CASE WHEN t - lag(t) OVER w > 0 AND t - lag(t) OVER w <= 43200000 THEN abs(x - lag(x) OVER w) / (t - lag(t) OVER w) END * 1000000, 6) AS speed FROM sa WINDOW w AS (PARTITION BY media_id ORDER BY t)",
)
def derivative(spark, d):
    return sq.derivative(samples(timeline(spark, d)), BY, "t", "x", 12 * HOUR).select("media_id", "t", F.round(F.col("speed") * 1_000_000, 6).alias("speed"))


@query(
    "median_smoothing",
    f"WITH {EV_SQL}, {SA_SQL} SELECT media_id, t, CASE WHEN x IS NOT NULL THEN median(x) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS smooth FROM sa",
)
def median_smoothing(spark, d):
    return sq.median_smooth(samples(timeline(spark, d)), BY, "t", "x", 1).select("media_id", "t", "smooth")


@query(
    "bridge_holes",
    f"""WITH {EV_SQL}, {SA_SQL}, c AS (SELECT *, count(x) OVER (PARTITION BY media_id ORDER BY t) AS k FROM sa),
 h AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, k) AS hole, max(t) FILTER (x IS NOT NULL) OVER (PARTITION BY media_id ORDER BY t) AS pt, min(t) FILTER (x IS NOT NULL) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ft FROM c)
 SELECT h.media_id, h.t, round(coalesce(h.x, CASE WHEN hole <= 2 THEN p.x + (f.x - p.x) * (h.t - pt) / (ft - pt) END), 6) AS bridged FROM h LEFT JOIN sa p ON p.media_id = h.media_id AND p.t = pt LEFT JOIN sa f ON f.media_id = h.media_id AND f.t = ft""",
)
def bridge_holes(spark, d):
    return sq.bridge_holes(samples(timeline(spark, d)), BY, "t", "x", 2).select("media_id", "t", F.round("bridged", 6).alias("bridged"))


@query(
    "novelty_peaks",
    f"""WITH {EV_SQL}, {SA_SQL}, n AS (SELECT media_id, t, abs(avg(value) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) - avg(value) OVER (PARTITION BY media_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS novelty FROM sa),
 p AS (SELECT *, lag(novelty) OVER (PARTITION BY media_id ORDER BY t) AS a, lead(novelty) OVER (PARTITION BY media_id ORDER BY t) AS b FROM n WHERE novelty IS NOT NULL)
 SELECT media_id, t, round(novelty, 6) AS novelty FROM p WHERE novelty > coalesce(a, -1e300) AND novelty >= coalesce(b, -1e300) AND novelty >= 20""",
)
def novelty_peaks(spark, d):
    curve = sq.novelty(samples(timeline(spark, d)), BY, "t", "value", 5).where("novelty is not null")
    return sq.local_peaks(curve, BY, "t", "novelty", 20).select("media_id", "t", F.round("novelty", 6).alias("novelty"))


@query("separated_peaks", fold_sql.SEPARATED_PEAKS)
def separated_peaks(spark, d):
    return sq.separated_peaks(samples(timeline(spark, d)), BY, "t", "value", 12 * HOUR, 30.0)


@query("prominent_peaks", fold_sql.PROMINENT_PEAKS)
def prominent_peaks(spark, d):
    return sq.prominent_peaks(samples(timeline(spark, d)), BY, "t", "value", 50.0).withColumn("prominence", F.round("prominence", 6))


@query("presence_absences", fold_sql.PRESENCE_ABSENCES)
def presence_absences(spark, d):
    ev = timeline(spark, d).withColumn("present", F.col("track_id") != "error")
    return sq.absences(ev.select("media_id", F.col("t_ini").alias("t"), "present"), BY, "t", "present", 2 * HOUR)


@query("pairwise_merge", fold_sql.PAIRWISE_MERGE)
def pairwise_merge(spark, d):
    ev = timeline(spark, d).withColumn("mean", F.col("value") / 2)
    return sq.merge_pairwise(ev, BY, HOUR, HOUR // 2, "value", "mean").withColumn("mean", F.round(F.col("mean") + 1e-9, 6))  # ties of the last digit go up in both engines


@query("wake_spans", fold_sql.WAKE_SPANS)
def wake_spans(spark, d):
    return sq.wake_spans(timeline(spark, d), BY, "track_id", {"signup"}, 12 * HOUR, 72 * HOUR, 2 * HOUR, slice_width=72 * HOUR)


@query(
    "zscore_pop",
    f"WITH {EV_SQL}, z AS (SELECT track_id, avg(value) AS mu, stddev_pop(value) AS sd FROM ev GROUP BY 1) SELECT event_id, track_id, round((value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z FROM ev JOIN z USING (track_id)",
)
def zscore_pop(spark, d):
    return st.zscore(timeline(spark, d), ["track_id"], "value").select("event_id", "track_id", F.round("value_z", 5).alias("z"))


@query(
    "robust_z_mad",
    f"WITH {EV_SQL}, m AS (SELECT track_id, median(value) AS med, mad(value) AS mad, quantile_cont(value, 0.95) AS p95 FROM ev GROUP BY 1) SELECT event_id, round((value - med) / greatest(1.4826 * mad, 0.5), 5) AS rz, round(p95, 5) AS p95 FROM ev JOIN m USING (track_id)",
)
def robust_z_mad(spark, d):
    return st.robust_z(timeline(spark, d), ["track_id"], "value", 0.5).select("event_id", F.round("value_rz", 5).alias("rz"), F.round("p95", 5).alias("p95"))


@query(
    "percentile_tiers",
    f"WITH {EV_SQL}, q AS (SELECT media_id, quantile_cont(value, 0.8) AS p80, quantile_cont(value, 0.95) AS p95, count(*) AS n FROM ev WHERE track_id = 'view' GROUP BY 1) SELECT event_id, CASE WHEN n < 5 THEN 1 WHEN value >= p95 THEN 3 WHEN value >= p80 THEN 2 ELSE 1 END AS tier FROM ev JOIN q USING (media_id) WHERE track_id = 'view'",
)
def percentile_tiers(spark, d):
    return st.tiers(timeline(spark, d).where("track_id = 'view'"), BY, "value").select("event_id", "tier")


@query("cume_dist_rank", f"WITH {EV_SQL}, r AS (SELECT event_id, value, cume_dist() OVER (PARTITION BY track_id ORDER BY value) AS rank FROM ev) SELECT event_id, round(rank, 9) AS rank FROM r WHERE value >= 50")
def cume_dist_rank(spark, d):
    return st.ranked_pool(timeline(spark, d), ["track_id"], "value", 50).select("event_id", F.round("rank", 9).alias("rank"))


@query(
    "upper_median",
    f"WITH {EV_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t_ini DESC, event_id DESC) AS r FROM ev), k AS (SELECT media_id, value, row_number() OVER (PARTITION BY media_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM l WHERE r <= 20) SELECT media_id, value AS upper_median, n FROM k WHERE i = n // 2",
)
def upper_median(spark, d):
    return st.upper_median(timeline(spark, d), BY, "value", [F.desc("t_ini"), F.desc("event_id")], 20)


@query(
    "bucket_envelope",
    f"""WITH {EV_SQL}, s AS (SELECT media_id, t_ini * 200 // 2600000000 AS bucket, value - 50 AS v FROM ev), b AS (SELECT media_id, bucket, min(v) AS lo, max(v) AS hi, sqrt(avg(v * v)) AS r, count(*) AS n FROM s GROUP BY 1, 2),
 g AS (SELECT DISTINCT media_id, unnest(range(0, 200)) AS bucket FROM s) SELECT g.media_id, g.bucket, round(coalesce(lo, 0), 6) AS v_min, round(coalesce(hi, 0), 6) AS v_max, round(coalesce(r, 0), 6) AS rms, coalesce(n, 0) AS n FROM g LEFT JOIN b USING (media_id, bucket)""",
)
def bucket_envelope(spark, d):
    s = timeline(spark, d).select("media_id", "t_ini", (F.col("value") - 50).alias("v"), F.lit(2_600_000_000).alias("total"))
    out = st.envelope(s, BY, "t_ini", "v", "total", 200)
    return out.select("media_id", "bucket", *(F.round(c, 6).alias(c) for c in ("v_min", "v_max", "rms")), "n")


@query(
    "noise_floor_level",
    f"""WITH {EV_SQL}, b AS (SELECT media_id, t_ini AS r_ini, t_fin AS r_fin, value / 500 AS rms FROM ev WHERE track_id <> 'error'), f AS (SELECT media_id, coalesce(quantile_cont(20 * log10(CASE WHEN rms > 1e-5 THEN rms END), 0.2), -60) AS fl FROM b GROUP BY 1),
 l AS (SELECT g.media_id, g.event_id, 10 * log10(CASE WHEN avg(rms * rms) < 1e-12 THEN 1e-12 ELSE avg(rms * rms) END) AS lv FROM ev g LEFT JOIN b ON b.media_id = g.media_id AND r_ini < g.t_fin AND r_fin > g.t_ini WHERE g.track_id = 'error' GROUP BY 1, 2)
 SELECT l.media_id, event_id, round(lv, 5) AS level_dbfs, round(fl, 5) AS floor_dbfs FROM l JOIN f USING (media_id)""",
)
def noise_floor_level(spark, d):
    ev = timeline(spark, d)
    b = ev.where("track_id <> 'error'").select("media_id", F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), (F.col("value") / 500).alias("rms"))
    out = st.level(ev.where("track_id = 'error'"), b, BY, "event_id", BIN).join(st.noise_floor(b, BY), BY)
    return out.select("media_id", "event_id", F.round("level_dbfs", 5).alias("level_dbfs"), F.round("floor_dbfs", 5).alias("floor_dbfs"))


@query(
    "intensity_curve",
    f"WITH {EV_SQL}, c AS (SELECT media_id, value, unnest(range(t_ini // 86400000, greatest(t_ini, t_fin - 1) // 86400000 + 1)) AS cell FROM ev) SELECT media_id, cell, count(*) AS n, max(value) AS peak FROM c GROUP BY 1, 2",
)
def intensity_curve(spark, d):
    return st.curve(timeline(spark, d), BY, "value", 24 * HOUR).withColumn("cell", F.col("cell").cast("long"))


@query(
    "chunk_signal_summary",
    f"""WITH {EV_SQL}, ch AS (SELECT DISTINCT media_id, c AS chunk_no, c * 259200000 AS a, (c + 1) * 259200000 AS b FROM ev, range(0, 10) t(c))
 SELECT ch.media_id, CAST(chunk_no AS INTEGER) AS chunk_no, track_id, count(*) AS n, max(value) AS peak, CAST(sum(least(t_fin, b) - greatest(t_ini, a)) AS BIGINT) AS shared FROM ch JOIN ev ON ev.media_id = ch.media_id AND t_ini < b AND t_fin > a GROUP BY 1, 2, 3""",
)
def chunk_signal_summary(spark, d):
    ev = timeline(spark, d)
    ch = ev.select("media_id").distinct().withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.lit(9))))
    ch = ch.withColumn("t_ini", F.col("chunk_no").cast("long") * 72 * HOUR).withColumn("t_fin", F.col("t_ini") + 72 * HOUR)
    return st.span_summary(ch, ev, BY, "chunk_no", "track_id", "value", 72 * HOUR)


@query(
    "activity_by_time",
    f"WITH {EV_SQL}, z AS (SELECT media_id, track_id, t_ini // 86400000 AS day, least(greatest((value - 50) / 20 / 8, 0), 1) AS a FROM ev), g AS (SELECT media_id, day, track_id, max(a) AS a FROM z GROUP BY 1, 2, 3) SELECT media_id, day, round(avg(a), 8) AS activity FROM g GROUP BY 1, 2",
)
def activity_by_time(spark, d):
    s = timeline(spark, d).select("media_id", "track_id", F.floor(F.col("t_ini") / (24 * HOUR)).alias("day"), ((F.col("value") - 50) / 20).alias("z"))
    return st.activity(s, ["media_id", "day"], "value", "track_id", "z").withColumn("activity", F.round("activity", 8))


@query(
    "emphasis_score",
    f"WITH {EV_SQL} SELECT event_id, round(1 / (1 + exp(-(0.72 * (value - 50) / 50 + 0.18 * (k - 50) / 30.0 + 0.10 * least(greatest((value - k) / 6, -3), 3)))), 6) AS emphasis FROM ev",
)
def emphasis_score(spark, d):
    v, k = F.col("value"), F.col("k")
    return timeline(spark, d).select("event_id", F.round(st.emphasis((v - 50) / 50, (k - 50) / 30, v - k), 6).alias("emphasis"))


@query(
    "stream_inventory",
    f"WITH {EV_SQL} SELECT track_id, count(*) AS n, round(count(*) / ((max(t_fin) - min(t_ini)) / 3600000.0), 6) AS per_hour, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.8), 6) AS p80, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (t_fin <= t_ini) AS anomalies FROM ev GROUP BY 1",
)
def stream_inventory(spark, d):
    ev = timeline(spark, d)
    rate = ev.groupBy("track_id").agg((F.count("*") / ((F.max("t_fin") - F.min("t_ini")) / HOUR)).alias("per_hour"), F.count_if(F.col("t_fin") <= F.col("t_ini")).alias("anomalies"))
    out = st.percentiles(ev, ["track_id"], "value").join(rate, "track_id")
    return out.select("track_id", "n", *(F.round(c, 6).alias(c) for c in ("per_hour", "p50", "p80", "p95")), "anomalies")


@query(
    "median_box",
    "SELECT label, round(median(embedding[1]) - 0.15 * median(embedding[3]), 6) AS x, round(median(embedding[2]) - 0.15 * median(embedding[4]), 6) AS y, round(median(embedding[3]) * 1.3, 6) AS w, round(median(embedding[4]) * 1.3, 6) AS h FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) GROUP BY label",
)
def median_box(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xywh")))
    return st.median_box(e, ["label"]).select("label", *(F.round(c, 6).alias(c) for c in "xywh"))
