"""Queries of the larger compositions and the remaining document rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import intervals as iv
from ..operators import sequence as sq
from ..operators import stats as st
from ..plans import review as rv
from ..plans.silence import analyse_silence, bounds_of, gate
from ..sources.timeline import EV_SQL, read, timeline
from . import fold_sql
from .document_queries import MAP_SQL, TREE_SQL, mapping, tree
from .interval_queries import BIN, BOUNDS_SQL, HOUR, UNION_SQL, clips
from .registry import query

BY = ["media_id"]


@query("declared_lanes", f"WITH {EV_SQL}, dl AS (SELECT DISTINCT media_id, 'view' AS track_id, 'declared' AS origin FROM ev) SELECT media_id, track_id, origin FROM dl UNION ALL SELECT DISTINCT media_id, track_id, 'used' FROM ev WHERE track_id <> 'view'")
def declared_lanes(spark, d):
    ev = timeline(spark, d)
    declared = ev.select("media_id").distinct().select("media_id", F.lit("view").alias("track_id"), F.lit("declared").alias("origin"))
    return dc.declared_and_used(declared, ev, BY, "track_id", {"origin": "used"})


@query("partition_errors", "WITH w AS (SELECT o_orderkey FROM orders), p AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 25 = 1) SELECT o_orderkey, 'missing' AS error FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM p) UNION ALL SELECT o_orderkey, 'extra' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM w)")
def partition_errors(spark, d):
    k = F.col("o_orderkey")
    whole = read(spark, d, "orders").select("o_orderkey")
    return dc.partition_errors(whole, whole.where(k % 10 != 3).unionByName(whole.where(k % 25 == 1)), ["o_orderkey"])


@query("outside_parent", f"WITH {TREE_SQL}, r AS (SELECT id, parent, id * 37 % 1000 AS a, id * 37 % 1000 + 10 + id % 400 AS b FROM it) SELECT c.id FROM r c WHERE c.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r p WHERE p.id = c.parent AND c.a >= p.a AND c.b <= p.b)")
def outside_parent(spark, d):
    k = F.col("id")
    items = tree(spark, d).withColumn("t_ini", k * 37 % 1000).withColumn("t_fin", F.col("t_ini") + 10 + k % 400)
    return dc.outside_parent(items, [], "id", "parent")


@query("ordered_layers", f"WITH {EV_SQL}, l AS (SELECT media_id, track_id, min(event_id) AS rank FROM ev GROUP BY 1, 2), s AS (SELECT *, CASE track_id WHEN 'view' THEN 0 WHEN 'error' THEN 1 END AS pos FROM l) SELECT media_id, track_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY pos IS NULL, pos, rank, track_id) - 1 AS INTEGER) AS place FROM s")
def ordered_layers(spark, d):
    layers = timeline(spark, d).groupBy("media_id", "track_id").agg(F.min("event_id").alias("rank"))
    saved = layers.where("track_id in ('view', 'error')").withColumn("pos", F.when(F.col("track_id") == "view", 0).otherwise(1))
    return dc.ordered_layers(layers, saved, BY, "track_id", "rank").select("media_id", "track_id", "place")


@query("hard_cuts", f"WITH {EV_SQL} SELECT media_id, t_ini FROM ev WHERE k / 100.0 > 0.6 AND value > 25")
def hard_cuts(spark, d):
    return sq.hard_cuts(timeline(spark, d).withColumn("m", F.col("k") / 100), BY, "t_ini", "m", "value")


@query(
    "gap_context",
    f"""WITH {EV_SQL}, w AS (SELECT media_id, t_ini, t_fin, track_id FROM ev), a AS (SELECT *, string_agg(track_id, ' ') OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, track_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS said FROM w),
 g AS (SELECT media_id, t_ini, t_ini + k * 60000 AS t_fin FROM ev WHERE track_id = 'signup'), b AS (SELECT media_id, t_fin AS bt, max(said) AS said FROM a GROUP BY 1, 2)
 SELECT g.media_id, g.t_ini, g.t_fin, b.said AS before_said, CASE WHEN g.t_fin - g.t_ini >= 3000000 THEN 'long' ELSE 'short' END AS kind FROM g ASOF LEFT JOIN b ON g.media_id = b.media_id AND g.t_ini >= b.bt""",
)
def gap_context(spark, d):
    ev = timeline(spark, d)
    gaps = ev.where("track_id = 'signup'").select("media_id", "t_ini", (F.col("t_ini") + F.col("k") * 60_000).alias("t_fin"))
    return sq.gap_context(gaps, ev.select("media_id", "t_ini", "t_fin", "track_id"), BY, "track_id", 4, 3_000_000).select("media_id", "t_ini", "t_fin", "before_said", "kind")


@query(
    "activity_speech",
    f"""WITH {EV_SQL}, ac AS (SELECT media_id, t_ini, t_fin FROM ev WHERE track_id = 'view'), wo AS (SELECT media_id, t_ini, t_fin FROM ev WHERE track_id = 'click'),
 s AS (SELECT * FROM ac WHERE EXISTS (SELECT 1 FROM wo WHERE wo.media_id = ac.media_id AND wo.t_ini < ac.t_fin AND wo.t_fin > ac.t_ini) UNION ALL SELECT * FROM wo WHERE NOT EXISTS (SELECT 1 FROM ac WHERE wo.media_id = ac.media_id AND wo.t_ini < ac.t_fin AND wo.t_fin > ac.t_ini)),
 o AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE t_fin > t_ini),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach + 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin) AS g FROM o) SELECT media_id, min(t_ini) AS t_ini, max(t_fin) AS t_fin FROM i GROUP BY media_id, g""",
)
def activity_speech(spark, d):
    ev = timeline(spark, d)
    return iv.speech_from_activity(ev.where("track_id = 'view'"), ev.where("track_id = 'click'"), BY, HOUR, BIN)


@query("gate_by_words", f"WITH {EV_SQL}, {BOUNDS_SQL}, w AS (SELECT media_id, t_ini - 60000 AS a, t_fin + 60000 AS b FROM ev), o AS (SELECT *, max(b) OVER (PARTITION BY media_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT media_id, a, b FROM w UNION ALL SELECT media_id, hi, NULL FROM bo)) SELECT o.media_id, coalesce(greatest(reach, 0), 0) AS t_ini, a AS t_fin FROM o WHERE a - coalesce(greatest(reach, 0), 0) >= 600000")
def gate_by_words(spark, d):
    ev = timeline(spark, d)
    return rv.gate_gaps(ev, BY, bounds_of(ev), "words", pad=60_000, min_gap=600_000)


@query(
    "gate_by_breaths",
    f"""WITH {EV_SQL}, c0 AS (SELECT media_id, t_ini + 60000 AS t_ini, t_fin - 60000 AS t_fin FROM ev WHERE track_id = 'error' AND t_fin - 60000 > t_ini + 60000),
 c1 AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c0),
 c2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin) AS i FROM c1),
 cut AS (SELECT media_id, min(t_ini) AS c_ini, max(t_fin) AS c_fin FROM c2 GROUP BY media_id, i), l AS (SELECT media_id, event_id, t_ini, t_fin FROM ev WHERE track_id = 'view' AND t_fin > t_ini),
 h AS (SELECT l.*, c_ini, c_fin FROM l JOIN cut ON l.media_id = cut.media_id AND c_ini < t_fin AND c_fin > t_ini),
 p AS (SELECT media_id, event_id, greatest(t_ini, coalesce(lag(c_fin) OVER (PARTITION BY media_id, event_id ORDER BY c_ini), t_ini)) AS a, least(c_ini, t_fin) AS b FROM h UNION ALL SELECT media_id, event_id, max(c_fin), max(t_fin) FROM h GROUP BY 1, 2
       UNION ALL SELECT media_id, event_id, t_ini, t_fin FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.event_id = l.event_id))
 SELECT media_id, a AS t_ini, b AS t_fin FROM p WHERE b > a AND b - a >= 300000""",
)
def gate_by_breaths(spark, d):
    ev = timeline(spark, d)
    breaths = ev.where("track_id = 'view'").withColumnRenamed("event_id", "breath_id")
    return rv.gate_gaps(ev.where("track_id = 'error'"), BY, bounds_of(ev), "breaths", breaths=breaths, shrink=60_000, min_gap=300_000)


@query(
    "word_levels",
    f"""WITH {EV_SQL}, b AS (SELECT media_id, t_ini AS r_ini, t_fin AS r_fin, value / 500 AS rms FROM ev), w AS (SELECT media_id, event_id, t_ini, t_fin, t_fin - t_ini AS dur FROM ev WHERE track_id = 'click'),
 l AS (SELECT w.media_id, w.event_id, 10 * log10(CASE WHEN avg(rms * rms) < 1e-12 THEN 1e-12 ELSE avg(rms * rms) END) AS lv FROM w LEFT JOIN b ON b.media_id = w.media_id AND r_ini < t_fin AND r_fin > t_ini GROUP BY 1, 2),
 f AS (SELECT w.media_id, w.event_id, quantile_cont(20 * log10(greatest(rms, 1e-6)), 0.1) AS fl FROM w JOIN b ON b.media_id = w.media_id AND r_ini < t_fin + 86400000 AND r_fin > t_ini - 86400000 GROUP BY 1, 2),
 j AS (SELECT w.media_id, w.event_id, dur, lv, fl FROM w JOIN l USING (media_id, event_id) LEFT JOIN f USING (media_id, event_id)), z AS (SELECT media_id, avg(lv) AS ml, stddev_pop(lv) AS sl, avg(dur) AS md, stddev_pop(dur) AS sd FROM j GROUP BY 1)
 SELECT media_id, event_id, round(lv, 5) AS level_dbfs, round(fl, 5) AS local_floor_db, round(lv - fl, 5) AS contrast_db, round(1 / (1 + exp(-(0.72 * (lv - ml) / CASE WHEN coalesce(sl, 0) = 0 THEN 1 ELSE sl END + 0.18 * (dur - md) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END + 0.10 * least(greatest((lv - fl) / 6, -3), 3)))), 5) AS emphasis FROM j JOIN z USING (media_id)""",
)
def word_levels(spark, d):
    ev = timeline(spark, d)
    b = ev.select("media_id", F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"), (F.col("value") / 500).alias("rms"))
    out = st.word_levels(ev.where("track_id = 'click'").select("media_id", "event_id", "t_ini", "t_fin"), b, BY, "event_id", 24 * HOUR, BIN)
    return out.select("media_id", "event_id", *(F.round(c, 5).alias(c) for c in ("level_dbfs", "local_floor_db", "contrast_db", "emphasis")))


@query(
    "silence_with_gate",
    f"""WITH {EV_SQL}, {UNION_SQL}, {BOUNDS_SQL}, e AS (SELECT media_id, t_ini, t_fin FROM un UNION ALL SELECT media_id, hi, NULL FROM bo),
 r AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
 g AS (SELECT media_id, greatest(coalesce(reach, lo), lo) AS a, least(t_ini, hi) AS b, coalesce(reach, lo) <= lo AS le, t_fin IS NULL AS tr FROM r JOIN bo USING (media_id) WHERE least(t_ini, hi) - greatest(coalesce(reach, lo), lo) >= {HOUR}),
 c AS (SELECT media_id, CASE WHEN le THEN a ELSE a + 300000 END AS t_ini, CASE WHEN tr THEN b ELSE b - 300000 END AS t_fin FROM g), f AS (SELECT * FROM c WHERE t_fin - t_ini >= 400000),
 k AS (SELECT media_id, t_ini AS x, t_fin + {2 * HOUR} AS y, value / 500 AS rms FROM ev), q AS (SELECT media_id, coalesce(quantile_cont(20 * log10(CASE WHEN rms > 1e-5 THEN rms END), 0.2), -60) AS fl FROM k GROUP BY 1),
 l AS (SELECT f.media_id, f.t_ini, f.t_fin, 10 * log10(CASE WHEN avg(rms * rms) < 1e-12 THEN 1e-12 ELSE avg(rms * rms) END) AS lv FROM f LEFT JOIN k ON k.media_id = f.media_id AND x < f.t_fin AND y > f.t_ini GROUP BY 1, 2, 3)
 SELECT media_id, 'cut-' || t_ini AS cut_id, t_ini, t_fin, NOT coalesce(lv - fl > 12 AND lv > -55, false) AS enabled, CASE WHEN coalesce(lv - fl > 12 AND lv > -55, false) THEN 0.4 ELSE 0.9 END::DOUBLE AS confidence FROM l JOIN q USING (media_id)""",
)
def silence_with_gate(spark, d):
    ev = timeline(spark, d)
    cuts = analyse_silence(ev, bounds_of(ev), HOUR, 300_000, 300_000, 400_000).withColumn("cut_id", F.concat_ws("-", F.lit("cut"), F.col("t_ini").cast("string")))
    b = ev.select("media_id", F.col("t_ini").alias("r_ini"), (F.col("t_fin") + 2 * HOUR).alias("r_fin"), (F.col("value") / 500).alias("rms"))
    return gate(cuts, b, "cut_id").select("media_id", "cut_id", "t_ini", "t_fin", "enabled", "confidence")


@query(
    "cut_view_curve",
    f"""WITH {EV_SQL}, {MAP_SQL}, m AS (SELECT e.media_id, child_ini + greatest(t_ini, source_ini) - source_ini AS a, child_ini + least(t_fin, source_fin) - source_ini AS b FROM ev e JOIN mp ON e.media_id = mp.media_id AND source_ini < t_fin AND source_fin > t_ini),
 c AS (SELECT media_id, unnest(range(a // 1800000, greatest(a, b - 1) // 1800000 + 1)) AS cell FROM m) SELECT media_id, cell, count(*) AS n FROM c GROUP BY 1, 2""",
)
def cut_view_curve(spark, d):
    ev = timeline(spark, d)
    return rv.cut_view(ev, mapping(ev), BY, "track_id", "event_id", "value", 1_800_000, BIN)["curve"].select("media_id", F.col("cell").cast("long").alias("cell"), "n")


@query("labels_at", f"WITH {EV_SQL}, h AS (SELECT a.event_id, b.track_id, min(b.t_ini) AS f FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.track_id = 'purchase' AND b.track_id <> 'purchase' AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini GROUP BY 1, 2), g AS (SELECT event_id, string_agg(track_id, ', ' ORDER BY f, track_id) AS labels FROM h GROUP BY 1) SELECT e.media_id, e.event_id, coalesce(labels, '') AS labels FROM ev e LEFT JOIN g USING (event_id) WHERE e.track_id = 'purchase'")
def labels_at(spark, d):
    ev = timeline(spark, d)
    return rv.labels_at(ev.where("track_id = 'purchase'"), ev.where("track_id <> 'purchase'"), BY, "event_id", "track_id", BIN)


@query("text_inside", f"WITH {EV_SQL}, h AS (SELECT a.event_id, string_agg(CAST(b.k AS VARCHAR), ' ' ORDER BY b.t_ini, b.t_fin, CAST(b.k AS VARCHAR)) AS said, count(*) AS n FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.track_id = 'purchase' AND b.track_id = 'view' AND b.t_ini >= a.t_ini AND b.t_fin <= a.t_fin AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini GROUP BY 1) SELECT e.media_id, e.event_id, said, n FROM ev e LEFT JOIN h USING (event_id) WHERE e.track_id = 'purchase'")
def text_inside(spark, d):
    ev = timeline(spark, d).withColumn("w", F.col("k").cast("string"))
    return rv.text_inside(ev.where("track_id = 'purchase'"), ev.where("track_id = 'view'"), BY, "event_id", "w", True, BIN)


@query("timeline_xml", f"WITH {EV_SQL} SELECT media_id, event_id, '<asset-clip ref=\"r1\" offset=\"' || ((t_ini * 25 + 500) // 1000) || '/25s\" start=\"' || ((event_id * 1000 * 25 + 500) // 1000) || '/25s\" duration=\"' || (((t_fin - t_ini) * 25 + 500) // 1000) || '/25s\"/>' AS element FROM ev")
def timeline_xml(spark, d):
    c = clips(timeline(spark, d)).withColumn("source_fin", F.col("source_ini") + F.col("seq_fin") - F.col("seq_ini")).withColumn("pos", F.col("clip_id"))
    return rv.timeline_xml(c, BY, 25).withColumnRenamed("pos", "event_id")


@query("snapped_proposal", fold_sql.SNAPPED_PROPOSAL)
def snapped_proposal(spark, d):
    ev = timeline(spark, d)
    proposal = ev.where("track_id = 'purchase'").select("media_id", "event_id", "t_ini", "t_fin")
    return dc.snapped_proposal(proposal, ev.where("track_id = 'view'"), ev.where("track_id = 'click'"), BY, "event_id", 2 * HOUR, 1, HOUR, HOUR, 12 * HOUR)
