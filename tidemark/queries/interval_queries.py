"""Queries of the interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import joins as jn
from ..plans.silence import analyse_silence, bounds_of
from ..sources.timeline import EV_SQL, timeline
from .registry import query

HOUR = 3_600_000
BIN = 12 * HOUR

UNION_SQL = """m0 AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev WHERE t_fin > t_ini),
m1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id) AS island FROM m0),
un AS (SELECT media_id, min(t_ini) AS t_ini, max(t_fin) AS t_fin, count(*) AS n_parts FROM m1 GROUP BY media_id, island)"""
BOUNDS_SQL = "bo AS (SELECT media_id, 0 AS lo, max(t_fin) + 3600000 AS hi FROM ev GROUP BY media_id)"


@query("interval_union", f"WITH {EV_SQL}, {UNION_SQL} SELECT * FROM un")
def interval_union(spark, d):
    return iv.union(timeline(spark, d), ["media_id"])


@query("interval_union_sliced", f"WITH {EV_SQL}, {UNION_SQL} SELECT * FROM un")
def interval_union_sliced(spark, d):
    return iv.union(timeline(spark, d), ["media_id"], slice_width=5 * 24 * HOUR)


@query(
    "interval_complement",
    f"""WITH {EV_SQL}, {UNION_SQL}, {BOUNDS_SQL},
 e AS (SELECT media_id, t_ini, t_fin FROM un UNION ALL SELECT media_id, hi, NULL FROM bo),
 r AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
 SELECT media_id, greatest(coalesce(reach, lo), lo) AS t_ini, least(t_ini, hi) AS t_fin, coalesce(reach, lo) <= lo AS "leading", t_fin IS NULL AS "trailing"
 FROM r JOIN bo USING (media_id) WHERE least(t_ini, hi) > greatest(coalesce(reach, lo), lo) AND least(t_ini, hi) - greatest(coalesce(reach, lo), lo) >= {HOUR}""",
)
def interval_complement(spark, d):
    ev = timeline(spark, d)
    return iv.complement(iv.union(ev, ["media_id"]), ["media_id"], bounds_of(ev), HOUR)


ERR_SQL = """c0 AS (SELECT media_id, t_ini, t_fin, event_id FROM ev WHERE track_id = 'error' AND t_fin > t_ini),
c1 AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c0),
c2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini > reach THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id) AS i FROM c1),
cut AS (SELECT media_id, min(t_ini) AS c_ini, max(t_fin) AS c_fin FROM c2 GROUP BY media_id, i)"""


@query(
    "interval_difference",
    f"""WITH {EV_SQL}, {ERR_SQL}, l AS (SELECT media_id, event_id, t_ini, t_fin FROM ev WHERE track_id = 'view' AND t_fin > t_ini),
 h AS (SELECT l.*, c_ini, c_fin FROM l JOIN cut ON l.media_id = cut.media_id AND c_ini < t_fin AND c_fin > t_ini),
 p AS (SELECT media_id, event_id, greatest(t_ini, coalesce(lag(c_fin) OVER (PARTITION BY media_id, event_id ORDER BY c_ini), t_ini)) AS a, least(c_ini, t_fin) AS b FROM h
       UNION ALL SELECT media_id, event_id, max(c_fin), max(t_fin) FROM h GROUP BY 1, 2
       UNION ALL SELECT media_id, event_id, t_ini, t_fin FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.media_id = l.media_id AND h.event_id = l.event_id))
 SELECT media_id, event_id, a AS t_ini, b AS t_fin FROM p WHERE b > a AND b - a >= 60000""",
)
def interval_difference(spark, d):
    ev = timeline(spark, d)
    views = ev.where("track_id = 'view'").select("media_id", "event_id", "t_ini", "t_fin")
    return iv.difference(views, ev.where("track_id = 'error'"), ["media_id"], "event_id", 60_000, BIN)


@query(
    "kept_segments",
    f"""WITH {EV_SQL}, {ERR_SQL}, {BOUNDS_SQL},
 e AS (SELECT media_id, c_ini AS t_ini, c_fin AS t_fin FROM cut UNION ALL SELECT media_id, hi, NULL FROM bo),
 r AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
 SELECT media_id, coalesce(reach, 0) AS t_ini, t_ini AS t_fin FROM r WHERE t_ini - coalesce(reach, 0) >= 600000""",
)
def kept(spark, d):
    ev = timeline(spark, d)
    return iv.kept_segments(ev.where("track_id = 'error'"), ["media_id"], bounds_of(ev), 600_000)


@query(
    "coverage_measure",
    f"WITH {EV_SQL}, {UNION_SQL}, {BOUNDS_SQL} SELECT media_id, CAST(sum(greatest(0, least(t_fin, hi) - greatest(t_ini, lo))) AS BIGINT) AS covered, max(hi) - max(lo) AS span FROM bo JOIN un USING (media_id) GROUP BY media_id",
)
def coverage_measure(spark, d):
    ev = timeline(spark, d)
    return iv.covered(iv.union(ev, ["media_id"]), ["media_id"], bounds_of(ev))


@query(
    "elementary_intervals",
    f"WITH {EV_SQL}, x AS (SELECT media_id, t_ini AS a FROM ev WHERE track_id = 'purchase' UNION SELECT media_id, t_fin FROM ev WHERE track_id = 'purchase'), y AS (SELECT media_id, a, lead(a) OVER (PARTITION BY media_id ORDER BY a) AS b FROM x) SELECT * FROM y WHERE b IS NOT NULL",
)
def elementary_intervals(spark, d):
    return iv.elementary(timeline(spark, d).where("track_id = 'purchase'"), ["media_id"])


def clips(ev):
    """Events as clips of a montage: the track's rank is the position of its name."""
    rank = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("track_id"))
    return ev.select("media_id", F.col("event_id").alias("clip_id"), rank.alias("rank"), F.col("t_ini").alias("seq_ini"), F.col("t_fin").alias("seq_fin"), (F.col("event_id") * 1000).alias("source_ini"))


@query(
    "flatten_top_track",
    f"""WITH {EV_SQL}, cl AS (SELECT media_id, event_id AS clip_id, list_position(['click','error','purchase','signup','view'], track_id) AS rank, t_ini AS seq_ini, t_fin AS seq_fin, event_id * 1000 AS source_ini FROM ev WHERE t_fin > t_ini),
 x AS (SELECT media_id, seq_ini AS a FROM cl UNION SELECT media_id, seq_fin FROM cl), y AS (SELECT media_id, a, lead(a) OVER (PARTITION BY media_id ORDER BY a) AS b FROM x),
 o AS (SELECT y.media_id, a, b, clip_id, source_ini + a - seq_ini AS s, row_number() OVER (PARTITION BY y.media_id, a ORDER BY rank DESC, clip_id) AS r FROM y JOIN cl ON y.media_id = cl.media_id AND seq_ini < b AND seq_fin > a),
 t AS (SELECT *, CASE WHEN lag(clip_id) OVER w = clip_id AND lag(b) OVER w = a THEN 0 ELSE 1 END AS n FROM o WHERE r = 1 WINDOW w AS (PARTITION BY media_id ORDER BY a)),
 u AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY a) AS run FROM t),
 g AS (SELECT media_id, run, clip_id, min(a) AS a, max(b) AS b, min(s) AS source_ini FROM u GROUP BY 1, 2, 3),
 k AS (SELECT *, CAST(coalesce(sum(b - a) OVER (PARTITION BY media_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq_ini, row_number() OVER (PARTITION BY media_id ORDER BY run) - 1 AS pos FROM g)
 SELECT media_id, CAST(pos AS INTEGER) AS pos, clip_id, seq_ini, seq_ini + b - a AS seq_fin, source_ini, source_ini + b - a AS source_fin FROM k""",
)
def flatten_top_track(spark, d):
    return iv.flatten(clips(timeline(spark, d)), ["media_id"], "rank", bin_width=BIN)


@query(
    "range_subtract",
    f"""WITH {EV_SQL}, x AS (SELECT media_id, event_id, t_ini, t_fin FROM ev)
 SELECT media_id, event_id, t_ini, t_fin FROM x WHERE NOT (t_ini < 900000000 AND t_fin > 864000000)
 UNION ALL SELECT media_id, event_id, t_ini, 864000000 FROM x WHERE t_ini < 900000000 AND t_fin > 864000000 AND 864000000 - t_ini >= 60000
 UNION ALL SELECT media_id, event_id, 900000000, t_fin FROM x WHERE t_ini < 900000000 AND t_fin > 864000000 AND t_fin - 900000000 >= 60000""",
)
def range_subtract(spark, d):
    ev = timeline(spark, d).select("media_id", "event_id", "t_ini", "t_fin")
    return iv.subtract_range(ev, ["media_id", "event_id"], 864_000_000, 900_000_000, 60_000)


@query(
    "range_add",
    f"""WITH {EV_SQL}, {UNION_SQL} SELECT media_id, t_ini, t_fin FROM un WHERE NOT (t_ini < 900000000 AND t_fin > 864000000)
 UNION ALL SELECT media_id, least(864000000, min(CASE WHEN t_ini < 900000000 AND t_fin > 864000000 THEN t_ini END)), greatest(900000000, max(CASE WHEN t_ini < 900000000 AND t_fin > 864000000 THEN t_fin END)) FROM un GROUP BY media_id""",
)
def range_add(spark, d):
    return iv.add_range(iv.union(timeline(spark, d), ["media_id"]), ["media_id"], 864_000_000, 900_000_000)


@query("edge_times", f"WITH {EV_SQL} SELECT media_id, t_ini AS t FROM ev UNION SELECT media_id, t_fin FROM ev")
def edge_times(spark, d):
    return iv.edges(timeline(spark, d), ["media_id"])


@query(
    "overlap_join",
    f"WITH {EV_SQL} SELECT a.media_id, a.event_id, b.event_id AS other_id, least(a.t_fin, b.t_fin) - greatest(a.t_ini, b.t_ini) AS shared FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.track_id = 'purchase' AND b.track_id = 'view' AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini",
)
def overlap_join(spark, d):
    ev = timeline(spark, d)
    left = ev.where("track_id = 'purchase'").select("media_id", "event_id", "t_ini", "t_fin")
    right = ev.where("track_id = 'view'").select("media_id", F.col("event_id").alias("other_id"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    hit = jn.overlap_join(left, right, ["media_id"], bin_width=BIN)
    return hit.select("media_id", "event_id", "other_id", iv.overlap_length("t_ini", "t_fin", "r_ini", "r_fin").alias("shared"))


@query(
    "overlap_semi_anti",
    f"WITH {EV_SQL} SELECT a.media_id, a.event_id, EXISTS (SELECT 1 FROM ev b WHERE b.media_id = a.media_id AND b.track_id = 'error' AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini) AS touched FROM ev a WHERE a.track_id = 'signup'",
)
def overlap_semi_anti(spark, d):
    ev = timeline(spark, d)
    left = ev.where("track_id = 'signup'").select("media_id", "event_id", "t_ini", "t_fin")
    right = ev.where("track_id = 'error'").select("media_id", F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    yes = jn.overlap_join(left, right, ["media_id"], bin_width=BIN, how="left_semi").withColumn("touched", F.lit(True))
    no = jn.overlap_join(left, right, ["media_id"], bin_width=BIN, how="left_anti").withColumn("touched", F.lit(False))
    return yes.unionByName(no).select("media_id", "event_id", "touched")


@query(
    "point_query",
    f"WITH {EV_SQL} SELECT track_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ev WHERE t_ini <= 1296000000 AND t_fin >= 1296000000 GROUP BY track_id",
)
def point_query(spark, d):
    at = F.lit(1_296_000_000)
    hit = timeline(spark, d).where(iv.meets("t_ini", "t_fin", at, at, iv.Convention.CLOSED))
    return hit.groupBy("track_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    "window_query",
    f"WITH {EV_SQL} SELECT media_id, track_id, count(*) AS n, CAST(sum(least(t_fin, 1382400000) - greatest(t_ini, 1296000000)) AS BIGINT) AS shared FROM ev WHERE t_ini < 1382400000 AND t_fin > 1296000000 GROUP BY media_id, track_id",
)
def window_query(spark, d):
    lo, hi = F.lit(1_296_000_000), F.lit(1_382_400_000)
    hit = timeline(spark, d).where(iv.meets("t_ini", "t_fin", lo, hi))
    return hit.groupBy("media_id", "track_id").agg(F.count("*").alias("n"), F.sum(iv.overlap_length("t_ini", "t_fin", lo, hi)).alias("shared"))


@query(
    "half_open_window",
    f"WITH {EV_SQL}, p AS (SELECT *, CASE WHEN k % 5 = 0 THEN t_ini ELSE t_fin END AS e FROM ev) SELECT media_id, count(*) AS n FROM p WHERE t_ini < 1382400000 AND (e > 1296000000 OR (e = t_ini AND t_ini >= 1296000000)) GROUP BY media_id",
)
def half_open_window(spark, d):
    p = timeline(spark, d).withColumn("e", F.when(F.col("k") % 5 == 0, F.col("t_ini")).otherwise(F.col("t_fin")))
    hit = p.where(iv.meets("t_ini", "e", F.lit(1_296_000_000), F.lit(1_382_400_000), iv.Convention.HALF_OPEN))
    return hit.groupBy("media_id").agg(F.count("*").alias("n"))


@query(
    "stabbing_counts",
    f"""WITH {EV_SQL}, p AS (SELECT DISTINCT media_id, t_ini AS t FROM ev WHERE track_id = 'click')
 SELECT p.media_id, p.t, count(e.event_id) AS n_active, coalesce(string_agg(DISTINCT e.track_id, ',' ORDER BY e.track_id), '') AS tracks FROM p LEFT JOIN ev e ON e.media_id = p.media_id AND e.t_ini < p.t AND e.t_fin > p.t GROUP BY 1, 2""",
)
def stabbing_counts(spark, d):
    ev = timeline(spark, d)
    points = ev.where("track_id = 'click'").select("media_id", F.col("t_ini").alias("t"))
    return jn.conflicts(points, ev.select("media_id", "track_id", "t_ini", "t_fin"), ["media_id"], "track_id", BIN)


ASOF = "SELECT media_id, event_id, t_ini FROM ev WHERE track_id = 'purchase'"


@query(
    "asof_prev",
    f"WITH {EV_SQL}, l AS ({ASOF}), r AS (SELECT media_id, t_ini AS rt, max(event_id) AS view_id FROM ev WHERE track_id = 'view' GROUP BY 1, 2) SELECT l.media_id, l.event_id, r.rt AS prev_t, r.view_id AS prev_event_id FROM l ASOF LEFT JOIN r ON l.media_id = r.media_id AND l.t_ini >= r.rt",
)
def asof_prev(spark, d):
    ev = timeline(spark, d)
    out = jn.asof(ev.where("track_id = 'purchase'").select("media_id", "event_id", "t_ini"), ev.where("track_id = 'view'").select("media_id", "event_id", "t_ini"), ["media_id"], "t_ini", "t_ini", ["event_id"], True, prefix="prev_")
    return out.select("media_id", "event_id", "prev_t", "prev_event_id")


@query(
    "asof_next",
    f"WITH {EV_SQL}, l AS ({ASOF}), r AS (SELECT media_id, t_ini AS rt, min(event_id) AS view_id FROM ev WHERE track_id = 'view' GROUP BY 1, 2) SELECT l.media_id, l.event_id, CASE WHEN r.rt - l.t_ini <= 86400000 THEN r.rt END AS next_t, CASE WHEN r.rt - l.t_ini <= 86400000 THEN r.view_id END AS next_event_id FROM l ASOF LEFT JOIN r ON l.media_id = r.media_id AND l.t_ini < r.rt",
)
def asof_next(spark, d):
    ev = timeline(spark, d)
    out = jn.asof(ev.where("track_id = 'purchase'").select("media_id", "event_id", "t_ini"), ev.where("track_id = 'view'").select("media_id", "event_id", "t_ini"), ["media_id"], "t_ini", "t_ini", ["event_id"], False, False, 24 * HOUR, "next_")
    return out.select("media_id", "event_id", "next_t", "next_event_id")


@query(
    "nearest_within",
    f"""WITH {EV_SQL}, l AS ({ASOF}), r AS (SELECT media_id, t_ini AS rt FROM ev WHERE track_id = 'view' GROUP BY 1, 2),
 x AS (SELECT l.media_id, l.event_id, l.t_ini, r.rt, row_number() OVER (PARTITION BY l.media_id, l.event_id ORDER BY abs(r.rt - l.t_ini), r.rt) AS n FROM l LEFT JOIN r ON l.media_id = r.media_id)
 SELECT media_id, event_id, CASE WHEN abs(rt - t_ini) <= 43200000 THEN rt END AS near_t FROM x WHERE n = 1""",
)
def nearest_within(spark, d):
    ev = timeline(spark, d)
    out = jn.nearest(ev.where("track_id = 'purchase'").select("media_id", "event_id", "t_ini"), ev.where("track_id = 'view'").select("media_id", "t_ini"), ["media_id"], "t_ini", "t_ini", [], 12 * HOUR)
    return out.select("media_id", "event_id", "near_t")


TURNS = "tu AS (SELECT media_id, t_ini AS r_ini, t_fin AS r_fin, track_id AS sp FROM ev WHERE track_id IN ('click', 'signup', 'view'))"


@query(
    "argmax_overlap",
    f"""WITH {EV_SQL}, {TURNS}, w AS (SELECT media_id, event_id, t_ini, t_fin FROM ev WHERE track_id = 'error'),
 n AS (SELECT w.*, r_ini, sp, greatest(0, least(t_fin, r_fin) - greatest(t_ini, r_ini)) AS ov, greatest(r_ini - (t_ini + t_fin) / 2, (t_ini + t_fin) / 2 - r_fin, 0) AS dist FROM w JOIN tu ON w.media_id = tu.media_id AND r_ini <= t_fin + 7200000 AND r_fin >= t_ini - 7200000),
 s AS (SELECT media_id, event_id, sp, sum(ov) AS ov, min(r_ini) AS since, min(dist) AS dist, arg_min(r_ini, dist * 1e13 + r_ini) AS dr FROM n GROUP BY 1, 2, 3),
 k AS (SELECT *, row_number() OVER (PARTITION BY media_id, event_id ORDER BY ov DESC, since, sp) AS ro, row_number() OVER (PARTITION BY media_id, event_id ORDER BY dist, dr, sp) AS rn FROM s),
 p AS (SELECT media_id, event_id, max(CASE WHEN ro = 1 AND ov > 0 THEN sp END) AS o, max(CASE WHEN rn = 1 AND dist <= 7200000 THEN sp END) AS ne FROM k GROUP BY 1, 2)
 SELECT w.media_id, w.event_id, coalesce(o, ne) AS speaker_id, CASE WHEN o IS NOT NULL THEN 'overlap' WHEN ne IS NOT NULL THEN 'nearest' ELSE 'unknown' END AS assignment FROM w LEFT JOIN p USING (media_id, event_id)""",
)
def argmax_overlap(spark, d):
    ev = timeline(spark, d)
    out = jn.assign_by_overlap(ev.where("track_id = 'error'").select("media_id", "event_id", "t_ini", "t_fin"), ev.where("track_id in ('click', 'signup', 'view')"), ["media_id"], "event_id", "track_id", 2 * HOUR, BIN)
    return out.select("media_id", "event_id", "speaker_id", "assignment")


@query(
    "overlap_weighted_mean",
    f"""WITH {EV_SQL}, x AS (SELECT a.media_id, a.event_id, least(a.t_fin, b.t_fin) - greatest(a.t_ini, b.t_ini) AS ov, b.k FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.track_id = 'purchase' AND b.track_id = 'view' AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini)
 SELECT e.media_id, e.event_id, round(sum(ov * x.k) / sum(ov), 6) AS k_mean, count(x.k) AS n_windows FROM ev e LEFT JOIN x USING (media_id, event_id) WHERE e.track_id = 'purchase' GROUP BY 1, 2""",
)
def overlap_weighted_mean(spark, d):
    ev = timeline(spark, d)
    out = jn.weighted_mean(ev.where("track_id = 'purchase'"), ev.where("track_id = 'view'"), ["media_id"], "event_id", "k", BIN)
    return out.withColumn("k_mean", F.round("k_mean", 6))


@query(
    "best_container",
    f"""WITH {EV_SQL}, x AS (SELECT a.media_id, a.event_id, b.event_id AS span_id, row_number() OVER (PARTITION BY a.media_id, a.event_id ORDER BY least(a.t_fin, b.t_fin) - greatest(a.t_ini, b.t_ini) DESC, b.t_ini, b.event_id) AS r FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.track_id = 'click' AND b.track_id = 'signup' AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini)
 SELECT e.media_id, e.event_id, x.span_id FROM ev e LEFT JOIN x ON e.media_id = x.media_id AND e.event_id = x.event_id AND r = 1 WHERE e.track_id = 'click'""",
)
def best_container(spark, d):
    ev = timeline(spark, d)
    spans = ev.where("track_id = 'signup'").select("media_id", F.col("event_id").alias("span_id"), "t_ini", "t_fin")
    return jn.best_container(ev.where("track_id = 'click'"), spans, ["media_id"], "event_id", "span_id", BIN)


@query(
    "pair_conflicts",
    f"WITH {EV_SQL} SELECT a.media_id, a.event_id AS left_id, b.event_id AS right_id, greatest(a.t_ini, b.t_ini) AS x_ini, least(a.t_fin, b.t_fin) AS x_fin FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.track_id = 'signup' AND b.track_id = 'error' AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini",
)
def pair_conflicts(spark, d):
    return jn.pair_conflicts(timeline(spark, d), ["media_id"], "event_id", F.col("track_id") == "signup", F.col("track_id") == "error", BIN)


@query(
    "silence_analysis",
    f"""WITH {EV_SQL}, pad AS (SELECT event_id, media_id, greatest(0, t_ini - 100) AS t_ini, t_fin + 200 AS t_fin FROM ev),
 {UNION_SQL.replace('FROM ev', 'FROM pad')}, {BOUNDS_SQL},
 e AS (SELECT media_id, t_ini, t_fin FROM un UNION ALL SELECT media_id, hi, NULL FROM bo),
 r AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
 g AS (SELECT media_id, greatest(coalesce(reach, lo), lo) AS a, least(t_ini, hi) AS b, coalesce(reach, lo) <= lo AS "leading", t_fin IS NULL AS "trailing" FROM r JOIN bo USING (media_id) WHERE least(t_ini, hi) - greatest(coalesce(reach, lo), lo) >= 3600000),
 c AS (SELECT *, CASE WHEN "leading" THEN a ELSE a + 300000 END AS t_ini, CASE WHEN "trailing" THEN b ELSE b - 300000 END AS t_fin FROM g),
 f AS (SELECT * FROM c WHERE t_fin - t_ini >= 400000),
 p AS (SELECT media_id, t_fin AS pt, max(event_id) AS pid FROM ev GROUP BY 1, 2), q AS (SELECT media_id, t_ini AS qt, min(event_id) AS qid FROM ev GROUP BY 1, 2),
 f2 AS (SELECT f.*, p.pid AS prev_id FROM f ASOF LEFT JOIN p ON f.media_id = p.media_id AND f.a >= p.pt),
 f3 AS (SELECT f2.*, q.qid AS next_id FROM f2 ASOF LEFT JOIN q ON f2.media_id = q.media_id AND f2.b <= q.qt),
 z AS (SELECT media_id, avg(b - a) AS mu, stddev_pop(b - a) AS sd FROM f3 GROUP BY 1)
 SELECT media_id, t_ini, t_fin, b - a AS gap, "leading", "trailing", prev_id, next_id, round((b - a - mu) / CASE WHEN coalesce(sd, 0) = 0 THEN 1 ELSE sd END, 6) AS gap_z FROM f3 JOIN z USING (media_id)""",
)
def silence(spark, d):
    ev = timeline(spark, d)
    return analyse_silence(ev, bounds_of(ev), min_gap=HOUR, keep_before=300_000, keep_after=300_000, min_cut=400_000, pad_before=100, pad_after=200)
