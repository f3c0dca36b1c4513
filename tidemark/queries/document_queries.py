"""Queries of edit documents, remapping, conversations, text and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as sc
from ..functions import text as tx
from ..functions import time as tm
from ..operators import conversation as cv
from ..operators import documents as dc
from ..operators import intervals as iv
from ..operators import planning as pl
from ..operators import remap as rm
from ..operators import stats as st
from ..operators import topics as tp
from ..plans import index as ix
from ..plans import master as ms
from ..plans.silence import bounds_of
from ..sources.timeline import EV_SQL, UT_SQL, read, timeline, utterances
from . import fold_sql
from .interval_queries import BIN, ERR_SQL, HOUR, clips
from .registry import ORACLE, query

BY = ["media_id"]
MAP_SQL = """sg AS (SELECT media_id, event_id, t_ini AS source_ini, t_ini + 3600000 AS source_fin FROM ev WHERE track_id = 'signup'),
 mp AS (SELECT media_id, source_ini, source_fin, row_number() OVER (PARTITION BY media_id ORDER BY source_ini, event_id) - 1 AS segment,
   CAST(coalesce(sum(source_fin - source_ini) OVER (PARTITION BY media_id ORDER BY source_ini, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS child_ini FROM sg)"""


def mapping(ev):
    seg = ev.where("track_id = 'signup'").select("media_id", "event_id", F.col("t_ini").alias("source_ini"), (F.col("t_ini") + HOUR).alias("source_fin"))
    return rm.time_map(seg, BY, ["source_ini", "event_id"])


@query("time_map", f"WITH {EV_SQL}, {MAP_SQL} SELECT media_id, CAST(segment AS INTEGER) AS segment, source_ini, source_fin, child_ini, child_ini + source_fin - source_ini AS child_fin FROM mp")
def time_map(spark, d):
    return mapping(timeline(spark, d)).select("media_id", "segment", "source_ini", "source_fin", "child_ini", "child_fin")


@query(
    "time_remap",
    f"""WITH {EV_SQL}, {MAP_SQL} SELECT e.media_id, CAST(e.event_id AS VARCHAR) || '~s' || CAST(segment + 1 AS VARCHAR) AS child_id, child_ini + greatest(t_ini, source_ini) - source_ini AS c_ini, child_ini + least(t_fin, source_fin) - source_ini AS c_fin, t_ini < source_ini AS clipped_left, t_fin > source_fin AS clipped_right
 FROM ev e JOIN mp ON e.media_id = mp.media_id AND source_ini < t_fin AND source_fin > t_ini""",
)
def time_remap(spark, d):
    ev = timeline(spark, d)
    return rm.map_range(ev, mapping(ev), BY, "event_id", BIN).select("media_id", "child_id", "c_ini", "c_fin", "clipped_left", "clipped_right")


@query(
    "child_to_source",
    f"""WITH {EV_SQL}, {MAP_SQL}, p AS (SELECT DISTINCT media_id, t FROM (SELECT media_id, unnest(range(0, 40)) * 1700000 AS t FROM (SELECT DISTINCT media_id FROM ev)))
 SELECT p.media_id, p.t, CASE WHEN p.t < child_ini + source_fin - source_ini THEN source_ini + p.t - child_ini END AS source_t FROM p ASOF LEFT JOIN mp ON p.media_id = mp.media_id AND p.t >= mp.child_ini""",
)
def child_to_source(spark, d):
    ev = timeline(spark, d)
    points = ev.select("media_id").distinct().withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("media_id", (F.col("n").cast("long") * 1_700_000).alias("t"))
    return rm.child_to_source(points, mapping(ev), BY, "t")


@query(
    "source_to_child",
    f"WITH {EV_SQL}, {MAP_SQL} SELECT e.media_id, e.event_id, CAST(segment AS INTEGER) AS segment, child_ini + t_ini - source_ini AS child_t FROM ev e JOIN mp ON e.media_id = mp.media_id AND source_ini <= t_ini AND source_fin >= t_ini",
)
def source_to_child(spark, d):
    ev = timeline(spark, d)
    out = rm.source_to_child(ev.select("media_id", "event_id", F.col("t_ini").alias("t")), mapping(ev), BY, "t", BIN)
    return out.select("media_id", "event_id", "segment", "child_t")


JUNCTION_SQL = """jn AS (SELECT media_id, segment AS left_segment, lead(segment) OVER w AS r_segment, child_ini + source_fin - source_ini AS join_t, source_fin AS left_out, lead(source_ini) OVER w AS right_in FROM mp WINDOW w AS (PARTITION BY media_id ORDER BY segment))"""


@query(
    "junction_cards",
    f"WITH {EV_SQL}, {MAP_SQL}, {JUNCTION_SQL} SELECT media_id, CAST(left_segment AS INTEGER) AS left_segment, CAST(r_segment AS INTEGER) AS r_segment, join_t, left_out, right_in, right_in - left_out AS jump, right_in >= left_out AS chronological FROM jn WHERE r_segment IS NOT NULL",
)
def junction_cards(spark, d):
    return rm.junctions(mapping(timeline(spark, d)), BY)


@query(
    "junction_risk",
    f"""WITH {EV_SQL}, {MAP_SQL}, {JUNCTION_SQL}, c AS (SELECT media_id, left_segment, right_in - left_out AS jump, left_segment % 3 = 0 AS ml, left_segment % 5 = 0 AS mr, left_segment % 7 = 0 AS dep, left_segment % 2 = 0 AS opn, left_segment % 4 <> 0 AS same, right_in >= left_out AS chron FROM jn WHERE r_segment IS NOT NULL)
 SELECT media_id, CAST(left_segment AS INTEGER) AS left_segment, CAST(least(100, CASE WHEN ml THEN 30 ELSE 0 END + CASE WHEN mr THEN 30 ELSE 0 END + CASE WHEN dep THEN 15 ELSE 0 END + CASE WHEN opn THEN 15 ELSE 0 END + CASE WHEN NOT same THEN 10 ELSE 0 END + CASE WHEN abs(jump) > 300000 THEN 22 WHEN abs(jump) > 60000 THEN 15 WHEN abs(jump) > 12000 THEN 8 ELSE 0 END + CASE WHEN NOT chron THEN 25 ELSE 0 END) AS INTEGER) AS risk FROM c""",
)
def junction_risk(spark, d):
    j = rm.junctions(mapping(timeline(spark, d)), BY)
    n = F.col("left_segment")
    cards = j.select("media_id", "left_segment", "jump", (n % 3 == 0).alias("mid_left"), (n % 5 == 0).alias("mid_right"), (n % 7 == 0).alias("dependent_start"), (n % 2 == 0).alias("open_clause"), (n % 4 != 0).alias("same_scene"), "chronological", F.lit(False).alias("teaser_before"))
    return rm.risk_score(cards).select("media_id", "left_segment", "risk")


@query(
    "edge_quality",
    f"""WITH {EV_SQL}, p AS (SELECT DISTINCT media_id, t_ini + 900000 AS t FROM ev WHERE track_id = 'error'), w AS (SELECT media_id, t_ini AS a, t_ini + 1200000 AS b FROM ev WHERE track_id = 'view'),
 x AS (SELECT p.media_id, p.t, max(CASE WHEN a < t AND b > t THEN 1 ELSE 0 END) AS ins, max(CASE WHEN b <= t THEN b END) AS pt, min(CASE WHEN a >= t THEN a END) AS nt FROM p LEFT JOIN w USING (media_id) GROUP BY 1, 2)
 SELECT media_id, t, CASE WHEN ins = 1 THEN 'inside_word' WHEN (t - pt < 600000 AND t - pt > 0) OR (nt - t < 600000 AND nt - t > 0) THEN 'close' WHEN pt IS NULL OR nt IS NULL OR nt - pt >= 86400000 THEN 'natural' ELSE 'open' END AS edge FROM x""",
)
def edge_quality(spark, d):
    ev = timeline(spark, d)
    points = ev.where("track_id = 'error'").select("media_id", (F.col("t_ini") + 900_000).alias("t")).distinct()
    words = ev.where("track_id = 'view'").select("media_id", "t_ini", (F.col("t_ini") + 1_200_000).alias("t_fin"), F.lit("word").alias("text"))
    return rm.edge_quality(points, words, BY, "t", "text", 600_000, 24 * HOUR, BIN).select("media_id", "t", "edge")


@query(
    "keyframe_snap",
    f"""WITH {EV_SQL}, c AS (SELECT media_id, event_id, t_ini AS t FROM ev WHERE track_id = 'click'), k AS (SELECT DISTINCT media_id, t_ini AS kt FROM ev WHERE track_id = 'view'), j AS (SELECT c.*, k.kt FROM c ASOF LEFT JOIN k ON c.media_id = k.media_id AND c.t >= k.kt)
 SELECT media_id, event_id, max(coalesce(kt, t)) OVER (PARTITION BY media_id ORDER BY t, event_id) AS snapped FROM j""",
)
def keyframe_snap(spark, d):
    ev = timeline(spark, d)
    cuts = ev.where("track_id = 'click'").select("media_id", "event_id", F.col("t_ini").alias("t"))
    return rm.snap_back(cuts, ev.where("track_id = 'view'").select("media_id", "t_ini"), BY, "t", "t_ini", ["t", "event_id"]).select("media_id", "event_id", "snapped")


@query(
    "coalesce_by_lane",
    f"""WITH {EV_SQL}, o AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id, track_id ORDER BY t_ini, t_fin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, track_id ORDER BY t_ini, t_fin, event_id) AS g FROM o)
 SELECT media_id, track_id, arg_max(event_id, (t_fin - t_ini) * 1000000 + event_id) AS event_id, min(t_ini) AS t_ini, max(t_fin) AS t_fin, count(*) AS n_merged FROM i GROUP BY media_id, track_id, g""",
)
def coalesce_by_lane(spark, d):
    cuts = timeline(spark, d).withColumn("reason", F.concat(F.lit("k"), F.col("k").cast("string")))
    return dc.coalesce_cuts(cuts, ["media_id", "track_id"], "event_id", "reason").select("media_id", "track_id", "event_id", "t_ini", "t_fin", "n_merged")


@query(
    "merge_analysis",
    f"""WITH {EV_SQL}, old AS (SELECT media_id, event_id AS cut_id, t_ini, t_fin, k % 2 = 0 AS enabled, k % 4 = 0 AS edited FROM ev WHERE track_id = 'view'), nw AS (SELECT media_id, t_ini, t_fin, true AS enabled FROM ev WHERE track_id IN ('view', 'purchase')),
 f AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM old WHERE edited AND old.media_id = nw.media_id AND old.t_ini < nw.t_fin AND old.t_fin > nw.t_ini)),
 b AS (SELECT f.media_id, f.t_ini, f.t_fin, old.cut_id AS oid, coalesce(old.enabled, f.enabled) AS enabled FROM f LEFT JOIN old ON NOT old.edited AND f.media_id = old.media_id AND f.t_ini = old.t_ini AND f.t_fin = old.t_fin)
 SELECT media_id, coalesce(oid, 1000000 + row_number() OVER (PARTITION BY media_id, oid IS NULL ORDER BY t_ini, t_fin) - 1) AS cut_id, t_ini, t_fin, enabled, CASE WHEN oid IS NULL THEN 'new' ELSE 'kept' END AS status FROM b
 UNION ALL SELECT media_id, cut_id, t_ini, t_fin, enabled, 'edited' FROM old WHERE edited""",
)
def merge_analysis(spark, d):
    ev = timeline(spark, d)
    old = ev.where("track_id = 'view'").select("media_id", F.col("event_id").alias("cut_id"), "t_ini", "t_fin", (F.col("k") % 2 == 0).alias("enabled"), (F.col("k") % 4 == 0).alias("edited"))
    new = ev.where("track_id in ('view', 'purchase')").select("media_id", "t_ini", "t_fin", F.lit(True).alias("enabled"))
    return dc.merge_analysis(old, new, BY, "cut_id", F.lit(1_000_000))


@query(
    "quarantine_split",
    f"""WITH {EV_SQL}, m AS (SELECT media_id, k AS mark_id, event_id, CASE WHEN value < 2 THEN 'too_short' WHEN t_fin > 2592000000 THEN 'out_of_range' WHEN track_id = 'error' THEN 'kind' END AS reason FROM ev),
 n AS (SELECT *, row_number() OVER (PARTITION BY media_id, mark_id, reason IS NULL ORDER BY event_id) AS r FROM m) SELECT event_id, CASE WHEN reason IS NULL AND r > 1 THEN 'duplicate_id' ELSE reason END AS reason FROM n""",
)
def quarantine_split(spark, d):
    rules = {"too_short": F.col("value") >= 2, "out_of_range": F.col("t_fin") <= 2_592_000_000, "kind": F.col("track_id") != "error"}
    return dc.quarantine(timeline(spark, d), BY, "k", ["event_id"], rules).select("event_id", "reason")


@query(
    "validation_report",
    f"""WITH {EV_SQL}, w AS (SELECT *, lag(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS p FROM ev), e AS (
 SELECT track_id, 'long' AS rule FROM w WHERE t_fin - t_ini > 86400000 UNION ALL SELECT track_id, 'overlaps_previous' FROM w WHERE p > t_ini UNION ALL SELECT track_id, 'weak' FROM w WHERE value < 1)
 SELECT track_id, rule, count(*) AS n FROM e GROUP BY 1, 2""",
)
def validation_report(spark, d):
    prev = F.lag("t_fin").over(Window.partitionBy("media_id").orderBy("t_ini", "event_id"))
    ev = timeline(spark, d).withColumn("p", prev)
    rules = {"long": F.col("t_fin") - F.col("t_ini") <= 24 * HOUR, "overlaps_previous": F.col("p").isNull() | (F.col("p") <= F.col("t_ini")), "weak": F.col("value") >= 1}
    return dc.rule_errors(ev, ["track_id"], rules).groupBy("track_id", "rule").agg(F.count("*").alias("n"))


@query(
    "stream_contract",
    f"WITH {EV_SQL}, w AS (SELECT event_id, t_ini, t_fin, lag(t_ini) OVER (PARTITION BY media_id ORDER BY k, event_id) AS p FROM ev) SELECT event_id, CASE WHEN t_fin < t_ini THEN 'ends_before_start' WHEN t_fin > 2592001000 THEN 'out_of_range' WHEN t_ini < p - 1000 THEN 'goes_back' END AS reason FROM w WHERE t_fin < t_ini OR t_fin > 2592001000 OR t_ini < p - 1000",
)
def stream_contract(spark, d):
    ev = timeline(spark, d).withColumn("pos", F.col("k").cast("long") * 10_000_000 + F.col("event_id"))
    return dc.stream_contract(ev, BY, "pos", F.lit(2_592_000_000), 1000).select("event_id", "reason")


@query(
    "tiling_errors",
    f"""WITH {EV_SQL}, b AS (SELECT media_id, 0 AS lo, max(t_fin) + 3600000 AS hi FROM ev GROUP BY 1), w AS (SELECT media_id, event_id, t_ini, t_fin, lag(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin) AS p, lead(t_ini) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin) IS NULL AS l, lo, hi FROM ev JOIN b USING (media_id) WHERE track_id = 'view')
 SELECT media_id, event_id, 'starts_late' AS rule FROM w WHERE p IS NULL AND abs(t_ini - lo) > 1 UNION ALL SELECT media_id, event_id, 'gap_or_overlap' FROM w WHERE abs(t_ini - p) > 1 UNION ALL SELECT media_id, event_id, 'ends_early' FROM w WHERE l AND abs(t_fin - hi) > 1 UNION ALL SELECT media_id, event_id, 'too_long' FROM w WHERE t_fin - t_ini > 43200000""",
)
def tiling_errors(spark, d):
    ev = timeline(spark, d)
    return dc.tiling_errors(ev.where("track_id = 'view'"), BY, "event_id", bounds_of(ev), 1, 12 * HOUR)


@query(
    "same_track_overlaps",
    f"WITH {EV_SQL}, r AS (SELECT media_id, track_id, event_id, max(t_fin) OVER (PARTITION BY media_id, track_id ORDER BY t_ini, t_fin, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - t_ini AS overlap FROM ev) SELECT * FROM r WHERE overlap > 0",
)
def same_track_overlaps(spark, d):
    return dc.same_track_overlaps(timeline(spark, d), ["media_id", "track_id"], "event_id", "t_ini", "t_fin")


@query("stable_ids", f"WITH {EV_SQL} SELECT event_id, 'ev-' || lpad(CAST(row_number() OVER (PARTITION BY media_id, track_id ORDER BY t_ini, event_id) - 1 AS VARCHAR), 4, '0') AS stable_id FROM ev")
def stable_ids(spark, d):
    return dc.stable_ids(timeline(spark, d), ["media_id", "track_id"], "ev-", ["t_ini", "event_id"]).select("event_id", "stable_id")


TREE_SQL = "it AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey - 1 - o_orderkey % 3 END AS parent FROM orders)"


def tree(spark, d):
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(k.alias("id"), F.when(k % 7 != 0, k - 1 - k % 3).alias("parent"))


@query("hierarchy_depth", f"WITH RECURSIVE {TREE_SQL}, t AS (SELECT id, 0 AS depth FROM it WHERE parent IS NULL UNION ALL SELECT it.id, t.depth + 1 FROM it JOIN t ON it.parent = t.id WHERE t.depth < 32) SELECT it.id, t.depth FROM it LEFT JOIN t USING (id)")
def hierarchy_depth(spark, d):
    return dc.depth(tree(spark, d), [], "id", "parent").select("id", "depth")


@query("layer_descendants", f"WITH RECURSIVE {TREE_SQL}, t AS (SELECT id FROM it WHERE id % 50 = 1 UNION SELECT it.id FROM it JOIN t ON it.parent = t.id) SELECT id FROM t")
def layer_descendants(spark, d):
    items = tree(spark, d)
    return dc.descendants(items, items.where("id % 50 = 1"), [], "id", "parent")


@query(
    "layer_merge",
    f"""WITH RECURSIVE {TREE_SQL}, st AS (SELECT id, parent, id % 5 = 0 AS edited, id % 50 = 1 AS deleted FROM it WHERE id % 2 = 1), t AS (SELECT id FROM st WHERE deleted UNION SELECT it.id FROM it JOIN t ON it.parent = t.id)
 SELECT id, parent, edited, deleted FROM st WHERE edited OR deleted UNION ALL SELECT id, parent, NULL, NULL FROM it WHERE id NOT IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM st WHERE edited OR deleted)""",
)
def layer_merge(spark, d):
    items = tree(spark, d)
    stored = items.where("id % 2 = 1").withColumn("edited", F.col("id") % 5 == 0).withColumn("deleted", F.col("id") % 50 == 1)
    return dc.merge_layer(stored, items, [], "id", "parent")


@query("latest_revision", "SELECT o_custkey, max(o_orderkey) AS revision, arg_max(o_orderstatus, o_orderkey) AS state FROM orders GROUP BY 1")
def latest_revision(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("state"))
    return dc.latest(rows, ["o_custkey"], "revision")


@query("neighbour_items", f"WITH {EV_SQL} SELECT media_id, event_id, lag(event_id) OVER w AS prev_id, lead(event_id) OVER w AS next_id FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini, t_fin, event_id)")
def neighbour_items(spark, d):
    return dc.next_item(timeline(spark, d), BY, "event_id")


@query(
    "split_at",
    f"WITH {EV_SQL} SELECT event_id, 0 AS part, t_ini, CASE WHEN 1296000000 - t_ini >= 60000 AND t_fin - 1296000000 >= 60000 THEN 1296000000 ELSE t_fin END AS t_fin FROM ev UNION ALL SELECT event_id, 1, 1296000000, t_fin FROM ev WHERE 1296000000 - t_ini >= 60000 AND t_fin - 1296000000 >= 60000",
)
def split_at(spark, d):
    return dc.split_at(timeline(spark, d), F.lit(1_296_000_000).cast("long"), 60_000).select("event_id", "part", "t_ini", "t_fin")


@query("trim_edges", f"WITH {EV_SQL} SELECT event_id, greatest(0, least(t_ini + 600000, t_fin - 60000)) AS t_ini, greatest(t_fin - 900000, greatest(0, least(t_ini + 600000, t_fin - 60000)) + 60000) AS t_fin FROM ev")
def trim_edges(spark, d):
    ev = timeline(spark, d)
    a = dc.trim_edge(ev, "start", F.col("t_ini") + 600_000, 60_000)
    return dc.trim_edge(a, "end", F.col("t_fin") - 900_000, 60_000).select("event_id", "t_ini", "t_fin")


@query(
    "shift_timeline",
    f"WITH {EV_SQL}, s AS (SELECT media_id, min(t_ini) AS lo, max(t_fin) AS hi FROM ev GROUP BY 1) SELECT event_id, t_ini + greatest(-lo, least(7200000, 3000000000 - hi)) AS t_ini, t_fin + greatest(-lo, least(7200000, 3000000000 - hi)) AS t_fin FROM ev JOIN s USING (media_id)",
)
def shift_timeline(spark, d):
    return dc.shift_all(timeline(spark, d), BY, 7_200_000, 3_000_000_000).select("event_id", "t_ini", "t_fin")


CLIP_SQL = "cl AS (SELECT media_id, track_id, event_id AS clip_id, t_ini AS seq_ini, t_fin AS seq_fin, k FROM ev)"


@query("close_gaps", f"WITH {EV_SQL}, {CLIP_SQL} SELECT clip_id, CAST(coalesce(sum(seq_fin - seq_ini) OVER w, 0) AS BIGINT) AS seq_ini, CAST(coalesce(sum(seq_fin - seq_ini) OVER w, 0) AS BIGINT) + seq_fin - seq_ini AS seq_fin FROM cl WINDOW w AS (PARTITION BY media_id, track_id ORDER BY seq_ini, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def close_gaps(spark, d):
    c = timeline(spark, d).select("media_id", "track_id", F.col("event_id").alias("clip_id"), F.col("t_ini").alias("seq_ini"), F.col("t_fin").alias("seq_fin"))
    return dc.close_gaps(c, ["media_id", "track_id"], ["seq_ini", "clip_id"]).select("clip_id", "seq_ini", "seq_fin")


@query(
    "ripple_delete",
    f"WITH {EV_SQL}, {CLIP_SQL}, g AS (SELECT *, CAST(coalesce(sum(CASE WHEN k % 3 = 0 THEN seq_fin - seq_ini ELSE 0 END) OVER (PARTITION BY media_id, track_id ORDER BY seq_ini ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone FROM cl) SELECT clip_id, seq_ini - gone AS seq_ini, seq_fin - gone AS seq_fin FROM g WHERE k % 3 <> 0",
)
def ripple_delete(spark, d):
    c = timeline(spark, d).select("media_id", "track_id", "k", F.col("event_id").alias("clip_id"), F.col("t_ini").alias("seq_ini"), F.col("t_fin").alias("seq_fin"))
    return dc.ripple_delete(c, ["media_id", "track_id"], F.col("k") % 3 == 0).select("clip_id", "seq_ini", "seq_fin")


@query(
    "edge_limits",
    f"WITH {EV_SQL} SELECT event_id AS clip_id, greatest(coalesce(lag(t_fin) OVER w, 0) - t_ini, -event_id * 1000) AS start_min, t_fin - t_ini AS start_max, t_ini - t_fin AS end_min, lead(t_ini) OVER w - t_fin AS end_max FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini, event_id)",
)
def edge_limits(spark, d):
    return dc.edge_limits(clips(timeline(spark, d)), BY, "clip_id").select("clip_id", "start_min", "start_max", "end_min", "end_max")


@query(
    "overwrite_track",
    f"""WITH {EV_SQL}, {ERR_SQL}, l AS (SELECT media_id, event_id, t_ini, t_fin, event_id * 1000 AS s FROM ev WHERE track_id = 'click' AND t_fin > t_ini), h AS (SELECT l.*, c_ini, c_fin FROM l JOIN cut ON l.media_id = cut.media_id AND c_ini < t_fin AND c_fin > t_ini),
 p AS (SELECT media_id, event_id, greatest(t_ini, coalesce(lag(c_fin) OVER (PARTITION BY media_id, event_id ORDER BY c_ini), t_ini)) AS a, least(c_ini, t_fin) AS b FROM h UNION ALL SELECT media_id, event_id, max(c_fin), max(t_fin) FROM h GROUP BY 1, 2
       UNION ALL SELECT media_id, event_id, t_ini, t_fin FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.event_id = l.event_id))
 SELECT p.media_id, p.event_id AS clip_id, a AS seq_ini, b AS seq_fin, s + a - t_ini AS source_ini FROM p JOIN l USING (media_id, event_id) WHERE b > a
 UNION ALL SELECT media_id, event_id, t_ini, t_fin, event_id * 1000 FROM ev WHERE track_id = 'error'""",
)
def overwrite_track(spark, d):
    ev = timeline(spark, d)
    return dc.overwrite(clips(ev.where("track_id = 'click'")), BY, "clip_id", clips(ev.where("track_id = 'error'")))


@query("busiest_lane", f"WITH {EV_SQL}, h AS (SELECT media_id, track_id, count(*) AS hits FROM ev WHERE t_ini < 1296000000 AND t_fin > 864000000 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY hits DESC, track_id) AS n FROM h) SELECT media_id, track_id, hits FROM r WHERE n = 1")
def busiest_lane(spark, d):
    return dc.busiest_lane(timeline(spark, d).withColumn("rank", F.lit(0)), BY, "track_id", 864_000_000, 1_296_000_000, "rank")


@query(
    "overlap_components",
    f"""WITH {EV_SQL}, o AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, track_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ev),
 i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_ini >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, track_id, event_id) AS g FROM o),
 c AS (SELECT media_id, g, min(t_ini) AS t_ini, max(t_fin) AS t_fin, count(*) AS n, string_agg(DISTINCT track_id, ',' ORDER BY track_id) AS tracks FROM i GROUP BY 1, 2 HAVING count(DISTINCT track_id) >= 2)
 SELECT media_id, t_ini, t_fin, n, tracks, CAST(row_number() OVER (PARTITION BY media_id ORDER BY t_ini) AS INTEGER) AS group_no FROM c""",
)
def overlap_components(spark, d):
    return cv.overlap_groups(timeline(spark, d), BY, "track_id", "event_id")


@query("cross_track_intersections", f"WITH {EV_SQL} SELECT a.media_id, a.event_id AS left_id, b.event_id AS right_id, greatest(a.t_ini, b.t_ini) AS x_ini, least(a.t_fin, b.t_fin) AS x_fin FROM ev a JOIN ev b ON a.media_id = b.media_id AND a.event_id < b.event_id AND a.track_id <> b.track_id AND b.t_ini < a.t_fin AND b.t_fin > a.t_ini")
def cross_track_intersections(spark, d):
    return cv.cross_track_intersections(timeline(spark, d), BY, "track_id", "event_id", BIN)


@query("conversation_transcript", f"WITH {UT_SQL} SELECT conv_id, string_agg('[' || lpad(CAST(t_ini // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t_ini // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t_ini // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t_ini % 1000 AS VARCHAR), 3, '0') || '] ' || role || ': ' || text, chr(10) ORDER BY t_ini, turn) AS transcript, count(*) AS n_lines FROM ut GROUP BY 1")
def conversation_transcript(spark, d):
    return ms.transcript(utterances(spark, d), ["conv_id"], "role", "text", "turn")


@query("bleed_duplicates", fold_sql.BLEED_DUPLICATES.replace("{accented}", tx.ACCENTED).replace("{plain}", tx.PLAIN).replace("{{2,}}", "{2,}"))
def bleed_duplicates(spark, d):
    u = utterances(spark, d).withColumn("size", F.length("text")).withColumn("text", tx.normalized(F.col("text")))
    later = lambda name, turns, ms, cut, n: u.withColumns({"role": name, "turn": F.col("turn") + turns, "t_ini": F.col("t_ini") + ms, "t_fin": F.col("t_fin") + ms, "text": F.when(cut, F.expr(f"substr(text, 1, length(text) - {n})")).otherwise(F.col("text"))})
    every = u.unionByName(later(F.concat("role", F.lit("-echo")), 1000, 20, F.col("turn") % 3 == 0, 1)).unionByName(later(F.lit("far"), 2000, 35, F.col("turn") % 2 == 0, 2))
    out = cv.bleed_duplicates(every.withColumn("id", F.col("conv_id") * 10_000 + F.col("turn")), ["conv_id"], "role", "id", "text", ["size", "id"], bin_width=60_000)
    return out.withColumn("similarity", F.round("similarity", 9))


@query("readable_blocks", fold_sql.READABLE_BLOCKS)
def readable_blocks(spark, d):
    u = utterances(spark, d).withColumn("track", F.lit("A")).withColumn("blocked", F.col("turn") % 11 == 10)
    u = u.withColumns({c: F.col(c) + F.col("turn") * 600 for c in ("t_ini", "t_fin")}).withColumn("role", F.when(F.col("turn") % 7 < 5, "a").otherwise(F.col("role")))
    return cv.readable_blocks(u, ["conv_id"], "track", "role", "turn", "text", "blocked", 2500, 60_000, 120, 3_600_000)


@query("boundary_snap", fold_sql.BOUNDARY_SNAP)
def boundary_snap(spark, d):
    ev = timeline(spark, d)
    targets = ev.select("media_id").distinct().withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("target", F.col("chunk_no").cast("long") * 72 * HOUR)
    return pl.snap(targets, ev.where("track_id = 'view'"), ev.where("track_id = 'click'"), BY, "chunk_no", 6 * HOUR, 1, HOUR, 6 * HOUR)


STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
TOK_SQL = f"regexp_extract_all(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), '[a-z0-9]{{2,}}')"

#: Turns on a clock with pauses that vary; a turn of more than 400 characters is exciting.
TALK_SQL = f"""{UT_SQL}, r AS (SELECT conv_id, turn, t_ini + turn * 500 + turn % 3 * 100 AS a, t_fin + turn * 500 + turn % 3 * 100 AS b, text, row_number() OVER (PARTITION BY conv_id ORDER BY t_ini, t_fin, turn) AS n FROM ut),
 tk AS (SELECT conv_id, n, a, b, unnest({TOK_SQL}) AS token FROM r), tf AS (SELECT * FROM tk WHERE token NOT IN ({STOP_SQL})),
 lb AS (SELECT r.conv_id, r.n, token, count(*) AS c FROM r JOIN tf ON tf.conv_id = r.conv_id AND tf.n < r.n AND tf.b >= r.a - 20000 GROUP BY 1, 2, 3),
 rb AS (SELECT r.conv_id, r.n, token, count(*) AS c FROM r JOIN tf ON tf.conv_id = r.conv_id AND tf.n >= r.n AND tf.a <= r.a + 20000 GROUP BY 1, 2, 3),
 dt AS (SELECT conv_id, n, sum(lb.c * rb.c) AS dot FROM lb JOIN rb USING (conv_id, n, token) GROUP BY 1, 2),
 lq AS (SELECT conv_id, n, sum(c * c) AS ll FROM lb GROUP BY 1, 2), rq AS (SELECT conv_id, n, sum(c * c) AS rr FROM rb GROUP BY 1, 2),
 sv AS (SELECT r.*, CASE WHEN n = 1 THEN 0 ELSE greatest(0, a - lag(b) OVER (PARTITION BY conv_id ORDER BY n)) END AS silence FROM r),
 sc AS (SELECT conv_id, turn, n, a AS t, silence, 1 - coalesce(dot / (sqrt(ll) * sqrt(rr)), 0) AS dis, length(text) > 400 AS loud FROM sv LEFT JOIN dt USING (conv_id, n) LEFT JOIN lq USING (conv_id, n) LEFT JOIN rq USING (conv_id, n)),
 bs AS (SELECT conv_id, turn, t, round(0.72 * dis + 0.20 * least(1.0, silence / 400.0) - CASE WHEN loud THEN 0.05 ELSE 0 END, 6) AS score, round(dis, 6) AS dissimilarity, silence FROM sc WHERE n > 1)"""


def talk(spark, d):
    return utterances(spark, d).withColumns({c: F.col(c) + F.col("turn") * 500 + F.col("turn") % 3 * 100 for c in ("t_ini", "t_fin")})


def talk_scores(spark, d):
    loud = F.when(F.length("text") > 400, 0.05).otherwise(0.0)
    out = tp.boundary_scores(talk(spark, d), ["conv_id"], "turn", "text", 20_000, 400, loud, slice_width=60_000)
    return out.select("conv_id", F.col("id").alias("turn"), "t", F.round("score", 6).alias("score"), F.round("dissimilarity", 6).alias("dissimilarity"), "silence")


@query("boundary_scores", f"WITH {TALK_SQL} SELECT * FROM bs")
def boundary_scores(spark, d):
    return talk_scores(spark, d)


@query("topic_chunks", fold_sql.plan_sql(TALK_SQL, "bs", "conv_id", "t", "score", "SELECT conv_id, 0 AS lo, max(b) AS hi FROM r GROUP BY 1", 45_000, 60_000, 5_000, 3_000))
def topic_chunks(spark, d):
    t = talk(spark, d)
    bounds = t.groupBy("conv_id").agg(F.lit(0).alias("lo"), F.max("t_fin").alias("hi"))
    return pl.chunk_plan(talk_scores(spark, d), ["conv_id"], "t", "score", bounds, 45_000, 60_000, 5_000, 3_000)


@query("chunk_plan", fold_sql.CHUNK_PLAN)
def chunk_plan(spark, d):
    ev = timeline(spark, d)
    return pl.chunk_plan(ev, BY, "t_ini", "value", bounds_of(ev), 72 * HOUR, 96 * HOUR, 6 * HOUR)


@query("snapped_plan", fold_sql.SNAPPED_PLAN)
def snapped_plan(spark, d):
    ev = timeline(spark, d)
    every = ev.select("media_id").distinct().withColumn("chunk_no", F.explode(F.sequence(F.lit(1), F.lit(10))))
    plan = every.withColumn("t_ini", (F.col("chunk_no") - 1).cast("long") * 72 * HOUR).withColumn("t_fin", F.col("chunk_no").cast("long") * 72 * HOUR)
    return pl.snap_plan(plan, ev.where("track_id = 'view'"), ev.where("track_id = 'click'"), BY, 6 * HOUR, 1, HOUR, 90 * HOUR, 6 * HOUR)


@query("snapped_topics", fold_sql.SNAPPED_TOPICS)
def snapped_topics(spark, d):
    """Topics of ten days, and in each a subtopic that begins before it: it is moved inside."""
    ev = timeline(spark, d)
    topic = ev.select("media_id").distinct().withColumn("i", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    start = F.col("i").cast("long") * 240 * HOUR
    top = topic.select("media_id", F.concat(F.lit("t"), F.col("i").cast("string")).alias("item_id"), F.lit(None).cast("string").alias("parent_id"), (start + 10 * HOUR).alias("t_ini"), (start + 230 * HOUR).alias("t_fin"))
    sub = topic.select("media_id", F.concat(F.lit("s"), F.col("i").cast("string")).alias("item_id"), F.concat(F.lit("t"), F.col("i").cast("string")).alias("parent_id"), (start + 9 * HOUR).alias("t_ini"), (start + 100 * HOUR).alias("t_fin"))
    out = pl.snap_nested(top.unionByName(sub), ev.where("track_id = 'view'"), ev.where("track_id = 'click'"), BY, "item_id", "parent_id", 6 * HOUR, 1, HOUR, 6 * HOUR)
    return out.select("media_id", "item_id", "s_ini", "s_fin", "crosses")


@query("activity_chunks", fold_sql.ACTIVITY_CHUNKS)
def activity_chunks(spark, d):
    motion = timeline(spark, d).withColumn("m", F.when(F.col("k") % 10 != 7, F.col("value") / 100)).withColumn("cut", F.col("k") % 10 == 3)
    return pl.activity_chunks(motion, BY, "t_ini", "m", 15.0, 4, 45, 3, "cut", ["event_id"], 240 * HOUR, 0.25)


@query("quota_index", fold_sql.QUOTA_INDEX)
def quota_index(spark, d):
    pool = st.ranked_pool(timeline(spark, d), ["track_id"], "value", 20).withColumn("id", F.col("event_id")).withColumn("always", F.col("k") == 7)
    return pl.quota_select(pool, BY, "track_id", "rank", ["purchase", "signup", "click", "view", "error"], {"purchase": 3, "signup": 2, "click": 2, "view": 4}, 2 * HOUR, "always", bin_width=BIN)


def index_parts(spark, d):
    ev = timeline(spark, d).withColumn("id", F.col("event_id").cast("string"))
    peak = F.col("t_ini") + F.expr("(t_fin - t_ini) div 2")
    peaks = st.ranked_pool(ev.where("track_id IN ('purchase', 'signup', 'view')"), ["track_id"], "value", -1).select("media_id", "id", F.col("track_id").alias("modality"), "t_ini", "t_fin", peak.alias("t_peak"), "rank", "value", "k")
    orders = peaks.where("k = 7").withColumn("modality", F.lit("order")).withColumn("rank", F.lit(1.0)).drop("k")
    span = lambda track, test: ev.where((F.col("track_id") == track) & test).select("media_id", "id", "t_ini", "t_fin")
    lengths = ev.groupBy("media_id").agg(F.max("t_fin").alias("length"))
    return ix.signal_index(
        peaks.where("value >= 40").drop("k"), BY, span("click", F.col("value") < 10), span("error", F.col("value") < 50), lengths, orders,
        ["purchase", "signup", "view"], {"multimodal": 2, "purchase": 1, "signup": 2, "view": 3}, 240 * HOUR, HOUR, HOUR // 2, 2 * HOUR, HOUR // 6, BIN,
    )


@query("signal_index", fold_sql.SIGNAL_INDEX)
def signal_index(spark, d):
    seeds, _ = index_parts(spark, d)
    named = lambda c: F.array_join(F.transform(c, lambda x: x["id"]), ",")
    return seeds.select("media_id", "seed_no", "lane", "strength", "t_ini", "t_fin", F.array_join("phrases", ",").alias("phrases"), named(F.col("members")).alias("members"), F.array_join(F.transform("build_up", lambda x: x["id"]), ",").alias("build_up"))


@query("refused_signals", fold_sql.REFUSED_SIGNALS)
def refused_signals(spark, d):
    return index_parts(spark, d)[1].withColumn("rank", F.round("rank", 9))


@query("first_fit_packing", fold_sql.FIRST_FIT_PACKING)
def first_fit_packing(spark, d):
    ev = timeline(spark, d)
    protected = ev.where("track_id = 'view'").select("media_id", F.col("t_ini").alias("seq_ini"), F.col("t_fin").alias("seq_fin"))
    new = ev.where("track_id = 'click'").select("media_id", F.col("event_id").alias("id"), (F.col("t_fin") - F.col("t_ini")).alias("len"), F.col("t_ini").alias("o"))
    return pl.pack_first_fit(protected, new, BY, "o")


@query("token_bag_topk", f"WITH t AS (SELECT doc_id, unnest({TOK_SQL}) AS token, generate_subscripts({TOK_SQL}, 1) AS pos FROM documents), n AS (SELECT doc_id, token, count(*) AS n, min(pos) AS f FROM t WHERE token NOT IN ({STOP_SQL}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM n) SELECT doc_id, string_agg(token, ' ' ORDER BY r) AS title FROM r WHERE r <= 3 GROUP BY 1")
def token_bag_topk(spark, d):
    return tx.top_tokens(read(spark, d, "documents"), ["doc_id"], "text", 3)


@query(
    "bag_cosine",
    f"""WITH t AS (SELECT conv_id, turn, unnest({TOK_SQL}) AS token FROM conversations), b AS (SELECT conv_id, turn, token, count(*) AS n FROM t WHERE token NOT IN ({STOP_SQL}) GROUP BY 1, 2, 3),
 s AS (SELECT conv_id, turn, sum(n * n) AS ss FROM b GROUP BY 1, 2), p AS (SELECT a.conv_id, a.turn, a.ss AS sa, c.ss AS sc FROM s a JOIN s c ON a.conv_id = c.conv_id AND c.turn = a.turn + 1),
 dd AS (SELECT a.conv_id, a.turn, sum(a.n * c.n) AS dot FROM b a JOIN b c ON a.conv_id = c.conv_id AND c.turn = a.turn + 1 AND a.token = c.token GROUP BY 1, 2)
 SELECT p.conv_id, p.turn, round(coalesce(dot, 0) / (sqrt(sa) * sqrt(sc)), 6) AS cosine FROM p LEFT JOIN dd USING (conv_id, turn)""",
)
def bag_cosine(spark, d):
    b = tx.bag(read(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return tx.bag_cosine(b, b.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"]).withColumn("cosine", F.round("cosine", 6))


@query("embedding_cosine", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(tx.vector_cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("normalized_text", f"SELECT conv_id, turn, array_to_string({TOK_SQL}, ' ') AS body, regexp_replace(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^a-z]', '', 'g') AS only_letters FROM conversations")
def normalized_text(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", tx.normalized(F.col("text")).alias("body"), tx.letters(F.col("text")).alias("only_letters"))


@query("slugs", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug FROM part")
def slugs(spark, d):
    return read(spark, d, "part").select("p_partkey", tx.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query(
    "timecode_format",
    f"""WITH {EV_SQL} SELECT event_id, lpad(CAST(t_ini // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(t_ini // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(t_ini // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t_ini // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(t_ini % 1000 AS VARCHAR), 3, '0') AS srt,
 CAST(t_ini // 3600000 AS VARCHAR) || ':' || lpad(CAST(t_ini // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t_ini // 1000 % 60 AS VARCHAR), 2, '0') AS clock, (t_ini * 25 + 500) // 1000 % 25 AS frame FROM ev WHERE t_ini >= 3600000""",
)
def timecode_format(spark, d):
    t = F.col("t_ini")
    return timeline(spark, d).where(t >= HOUR).select("event_id", tm.format_ms(t, ",").alias("srt"), tm.clock(t).alias("clock"), F.substring_index(tm.frames(t, 25), ":", -1).cast("long").alias("frame"))


@query("timecode_parse", f"WITH {EV_SQL} SELECT event_id, (t_ini // 1000) % 36000 AS seconds FROM ev")
def timecode_parse(spark, d):
    s = F.floor(F.col("t_ini") / 1000).cast("long") % 36000
    text = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    return timeline(spark, d).select("event_id", tm.parse_time(text).cast("long").alias("seconds"))


@query("track_names", "SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(CAST(65 + p_partkey AS INTEGER)) WHEN p_partkey < 702 THEN chr(CAST(65 + (p_partkey - 26) // 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 26) % 26 AS INTEGER)) ELSE chr(CAST(65 + (p_partkey - 702) // 676 AS INTEGER)) || chr(CAST(65 + (p_partkey - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey - 702) % 26 AS INTEGER)) END AS name FROM part")
def track_names(spark, d):
    return read(spark, d, "part").select("p_partkey", tm.track_name(F.col("p_partkey")).alias("name"))


@query(
    "scalar_signals",
    f"WITH {EV_SQL} SELECT event_id, CASE WHEN value >= 100 THEN 'high' WHEN value >= 40 THEN 'medium' ELSE 'low' END AS level, round(pow(10, -value / 20), 6) AS gain, round(CASE WHEN track_id = 'view' THEN value WHEN track_id = 'error' THEN k END, 6) AS strength, (t_ini + t_fin) / 2 AS peak_t, round(greatest(0.35, least(1, abs(value) / 100)), 6) AS height FROM ev",
)
def scalar_signals(spark, d):
    v = F.col("value")
    return timeline(spark, d).select("event_id", sc.signal_level(v, 40, 100).alias("level"), F.round(sc.db_to_gain(-v), 6).alias("gain"), F.round(sc.strength(F.col("track_id"), {"view": v, "error": F.col("k")}), 6).alias("strength"), sc.peak_time(F.lit(None), F.col("t_ini"), F.col("t_fin")).alias("peak_t"), F.round(sc.bracket_height(v, 100.0), 6).alias("height"))


@query(
    "gaze_classes",
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, v[1] * 100 AS yaw, v[2] * 100 AS pitch FROM e) SELECT vec_id, CASE WHEN yaw <= -18 THEN 'left' WHEN yaw >= 18 THEN 'right' WHEN pitch >= 14 THEN 'up' WHEN pitch <= -14 THEN 'down' WHEN abs(yaw) <= 6 AND abs(pitch) <= 6 THEN 'camera' ELSE 'front' END AS gaze FROM p",
)
def gaze_classes(spark, d):
    e = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", sc.gaze(e[0].cast("double") * 100, e[1].cast("double") * 100).alias("gaze"))


@query("identity_digest", "SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}') AS digest FROM part")
def identity_digest(spark, d):
    return read(spark, d, "part").select("p_partkey", sc.digest("p_size", "p_brand").alias("digest"))


@query("consolidated_streams", f"WITH {EV_SQL}, s AS (SELECT media_id, 'voice' AS stream, event_id, t_ini, t_fin FROM ev WHERE track_id IN ('view', 'click') UNION ALL SELECT media_id, 'video', event_id, t_ini, t_fin FROM ev WHERE track_id = 'purchase') SELECT media_id, stream, event_id, 'ev-' || lpad(CAST(row_number() OVER (PARTITION BY media_id, stream ORDER BY t_ini, t_fin, event_id) - 1 AS VARCHAR), 4, '0') AS stable_id FROM s")
def consolidated_streams(spark, d):
    ev = timeline(spark, d)
    out = ms.consolidate({"voice": ev.where("track_id in ('view', 'click')"), "video": ev.where("track_id = 'purchase'").drop("k")}, BY)
    return out.select("media_id", "stream", "event_id", "stable_id")


@query("interleaved_review", f"WITH {EV_SQL}, b AS (SELECT media_id, t_ini AS t, 1 AS kind, 'event ' || event_id AS line FROM ev WHERE track_id = 'view' UNION ALL SELECT media_id, t_fin, 0, 'cut ' || event_id FROM ev WHERE track_id = 'error') SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY t, kind, line) AS INTEGER) AS line_no FROM b")
def interleaved_review(spark, d):
    ev = timeline(spark, d)
    left = ev.where("track_id = 'view'").select("media_id", F.col("t_ini").alias("t"), F.lit(1).alias("kind"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("line"))
    right = ev.where("track_id = 'error'").select("media_id", F.col("t_fin").alias("t"), F.lit(0).alias("kind"), F.concat(F.lit("cut "), F.col("event_id").cast("string")).alias("line"))
    return ms.interleaved(left, right, BY)


@query("moment_dossier", f"WITH {EV_SQL} SELECT event_id, CASE WHEN t_ini < 1299600000 AND t_fin > 1296000000 THEN 'inside' WHEN t_fin <= 1296000000 THEN 'before' ELSE 'after' END AS place FROM ev WHERE t_ini < 1299600000 + 86400000 AND t_fin > 1296000000 - 86400000")
def moment_dossier(spark, d):
    return ms.dossier(timeline(spark, d), BY, 1_296_000_000, 1_299_600_000, 24 * HOUR).select("event_id", "place")


@query("subtitle_entries", f"WITH {UT_SQL} SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t_ini, turn) AS INTEGER) AS no, length(text) AS chars FROM ut")
def subtitle_entries(spark, d):
    out = ms.subtitles(utterances(spark, d), ["conv_id"], "text", "turn")
    return out.select("conv_id", "turn", "no", F.length("body").cast("long").alias("chars"))


@query("edit_list", fold_sql.edit_list_sql(ORACLE["flatten_top_track"]))
def edit_list(spark, d):
    return ms.edit_list(iv.flatten(clips(timeline(spark, d)), BY, "rank", bin_width=BIN), BY, 25)


@query(
    "filter_script",
    f"""WITH {EV_SQL}, {ERR_SQL}, bo AS (SELECT media_id, max(t_fin) + 3600000 AS hi FROM ev GROUP BY media_id), e AS (SELECT media_id, c_ini AS t_ini, c_fin AS t_fin FROM cut UNION ALL SELECT media_id, hi, NULL FROM bo),
 r AS (SELECT *, max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), k AS (SELECT media_id, coalesce(reach, 0) AS a, t_ini AS b FROM r WHERE t_ini - coalesce(reach, 0) >= 600000),
 n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY a) - 1 AS n FROM k)
 SELECT media_id, string_agg(printf('[0:a]atrim=start=%d.%03d:end=%d.%03d,asetpts=PTS-STARTPTS[a%d]', a // 1000, a % 1000, b // 1000, b % 1000, n), ';' ORDER BY n) || ';' || string_agg('[a' || n || ']', '' ORDER BY n) || 'concat=n=' || count(*) || ':v=0:a=1[out]' AS script FROM n GROUP BY 1""",
)
def filter_script(spark, d):
    ev = timeline(spark, d)
    return ms.filter_script(iv.kept_segments(ev.where("track_id = 'error'"), BY, bounds_of(ev), 600_000), BY)


@query("derived_streams", f"WITH {EV_SQL}, {MAP_SQL} SELECT e.media_id, track_id, count(*) AS n, CAST(sum(least(t_fin, source_fin) - greatest(t_ini, source_ini)) AS BIGINT) AS kept FROM ev e JOIN mp ON e.media_id = mp.media_id AND source_ini < t_fin AND source_fin > t_ini GROUP BY 1, 2")
def derived_streams(spark, d):
    ev = timeline(spark, d)
    return rm.derive(ev, mapping(ev), BY, "event_id", BIN).groupBy("media_id", "track_id").agg(F.count("*").alias("n"), F.sum(F.col("t_fin") - F.col("t_ini")).alias("kept"))
