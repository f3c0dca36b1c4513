"""Queries of lanes, tracks, montage transcripts, annotated transcripts and the author's ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents as dc
from ..operators import edits as ed
from ..functions import scalar as sc
from ..operators import sequence as sq
from ..plans import master as ms
from ..plans import review as rv
from ..sources.timeline import EV_SQL, UT_SQL, timeline, utterances
from .interval_queries import BIN, HOUR
from .registry import query

BY = ["media_id"]
#: Lanes are the tracks; two recordings in three lose some.
LANE_SQL = f"{EV_SQL}, la AS (SELECT DISTINCT media_id, track_id AS lane FROM ev), cu AS (SELECT media_id, event_id, track_id AS lane FROM ev), rm AS (SELECT media_id, lane, CASE media_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN NULL ELSE 'nowhere' END AS move_to FROM la WHERE lane IN ('click', 'error'))"
#: Removed are unfixed lanes ('error' is fixed) whose target is known, or null.
GONE_SQL = f"{LANE_SQL}, go AS (SELECT r.* FROM rm r WHERE lane <> 'error' AND (move_to IS NULL OR EXISTS (SELECT 1 FROM la WHERE la.media_id = r.media_id AND la.lane = r.move_to)))"


def lanes(spark, d):
    ev = timeline(spark, d)
    la = ev.select("media_id", F.col("track_id").alias("lane")).distinct()
    to = F.when(F.col("media_id") % 3 == 0, "view").when(F.col("media_id") % 3 == 2, "nowhere")
    gone = la.where("lane IN ('click', 'error')").withColumn("move_to", to)
    return ed.remove_lanes(la, ev.select("media_id", "event_id", F.col("track_id").alias("lane")), gone, BY, ("error",))


@query("removed_lanes", f"WITH {GONE_SQL} SELECT la.* FROM la ANTI JOIN go USING (media_id, lane)")
def removed_lanes(spark, d):
    return lanes(spark, d)[0]


@query("moved_cuts", f"WITH {GONE_SQL} SELECT cu.media_id, event_id, coalesce(move_to, cu.lane) AS lane FROM cu LEFT JOIN go ON go.media_id = cu.media_id AND go.lane = cu.lane WHERE go.lane IS NULL OR move_to IS NOT NULL")
def moved_cuts(spark, d):
    return lanes(spark, d)[1]


#: Clips one behind the other on three tracks, with a gap before every fourth.
TRACK_SQL = f"""{EV_SQL}, n0 AS (SELECT media_id, event_id AS id, 1 + event_id % 3 AS track, 60000 * (1 + k % 9) AS len, CASE WHEN k % 4 = 0 THEN 90000 ELSE 0 END AS gap, row_number() OVER (PARTITION BY media_id, event_id % 3 ORDER BY t_ini, event_id) AS n FROM ev),
 cl AS (SELECT media_id, id, track, CAST(sum(len + gap) OVER w - len AS BIGINT) AS seq_ini, CAST(sum(len + gap) OVER w AS BIGINT) AS seq_fin FROM n0 WINDOW w AS (PARTITION BY media_id, track ORDER BY n))"""


def tracked(spark, d):
    w = Window.partitionBy("media_id", "track").orderBy("t_ini", "event_id")
    rows = timeline(spark, d).withColumn("track", 1 + F.col("event_id") % 3).withColumn("len", 60_000 * (1 + F.col("k") % 9)).withColumn("gap", F.when(F.col("k") % 4 == 0, 90_000).otherwise(0))
    rows = rows.withColumn("seq_fin", F.sum(F.col("len") + F.col("gap")).over(w).cast("long"))
    return rows.select("media_id", F.col("event_id").alias("id"), "track", (F.col("seq_fin") - F.col("len")).cast("long").alias("seq_ini"), "seq_fin")


@query(
    "insert_moves",
    f"""WITH {TRACK_SQL}, mv AS (SELECT media_id, min(id) AS mid, 100000 + 70000 * (media_id % 13) AS tgt, 1 + media_id % 3 AS onto FROM cl GROUP BY media_id),
 m AS (SELECT mv.*, track AS org, seq_fin AS fin, seq_fin - seq_ini AS len FROM mv JOIN cl ON cl.media_id = mv.media_id AND cl.id = mid),
 a AS (SELECT cl.*, m.* EXCLUDE (media_id), id = mid AS self, CASE WHEN id <> mid AND track = org AND seq_ini >= fin THEN len ELSE 0 END AS back FROM cl JOIN m USING (media_id)),
 e AS (SELECT media_id, any_value(CASE WHEN tgt - (seq_ini - back) < seq_fin - back - tgt THEN seq_ini - back ELSE seq_fin - back END) AS edge FROM a WHERE NOT self AND track = onto AND seq_ini - back < tgt AND tgt < seq_fin - back GROUP BY 1),
 f AS (SELECT a.*, coalesce(edge, tgt) AS t FROM a LEFT JOIN e USING (media_id)),
 g AS (SELECT *, CASE WHEN self THEN t ELSE seq_ini - back + CASE WHEN track = onto AND seq_ini - back >= t THEN len ELSE 0 END END AS s FROM f)
 SELECT media_id, id, CAST(CASE WHEN self THEN onto ELSE track END AS BIGINT) AS track, CAST(s AS BIGINT) AS seq_ini, CAST(s + seq_fin - seq_ini AS BIGINT) AS seq_fin FROM g""",
)
def insert_moves(spark, d):
    clips = tracked(spark, d)
    moves = clips.groupBy("media_id").agg(F.min("id").alias("id")).withColumn("to_ini", 100_000 + 70_000 * (F.col("media_id") % 13)).withColumn("to_track", 1 + F.col("media_id") % 3)
    out = ed.insert_move(clips, moves, BY, "id")
    return out.select("media_id", "id", *(F.col(c).cast("long").alias(c) for c in ("track", "seq_ini", "seq_fin")))


@query(
    "shifted_sets",
    f"""WITH {TRACK_SQL}, ch AS (SELECT media_id, id FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq_ini DESC, id) AS r FROM cl) WHERE r <= 1 + media_id % 3),
 mk AS (SELECT cl.*, ch.id IS NOT NULL AS c FROM cl LEFT JOIN ch ON ch.media_id = cl.media_id AND ch.id = cl.id),
 dl AS (SELECT media_id, greatest(-200000, -min(seq_ini)) AS dt, greatest(-1, 1 - min(track)) AS dn FROM mk WHERE c GROUP BY 1),
 nw AS (SELECT mk.*, track + CASE WHEN c THEN dn ELSE 0 END AS nt, seq_ini + CASE WHEN c THEN dt ELSE 0 END AS a, seq_fin + CASE WHEN c THEN dt ELSE 0 END AS b FROM mk JOIN dl USING (media_id)),
 ov AS (SELECT DISTINCT x.media_id FROM nw x JOIN nw y ON x.media_id = y.media_id AND x.nt = y.nt AND x.c AND NOT y.c AND x.a < y.b AND y.a < x.b)
 SELECT media_id, id, CAST(CASE WHEN m THEN nt ELSE track END AS BIGINT) AS track, CAST(CASE WHEN m THEN a ELSE seq_ini END AS BIGINT) AS seq_ini, CAST(CASE WHEN m THEN b ELSE seq_fin END AS BIGINT) AS seq_fin, m AS moved
 FROM (SELECT nw.*, c AND ov.media_id IS NULL AS m FROM nw LEFT JOIN ov USING (media_id))""",
)
def shifted_sets(spark, d):
    clips = tracked(spark, d)
    r = F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("seq_ini"), "id"))
    chosen = clips.withColumn("r", r).where(F.col("r") <= 1 + F.col("media_id") % 3)
    out = ed.shift_set(clips, chosen, BY, "id", -200_000, -1)
    return out.select("media_id", "id", *(F.col(c).cast("long").alias(c) for c in ("track", "seq_ini", "seq_fin")), "moved")


@query(
    "spare_tracks",
    f"WITH {EV_SQL}, us AS (SELECT media_id, max(1 + k % 5) AS top FROM ev WHERE value > 60 GROUP BY 1), al AS (SELECT DISTINCT media_id FROM ev) SELECT al.media_id, CAST(t.n AS INTEGER) AS track, CASE WHEN t.n <= 8 AND t.n % 2 = 1 THEN 'V' || t.n END AS name FROM al LEFT JOIN us USING (media_id), range(1, 20) t(n) WHERE t.n <= coalesce(top, 0) + 1",
)
def spare_tracks(spark, d):
    ev = timeline(spark, d)
    declared = ev.select("media_id").distinct().withColumn("track", F.explode(F.array(*map(F.lit, (1, 3, 5, 7))))).withColumn("name", F.concat(F.lit("V"), F.col("track").cast("string")))
    return ed.spare_tracks(declared, ev.where("value > 60").select("media_id", (1 + F.col("k") % 5).cast("int").alias("track")), BY)


CODE = lambda c: f"printf('%02d:%02d:%02d.%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


@query(
    "montage_lines",
    f"""WITH {EV_SQL}, tp AS (SELECT media_id, track_id || '-' || k % 3 AS item_id, 'About ' || track_id AS label, CASE WHEN k % 3 > 0 THEN track_id || '-0' END AS parent_id, t_ini, t_fin FROM ev WHERE track_id IN ('purchase', 'signup') AND value > 50),
 rt AS (SELECT DISTINCT media_id, item_id FROM tp WHERE parent_id IS NULL),
 nm AS (SELECT tp.*, row_number() OVER (PARTITION BY media_id, item_id ORDER BY t_ini, t_fin) AS part, count(*) OVER (PARTITION BY media_id, item_id) AS parts, CASE WHEN parent_id IS NOT NULL AND EXISTS (SELECT 1 FROM rt WHERE rt.media_id = tp.media_id AND rt.item_id = tp.parent_id) THEN 'Subtopic' ELSE 'Topic' END AS kind FROM tp),
 ln AS (SELECT media_id, t_ini AS t, 0 AS p, item_id AS id, '## > ' || kind || ': ' || label || ' (' || item_id || ')' || CASE WHEN parts > 1 THEN ' · part ' || part || '/' || parts ELSE '' END AS line FROM nm
  UNION ALL SELECT media_id, t_fin, 2, item_id, '## < end: ' || label || ' (' || item_id || ')' FROM nm
  UNION ALL SELECT media_id, t_ini, 1, CAST(event_id AS VARCHAR), {CODE('t_ini')} || '–' || {CODE('t_fin')} || ' [' || track_id || '] ' || k FROM ev WHERE track_id = 'view')
 SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY t, p, id, line) AS INTEGER) AS line_no, t, line FROM ln""",
)
def montage_lines(spark, d):
    ev = timeline(spark, d)
    topics = ev.where("track_id IN ('purchase', 'signup') AND value > 50").select("media_id", F.concat("track_id", F.lit("-"), (F.col("k") % 3).cast("string")).alias("item_id"), F.concat(F.lit("About "), "track_id").alias("label"), F.when(F.col("k") % 3 > 0, F.concat("track_id", F.lit("-0"))).alias("parent_id"), "t_ini", "t_fin")
    said = ev.where("track_id = 'view'").select("media_id", F.col("event_id").alias("id"), "t_ini", "t_fin", F.col("track_id").alias("track"), F.col("k").cast("string").alias("text"))
    return rv.montage_lines(said, topics, BY)


@query(
    "annotated_lines",
    f"""WITH {EV_SQL}, ph AS (SELECT media_id, CAST(event_id AS VARCHAR) AS id, t_ini, t_fin, track_id AS text FROM ev WHERE track_id = 'view' AND value < 30), bo AS (SELECT media_id, max(t_fin) AS hi FROM ev GROUP BY 1),
 g0 AS (SELECT media_id, coalesce(max(t_fin) OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, t_ini AS b FROM ph UNION ALL SELECT bo.media_id, coalesce(max(ph.t_fin), 0), any_value(hi) FROM bo LEFT JOIN ph USING (media_id) GROUP BY 1),
 rw AS (SELECT media_id, t_ini, t_fin, 'phrase' AS kind, id, text FROM ph UNION ALL SELECT DISTINCT media_id, a, b, 'gap', '', '' FROM g0 WHERE b - a >= 7200000),
 ti AS (SELECT media_id, track_id AS lane, CASE WHEN value >= 95 THEN 3 WHEN value >= 80 THEN 2 WHEN value >= 50 THEN 1 ELSE 0 END AS tier, t_ini, t_fin FROM ev WHERE track_id <> 'view'),
 be AS (SELECT rw.media_id, rw.t_ini, rw.t_fin, kind, id, lane, max(tier) AS tier FROM rw JOIN ti ON ti.media_id = rw.media_id AND ti.t_ini < rw.t_fin AND ti.t_fin > rw.t_ini WHERE tier > 0 GROUP BY 1, 2, 3, 4, 5, 6),
 st AS (SELECT media_id, t_ini, t_fin, kind, id, string_agg(lane || ':' || tier, ' ' ORDER BY lane || ':' || tier) AS tiers, bool_or(tier >= 2 OR lane = 'signup') AS loud FROM be GROUP BY 1, 2, 3, 4, 5)
 SELECT rw.media_id, rw.t_ini, rw.t_fin, rw.kind, rw.id, text, coalesce(tiers, '') AS tiers FROM rw LEFT JOIN st ON st.media_id = rw.media_id AND st.t_ini = rw.t_ini AND st.t_fin = rw.t_fin AND st.kind = rw.kind AND st.id = rw.id WHERE rw.kind = 'phrase' OR loud""",
)
def annotated_lines(spark, d):
    ev = timeline(spark, d)
    phrases = ev.where("track_id = 'view' AND value < 30").select("media_id", F.col("event_id").alias("id"), "t_ini", "t_fin", F.col("track_id").alias("text"))
    tier = F.when(F.col("value") >= 95, 3).when(F.col("value") >= 80, 2).when(F.col("value") >= 50, 1).otherwise(0)
    events = ev.where("track_id <> 'view'").select("media_id", F.col("track_id").alias("lane"), tier.alias("tier"), "t_ini", "t_fin")
    return rv.annotated_lines(phrases, events, BY, ev.groupBy("media_id").agg(F.max("t_fin").alias("hi")), 2 * HOUR, ("signup",), BIN)


@query(
    "author_ledger",
    f"""WITH {EV_SQL}, mk AS (SELECT media_id, CAST(event_id AS VARCHAR) AS id, CASE k % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' END AS decision, t_ini, t_fin FROM ev WHERE track_id = 'signup'),
 al AS (SELECT media_id, 1 AS section, t_ini, t_fin, id AS ids, CASE decision WHEN 'include' THEN 'must be in' WHEN 'exclude' THEN 'must not be in' ELSE 'note' END AS rule FROM mk
  UNION ALL SELECT i.media_id, 2, greatest(i.t_ini, x.t_ini), least(i.t_fin, x.t_fin), i.id || '&' || x.id, 'conflict: exclude wins' FROM mk i JOIN mk x ON i.media_id = x.media_id AND i.decision = 'include' AND x.decision = 'exclude' AND i.t_ini < x.t_fin AND x.t_ini < i.t_fin
  UNION ALL SELECT media_id, 3, t_ini, t_fin, CAST(event_id AS VARCHAR), 'spoken: its time is out' FROM ev WHERE track_id = 'error' AND k < 20)
 SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY section, t_ini, t_fin, ids) AS INTEGER) AS line_no, section, t_ini, t_fin, ids, rule FROM al""",
)
def author_ledger(spark, d):
    ev = timeline(spark, d).withColumn("id", F.col("event_id"))
    decision = F.when(F.col("k") % 3 == 0, "include").when(F.col("k") % 3 == 1, "exclude")
    return rv.author_ledger(ev.where("track_id = 'signup'").withColumn("decision", decision), ev.where("track_id = 'error' AND k < 20"), BY, BIN)


#: A frame of a track's curve: the largest value of six hours; chunks have 40 frames and share 10 with the next.
FRAME = 6 * HOUR


@query(
    "stitched_chunks",
    f"""WITH {EV_SQL}, fr AS (SELECT track_id, t_ini // {FRAME} AS f, max(value) AS score FROM ev GROUP BY 1, 2),
 ch AS (SELECT track_id, c * 30 AS c0, f - c * 30 AS n, score FROM fr, unnest(range(greatest(0, (f - 10) // 30), f // 30 + 1)) AS u(c) WHERE f - c * 30 < 40),
 ab AS (SELECT *, n - row_number() OVER (PARTITION BY track_id, c0 ORDER BY n) AS run FROM ch WHERE score > 50),
 sp AS (SELECT track_id, (c0 + min(n)) * {FRAME} AS a, (c0 + max(n)) * {FRAME} AS b FROM ab GROUP BY track_id, c0, run HAVING count(*) > 2),
 nx AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY track_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM sp),
 gr AS (SELECT *, sum(fresh) OVER (PARTITION BY track_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM nx)
 SELECT track_id, min(a) AS t_ini, max(b) AS t_fin, count(*) AS n_parts FROM gr GROUP BY track_id, g""",
)
def stitched_chunks(spark, d):
    scores = timeline(spark, d).groupBy("track_id", F.floor(F.col("t_ini") / FRAME).alias("f")).agg(F.max("value").alias("score"))
    chunks = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("f") - 39) / 30)), F.floor(F.col("f") / 30)))
    frames = scores.withColumn("c", chunks).select("track_id", (F.col("c") * 30 * FRAME).alias("c0"), (F.col("f") - F.col("c") * 30).alias("n"), "score")
    return sq.stitch_chunks(frames, ["track_id"], "c0", "n", "score", 50.0, 2, FRAME)


@query(
    "proposal_findings",
    f"""WITH {EV_SQL}, cl AS (SELECT media_id, event_id, t_ini, t_fin, CASE WHEN k % 3 = 0 THEN ' ' ELSE track_id END AS reason, k % 2 = 0 AS again FROM ev),
 k AS (SELECT a.media_id, a.event_id, a.again AND trim(a.reason) <> '' AS meant, b.event_id AS other FROM cl a JOIN cl b ON a.media_id = b.media_id AND b.event_id < a.event_id AND a.t_ini < b.t_fin - 1000 AND a.t_fin > b.t_ini + 1000)
 SELECT media_id, event_id, CASE WHEN meant THEN 'warning' ELSE 'error' END AS level, CASE WHEN meant THEN 'callback' ELSE 'repeats' END AS kind, other FROM k
 UNION ALL SELECT media_id, event_id, 'warning', 'short', NULL FROM cl WHERE t_fin - t_ini < {HOUR} * 0.8
 UNION ALL SELECT media_id, event_id, 'warning', 'long', NULL FROM cl WHERE t_fin - t_ini > {4 * HOUR} * 1.2
 UNION ALL SELECT media_id, event_id, 'warning', 'no_reason', NULL FROM cl WHERE trim(reason) = ''
 UNION ALL SELECT media_id, NULL, 'warning', 'off_target', NULL FROM cl GROUP BY media_id HAVING media_id % 5 > 0 AND abs(sum(t_fin - t_ini) - media_id % 5 * {20 * HOUR}) > media_id % 5 * {20 * HOUR} * 0.1""",
)
def proposal_findings(spark, d):
    ev = timeline(spark, d)
    clips = ev.select("media_id", "event_id", "t_ini", "t_fin", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("track_id")).alias("reason"), (F.col("k") % 2 == 0).alias("repeat"))
    targets = ev.select("media_id").distinct().withColumn("target", F.col("media_id") % 5 * (20 * HOUR))
    return dc.proposal_findings(clips, BY, "event_id", "event_id", targets, 0.1, HOUR, 4 * HOUR, 1000, BIN)


@query(
    "winning_documents",
    """WITH c AS (SELECT o_custkey AS media_id, o_orderkey % 3 AS theirs, CASE WHEN o_orderkey % 2 = 0 THEN 'store' ELSE 'sidecar' END AS origin, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 4 END AS revision, o_orderkey % 31 > 0 AS readable, o_orderkey % 5 AS n_items FROM orders),
 m AS (SELECT c_custkey AS media_id, c_custkey % 3 AS identity FROM customer),
 b AS (SELECT media_id, bool_or(NOT readable) AS broken FROM c GROUP BY 1),
 w AS (SELECT media_id, origin, coalesce(revision, 0) AS revision, n_items, row_number() OVER (PARTITION BY media_id ORDER BY coalesce(revision, 0) DESC, CASE origin WHEN 'sidecar' THEN 0 ELSE 1 END, origin DESC, n_items DESC) AS r FROM c JOIN m USING (media_id) WHERE readable AND theirs = identity),
 o AS (SELECT m.media_id, CASE WHEN coalesce(broken, false) THEN 'error' WHEN coalesce(n_items, 0) = 0 THEN 'none' ELSE 'found' END AS outcome, origin, revision, n_items FROM m LEFT JOIN b USING (media_id) LEFT JOIN (SELECT * FROM w WHERE r = 1) x ON x.media_id = m.media_id)
 SELECT media_id, outcome, CASE WHEN outcome = 'found' THEN origin END AS origin, CASE WHEN outcome = 'found' THEN revision END AS revision, CASE WHEN outcome = 'found' THEN n_items END AS n_items FROM o""",
)
def winning_documents(spark, d):
    key = F.col("o_orderkey")
    found = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("media_id"), (key % 3).alias("identity"), F.when(key % 2 == 0, "store").otherwise("sidecar").alias("origin"),
        F.when(key % 7 > 0, key % 4).alias("revision"), (key % 31 > 0).alias("readable"), (key % 5).alias("n_items"),
    )
    media = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("media_id"), (F.col("c_custkey") % 3).alias("identity"))
    return dc.resolve_candidates(media, found, BY, "identity", "sidecar", strict=True)


@query(
    "view_bundle",
    f"""WITH {UT_SQL} SELECT conv_id, 'subtitles' AS view, row_number() OVER (PARTITION BY conv_id ORDER BY t_ini, turn) AS line_no, text AS line FROM ut
 UNION ALL SELECT conv_id, 'inventory', row_number() OVER (PARTITION BY conv_id ORDER BY role), role || ': ' || count(*) FROM ut GROUP BY conv_id, role""",
)
def view_bundle(spark, d):
    ut, by = utterances(spark, d), ["conv_id"]
    subtitles = ms.subtitles(ut, by, "text", "turn").select("conv_id", F.col("no").alias("line_no"), F.col("body").alias("line"))
    counts = ut.groupBy("conv_id", "role").count()
    inventory = counts.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("role")).alias("line_no"), F.concat("role", F.lit(": "), F.col("count").cast("string")).alias("line"))
    return rv.bundle({"subtitles": subtitles, "inventory": inventory}, by)


@query(
    "strong_signals",
    f"""WITH {EV_SQL}, s AS (SELECT media_id, avg(value) AS mu, stddev_pop(value) AS sd FROM ev GROUP BY 1),
 z AS (SELECT media_id, event_id, t_ini FROM ev JOIN s USING (media_id) WHERE (value - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END >= 1.0),
 n AS (SELECT media_id, event_id, row_number() OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS n FROM z) SELECT media_id, event_id, n FROM n WHERE n <= 5""",
)
def strong_signals(spark, d):
    return ms.signals(timeline(spark, d), BY, "value", 1.0, 5).select("media_id", "event_id", F.col("n").cast("long").alias("n"))


@query("pixel_rectangles", "SELECT p_partkey, CAST(round(p_partkey % 7 / 7.0 * 1920) AS INTEGER) AS x, CAST(round(p_partkey % 11 / 11.0 * 1080) AS INTEGER) AS y, CAST(round(p_size / 51.0 * 1920) AS INTEGER) AS w, CAST(round(p_size / 53.0 * 1080) AS INTEGER) AS h FROM part")
def pixel_rectangles(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    box = sc.rect_pixels(k % 7 / 7.0, k % 11 / 11.0, size / 51.0, size / 53.0, 1920, 1080)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", box.alias("box")).select("p_partkey", "box.*")
