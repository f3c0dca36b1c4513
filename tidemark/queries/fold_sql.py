"""SQL of the queries whose choices depend on the choices before, or on safety near a place."""

from __future__ import annotations

from ..sources.timeline import EV_SQL, UT_SQL


def snap_sql(radius: int | None, reach: int) -> str:
    """sn (media_id, id, target, snapped, n_hard, n_soft) from tg (media_id, id, target; without a radius also lower and upper), hd and sf (media_id, a, b)."""
    bounds = "*" if radius is None else f"*, target - {radius} AS lower, target + {radius} AS upper"
    return f"""w AS (SELECT {bounds} FROM tg),
 ed AS (SELECT media_id, a AS e FROM hd UNION SELECT media_id, b FROM hd UNION SELECT media_id, a FROM sf UNION SELECT media_id, b FROM sf),
 eg AS (SELECT w.media_id, id, greatest(a, lower) AS a, least(b, upper) AS b FROM w JOIN hd USING (media_id) WHERE a < upper AND b > lower AND b > a UNION ALL SELECT media_id, id, upper, NULL FROM w),
 gp AS (SELECT media_id, id, a AS z, max(b) OVER (PARTITION BY media_id, id ORDER BY a, b NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM eg),
 ca AS (SELECT media_id, id, target, unnest([target, lower, upper]) AS c FROM w
  UNION SELECT w.media_id, id, target, greatest(lower, e - 1) FROM w JOIN ed USING (media_id) WHERE e BETWEEN lower AND upper
  UNION SELECT w.media_id, id, target, least(upper, e + 1) FROM w JOIN ed USING (media_id) WHERE e BETWEEN lower AND upper
  UNION SELECT w.media_id, w.id, target, CAST(trunc((coalesce(r, lower) + z) / 2.0) AS BIGINT) FROM gp JOIN w USING (media_id, id) WHERE z > coalesce(r, lower)),
 pt AS (SELECT DISTINCT media_id, c FROM ca),
 ph AS (SELECT pt.media_id, c, count(*) FILTER (a < c AND c < b) AS nh, least({reach}, min(least(abs(c - a), abs(c - b))) FILTER (NOT (a < c AND c < b))) AS room FROM pt LEFT JOIN hd USING (media_id) GROUP BY 1, 2),
 ps AS (SELECT pt.media_id, c, count(*) FILTER (a < c AND c < b) AS ns FROM pt LEFT JOIN sf USING (media_id) GROUP BY 1, 2),
 sc AS (SELECT ca.*, nh, ns, row_number() OVER (PARTITION BY media_id, id ORDER BY nh, ns, room DESC, abs(c - target), c) AS r FROM ca JOIN ph USING (media_id, c) JOIN ps USING (media_id, c)),
 sn AS (SELECT media_id, id, target, c AS snapped, nh AS n_hard, ns AS n_soft FROM sc WHERE r = 1)"""


SAFE_SQL = f"{EV_SQL}, hd AS (SELECT media_id, t_ini AS a, t_fin AS b FROM ev WHERE track_id = 'view'), sf AS (SELECT media_id, t_ini AS a, t_fin AS b FROM ev WHERE track_id = 'click')"

BOUNDARY_SNAP = f"""WITH {SAFE_SQL}, tg AS (SELECT DISTINCT media_id, CAST(n AS INTEGER) AS id, n * 259200000 AS target FROM ev, range(1, 10) r(n)), {snap_sql(21_600_000, 3_600_000)}
 SELECT media_id, id AS chunk_no, target, snapped, n_hard, n_soft FROM sn"""

#: No limit depends on the boundary before: chunks of 72 hours, 90 at most, boundaries moved by 6.
SNAPPED_PLAN = f"""WITH {SAFE_SQL}, tg AS (SELECT DISTINCT media_id, CAST(n AS INTEGER) AS id, n * 259200000 AS target, n * 259200000 - 21600000 AS lower, n * 259200000 + 21600000 AS upper FROM ev, range(1, 10) r(n)), {snap_sql(None, 3_600_000)}
 SELECT media_id, id AS chunk_no, target, snapped, n_hard, n_soft, CASE WHEN n_hard > 0 THEN 'crosses' END AS error FROM sn"""

_TOPICS = "SELECT DISTINCT media_id, i, i * 864000000 AS z FROM ev, range(0, 3) r(i)"
_top, _sub = (snap_sql(None, 3_600_000) for _ in range(2))
#: The same search twice: the second with windows cut to what the first found.
SNAPPED_TOPICS = f"""WITH {SAFE_SQL}, tp AS ({_TOPICS}),
 e1 AS (SELECT media_id, 't' || i AS item, 'a' AS e, z + 36000000 AS t FROM tp UNION ALL SELECT media_id, 't' || i, 'b', z + 828000000 FROM tp),
 r1 AS (WITH tg AS (SELECT media_id, item || '/' || e AS id, t AS target, t - 21600000 AS lower, t + 21600000 AS upper FROM e1), {_top} SELECT * FROM sn),
 d1 AS (SELECT media_id, split_part(id, '/', 1) AS item, max(snapped) FILTER (id LIKE '%/a') AS s_ini, max(snapped) FILTER (id LIKE '%/b') AS s_fin, max(n_hard) > 0 AS crosses FROM r1 GROUP BY 1, 2),
 e2 AS (SELECT tp.media_id, 's' || i AS item, e, z + t AS t, s_ini AS p, s_fin AS q FROM tp JOIN d1 ON d1.media_id = tp.media_id AND item = 't' || i, (VALUES ('a', 32400000), ('b', 360000000)) v(e, t)),
 r2 AS (WITH tg AS (SELECT media_id, item || '/' || e AS id, greatest(p, least(q, t)) AS target, greatest(p, least(q, t - 21600000)) AS lower, greatest(p, least(q, t + 21600000)) AS upper FROM e2), {_sub} SELECT * FROM sn),
 d2 AS (SELECT media_id, split_part(id, '/', 1) AS item, max(snapped) FILTER (id LIKE '%/a') AS s_ini, max(snapped) FILTER (id LIKE '%/b') AS s_fin, max(n_hard) > 0 AS crosses FROM r2 GROUP BY 1, 2)
 SELECT media_id, item AS item_id, s_ini, s_fin, crosses FROM d1 UNION ALL SELECT * FROM d2"""

SNAPPED_PROPOSAL = f"""WITH {SAFE_SQL}, pr AS (SELECT media_id, event_id, t_ini, t_fin FROM ev WHERE track_id = 'purchase'),
 tg AS (SELECT media_id, event_id || '/a' AS id, t_ini AS target FROM pr UNION ALL SELECT media_id, event_id || '/b', t_fin FROM pr), {snap_sql(7_200_000, 3_600_000)}
 SELECT pr.*, x.snapped AS s_ini, y.snapped AS s_fin, concat_ws(',', CASE WHEN y.snapped - x.snapped < 3600000 THEN 'too_short' END, CASE WHEN x.n_hard + y.n_hard > 0 THEN 'crosses' END, CASE WHEN x.snapped <> t_ini OR y.snapped <> t_fin THEN 'moved' END) AS warnings
 FROM pr JOIN sn x ON x.media_id = pr.media_id AND x.id = event_id || '/a' JOIN sn y ON y.media_id = pr.media_id AND y.id = event_id || '/b'"""

def plan_sql(ctes: str, scored: str, key: str, t: str, score: str, bounds: str, target: int, longest: int, shortest: int, nearby: int) -> str:
    """Chunk plan of the table ``scored`` of the given CTEs, boundary by boundary."""
    return f"""WITH RECURSIVE {ctes}, bo AS ({bounds}),
 ba AS (SELECT {key}, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(greatest(1, ceil((hi - lo) / {target}.0), ceil((hi - lo) / {longest}.0)) AS INTEGER) AS n FROM bo),
 le AS (SELECT {key}, lo, hi, n, (hi - lo) / n AS ideal, least({shortest}.0, 0.2 * ((hi - lo) / n)) AS least_len, (SELECT list({{'t': CAST({t} AS DOUBLE), 's': {score}}}) FROM {scored} WHERE {scored}.{key} = ba.{key}) AS es FROM ba),
 st AS (SELECT {key}, 0 AS k, lo AS edge FROM le UNION ALL
  SELECT {key}, CAST(k AS INTEGER), coalesce(list_sort(list_transform(list_filter(es, lambda x: x.t > low AND x.t < high), lambda x: {{'far': abs(x.t - goal) > greatest({nearby}, 0.28 * ideal), 's': -(x.s - 0.35 * abs(x.t - goal) / greatest(1.0, ideal)), 't': x.t}}))[1].t, greatest(low, least(high, goal)))
  FROM (SELECT le.*, st.k + 1 AS k, lo + ideal * (st.k + 1) AS goal, greatest(edge + least_len, hi - (n - st.k - 1) * {longest}.0) AS low, least(edge + {longest}.0, hi - (n - st.k - 1) * least_len) AS high FROM st JOIN le USING ({key}) WHERE st.k + 1 < n)),
 al AS (SELECT * FROM st UNION ALL SELECT {key}, n, hi FROM le)
 SELECT {key}, k AS chunk_no, lag_edge AS t_ini, edge AS t_fin FROM (SELECT *, lag(edge) OVER (PARTITION BY {key} ORDER BY k) AS lag_edge FROM al) WHERE k > 0"""


CHUNK_PLAN = plan_sql(EV_SQL, "ev", "media_id", "t_ini", "value", "SELECT media_id, 0 AS lo, max(t_fin) + 3600000 AS hi FROM ev GROUP BY 1", 259_200_000, 345_600_000, 21_600_000, 300_000)

PEAK_SQL = f"{EV_SQL}, o AS (SELECT media_id, t_ini AS t, value AS v, row_number() OVER w AS n, lag(value) OVER w AS p, lead(value) OVER w AS q FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini))"

SEPARATED_PEAKS = f"""WITH RECURSIVE {PEAK_SQL}, pk AS (SELECT media_id, t, v, row_number() OVER (PARTITION BY media_id ORDER BY v DESC, t) AS n FROM o WHERE (p IS NULL OR v > p) AND (q IS NULL OR v >= q) AND v >= 30),
 ta AS (SELECT media_id, n, [t] AS taken, TRUE AS took FROM pk WHERE n = 1 UNION ALL
  SELECT media_id, n, CASE WHEN free THEN list_append(taken, t) ELSE taken END, free FROM (SELECT pk.media_id, pk.n, pk.t, taken, len(list_filter(taken, lambda x: abs(x - pk.t) < 43200000)) = 0 AS free FROM ta JOIN pk ON pk.media_id = ta.media_id AND pk.n = ta.n + 1))
 SELECT media_id, t AS peak_t, v AS peak FROM ta JOIN pk USING (media_id, n) WHERE took"""

PROMINENT_PEAKS = f"""WITH {PEAK_SQL}, pk AS (SELECT * FROM o WHERE v > p AND v >= q),
 l AS (SELECT pk.media_id, pk.n, coalesce(max(o.n), 0) AS l FROM pk LEFT JOIN o ON o.media_id = pk.media_id AND o.n < pk.n AND o.v > pk.v GROUP BY 1, 2),
 r AS (SELECT pk.media_id, pk.n, coalesce(min(o.n), 1e15) AS r FROM pk LEFT JOIN o ON o.media_id = pk.media_id AND o.n > pk.n AND o.v > pk.v GROUP BY 1, 2),
 m AS (SELECT pk.media_id, pk.t, pk.v, pk.v - greatest(min(o.v) FILTER (o.n <= pk.n), min(o.v) FILTER (o.n >= pk.n)) AS rise FROM pk JOIN l USING (media_id, n) JOIN r USING (media_id, n) JOIN o ON o.media_id = pk.media_id AND o.n BETWEEN l AND r GROUP BY 1, 2, 3)
 SELECT media_id, t AS peak_t, v AS peak, round(rise, 6) AS prominence FROM m WHERE rise >= 50"""

PRESENCE_ABSENCES = f"""WITH {EV_SQL}, o AS (SELECT media_id, t_ini AS t, track_id <> 'error' AS s, lag(track_id <> 'error') OVER w AS p, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini)),
 u AS (SELECT *, sum(CASE WHEN p = s THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY n) AS run FROM o),
 r AS (SELECT media_id, run, any_value(s) AS s, min(t) AS a, max(t) AS b FROM u GROUP BY 1, 2),
 f AS (SELECT *, last_value(CASE WHEN run = 1 OR b - a >= 7200000 THEN s END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM r),
 c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY media_id ORDER BY run) = state THEN 0 ELSE 1 END AS nw FROM f),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY run) AS g FROM c),
 s AS (SELECT media_id, g, any_value(state) AS state, min(a) AS t_ini, max(b) AS t_fin, g = max(g) OVER (PARTITION BY media_id) AS at_end FROM g GROUP BY 1, 2)
 SELECT media_id, t_ini, t_fin, at_end FROM s WHERE NOT state"""

PAIRWISE_MERGE = f"""WITH {EV_SQL}, o AS (SELECT media_id, t_ini, t_fin, value, value / 2 AS mu, lag(t_fin) OVER w AS p, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY media_id ORDER BY t_ini, t_fin, value)),
 g AS (SELECT *, sum(CASE WHEN t_ini - p < 3600000 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY n) AS g FROM o),
 m AS (SELECT media_id, min(t_ini) AS t_ini, arg_max(t_fin, n) AS t_fin, max(value) AS peak, round(list_reduce(list(mu ORDER BY n), lambda x, y: (x + y) / 2) + 1e-9, 6) AS mean FROM g GROUP BY media_id, g)
 SELECT * FROM m WHERE t_fin - t_ini >= 1800000"""

WAKE_SPANS = f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT media_id, t_ini AS a, greatest(t_ini, t_fin) AS b, track_id AS s, track_id = 'signup' AS wake, row_number() OVER (PARTITION BY media_id ORDER BY t_ini, t_fin, track_id) AS n FROM ev),
 pr AS (SELECT i.media_id, i.n AS i, i.a AS a0, k.n AS k, k.a, k.b, k.s, k.wake, greatest(i.b, max(k.b) OVER (PARTITION BY i.media_id, i.n ORDER BY k.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS reach, greatest(i.b, k.b) AS b1 FROM o i JOIN o k ON i.media_id = k.media_id AND k.n > i.n WHERE i.wake),
 st AS (SELECT *, CASE WHEN a - reach >= 43200000 THEN 'silence' WHEN wake AND a - a0 > 7200000 THEN 'invocation' WHEN b - a0 > 259200000 THEN 'limit' END AS why FROM pr),
 fs AS (SELECT media_id, i, min(k) FILTER (why IS NOT NULL) AS k, max(b1) AS far FROM st GROUP BY 1, 2),
 sp AS (SELECT o.media_id, o.n AS i, o.a AS a0, fs.k, coalesce(st.why, 'end') AS why, CASE WHEN fs.k IS NULL THEN greatest(o.b, fs.far) WHEN st.why = 'invocation' THEN least(st.reach, st.a) ELSE st.reach END AS fin FROM o LEFT JOIN fs ON fs.media_id = o.media_id AND fs.i = o.n LEFT JOIN st ON st.media_id = o.media_id AND st.i = o.n AND st.k = fs.k WHERE o.wake),
 sq AS (SELECT media_id, i, a0, k, CASE WHEN fin - a0 > 259200000 THEN 'limit' ELSE why END AS why, least(fin, a0 + 259200000) AS fin FROM sp),
 nx AS (SELECT x.media_id, x.i, min(y.i) AS nxt FROM sq x LEFT JOIN sq y ON y.media_id = x.media_id AND y.i > x.i AND y.a0 >= x.fin GROUP BY 1, 2),
 ch AS (SELECT media_id, min(i) AS i FROM sq GROUP BY 1 UNION ALL SELECT nx.media_id, nxt FROM ch JOIN nx USING (media_id, i) WHERE nxt IS NOT NULL),
 h AS (SELECT sq.media_id, sq.i, string_agg(o.s, ' ' ORDER BY o.n) FILTER (o.n > sq.i) AS heard, string_agg(o.s, ' ' ORDER BY o.n) FILTER (o.n < sq.i) AS before, max(o.b) FILTER (o.n = sq.i - 1) AS prev FROM sq JOIN o ON o.media_id = sq.media_id AND o.n BETWEEN sq.i - 5 AND coalesce(k - 1, 1000000000) GROUP BY 1, 2)
 SELECT media_id, a0 AS t_ini, fin AS t_fin, why AS cause, greatest(0, a0 - coalesce(prev, 0)) AS pause, coalesce(before, '') AS before, coalesce(heard, '') AS heard FROM ch JOIN sq USING (media_id, i) JOIN h USING (media_id, i)"""


#: Utterances on a clock with pauses; some are marked, and most neighbours share a speaker.
READABLE_BLOCKS = f"""WITH RECURSIVE {UT_SQL}, r AS (SELECT conv_id, CASE WHEN turn % 7 < 5 THEN 'a' ELSE role END AS speaker, turn % 11 = 10 AS blocked, t_ini + turn * 600 AS a, t_fin + turn * 600 AS b, trim(text) AS said,
  CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\\s+')) END AS words, row_number() OVER (PARTITION BY conv_id ORDER BY t_ini, t_fin, turn) AS n FROM ut),
 l AS (SELECT *, coalesce(speaker = lag(speaker) OVER w AND NOT blocked AND NOT lag(blocked) OVER w AND a - lag(b) OVER w BETWEEN 0 AND 2500, FALSE) AS linked, sum(words) OVER w AS upto FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
 nx AS (SELECT i.conv_id, i.n, min(k.n) AS nxt FROM l i JOIN l k ON k.conv_id = i.conv_id AND k.n > i.n AND (NOT k.linked OR k.b - i.a > 60000 OR k.upto - i.upto + i.words > 120) GROUP BY 1, 2),
 ch AS (SELECT conv_id, n FROM l WHERE n = 1 UNION ALL SELECT ch.conv_id, nxt FROM ch JOIN nx USING (conv_id, n)),
 bl AS (SELECT l.*, sum(CASE WHEN ch.n IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY l.conv_id ORDER BY l.n) AS block_no FROM l LEFT JOIN ch ON ch.conv_id = l.conv_id AND ch.n = l.n)
 SELECT conv_id, CAST(block_no AS INTEGER) AS block_no, 'A' AS track, arg_min(speaker, n) AS speaker, min(a) AS t_ini, max(b) AS t_fin, CAST(count(*) AS INTEGER) AS n, CAST(sum(words) AS INTEGER) AS words, coalesce(string_agg(said, ' ' ORDER BY n) FILTER (said <> ''), '') AS text FROM bl GROUP BY conv_id, block_no"""

ACTIVITY_CHUNKS = f"""WITH RECURSIVE {EV_SQL}, o AS (SELECT media_id, CASE WHEN k % 10 = 7 THEN 0 ELSE value / 100 END AS m, k % 10 = 3 AS cut, row_number() OVER (PARTITION BY media_id ORDER BY t_ini, event_id) - 1 AS i FROM ev),
 s1 AS (SELECT media_id, count(*) AS n, list(m ORDER BY i) AS ms, list(cut ORDER BY i) AS cs, list_sort(list(m)) AS so FROM o GROUP BY 1),
 s2 AS (SELECT *, so[1 + CAST(floor(0.1 * (n - 1)) AS BIGINT)] AS noise FROM s1),
 s3 AS (SELECT *, len(list_filter(so, lambda x: x > noise)) AS above FROM s2),
 s4 AS (SELECT *, greatest(CASE WHEN above > 0 THEN so[1 + n - above + above // 2] - noise ELSE 1e-6 END, 1e-6) AS scale FROM s3),
 s5 AS (SELECT media_id, n, ms, cs, list_transform(ms, lambda x: CAST(floor(least(greatest((x - noise) / scale, (x - 0.02) / 0.10, 0), 3) * 1000000 + 0.5) AS BIGINT)) AS acts FROM s4),
 sm AS (SELECT *, list_transform(range(0, n + 1), lambda x: CAST(coalesce(list_sum(acts[1:x]), 0) AS BIGINT)) AS upto FROM s5),
 wl AS (SELECT media_id, CAST(0 AS BIGINT) AS w FROM sm UNION ALL SELECT media_id, nw FROM (SELECT sm.media_id, list_min(list_filter(range(w + 4, n - 3), lambda x: cs[x + 1])) AS nw FROM wl JOIN sm USING (media_id)) WHERE nw IS NOT NULL),
 ww AS (SELECT media_id, list(w) AS ws FROM wl GROUP BY 1),
 ck AS (SELECT media_id, CAST(-1 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS b FROM sm UNION ALL
  SELECT media_id, i, CASE WHEN j < e AND greatest(i + 4, j - 3) < j THEN greatest(i + 4, j - 3) - 1 + list_position(ms[greatest(i + 4, j - 3) + 1:j + 1], list_min(ms[greatest(i + 4, j - 3) + 1:j + 1])) ELSE j END
  FROM (SELECT *, least(i + 44, e, coalesce(list_min(list_filter(range(i + 3, n), lambda x: upto[x + 2] - upto[i + 1] >= 15000000)), n)) AS j
   FROM (SELECT sm.*, ck.b + 1 AS i, coalesce(list_min(list_filter(ws, lambda x: x > ck.b + 1)), n) - 1 AS e FROM ck JOIN sm USING (media_id) JOIN ww USING (media_id) WHERE ck.b + 1 < n))),
 fr AS (SELECT ck.*, CASE WHEN b - a + 1 < 4 AND NOT cs[a + 1] AND NOT list_contains(ws, a) THEN 0 ELSE 1 END AS fresh, upto[b + 2] - upto[a + 1] AS act FROM ck JOIN sm USING (media_id) JOIN ww USING (media_id) WHERE a >= 0),
 gr AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY a) AS chunk_no FROM fr)
 SELECT media_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(min(a) AS INTEGER) AS first, CAST(max(b) AS INTEGER) AS last, sum(act) / 1000000.0 AS activity FROM gr GROUP BY media_id, chunk_no"""


def quota_sql(ctes: str, spacing: int) -> str:
    """se (media_id, n, ok, why) of the table cd (media_id, n in serial order, lane, a, b, ids, always, quota), one after the other."""
    return f"""{ctes},
 ta AS (SELECT media_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a BIGINT, b BIGINT, ids VARCHAR[])[]) AS used, CAST([] AS VARCHAR[]) AS lanes, FALSE AS ok, CAST(NULL AS VARCHAR) AS why FROM (SELECT DISTINCT media_id FROM cd) UNION ALL
  SELECT media_id, n, CASE WHEN w IS NULL THEN list_append(used, {{'a': a, 'b': b, 'ids': ids}}) ELSE used END, CASE WHEN w IS NULL AND NOT always THEN list_append(lanes, lane) ELSE lanes END, w IS NULL, w
  FROM (SELECT cd.*, used, lanes, CASE WHEN always THEN NULL WHEN len(list_filter(used, lambda u: (cd.a < u.b + {spacing} AND u.a - {spacing} < cd.b) OR list_has_any(u.ids, cd.ids))) > 0 THEN 'duplicate'
   WHEN len(list_filter(lanes, lambda l: l = cd.lane)) >= quota THEN 'quota' END AS w FROM ta JOIN cd ON cd.media_id = ta.media_id AND cd.n = ta.n + 1)),
 se AS (SELECT media_id, n, ok, why FROM ta WHERE n > 0)"""


QUOTA_INDEX = f"""WITH RECURSIVE {EV_SQL}, po AS (SELECT *, cume_dist() OVER (PARTITION BY track_id ORDER BY value) AS rank FROM ev),
 {quota_sql("""cd AS (SELECT media_id, event_id, track_id AS lane, t_ini AS a, t_fin AS b, CAST([] AS VARCHAR[]) AS ids, k = 7 AS always, rank, CASE track_id WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 2 WHEN 'view' THEN 4 ELSE 99 END AS quota,
  row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN k = 7 THEN -1 ELSE list_position(['purchase', 'signup', 'click', 'view', 'error'], track_id) END, rank DESC, t_ini, event_id) AS n FROM po WHERE value >= 20)""", 7_200_000)}
 SELECT media_id, event_id AS id, lane, a AS t_ini, b AS t_fin, rank, ok AS accepted, why FROM se JOIN cd USING (media_id, n)"""

#: Peaks of three tracks, orders (k = 7), phrases and pauses of two other tracks; see the query.
INDEX_CTES = f"""{EV_SQL}, po AS (SELECT media_id, CAST(event_id AS VARCHAR) AS id, event_id, track_id AS modality, t_ini, t_fin, t_ini + (t_fin - t_ini) // 2 AS t_peak, cume_dist() OVER (PARTITION BY track_id ORDER BY value) AS rank, value, k FROM ev WHERE track_id IN ('purchase', 'signup', 'view')),
 pl AS (SELECT * FROM po WHERE value >= 40),
 ss AS (SELECT *, sum(CASE WHEN t_peak - p <= 3600000 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t_peak, id) AS g FROM (SELECT *, lag(t_peak) OVER (PARTITION BY media_id ORDER BY t_peak, id) AS p FROM pl)),
 nu AS (SELECT media_id, 'n:' || arg_min(id, (t_peak, id)) AS id, 'multimodal' AS lane, min(t_ini) AS t_ini, max(t_fin) AS t_fin, min(t_peak) AS t_peak, list_sum(list_sort(list(rank), 'DESC')[1:2]) / 2 AS rank, string_agg(id, ',' ORDER BY t_peak, id) AS members, FALSE AS always FROM ss GROUP BY media_id, g HAVING count(DISTINCT modality) >= 2),
 al AS (SELECT * FROM nu UNION ALL SELECT media_id, id, modality, t_ini, t_fin, t_peak, rank, id, FALSE FROM pl UNION ALL SELECT media_id, id, 'order', t_ini, t_fin, t_peak, 1.0, id, TRUE FROM po WHERE k = 7),
 ph AS (SELECT media_id, CAST(event_id AS VARCHAR) AS id, t_ini, t_fin FROM ev WHERE track_id = 'click' AND value < 10),
 th AS (SELECT al.*, coalesce((SELECT list_sort(list(ph.id)) FROM ph WHERE ph.media_id = al.media_id AND ph.t_ini < al.t_fin + 600000 AND ph.t_fin > al.t_ini - 600000), CAST([] AS VARCHAR[])) AS ids FROM al),
 le AS (SELECT media_id, greatest(max(t_fin) / 864000000.0, 0.5) AS scale FROM ev GROUP BY 1),
 cd AS (SELECT th.*, t_ini AS a, t_fin AS b, greatest(1, CAST(round_even(scale * CASE lane WHEN 'multimodal' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 99 END, 0) AS INTEGER)) AS quota,
  row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN always THEN -1 ELSE list_position(['multimodal', 'purchase', 'signup', 'view'], lane) END, rank DESC, t_ini, id) AS n FROM th JOIN le USING (media_id))"""

SIGNAL_INDEX = f"""WITH RECURSIVE {quota_sql(INDEX_CTES, 1_800_000)},
 pz AS (SELECT media_id, CAST(event_id AS VARCHAR) AS id, t_ini, t_fin FROM ev WHERE track_id = 'error' AND value < 50),
 sd AS (SELECT cd.*, (SELECT list(p.id ORDER BY p.t_ini, p.t_fin, p.id) FROM pz p WHERE p.media_id = cd.media_id AND p.t_fin > cd.t_peak - 7200000 AND p.t_fin <= cd.t_peak)[1:3] AS up FROM se JOIN cd USING (media_id, n) WHERE ok)
 SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY t_ini, id, lane) AS INTEGER) AS seed_no, lane, round(least(rank, 1.0), 2) AS strength, t_ini, t_fin, array_to_string(ids, ',') AS phrases, members, coalesce(array_to_string(up, ','), '') AS build_up FROM sd"""

REFUSED_SIGNALS = f"""WITH RECURSIVE {quota_sql(INDEX_CTES, 1_800_000)}
 SELECT media_id, id, lane, t_ini, t_fin, round(rank, 9) AS rank, why FROM se JOIN cd USING (media_id, n) WHERE NOT ok"""

#: Each turn is heard on two more tracks; a text without its last letters is a prefix, of which the similarity is known.
BLEED_DUPLICATES = f"""WITH RECURSIVE {UT_SQL}, nb AS (SELECT conv_id, turn, role, array_to_string(regexp_extract_all(translate(lower(text), '{{accented}}', '{{plain}}'), '[a-z0-9]{{{{2,}}}}'), ' ') AS body, length(text) AS size, t_ini, t_fin FROM ut),
 b AS (SELECT conv_id, conv_id * 10000 + turn AS id, role AS track, body, size, t_ini, t_fin FROM nb
  UNION ALL SELECT conv_id, conv_id * 10000 + turn + 1000, role || '-echo', CASE WHEN turn % 3 = 0 THEN substr(body, 1, length(body) - 1) ELSE body END, size, t_ini + 20, t_fin + 20 FROM nb
  UNION ALL SELECT conv_id, conv_id * 10000 + turn + 2000, 'far', CASE WHEN turn % 2 = 0 THEN substr(body, 1, length(body) - 2) ELSE body END, size, t_ini + 35, t_fin + 35 FROM nb),
 p AS (SELECT x.conv_id, x.id, o.id AS o_id, (x.size, x.id) > (o.size, o.id) AS better, 2.0 * least(length(x.body), length(o.body)) / (length(x.body) + length(o.body)) AS similarity,
   row_number() OVER (PARTITION BY x.conv_id ORDER BY x.t_ini, x.track, x.t_fin, x.id, o.t_ini, o.track, o.t_fin, o.id) AS n
  FROM b x JOIN b o ON o.conv_id = x.conv_id AND o.track <> x.track AND (o.t_ini, o.track, o.t_fin, o.id) < (x.t_ini, x.track, x.t_fin, x.id) AND length(x.body) >= 8
   AND least(x.t_fin, o.t_fin) - greatest(x.t_ini, o.t_ini) >= 0.8 * least(x.t_fin - x.t_ini, o.t_fin - o.t_ini) AND (starts_with(x.body, o.body) OR starts_with(o.body, x.body)) AND 2.0 * least(length(x.body), length(o.body)) >= 0.92 * (length(x.body) + length(o.body))),
 t AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS claimed, FALSE AS took FROM (SELECT DISTINCT conv_id FROM p) UNION ALL
  SELECT conv_id, n, CASE WHEN free THEN list_append(list_append(claimed, id), o_id) ELSE claimed END, free FROM (SELECT p.*, claimed, NOT (list_contains(claimed, p.id) OR list_contains(claimed, p.o_id)) AS free FROM t JOIN p ON p.conv_id = t.conv_id AND p.n = t.n + 1))
 SELECT conv_id, CASE WHEN better THEN id ELSE o_id END AS primary_id, CASE WHEN better THEN o_id ELSE id END AS secondary_id, round(similarity, 9) AS similarity FROM t JOIN p USING (conv_id, n) WHERE took"""

FIRST_FIT_PACKING = f"""WITH RECURSIVE {EV_SQL}, h AS (SELECT media_id, list({{'a': t_ini, 'b': t_fin}} ORDER BY t_ini, t_fin) AS held FROM ev WHERE track_id = 'view' GROUP BY 1),
 c AS (SELECT media_id, event_id AS id, t_fin - t_ini AS len, row_number() OVER (PARTITION BY media_id ORDER BY t_ini, event_id) AS n FROM ev WHERE track_id = 'click'),
 t AS (SELECT media_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS fin FROM (SELECT DISTINCT media_id FROM c) UNION ALL
  SELECT media_id, n, start, start + len FROM (SELECT c.media_id, c.n, c.len, CASE WHEN held IS NULL THEN fin ELSE list_reduce(list_transform(held, lambda x: [x.a, x.b]), lambda s, x: [0, CASE WHEN s[2] < x[2] AND s[2] + c.len > x[1] THEN x[2] ELSE s[2] END], [CAST(0 AS BIGINT), fin])[2] END AS start FROM t JOIN c ON c.media_id = t.media_id AND c.n = t.n + 1 LEFT JOIN h ON h.media_id = c.media_id))
 SELECT media_id, id, start AS seq_ini, fin AS seq_fin FROM t JOIN c USING (media_id, n)"""


def edit_list_sql(flatten: str) -> str:
    n = {c: f"(({c} * 25 + 500) // 1000)" for c in ("source_ini", "source_fin", "seq_ini", "seq_fin")}
    codes = " || ' ' || ".join(f"printf('%02d:%02d:%02d:%02d', {x} // 90000, {x} // 1500 % 60, {x} // 25 % 60, {x} % 25)" for x in n.values())
    return f"SELECT media_id, pos, printf('%03d', pos + 1) || ' AX V C ' || {codes} AS line FROM ({flatten})"
