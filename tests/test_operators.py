"""Small examples, edge cases and properties of the operators."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import text as tx
from tidemark.functions import time as tm
from tidemark.operators import conversation as cv
from tidemark.operators import documents as dc
from tidemark.operators import intervals as iv
from tidemark.operators import joins as jn
from tidemark.operators import planning as pl
from tidemark.operators import remap as rm
from tidemark.operators import sequence as sq
from tidemark.plans import master as ms
from tidemark.sources import documents as src

M = ["m"]


def table(spark, rows, schema="m int, id int, t_ini long, t_fin long"):
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_union_touching_nested_and_empty(spark):
    df = table(spark, [(1, 0, 0, 10), (1, 1, 10, 12), (1, 2, 2, 5), (1, 3, 20, 20), (2, 4, 1, 2)])
    assert got(iv.union(df, M), *M, "t_ini", "t_fin", "n_parts") == [(1, 0, 12, 3), (2, 1, 2, 1)]
    assert got(iv.union(df.where("false"), M), "t_ini") == []
    assert got(iv.union(df, M, touching=False), *M, "t_ini", "t_fin") == [(1, 0, 10), (1, 10, 12), (2, 1, 2)]


def test_union_is_idempotent_and_complement_tiles(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(5), i, a := rnd.randrange(1000), a + rnd.randrange(0, 60)) for i in range(300)]
    df = table(spark, rows)
    u = iv.union(df, M)
    assert got(iv.union(u, M), *M, "t_ini", "t_fin") == got(u, *M, "t_ini", "t_fin") == got(iv.union(df, M, slice_width=100), *M, "t_ini", "t_fin")
    bounds = df.select("m").distinct().select("m", F.lit(0).cast("long").alias("lo"), F.lit(1100).cast("long").alias("hi"))
    gaps = got(iv.complement(u, M, bounds), *M, "t_ini", "t_fin")
    for m in range(5):
        parts = sorted([p[1:] for p in gaps if p[0] == m] + [p[1:] for p in got(u, *M, "t_ini", "t_fin") if p[0] == m])
        assert parts[0][0] == 0 and parts[-1][1] == 1100 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_difference_and_kept(spark):
    left = table(spark, [(1, 0, 0, 100), (1, 1, 10, 20), (2, 2, 0, 5)])
    right = table(spark, [(1, 9, 10, 30), (1, 9, 90, 200)])
    want = [(0, 0, 10), (0, 30, 90), (2, 0, 5)]
    assert got(iv.difference(left, right, M, "id"), "id", "t_ini", "t_fin") == want == got(iv.difference(left, right, M, "id", bin_width=7), "id", "t_ini", "t_fin")
    bounds = spark.createDataFrame([(1, 0, 100)], "m int, lo long, hi long")
    assert got(iv.kept_segments(right, M, bounds, 1), "t_ini", "t_fin") == [(0, 10), (30, 90)]


@pytest.mark.parametrize("convention", list(iv.Convention))
def test_binned_overlap_join_equals_brute_force(spark, convention):
    rnd = random.Random(3)
    a = [(rnd.randrange(3), i, s := rnd.randrange(200), s + rnd.choice([0, 3, 10, 40])) for i in range(120)]
    b = [(rnd.randrange(3), i, s := rnd.randrange(200), s + rnd.choice([0, 3, 10, 40])) for i in range(120)]

    def meets(s, e, lo, hi):
        if convention is iv.Convention.CLOSED:
            return s <= hi and e >= lo
        if convention is iv.Convention.HALF_OPEN:
            return s < hi and (e > lo or (e == s and s >= lo))
        return s < hi and e > lo

    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and meets(y[2], y[3], x[2], x[3]))
    right = spark.createDataFrame(b, "m int, rid int, r_ini long, r_fin long")
    for width in (None, 10):
        assert got(jn.overlap_join(table(spark, a), right, M, convention=convention, bin_width=width), "id", "rid") == want
    anti = got(jn.overlap_join(table(spark, a), right, M, convention=convention, bin_width=10, how="left_anti"), "id")
    assert anti == sorted((x[1],) for x in a if x[1] not in {i for i, _ in want})


def test_asof_nearest_and_ties(spark):
    left = spark.createDataFrame([(1, 0, 10), (1, 1, 25), (2, 2, 5)], "m int, id int, t long")
    right = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 20, 3), (1, 30, 4)], "m int, rt long, v int")
    back = jn.asof(left, right, M, "t", "rt", ["v"], True, prefix="p_")
    assert got(back, "id", "p_t", "p_v") == [(0, 10, 2), (1, 20, 3), (2, None, None)]
    strict = jn.asof(left, right, M, "t", "rt", ["v"], True, False, prefix="p_")
    assert [r for r in got(strict, "id", "p_t") if r[0] == 0] == [(0, None)]
    near = jn.nearest(left, right, M, "t", "rt", [], 4)
    assert got(near, "id", "near_t") == [(0, 10), (1, None), (2, None)]
    assert [r for r in got(jn.nearest(left, right, M, "t", "rt", []), "id", "near_t") if r[0] == 1] == [(1, 20)]


def test_assign_by_overlap(spark):
    items = table(spark, [(1, 0, 1000, 1800), (1, 1, 1700, 2400), (1, 2, 2400, 2900), (1, 3, 10000, 11000), (1, 4, 3100, 3200)])
    turns = spark.createDataFrame([(1, 800, 1800, "s0"), (1, 1800, 3000, "s1")], "m int, t_ini long, t_fin long, sp string")
    out = jn.assign_by_overlap(items, turns, M, "id", "sp", 500, 1000)
    assert got(out, "id", "speaker_id", "assignment") == [(0, "s0", "overlap"), (1, "s1", "overlap"), (2, "s1", "overlap"), (3, None, "unknown"), (4, "s1", "nearest")]


def test_flatten_top_wins_and_gaps(spark):
    clips = spark.createDataFrame([(1, 0, 1, 0, 10, 100), (1, 1, 2, 4, 6, 500), (1, 2, 1, 20, 25, 0)], "m int, clip_id int, rank int, seq_ini long, seq_fin long, source_ini long")
    assert got(iv.flatten(clips, M, "rank", gaps=True), "pos", "clip_id", "seq_ini", "seq_fin", "source_ini") == [(0, 0, 0, 4, 100), (1, 1, 4, 6, 500), (2, 0, 6, 10, 106), (3, 2, 20, 25, 0)]
    assert got(iv.flatten(clips, M, "rank"), "pos", "seq_ini", "seq_fin") == [(0, 0, 4), (1, 4, 6), (2, 6, 10), (3, 10, 15)]


def test_pauses_neighbour_is_the_furthest_word(spark):
    words = spark.createDataFrame([(1, 5, 9, "a."), (1, 6, 7, "b"), (1, 20, 21, "c")], "m int, t_ini long, t_fin long, w string")
    assert got(sq.pauses(words, M, "w", 3), "g_ini", "g_fin", "prev_text", "next_text", "ends_sentence") == [(0, 5, None, "a.", False), (9, 20, "a.", "c", True)]


def test_hysteresis_needs_trigger_and_stops_at_holes(spark):
    zs = [(1, 1.0), (2, 3.0), (3, 1.0), (4, 0.0), (5, 3.0), (20, 3.0), (21, None), (22, 1.0)]
    df = spark.createDataFrame([(1, t, z, 9.0) for t, z in zs], "m int, t long, z double, v double")
    out = sq.hysteresis(df, M, "t", "z", "v", 2.0, 0.5, 1.0, 5, 0, 0)
    assert got(out, "t_ini", "t_fin", "t_peak", "n") == [(2, 3, 2, 2), (5, 5, 5, 1), (20, 20, 20, 1)]


def test_wake_spans(spark):
    rows = [(1, 0, 1, "hey"), (1, 1, 2, "hey"), (1, 3, 4, "go"), (1, 30, 31, "hey"), (1, 31, 32, "x"), (1, 33, 34, "hey"), (1, 34, 90, "y")]
    df = spark.createDataFrame(rows, "m int, t_ini long, t_fin long, w string")
    assert got(sq.wake_spans(df, M, "w", {"hey"}, 10, 20, 2), "t_ini", "t_fin", "cause", "heard") == [(0, 4, "silence", "hey go"), (30, 32, "invocation", "x"), (33, 34, "limit", "")]


def test_pairwise_merge_is_ordered(spark):
    df = spark.createDataFrame([(1, 0, 10, 0.9, 0.5), (1, 11, 20, 0.7, 0.7), (1, 21, 30, 0.8, 0.1), (1, 99, 100, 1.0, 1.0)], "m int, t_ini long, t_fin long, p double, q double")
    assert got(sq.merge_pairwise(df, M, 2, 5, "p", "q"), "t_ini", "t_fin", "peak", "mean") == [(0, 30, 0.9, pytest.approx(0.35))]


def test_bridge_and_smooth(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, None, 3.0, None, None, None, 7.0])], "m int, t long, x double")
    assert [r[0] for r in sq.bridge_holes(df, M, "t", "x", 2).orderBy("t").select("bridged").collect()] == [1.0, 2.0, 3.0, None, None, None, 7.0]
    assert [r[0] for r in sq.median_smooth(df, M, "t", "x", 2).orderBy("t").select("smooth").collect()] == [2.0, None, 2.0, None, None, None, 7.0]


def test_interpolated_words(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, None, None), (1, 2, None, None), (1, 3, 5.0, 6.0)], "m int, pos int, t_ini double, t_fin double")
    assert got(sq.interpolate_words(df, M, "pos"), "pos", "s", "e", "aligned") == [(0, 0.0, 1.0, True), (1, 1.0, 3.0, False), (2, 3.0, 5.0, False), (3, 5.0, 6.0, True)]


def test_speaker_phrases(spark):
    words = spark.createDataFrame([(1, 0, 0, 10, "a", "s0"), (1, 1, 10, 20, "b", "s0"), (1, 2, 20, 30, "c", "s1"), (1, 3, 30, 40, "d", "s1")], "m int, id int, t_ini long, t_fin long, w string, sp string")
    seg = spark.createDataFrame([(1, 0, 0), (1, 1, 31)], "m int, seg int, t_ini long")
    assert got(sq.speaker_phrases(words, M, seg, "seg", "sp", "w", ["id"]), "phrase", "sp", "n_words", "text") == [(1, "s0", 2, "a b"), (2, "s1", 1, "c"), (3, "s1", 1, "d")]


def test_absences_absorb_short_runs(spark):
    df = spark.createDataFrame([(1, t, p) for t, p in [(0, True), (10, True), (11, False), (12, True), (20, False), (40, False)]], "m int, t long, ok boolean")
    assert got(sq.absences(df, M, "t", "ok", 5), "t_ini", "t_fin", "at_end") == [(20, 40, True)]


def test_bleed_and_blocks(spark):
    rows = [(1, 0, "A", 0, 100, "hello there friend", 5), (1, 1, "B", 2, 102, "hello there friend", 9), (1, 2, "A", 200, 300, "something else", 1)]
    u = spark.createDataFrame(rows, "m int, id int, track string, t_ini long, t_fin long, text string, q int")
    assert got(cv.bleed_duplicates(u, M, "track", "id", "text", ["q"]), "primary_id", "secondary_id") == [(1, 0)]
    b = u.withColumn("blocked", F.lit(False)).withColumn("sp", F.lit("x")).where("track = 'A'")
    assert got(cv.readable_blocks(b, M, "track", "sp", "id", "text", "blocked", 150, 1000, 100), "n", "words") == [(2, 5)]
    assert got(cv.overlap_groups(u, M, "track", "id"), "t_ini", "t_fin", "tracks") == [(0, 102, "A,B")]


def test_coalesce_property(spark):
    rnd = random.Random(7)
    rows = [(rnd.randrange(3), i, a := rnd.randrange(300), a + rnd.randrange(1, 30), f"r{i % 4}") for i in range(150)]
    df = spark.createDataFrame(rows, "m int, id int, t_ini long, t_fin long, reason string")
    once = dc.coalesce_cuts(df, M, "id", "reason").cache()
    assert got(iv.union(df, M), *M, "t_ini", "t_fin") == got(iv.union(once, M), *M, "t_ini", "t_fin")
    assert got(dc.coalesce_cuts(once, M, "id", "reason"), "id", "t_ini", "t_fin", "reason") == got(once, "id", "t_ini", "t_fin", "reason")
    right = once.select("m", F.col("id").alias("rid"), F.col("t_ini").alias("r_ini"), F.col("t_fin").alias("r_fin"))
    assert jn.overlap_join(once, right, M).where("id <> rid").count() == 0


def test_quarantine_first_wins(spark):
    df = spark.createDataFrame([(1, 7, 0, 5), (1, 7, 1, 5), (1, 8, 5, 2)], "m int, id int, t_ini long, t_fin long")
    out = dc.quarantine(df, M, "id", ["t_ini"], {"order": F.col("t_fin") > F.col("t_ini")})
    assert got(out, "id", "t_ini", F.coalesce("reason", F.lit("-"))) == [(7, 0, "-"), (7, 1, "duplicate_id"), (8, 5, "order")]


def test_layer_merge_and_depth(spark):
    stored = spark.createDataFrame([(1, None, True, False), (2, None, False, True), (9, None, False, False)], "id int, parent int, edited boolean, deleted boolean")
    new = spark.createDataFrame([(1, None), (2, None), (3, 2), (4, 3), (5, 1)], "id int, parent int")
    assert got(dc.merge_layer(stored, new, [], "id", "parent"), "id") == [(1,), (2,), (5,)]
    cyclic = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3)], "id int, parent int")
    assert got(dc.depth(cyclic, [], "id", "parent"), "id", F.coalesce("depth", F.lit(-1))) == [(1, 0), (2, 1), (3, -1), (4, -1)]


def test_remap_keeps_measure_and_inverts(spark):
    seg = spark.createDataFrame([(1, 10, 15), (1, 40, 42), (1, 70, 80)], "m int, source_ini long, source_fin long")
    mp = rm.time_map(seg, M, ["source_ini"])
    assert got(mp, "segment", "child_ini", "child_fin") == [(0, 0, 5), (1, 5, 7), (2, 7, 17)]
    ev = table(spark, [(1, 0, 12, 75), (1, 1, 0, 5)])
    out = rm.map_range(ev, mp, M, "id")
    assert got(out, "child_id", "c_ini", "c_fin") == [("0~s1", 2, 5), ("0~s2", 5, 7), ("0~s3", 7, 12)]
    pts = spark.createDataFrame([(1, 6), (1, 99)], "m int, t long")
    assert got(rm.child_to_source(pts, mp, M, "t"), "t", F.coalesce("source_t", F.lit(-1))) == [(6, 41), (99, -1)]


def test_snap_prefers_safe_places(spark):
    targets = spark.createDataFrame([(1, 0, 50)], "m int, id int, target long")
    hard = table(spark, [(1, 0, 45, 60)])
    soft = table(spark, [(1, 0, 60, 70)])
    out = pl.snap(targets, hard, soft, M, "id", 20, 1, 5).first()
    assert out["n_hard"] == 0 and out["n_soft"] == 0 and out["snapped"] < 45


def test_chunk_plan_tiles(spark):
    scored = spark.createDataFrame([(1, float(t), t % 7.0) for t in range(0, 1000, 10)], "m int, t double, s double")
    bounds = spark.createDataFrame([(1, 0.0, 1000.0)], "m int, lo double, hi double")
    rows = got(pl.chunk_plan(scored, M, "t", "s", bounds, 240, 300, 20), "t_ini", "t_fin")
    assert rows[0][0] == 0 and rows[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(rows, rows[1:])) and max(b - a for a, b in rows) <= 300


def test_activity_chunks_constant_and_quota(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(100)], "m int, i int, v double")
    rows = got(pl.activity_chunks(df, M, "i", "v", 15.0, 4, 45, 3), "first", "last")
    assert rows[0][0] == 0 and rows[-1][1] == 99 and all(a[1] + 1 == b[0] for a, b in zip(rows, rows[1:]))
    pool = spark.createDataFrame([(1, 0, "a", 0, 1, 0.9), (1, 1, "a", 3, 4, 0.8), (1, 2, "a", 100, 101, 0.7), (1, 3, "a", 200, 201, 0.1)], "m int, id int, lane string, t_ini long, t_fin long, r double")
    out = pl.quota_select(pool, M, "lane", "r", ["a"], {"a": 2}, 5)
    assert got(out, "id", F.coalesce("why", F.lit("-"))) == [(0, "-"), (1, "duplicate"), (2, "-"), (3, "quota")]


def test_edits(spark):
    df = table(spark, [(1, 0, 0, 10), (1, 1, 20, 30)])
    assert got(dc.split_at(df, F.lit(25).cast("long"), 1), "id", "part", "t_ini", "t_fin") == [(0, 0, 0, 10), (1, 0, 20, 25), (1, 1, 25, 30)]
    assert got(dc.range_at(df, 10), "id") == [(0,)]
    assert got(dc.shift_all(df, M, -5, 100), "t_ini") == [(0,), (20,)]
    assert got(iv.subtract_range(df, ["m", "id"], 5, 25, 1), "id", "t_ini", "t_fin") == [(0, 0, 5), (1, 25, 30)]


def test_text_and_time(spark):
    row = spark.range(1).select(
        tx.normalized(F.lit("Él Niño, über-cool a 42!")).alias("n"), tx.slug(F.lit("  ¡¿?! ")).alias("s"), tx.join_reasons(F.lit("a · b"), F.lit("b"), F.lit(None).cast("string")).alias("j"),
        tm.format_time(F.lit(3661.5)).alias("t"), tm.parse_time(F.lit("01:01:01.5")).alias("p"), tm.parse_time(F.lit("x")).alias("bad"), tm.goto(F.lit("-10"), F.lit(5.0), F.lit(100.0)).alias("g"),
        tm.track_name(F.lit(26)).alias("aa"), tm.track_number(F.lit("V12")).alias("v"), sc.signal_level(F.lit(None).cast("double"), 1, 2).alias("none"), tx.parse_fenced_json(F.lit('text ```json\n{"a": 1}\n``` more'), "a int")["a"].alias("a"),
    ).first()
    assert tuple(row) == ("el nino uber cool 42", "item", "a · b", "01:01:01.500", 3661.5, None, 0.0, "AA", 12, "none", 1)


def test_sources(spark, tmp_path):
    (tmp_path / "w.json").write_bytes(b"\xef\xbb\xbf" + b'[{"word": "a", "start": 0.5, "end": 1.0}, {"word": "b", "start": 3, "end": 2}]')
    words = src.read_words(spark, str(tmp_path / "w.json"))
    assert got(words, "text", "t_ini", "t_fin", "valid") == [("a", 500, 1000, True), ("b", 3000, 2000, False)]
    cat = src.scan(spark, str(tmp_path))
    assert src.changed(cat, cat).count() == 0 and cat.count() == 1
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    root = str(tmp_path / "steps")
    assert src.run_step(spark, root, "s", {"k": 1}, make).count() == src.run_step(spark, root, "s", {"k": 1}, make).count() == 3 and len(calls) == 1
    ev = table(spark, [(1, 0, 0, 5), (2, 1, 0, 5)]).withColumnsRenamed({"m": "media_id"}).withColumn("stream", F.lit("a"))
    src.write_events(ev, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).where("media_id = 1").count() == 1


def test_views(spark):
    df = spark.createDataFrame([(1, 0, 0, 1000, "a", "x"), (1, 1, 1000, 2000, "b", None)], "m int, id int, t_ini long, t_fin long, who string, text string")
    assert ms.transcript(df, M, "who", "text", "id").first()["transcript"] == "[00:00:00.000] a: x\n[00:00:01.000] b: "
    kept = spark.createDataFrame([(1, 0, 1500)], "m int, t_ini long, t_fin long")
    assert ms.filter_script(kept, M).first()["script"] == "[0:a]atrim=start=0.000:end=1.500,asetpts=PTS-STARTPTS[a0];[a0]concat=n=1:v=0:a=1[out]"


def test_streaming(spark, tmp_path):
    from tidemark.streaming import events as st

    rows = [(1, datetime(2024, 1, 1, 0, 0, s), k, 1.0) for s, k in ((0, "wake"), (3, "x"), (30, "x"), (40, "wake"))] + [(1, datetime(2024, 1, 2), "x", 1.0)]
    df = spark.createDataFrame(rows, "u int, ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = st.read_stream(spark, str(tmp_path / "in"), df.schema)
    for name, out, want in (("sess", st.sessions(source, "u", "ts", "5 seconds", "1 second"), 3), ("wake", st.wake_spans(source, "u", "ts", "kind", "wake", 10_000, 60_000, "1 second"), 2)):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql(f"select * from {name}").count() == want
