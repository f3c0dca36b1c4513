"""Scans, chains of choices, greedy rounds, joins of long intervals, replay and step graphs against the serial way."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import conversation as cv
from tidemark.operators import greedy as gr
from tidemark.operators import history as hi
from tidemark.operators import joins as jn
from tidemark.operators import planning as pl
from tidemark.operators import scan as sn
from tidemark.operators import sequence as sq
from tidemark.operators import topics as tp
from tidemark.operators.intervals import Convention
from tidemark.plans import index as ix
from tidemark.sources import steps as st

M = ["m"]


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("width", [None, 50])
def test_running_values_in_slices(spark, width):
    rnd = random.Random(1)
    rows = [(m, rnd.randrange(-300, 700), i, rnd.choice([None, rnd.randrange(9)])) for i in range(300) for m in (1, 2)]
    df = spark.createDataFrame(rows, "m int, t long, i long, x long")
    for before in (False, True):
        want = []
        for m in (1, 2):
            seen = []
            for r in sorted(r for r in rows if r[0] == m):
                held = list(seen) if before else [*seen, r[3]]
                known = [x for x in held if x is not None]
                want.append((m, r[2], sum(known), len(known), max(known, default=None), known[-1] if known else None))
                seen.append(r[3])
        x = F.col("x")
        got = sn.running(df, M, ["t", "i"], {"s": ("sum", x), "n": ("count", x), "hi": ("max", x), "at": ("last", x)}, width, before)
        assert rows_of(got, "m", "i", "s", "n", "hi", "at") == sorted(want, key=str)


def test_follow_finds_what_is_reached(spark):
    rnd = random.Random(2)
    steps = {(m, a): a + rnd.randrange(1, 4) for m in range(3) for a in range(120)}
    want = []
    for m in range(3):
        at = m
        while at is not None:
            want.append((m, at))
            at = steps.get((m, at))
    df = spark.createDataFrame([(m, a, b) for (m, a), b in steps.items()] + [(0, 500, None), (0, 501, 400)], "m int, at long, to long")
    starts = spark.createDataFrame([(m, m) for m in range(3)], "m int, at long")
    assert rows_of(sn.follow(df, starts, M), "m", "at") == sorted(want, key=str)
    assert rows_of(sn.follow(df.limit(0), starts, M), "m", "at") == [(m, m) for m in range(3)]


def test_asof_in_slices_is_the_same(spark):
    rnd = random.Random(3)
    left = spark.createDataFrame([(rnd.choice([1, 2]), rnd.randrange(2000), i) for i in range(150)], "m int, t long, i long")
    right = spark.createDataFrame([(1, rnd.choice([rnd.randrange(300), rnd.randrange(1500, 1600)]), i) for i in range(60)], "m int, s long, v long")
    for backward in (True, False):
        for exact in (True, False):
            out = [rows_of(jn.asof(left, right, M, "t", "s", ["v"], backward, exact, prefix="r_", slice_width=w), "i", "r_t", "r_v") for w in (None, 70)]
            assert out[0] == out[1]


def test_overlap_join_with_lengths_from_a_moment_to_ten_years(spark):
    rnd = random.Random(4)

    def some(n, first):
        out = []
        for i in range(n):
            a, size = rnd.randrange(0, 400_000_000_000), int(10 ** rnd.uniform(0, 11.5))
            out.append((1 + i % 2, first + i, a, a + rnd.choice([0, size])))
        return out

    a, b = some(120, 0), some(120, 1000)
    left = spark.createDataFrame([*a, (1, 999, None, 5)], "m int, id int, t_ini long, t_fin long")
    right = spark.createDataFrame([*b, (1, 1999, 3, None)], "m int, r_id int, r_ini long, r_fin long")
    for convention, meets in ((Convention.OPEN, lambda x, y: y[2] < x[3] and y[3] > x[2]), (Convention.CLOSED, lambda x, y: y[2] <= x[3] and y[3] >= x[2])):
        want = [(x[1], y[1]) for x in a for y in b if x[0] == y[0] and meets(x, y)]
        assert rows_of(jn.overlap_join(left, right, M, convention=convention, bin_width=60_000), "id", "r_id") == sorted(want, key=str) and want
    loose = {x[1] for x in a} - {i for i, _ in want} | {999}
    assert {r["id"] for r in jn.overlap_join(left, right, M, convention=Convention.CLOSED, bin_width=60_000, how="left").where("r_id IS NULL").collect()} == loose
    assert {r["id"] for r in jn.overlap_join(left, right, M, convention=Convention.CLOSED, bin_width=60_000, how="left_anti").collect()} == loose
    # an event costs a few rows, whatever its length
    one = left.where("id < 3").select("m", "id", F.lit(0).cast("long").alias("t_ini"), F.lit(10**12).cast("long").alias("t_fin"))
    cells = jn._own(one.withColumn("__level", jn._level("t_ini", "t_fin", 1000)), "l", "t_ini", "t_fin", 1000)
    assert cells.count() <= 6
    assert jn.overlap_join(left.limit(0), right, M, bin_width=1000).count() == 0 == jn.overlap_join(left, right.limit(0), M, bin_width=1000).count()


def test_greedy_rounds_equal_the_serial_order(spark):
    rnd = random.Random(5)
    pairs = [(m, *rnd.sample(range(1, 60), 2)) for m in (1, 2) for _ in range(150)]
    refused = set()
    for m in (1, 2):
        near = {(a, b) for k, a, b in pairs if k == m} | {(b, a) for k, a, b in pairs if k == m}
        taken = []
        for r in range(1, 60):
            if any((r, t) in near for t in taken):
                refused.add((m, r))
            else:
                taken.append(r)
    df = spark.createDataFrame(pairs, "m int, a int, b int")
    assert set(rows_of(gr.refused(df, M, "a", "b"), "m", "rank_no")) == refused
    claimed, want = set(), []
    for n, (m, a, b) in enumerate(pairs):
        if not {(m, a), (m, b)} & claimed:
            claimed |= {(m, a), (m, b)}
            want.append(n)
    ranked = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, m int, a int, b int")
    assert [n for (n,) in sorted(tuple(r) for r in gr.matching(ranked, M, "a", "b", "n").select("n").collect())] == want


def test_separated_peaks_and_bleed_serially(spark):
    rnd = random.Random(6)
    curve = [(1, t, float(rnd.randrange(100))) for t in range(0, 600, 2)]
    got = rows_of(sq.separated_peaks(spark.createDataFrame(curve, "m int, t long, v double"), M, "t", "v", 25, 10.0), "peak_t")
    v = [x for *_, x in curve]
    peaks = [(-v[i], t) for i, (_, t, _) in enumerate(curve) if v[i] >= 10 and (i == 0 or v[i] > v[i - 1]) and (i == len(v) - 1 or v[i] >= v[i + 1])]
    taken = []
    for _, t in sorted(peaks):
        if all(abs(t - x) >= 25 for x in taken):
            taken.append(t)
    assert [t for (t,) in sorted(got)] == sorted(taken)
    words = ["alpha", "bravo", "candle", "dune", "ember", "flint"]
    rows = []
    for i in range(60):
        text = " ".join(rnd.choice(words) for _ in range(3))
        a = rnd.randrange(300)
        rows.append((1, i, "ABC"[i % 3], a, a + 100, rnd.choice([text, "alpha bravo candle"]), i))
    df = spark.createDataFrame(rows, "m int, id int, track string, t_ini long, t_fin long, text string, q int")
    order = sorted(rows, key=lambda r: (r[3], r[2], r[4], r[1]))
    claimed, want = set(), []
    for k, x in enumerate(order):
        for y in order[:k]:
            shared = min(x[4], y[4]) - max(x[3], y[3])
            if x[1] in claimed or y[1] in claimed or x[2] == y[2] or shared < 80 or SequenceMatcher(None, x[5], y[5], autojunk=False).ratio() < 0.92:
                continue
            claimed |= {x[1], y[1]}
            want.append((max(x[1], y[1]), min(x[1], y[1])))
    assert rows_of(cv.bleed_duplicates(df, M, "track", "id", "text", ["q"], bin_width=100), "primary_id", "secondary_id") == sorted(want, key=str) and want


@pytest.mark.parametrize("width", [None, 500])
def test_readable_blocks_serially(spark, width):
    rnd = random.Random(7)
    rows, t = [], 0
    for i in range(250):
        t += rnd.choice([0, 1, 5, 60])
        size = rnd.randrange(0, 40)
        rows.append((1, i, "A", rnd.choice("xxxxy"), t, t + size, rnd.choice([None, " ", "one", "one two three"]), rnd.random() < 0.05))
        t += size - rnd.choice([0, 0, 0, 3])
    blocks = []
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[1])):
        n, b = len((r[6] or "").split()), blocks[-1] if blocks else None
        if b and not r[7] and not b["blocked"] and b["sp"] == r[3] and 0 <= r[4] - b["fin"] <= 5 and r[5] - b["ini"] <= 120 and b["words"] + n <= 7:
            b.update(fin=r[5], words=b["words"] + n, n=b["n"] + 1)
        else:
            blocks.append({"sp": r[3], "ini": r[4], "fin": r[5], "words": n, "n": 1, "blocked": r[7]})
    df = spark.createDataFrame(rows, "m int, id int, track string, sp string, t_ini long, t_fin long, text string, blocked boolean")
    got = cv.readable_blocks(df, M, "track", "sp", "id", "text", "blocked", 5, 120, 7, width)
    assert [(r["speaker"], r["t_ini"], r["t_fin"], r["words"], r["n"]) for r in got.orderBy("block_no").collect()] == [(b["sp"], b["ini"], b["fin"], b["words"], b["n"]) for b in blocks]


def test_activity_chunks_with_cuts_and_gaps_in_the_data(spark):
    rnd = random.Random(8)
    rows = [(1, i, rnd.choice([None, rnd.random(), 0.0]), i in (30, 31, 200, 597)) for i in range(600)]
    df = spark.createDataFrame(rows, "m int, i long, v double, cut boolean")
    out = [rows_of(pl.activity_chunks(df, M, "i", "v", 15.0, 4, 45, 3, "cut", slice_width=w, value_width=vw), "chunk_no", "first", "last", "activity") for w, vw in ((None, None), (70, 0.2))]
    assert out[0] == out[1]
    got = sorted(out[0])
    assert got[0][1] == 0 and got[-1][2] == 599 and all(x[2] + 1 == y[1] for x, y in zip(got, got[1:])) and {30, 200} <= {g[1] for g in got}
    assert all(3 < g[2] - g[1] + 1 <= 49 for g in got)
    assert pl.activity_chunks(df.limit(0), M, "i", "v", 15.0, 4, 45, 3, "cut").count() == 0


def test_dissimilarity_slides(spark):
    rows = [(1, 0, 0, 10, "cats and dogs cats"), (1, 1, 12, 20, "cats dogs"), (1, 2, 300, 310, "rockets fly"), (1, 3, 315, 320, None), (1, 4, 318, 330, "rockets")]
    df = spark.createDataFrame(rows, "m int, id int, t_ini long, t_fin long, text string")
    got = {r["id"]: (round(r["dissimilarity"], 6), r["silence"]) for r in tp.context_dissimilarity(df, M, "id", "text", 100, slice_width=50).collect()}
    assert got[0] == (1.0, 0) and got[2] == (1.0, 280) and got[3][1] == 5 and got[4][1] == 0
    assert got[1][0] == round(1 - 3 / (5**0.5 * 2**0.5), 6) and got[4][0] == round(1 - 1 / 2**0.5, 6)
    scores = tp.boundary_scores(df, M, "id", "text", 100, 40, F.when(F.col("id") == 2, 0.1))
    assert {r["id"]: round(r["score"], 6) for r in scores.collect()}[2] == round(0.72 + 0.2 - 0.1, 6)


def test_build_ups_before_a_peak(spark):
    moments = spark.createDataFrame([(1, "a", 100), (1, "b", 200), (2, "c", 5)], "m int, id string, t_peak long")
    pauses = spark.createDataFrame([(1, f"p{t}", t - 3, t) for t in (80, 88, 89, 95, 99, 100, 101)], "m int, id string, t_ini long, t_fin long")
    got = {r["id"]: [x["id"] for x in r["build_up"]] for r in ix.build_ups(moments, pauses, M, 12).collect()}
    assert got == {"a": ["p89", "p95", "p99"], "b": [], "c": []}


def serial(log):
    rev, up, re, out = 0, [], [], []
    for seq, kind, base in log:
        target = None
        if base is not None and base != rev:
            what = "stale"
        elif kind == "undo" and not up or kind == "redo" and not re:
            what = "nothing"
        else:
            what, rev = "applied", rev + 1
            target = seq if kind == "edit" else up[-1] if kind == "undo" else re[-1]
            if kind == "edit":
                up, re = [*up, seq], []
            elif kind == "undo":
                up, re = up[:-1], [*re, target]
            else:
                up, re = [*up, target], re[:-1]
        out.append((seq, what, rev, target, list(up)))
    return out


def test_history_replays_like_a_stack(spark):
    e, u, r = "edit", "undo", "redo"
    logs = {1: [(1, e, 0), (2, e, 1), (3, u, 2), (4, u, 3), (5, u, 4), (6, r, 4), (7, r, 5), (8, r, 6), (9, e, None), (10, r, None)], 2: [(1, u, 0), (2, e, 5), (3, e, 0), (4, u, 0), (5, u, None), (6, r, None), (7, e, 3), (8, e, 3), (9, u, 4)]}
    rnd = random.Random(9)
    logs[3] = [(i, rnd.choice([e, e, e, u]), rnd.choice([None, None, max(0, i - rnd.randrange(4))])) for i in range(1, 41)]
    df = spark.createDataFrame([(m, s, k, b, f"k{s % 3}", s * 10) for m, log in logs.items() for s, k, b in log] + [(1, None, e, None, "k0", 1), (1, 50, "look", None, "k0", 1)], "m int, seq long, kind string, base long, field string, v long")
    done = hi.replay(df, M, 7).cache()
    for m, log in logs.items():
        want = serial(log)
        got = sorted((x["seq"], x["outcome"], x["revision"], x["target"]) for x in done.where((F.col("m") == m) & F.col("outcome").isNotNull()).collect())
        assert got == [w[:4] for w in want], m
        for at in (0, 2, 4, 99):
            stands = next((w[4] for w in reversed(want) if w[2] <= at), [])
            state = {f"k{s % 3}": s * 10 for s in stands}
            asked = spark.createDataFrame([(m, at)], "m int, revision long")
            assert {x["field"]: x["v"] for x in hi.state_at(done, M, ["field"], "v", asked).collect()} == state, (m, at)
    assert done.where("outcome IS NULL").count() == 2
    done.unpersist()


def test_steps_are_made_anew_behind_a_change_only(spark, tmp_path):
    one, two = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(2,), (1,)], "x int")
    calls = []

    def made(name, f):
        def make(**tables):
            calls.append(name)
            return f(**tables)

        return make

    graph = lambda version=1: [
        st.Step("a", made("a", lambda left: left), inputs=("left",), version=version), st.Step("b", made("b", lambda right: right), inputs=("right",)),
        st.Step("c", made("c", lambda a, b: a.unionByName(b)), ("a", "b")), st.Step("d", made("d", lambda c: c.agg(F.sum("x").alias("s"))), ("c",), view=True),
    ]
    root = f"{tmp_path}/steps"
    more = one.unionByName(spark.createDataFrame([(7,)], "x int"))

    def go(inputs, **options):
        calls.clear()
        tables, became = st.run_graph(spark, root, graph(options.pop("version", 1)), inputs, **options)
        return calls[:], {n: df.collect() for n, df in tables.items()}, became

    assert go({"left": one, "right": one})[0] == ["a", "b", "c", "d"]
    assert go({"left": two, "right": one})[0] == []  # the same rows in another order
    calls_, tables, became = go({"left": one, "right": more})
    assert calls_ == ["b", "c", "d"] and tables["d"][0]["s"] == 13 and became["a"] == "read"
    assert go({"left": one, "right": more}, version=2)[0] == ["a", "c", "d"]
    assert go({"left": more, "right": more}, views_only=True)[0] == [] and go({"left": more, "right": more}, views_only=True, again=["d"])[0] == ["d"]
    assert set(st.completed(spark, root)) == {"a", "b", "c", "d"}
    path = next(r["path"] for r in st.manifests(spark, root).orderBy(F.desc("number")).collect() if r["step"] == "b")
    spark.createDataFrame([(9,)], "x int").write.mode("append").parquet(path)  # a result that was changed is no result
    assert "b" in go({"left": one, "right": more}, version=2)[0]
    assert st.prune(spark, root) > 0 and st.manifests(spark, root).count() == 4 and go({"left": one, "right": more}, version=2)[0] == []
    assert st.run_graph(spark, f"{tmp_path}/none", graph(), {"left": one, "right": one}, views_only=True)[1] == dict.fromkeys("abcd", "absent")


def test_secrets_go_at_every_level(spark):
    df = spark.createDataFrame([(1, ("k", "t"), [("x", "y")], {"a": "1", "my_key": "2"}, 5)], "s_suppkey int, inner struct<monkey:string,Token:string>, list array<struct<n:string,api_key:string>>, m map<string,string>, private_key int")
    out = df.select(*sc.without_secrets(df.schema))
    assert out.columns == ["s_suppkey", "inner", "list", "m"] and out.first() == (1, ("k",), [("x",)], {"a": "1"})


def test_snapped_plans_keep_order_and_limits(spark):
    """Boundaries move away from events; limits that depend on the boundary before hold, and what has no room or no safe place says so."""
    plan = spark.createDataFrame([(1, k, (k - 1) * 100, k * 100) for k in range(1, 6)] + [(2, 1, 0, 50), (2, 2, 50, 100)] + [(3, 1, 0, 100), (3, 2, 100, 190)], "m int, chunk_no int, t_ini long, t_fin long")
    # the first boundary is pushed back, so the second, kept within 105 of it, can't reach the free place behind its event
    hard = spark.createDataFrame([(1, 95, 112), (1, 195, 212), (1, 290, 295), (2, 20, 90)], "m int, t_ini long, t_fin long")
    out = pl.snap_plan(plan, hard, hard.limit(0), M, 20, 1, 10, 105).orderBy("m", "chunk_no").collect()
    got = {(r["m"], r["chunk_no"]): (r["snapped"], r["error"]) for r in out}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (3, 1)} and got[2, 1][1] == "crosses" and got[3, 1] == (100, None)
    edges = [0, *(got[1, k][0] for k in range(1, 5)), 500]
    assert all(0 < b - a <= 105 for a, b in zip(edges, edges[1:])) and all(got[1, k][1] is None for k in range(1, 5))
    assert not any(a < got[1, k][0] < b for k in range(1, 5) for a, b in ((95, 112), (195, 212), (290, 295)))
    tight = pl.snap_plan(plan.where("m = 1"), hard, hard.limit(0), M, 20, 1, 10, 60)
    assert {r["error"] for r in tight.collect()} <= {"no_room", "crosses", None} and tight.where("error = 'no_room'").count() > 0


def test_nested_items_stay_inside_their_parents(spark):
    items = spark.createDataFrame([(1, "a", None, 100, 300), (1, "b", "a", 95, 200), (1, "c", "b", 90, 310), (1, "x", "gone", 0, 5)], "m int, id string, parent string, t_ini long, t_fin long")
    hard = spark.createDataFrame([(1, 98, 104), (1, 295, 306)], "m int, t_ini long, t_fin long")
    got = {r["id"]: (r["s_ini"], r["s_fin"], r["crosses"]) for r in pl.snap_nested(items, hard, hard.limit(0), M, "id", "parent", 15, 1, 5).collect()}
    assert set(got) == {"a", "b", "c"} and not any(v[2] for v in got.values())
    assert all(got[p][0] <= got[k][0] <= got[k][1] <= got[p][1] for k, p in (("b", "a"), ("c", "b")))
