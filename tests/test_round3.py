"""Cases of the third review."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import documents as dc
from tidemark.operators import joins as jn
from tidemark.operators import stats as st

M = ["m"]


def test_weighted_mean_of_an_item_without_length(spark):
    items = spark.createDataFrame([(1, 1, 5, 5), (1, 2, 0, 4), (1, 3, 90, 95)], "m int, id int, t_ini long, t_fin long")
    signal = spark.createDataFrame([(1, 0, 10, 7)], "m int, t_ini long, t_fin long, k int")
    for width in (None, 20):
        out = {r["id"]: (r["k_mean"], r["n_windows"]) for r in jn.weighted_mean(items, signal, M, "id", "k", width).collect()}
        assert math.isnan(out[1][0]) and out[1][1] == 1
        assert out[2] == (7.0, 1) and out[3] == (None, 0)


def test_depth_without_a_limit_of_rows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        rows = [(1, i, None if i % 40 == 0 else i - 1) for i in range(400)] + [(1, 1000, 1001), (1, 1001, 1000), (1, 1002, 5555), (2, 7, None), (2, 8, 7)]
        out = {(r["m"], r["id"]): r["depth"] for r in dc.depth(spark.createDataFrame(rows, "m int, id int, parent int"), M, "id", "parent").collect()}
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert len(out) == len(rows)
    assert all(out[1, i] == (i % 40 if i % 40 <= 32 else None) for i in range(400))
    assert [out[1, i] for i in (1000, 1001, 1002)] == [None] * 3 and out[2, 7] == 0 and out[2, 8] == 1


def test_ranks_when_each_approximation_differs(spark, monkeypatch):
    cut = F.udf(lambda top: [top * int.from_bytes(os.urandom(2), "big") / 65536], "array<double>").asNondeterministic()
    monkeypatch.setattr(st.F, "percentile_approx", lambda value, *_: cut(F.max(value)))
    rows = [(1, float(random.Random(k).randrange(50))) for k in range(300)]
    values = sorted(v for _, v in rows)
    for r in st.value_counts(spark.createDataFrame(rows, "m int, v double"), M, "v").collect():
        assert r["below"] == sum(v < r["value"] for v in values) and r["c"] == values.count(r["value"])


def test_names_of_tracks_beyond_three_letters(spark):
    names = [r[0] for r in spark.createDataFrame([(p,) for p in (0, 25, 26, 701, 702, 18277, 18278, 129142, 1199999)], "p long").select(tm.track_name(F.col("p"))).collect()]
    assert names == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "[AA", "ÿAA", chr(65 + 1199297 // 676) + chr(65 + 1199297 // 26 % 26) + chr(65 + 1199297 % 26)]


@pytest.mark.parametrize("query", ["same_identity", "legacy_matches"])
def test_matches_are_not_narrowed_to_one_number(spark, query):
    from tidemark import catalog

    rows = catalog.queries()[query](spark, "/root/testdata/sf0.001").collect()
    assert any(r["s_suppkey"] not in (r["c_custkey"], r["c_custkey"] // 2) for r in rows)


def test_descendants_of_many_items_without_parent(spark, monkeypatch):
    sizes, store = [], dc.stored
    monkeypatch.setattr(dc, "stored", lambda df, name: sizes.append(df.count()) or store(df, name))
    rows = [(i, None if i % 5 else i - 5 if i else None) for i in range(200)]
    items = spark.createDataFrame(rows, "id int, parent int")
    out = [r["id"] for r in dc.descendants(items, items.where("id = 50 OR id = 3"), [], "id", "parent").collect()]
    assert sorted(out) == sorted([3, *range(50, 200, 5)])
    # those without a parent aren't looked at in each round, when they would be one key
    assert all(n <= 40 for n in sizes[1:])


def test_lists_of_words_are_lines_of_few_files(spark, monkeypatch):
    from tidemark.queries import edit_queries as eq

    made, path_of = [], eq.scratch_path
    monkeypatch.setattr(eq, "scratch_path", lambda *a: made.append(path_of(*a)) or made[-1])
    out = eq.json_words(spark, "/root/testdata/sf0.001")
    files = [f for _, _, names in os.walk(made[0]) for f in names if f.startswith("part-")]
    assert len(files) <= 8 and out.agg({"n": "sum"}).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_likeness_is_the_ratio_and_quick_for_texts_that_hold_each_other(monkeypatch):
    from difflib import SequenceMatcher

    from tidemark.operators import conversation as cv

    rng, texts = random.Random(3), ["", "a", "ab ab"]
    texts += ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += [t[i : i + 12] for t in texts[3:] for i in (0, 3)]
    for x in texts:
        for y in texts[:90]:
            assert cv.likeness(x, y) == SequenceMatcher(None, x, y, autojunk=False).ratio()
    monkeypatch.setattr(cv, "SequenceMatcher", None)  # not asked when one is the beginning of the other
    assert cv.likeness("ab" * 5000, "ab" * 4999) == 2 * 9998 / 19998


def test_visits_are_given_in_bounded_portions():
    import numpy as np

    from tidemark.llm import knn

    at, per, first = np.array([0, 0, 1, 3]), np.array([2, 5, 1, 3]), np.array([10, 20, 30, 40])
    parts = list(knn.portions(at, per, first, 4))
    assert [len(r) for r, _ in parts] == [4, 4, 3]
    assert np.concatenate([r for r, _ in parts]).tolist() == [0] * 7 + [1] + [3] * 3
    assert np.concatenate([c for _, c in parts]).tolist() == [10, 11, 20, 21, 22, 23, 24, 30, 40, 41, 42]
    assert not list(knn.portions(at[:0], per[:0], first[:0], 4))


def test_a_source_that_many_later_messages_repeat_in_part(spark):
    from tidemark.llm import quotes

    one, two = "the quick brown fox jumps over the lazy dog today", "seven small boats sail slowly past our old harbour wall"
    rows = [(1, 0, f"{one}\nbetween them\n{two}")]
    for k in range(1, 31):  # each passage is written again by many, both only by the first
        rows.append((1, k, f"{one if k % 2 else two}\nand number {k} goes on"))
    rows.append((1, 40, f"> {one}\nI agree.\n> {two}\nwith that too"))
    out = quotes.link_quotes(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string"))
    assert out.where("turn = 40").first()["parent_turn"] == 0


def test_top_tokens_shuffle_texts_once(spark):
    from tidemark.functions import text as tx

    df = spark.createDataFrame([(1, "red red blue"), (1, "blue blue sky"), (2, None), (3, "the and")], "d int, x string")
    out = tx.top_tokens(df, ["d"], "x", 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in out.collect()] == [(1, "blue red")]


def brute_safety(c, hard, soft, reach):
    held = lambda events: sum(a < c < b for a, b in events)
    near = [min(abs(c - a), abs(c - b)) for a, b in hard if a <= c + reach and b >= c - reach and not a < c < b]
    return held(hard), held(soft), min([reach, *near])


@pytest.mark.parametrize("width", [None, 7])
def test_safety_of_places_pairs_nothing(spark, monkeypatch, width):
    """Also with events without length, in reverse, at the place itself, without a time or a timeline, and slices without an event."""
    from tidemark.operators import planning as pl

    rng, made = random.Random(5), []
    spans = lambda n, least: [(a, a + rng.randrange(least, 25)) for a in (rng.randrange(200) for _ in range(n))]
    hard, soft = {1: spans(12, 0), 2: spans(3, 0), 3: spans(6, -20)}, {1: spans(9, 0), 2: [], 3: spans(4, -20)}
    table = lambda events, more: spark.createDataFrame([(m, *x) for m, xs in events.items() for x in xs] + more, "m int, t_ini long, t_fin long")
    places = [(m, k, c) for m in (1, 2, 3, 4) for k, c in enumerate(range(-40, 260))]
    candidates = spark.createDataFrame(places + [(None, 7, 50), (1, 900, None)], "m int, id int, c long")
    join = pl.overlap_join
    monkeypatch.setattr(pl, "overlap_join", lambda left, right, *a, **k: made.append(right.count()) or join(left, right, *a, **k))
    out = pl.boundary_safety(candidates, table(hard, [(None, 40, 60), (1, None, 60), (1, 40, None)]), table(soft, [(None, 40, 60)]), M, "c", 6, width)
    got = {(r["m"], r["id"]): (r["n_hard"], r["n_soft"], r["clearance"]) for r in out.collect()}
    assert len(got) == len(places) + 2 and got[None, 7] == got[1, 900] == (0, 0, 6)
    assert all(got[m, k] == brute_safety(c, hard.get(m, []), soft.get(m, []), 6) for m, k, c in places)
    assert made == [sum(b < a for a, b in hard[3])] and made[0] > 0  # only the reversed ones are joined


def test_snapping_sends_no_table_to_the_driver(spark, monkeypatch):
    from tidemark.operators import planning as pl

    plans, store = [], pl.stored
    monkeypatch.setattr(pl, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, name))
    items = spark.createDataFrame([(1, "a", None, 100, 300), (1, "b", "a", 95, 200)], "m int, id string, parent string, t_ini long, t_fin long")
    plan = spark.createDataFrame([(1, k, (k - 1) * 100, k * 100) for k in range(1, 4)], "m int, chunk_no int, t_ini long, t_fin long")
    hard = spark.createDataFrame([(1, 98, 104), (1, 195, 206)], "m int, t_ini long, t_fin long")
    out = [pl.snap_nested(items, hard, hard.limit(0), M, "id", "parent", 15, 1, 5, 50), pl.snap_plan(plan, hard, hard.limit(0), M, 20, 1, 10, 120, 50)]
    assert [df.count() for df in out] == [2, 2]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in out]
    assert not any("Broadcast" in p for p in plans)


def test_replay_sends_no_table_to_the_driver_and_leaves_finished_documents(spark, monkeypatch):
    from tidemark.operators import history as hi
    from tidemark.operators import scan as sn

    plans, sizes, store = [], [], hi.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = store(df, name)
        if df.columns == ["m", "seq", "kind", "base"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(hi, "stored", watched)
    monkeypatch.setattr(sn, "stored", watched)
    # of 20 documents only one has an undo that finds nothing, after that a redo that doesn't
    log = [(m, s, "edit", None if s % 2 else s - 1, "f", 10 * m + s) for m in range(20) for s in range(1, 6)]
    log += [(99, 1, "undo", None, "f", 0), (99, 2, "edit", 0, "f", 7), (99, 3, "redo", None, "f", 0), (99, 4, "undo", None, "f", 0), (99, 5, "redo", 2, "f", 0)]
    rows = spark.createDataFrame(log, "m int, seq long, kind string, base long, field string, v long")
    out = hi.replay(rows, M, 4)
    got = {(r["m"], r["seq"]): (r["outcome"], r["revision"], r["target"]) for r in out.collect()}
    state = hi.state_at(out, M, ["field"], "v")
    assert {r["m"]: r["v"] for r in state.collect()} == {m: 10 * m + 5 for m in range(20)} | {99: 7}
    assert [got[99, s] for s in range(1, 6)] == [("nothing", 0, None), ("applied", 1, 2), ("nothing", 1, None), ("applied", 2, 2), ("applied", 3, 2)]
    assert all(got[m, s] == ("applied", s, s) for m in range(20) for s in range(1, 6))
    assert sizes == [105, 4, 3]  # the second and third round look at the one document that isn't done
    assert not any("Broadcast" in p for p in plans)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flatten_looks_for_the_clips_over_a_point(spark):
    from tidemark.operators import intervals as iv

    rng = random.Random(2)
    rows = [(m, k, rng.randrange(4), a, a + rng.randrange(1, 60), 1000 * k) for m in (1, 2) for k, a in enumerate(rng.randrange(150) for _ in range(25))] + [(3, 1, 1, 0, 90, 5), (3, 2, 2, 90, 90, 5)]
    clips = spark.createDataFrame(rows, "m int, clip_id int, rank int, seq_ini long, seq_fin long, source_ini long")
    out = iv.flatten(clips, M, "rank", gaps=True, bin_width=10)
    assert "Union" not in plan_of(out)  # pieces are no intervals that clips would look for in turn
    got = {}
    for r in out.collect():
        got.update({(r["m"], t): (r["clip_id"], r["source_ini"] + t - r["seq_ini"]) for t in range(r["seq_ini"], r["seq_fin"])})
    want = {}
    for m in (1, 2, 3):
        for t in range(250):
            over = [(-rank, k, s + t - a) for n, k, rank, a, b, s in rows if n == m and a <= t < b]
            want.update({(m, t): min(over)[1:]} if over else {})
    assert got == want
    edges = iv.elementary(spark.createDataFrame([(1, 5, 9), (1, 5, 9), (1, None, 7), (1, None, 9), (2, 3, 3)], "m int, t_ini long, t_fin long"), M)
    assert plan_of(edges).count("Exchange hashpartitioning") == 1
    assert sorted((tuple(r) for r in edges.collect()), key=str) == [(1, 5, 7), (1, 7, 9), (1, None, 5)]


@pytest.mark.parametrize("shared", [None, "s"])
def test_quotas_send_no_table_to_the_driver(spark, monkeypatch, shared):
    from tidemark.operators import greedy as gr
    from tidemark.operators import planning as pl

    plans, store = [], pl.stored
    for module in (pl, gr):
        monkeypatch.setattr(module, "stored", lambda df, name: plans.append(plan_of(df)) or store(df, name))
    rng = random.Random(4)
    rows = [(1, f"i{k:02}", "ab"[k % 2], t, t + 5, k / 40, [f"p{k % 9}"]) for k, t in enumerate(rng.sample(range(600), 40))]
    pool = spark.createDataFrame(rows, "m int, id string, lane string, t_ini long, t_fin long, rank double, s array<string>")
    out = pl.quota_select(pool, M, "lane", "rank", ["a", "b"], {"a": 4}, 20, shared=shared, bin_width=50)
    got = {r["id"]: r["accepted"] for r in out.collect()}
    taken = []
    for lane, most in (("a", 4), ("b", 99)):
        for r in sorted((r for r in rows if r[2] == lane), key=lambda r: (-r[5], r[3], r[1])):
            clash = any(r[3] - 20 < x[4] and r[4] + 20 > x[3] or shared and r[6] == x[6] for x in taken)
            if not clash and sum(x[2] == lane for x in taken) < most:
                taken.append(r)
    assert len(got) == 40 and {k for k, v in got.items() if v} == {r[1] for r in taken}
    assert plans and not any("Broadcast" in p for p in [*plans, plan_of(out)])
    if shared is None:
        assert not any("Generate explode(shared" in p for p in plans)
