"""Exact copies, hard negatives and whitening against brute force and edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, negatives, whitening
from tidemark.llm.common import save

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def by_sql(sql, columns, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=str)


# ---- op12


def copies_slowly(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids)]
    return sorted(out, key=str)


def test_exact_copies_sql(spark):
    df = exact_dedup.op12_exact_dedup(spark, SF)
    assert rows_of(df) == by_sql(exact_dedup.OP12_SQL, df.columns, documents=f"{SF}/documents.parquet")


@pytest.mark.parametrize("weak", [None, 3, 1])
def test_exact_copies_by_brute_force(spark, monkeypatch, weak):
    """With 3 keys or 1 for all texts every chain is a collision chain, in several pages and levels."""
    monkeypatch.setattr(exact_dedup, "PAGE", 8)
    monkeypatch.setattr(exact_dedup, "FAN", 3)
    rnd = random.Random(2)
    texts = ["a", "A", "a ", "", None, " ", "\n", "日本語", "é", "é", "x" * 200_000] + [f"text {i % 60}" for i in range(300)]
    rows = [(rnd.choice([None, rnd.randrange(900)]), rnd.choice(texts)) for _ in range(1500)] + [(5, "same")] * 700 + [(i, "hot") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("body", F.lit(1)).withColumn("row", F.lit(2)).withColumn("bucket", F.lit(None).cast("int"))
    hashed = F.xxhash64 if weak is None else lambda c: F.pmod(F.xxhash64(c), F.lit(weak))
    assert rows_of(exact_dedup.exact_copies(docs, hashed=hashed)) == copies_slowly(rows)
    assert exact_dedup.exact_copies(docs.limit(0)).count() == 0
    named = docs.select(F.concat(F.lit("n"), "doc_id").alias("name"), F.col("text").alias("page"))
    got = rows_of(exact_dedup.exact_copies(named, "name", "page").where("NOT kept").select("doc_id"))
    assert len(got) == len(rows) - len({t or "" for _, t in rows}) and all(i is None or i[0] == "n" for (i,) in got)


def test_directory_doubles_only_where_buckets_are_full():
    load = np.zeros(1 << 10, np.int64)
    load[:16] = 100
    load[700] = 5
    d = exact_dedup.grown(load, capacity=256)
    fill = np.bincount(d.slots, load.reshape(len(d.slots), -1).sum(1))
    assert fill.max() <= 256 and fill.sum() == load.sum() and d.depth == 9 and d.local.min() == 1 and len(d.local) == len(fill) < 20
    for b in range(len(d.local)):  # a bucket is one run of slots, as long as the bits it leaves open
        own = np.flatnonzero(d.slots == b)
        assert len(own) == 1 << (d.depth - d.local[b]) and own[-1] - own[0] == len(own) - 1
    more = load.copy()
    more[512:] = 3
    e = exact_dedup.grown(more, d, capacity=256)
    old = np.repeat(d.slots, len(e.slots) // len(d.slots))
    assert all(len(set(old[e.slots == b])) == 1 for b in range(len(e.local)))  # splits stay
    full = exact_dedup.grown(np.full(4, 1000), capacity=10)
    assert full.depth == 2 and (full.local == 2).all()


# ---- op11


def negatives_slowly(rows, every=100, low=80, high=100):
    """rows: (id, label, vector of whole numbers)."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2] and np.isfinite(r[2]).all()]
    width = max([len(r[2]) for r in rows], default=0)
    whole = [[int(np.floor(256 * c)) for c in r[2]] + [0] * (width - len(r[2])) for r in rows]
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(whole[a], w, strict=True)), r[0], r[1]) for r, w in zip(rows, whole, strict=True) if r[0] != i)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(-t, n) for t, n, other in scored if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, p, at + 1, n, -s, t) for at, (t, n) in enumerate(fits[:5])]
    return sorted(out, key=str)


def test_hard_negatives_sql(spark):
    df = negatives.op11_hard_negatives(spark, SF)
    assert rows_of(df) == by_sql(negatives.OP11_SQL, df.columns, embeddings=f"{SF}/embeddings.parquet")


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    """Clusters, ties, negative scores, repeated ids and rows that take no part; lists are pruned and dealt into chunks."""
    monkeypatch.setattr(negatives, "CLUSTER_ROWS", 20)
    monkeypatch.setattr(negatives, "MOST_ROWS", 25)
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((8, 5)) * 3
    rows = [(int(i) - 300, int(rnd.integers(3)), (centres[rnd.integers(8)] + rnd.standard_normal(5) * 0.1).round(2).tolist()) for i in range(700)]
    rows += [(i, 1, [1.0, 2.0, 0.5, 0.0, 0.0]) for i in range(1000, 1200)] + [(i, 2, [1.0, 2.0, 0.5]) for i in range(1200, 1220)]
    rows += [(100, 1, [1.0, 1.0, 1.0, 1.0, 1.0]), (100, 2, [0.5, 1.0, 1.0, 1.0, 1.0]), (200, 0, []), (1300, 9, [-1.0, 0.0, 0.0, 0.0, 0.0])]
    rows += [(300, None, [1.0] * 5), (400, 1, None), (500, 1, [1.0, None]), (600, 1, [float("nan")]), (700, 1, [float("inf")] * 5), (None, 1, [1.0] * 5)]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit(1)).withColumn("chunk", F.lit("x")).withColumn("w", F.lit(None).cast("int"))
    anchor = F.col("vec_id") % 100 == 0
    got = rows_of(negatives.hard_negatives(vectors, anchor))
    assert got == negatives_slowly(rows) and len(got) > 100
    assert rows_of(negatives.hard_negatives(vectors, anchor, low=30, high=90)) == negatives_slowly(rows, low=30, high=90)
    assert negatives.hard_negatives(vectors.limit(0), anchor).count() == 0
    assert negatives.hard_negatives(vectors.where("vec_id % 100 <> 0"), anchor).count() == 0
    wide = spark.createDataFrame([(100, 1, [1e9, 3e8]), (1, 1, [1e9, 3e8]), (2, 2, [9e8, 3e8]), (3, 2, [1e300, 1e300])], "vec_id long, label int, embedding array<double>")
    assert [(r["positive_id"], r["negative_id"]) for r in negatives.hard_negatives(wide, anchor).collect()] == [(1, 2), (1, 3)]  # scores cut to a long


def test_lists_outside_the_windows_are_not_visited():
    rnd = np.random.default_rng(4)
    known = negatives.Clusters(rnd.standard_normal((20, 8)) * 100, np.full(20, 3.0), np.ones(20, int), np.arange(20), 8)
    a = rnd.standard_normal((5, 8)) * 50
    low, high = known.bounds(a)
    for c in range(20):
        x = rnd.standard_normal((200, 8))
        x = known.centroids[c] + 3 * x / np.linalg.norm(x, axis=1)[:, None]
        s = a @ x.T
        assert (s >= low[:, c, None]).all() and (s <= high[:, c, None]).all() and (high[:, c] - low[:, c] < 6.1 * np.linalg.norm(a, axis=1) + 3).all()


# ---- op13


def whitened_slowly(v, k=16):
    x = np.floor(64 * np.asarray(v, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ q / np.sqrt(e), e / (z * z).sum() * n


def same(df, v, k=16):
    """Rows in vec_id order against the slow way, up to one sign for each component."""
    n, deviation, want, share = whitened_slowly(v, k)
    got = df.toPandas().sort_values(["vec_id", "component"])
    w = got["whitened"].to_numpy().reshape(want.shape)
    assert (got["n"] == n).all() and got["component"].tolist() == list(range(1, want.shape[1] + 1)) * len(want)
    assert got["deviation"].tolist() == np.repeat(deviation, want.shape[1]).tolist()
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert np.abs(got["explained"].to_numpy().reshape(want.shape) / share - 1).max() < 1e-9 and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_of_the_table(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas().sort_values("vec_id")
    same(whitening.op13_embedding_whitening(spark, SF), np.stack(t["embedding"]))


def test_whitening_edges(spark):
    rnd = np.random.default_rng(5)
    v = rnd.standard_normal((300, 6)) * [5, 4, 3, 2, 1, 0.5]
    v[100:200] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [1.0, float("-inf")])]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("component", F.lit(1))
    same(whitening.whiten(vectors), v, 6)
    short = [(i, [float(i % 7), float(i % 5)][: 1 + i % 2]) for i in range(60)] + [(60, []), (61, [0.0, 0.0])]
    padded = [x + [0.0] * (2 - len(x)) for _, x in short]
    same(whitening.whiten(spark.createDataFrame(short, "vec_id long, embedding array<double>")), padded, 2)
    assert whitening.whiten(vectors.limit(0)).count() == 0 and whitening.whiten(vectors.where("vec_id >= 900")).count() == 0
    assert whitening.whiten(vectors.where("vec_id BETWEEN 100 AND 199")).count() == 0  # one distinct vector
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 5.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat).toPandas()
    assert got["component"].tolist() == [1, 1, 1] and sorted(got["whitened"].abs().round(9)) == [1, 1, 1] and got["vec_id"].isna().sum() == 1
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")).toPandas()
    assert Counter(huge["deviation"])[2**63 - 1] == len(huge) - (huge["vec_id"] == 3).sum()


def test_whitening_in_small_blocks(spark):
    """Wider vectors than a block, with close eigenvalues and restarts, still give certified pairs."""
    rnd = np.random.default_rng(6)
    x = np.floor(64 * rnd.standard_normal((800, 60)) * np.linspace(1, 1.6, 60)).astype(np.int64) + 1_000_000
    fit = save(spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>"))
    w = whitening.fitted(fit, 60, k=4, block=5, basis=20)
    z = x - x.mean(0)
    e, q = np.linalg.eigh(z.T @ z / len(x))
    assert w.passes > 4 and w.residuals.max() <= 1e-12 * e[-1] and np.abs(w.values / e[::-1][:4] - 1).max() < 1e-12
    assert np.abs(np.abs((q[:, ::-1][:, :4] * w.vectors).sum(0)) - 1).max() < 1e-10 and whitening.identity_error(fit, w) < 1e-12
