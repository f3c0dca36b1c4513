"""Cases of the fourth review."""

import duckdb
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import joins as jn


def test_keyed_pairs_are_all_pairs_in_many_tasks(spark):
    left = spark.createDataFrame([(i, i % 3 if i % 5 else None, "x" if i % 2 else None) for i in range(90)], "a int, p int, q string")
    right = spark.createDataFrame([(i, i % 4 if i % 7 else None, "x" if i % 3 else None) for i in range(60)], "b int, r int, s string")
    want = sorted((x["a"], y["b"]) for x in left.collect() for y in right.collect() if x["p"] == y["r"] and x["q"] == y["s"])
    for size, block in ((20, 4), (200, 1), (50, None), (1 << 20, None)):
        out = jn.keyed_pairs(left, right, ["p", "q"], ["r", "s"], size, block)
        assert out.columns == ["a", "p", "q", "b", "r", "s"] and sorted((r["a"], r["b"]) for r in out.collect()) == want
    parts = [r["n"] for r in jn.keyed_pairs(left, right, ["p", "q"], ["r", "s"], 20, 4).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) > 5 and max(parts) < len(want) / 2
    assert jn.keyed_pairs(left, right.where("r > 5"), ["p", "q"], ["r", "s"]).count() == 0


def test_same_identity_takes_little_disk_and_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jn, "CELL", 20_000, raising=False)
    spark.range(2000).selectExpr("id s_suppkey", "cast(if(id % 97 = 0, null, id * 7 % 25) as int) s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(20_000).selectExpr("id c_custkey", "cast(if(id % 89 = 0, null, xxhash64(id) % 13 + 12) as int) c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    catalog.queries()["same_identity"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want, out = catalog.oracle_sql()["same_identity"], f"SELECT s_suppkey, c_custkey FROM '{tmp_path}/out/*.parquet'"
    n, missing, extra = con.execute(f"SELECT (SELECT count(*) FROM ({out})), (SELECT count(*) FROM ({want} EXCEPT ALL {out})), (SELECT count(*) FROM ({out} EXCEPT ALL {want}))").fetchall()[0]
    assert n > 300_000 and missing == extra == 0
    files = list((tmp_path / "out").glob("*.parquet"))
    # pairs in the order of files took more than a byte each, and all were made in one task
    assert len(files) > 4 and sum(f.stat().st_size for f in files) < 0.8 * n
