"""Every registered query of the engine against its SQL on the smallest scale."""

import math

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cells(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        if isinstance(x, float):
            return f"{x:.7g}"
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert rows, name
    sql = catalog.oracle_sql().get(name)
    if sql:
        names = ", ".join(f'"{c}"' for c in columns)
        want = con.execute(f"SELECT {names} FROM ({sql})").fetchall()
        as_float = [i for i, c in enumerate(columns) if dict(df.dtypes)[c] == "double"]
        want = [tuple(float(x) if i in as_float and x is not None else x for i, x in enumerate(r)) for r in want]
        assert cells(rows) == cells(want)
