"""Every query of the core runs; those with SQL give the same rows in DuckDB."""

import glob
import os

import duckdb
import pytest

from metascope.queries import QUERIES, SQL


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if v is None or v != v:
            return "\0"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    r = duck.execute(SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon([tuple(x) for x in df.collect()], df.columns) == canon(r.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    QUERIES[name](spark, data).collect()
