"""Each query with SQL gives the same rows in DuckDB over the same files."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def order(row):
    return [(x is None, f"{x:.4f}" if isinstance(x, float) else str(x)) for x in row]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=order)
    told = duck.execute(SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(same, a, b)), (columns, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    if name.startswith("op") or name == "pipeline":
        pytest.skip("tested with the corpus operators")
    assert name == "rebalanced_accounts"
    books = QUERIES[name](spark, DATA).toPandas()
    assert len(books) and books["gap"].abs().max() < 1e-6  # how far weights may be below the optimum
    held = books.groupby("portfolio_id")["w"].sum()
    assert (abs(held - 1) < 1e-4).all() and books["w"].min() >= 0
