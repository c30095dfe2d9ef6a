"""Every registered query with SQL agrees with DuckDB on the smallest tables; every other one runs with a stable schema."""

import math
import os

import duckdb
import pytest

from postlens.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(x, y):
    if x is None or y is None:
        return x is y
    if isinstance(x, (int, float)) and isinstance(y, (int, float)):
        return math.isclose(float(x), float(y), rel_tol=1e-9)
    return str(x) == str(y)


def order(row):
    return tuple((x is not None, str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)) for x in row)


@pytest.fixture(scope="module")
def con(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(tables, t)}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, con, tables, name):
    df = catalog.QUERIES[name](spark, tables)
    cursor = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    places = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(r[k] for k in places) for r in cursor.fetchall()), key=order)
    got = sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=order)
    assert len(got) == len(want)
    assert all(all(map(same, g, w)) for g, w in zip(got, want, strict=True))


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
