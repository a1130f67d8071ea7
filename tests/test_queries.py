"""Every core query against its SQL over whole tables, and without SQL for a stable schema."""

import datetime
import math
import os

import pytest

from lacre.plans import queries

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def sql(base):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(base):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{base}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, base, sql, name):
    df = queries.QUERIES[name](spark, base)
    columns = sorted(df.columns)
    ours = sorted((tuple(str(plain(r[c])) for c in columns) for r in df.collect()))
    cursor = sql.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(plain(dict(zip(names, r, strict=True))[c])) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, base, name):
    assert queries.QUERIES[name](spark, base).count() > 0
