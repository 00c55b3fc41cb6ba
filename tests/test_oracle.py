"""Every registered query with SQL, against DuckDB on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

from veritick.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(value(r[c]) for c in cols) for r in rows), key=repr) == want
