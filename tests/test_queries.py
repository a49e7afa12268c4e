"""Every registered query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from streamloom import plans

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return int(v) if isinstance(v, bool) else v

    return sorted([tuple(str(value(r[i])) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = duck.execute(plans.ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(got.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    rows = plans.QUERIES[name](spark, DATA).collect()
    assert rows
    for c in ("same", "prefixed_same", "kind_same", "time_same", "key_same"):
        assert all(r[c] for r in rows if c in r)
