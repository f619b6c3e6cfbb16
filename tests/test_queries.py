"""Every registered graph query on the smallest driver tables: its result against its DuckDB twin,
and its plan without pair products."""

import contextlib
import io

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from graphdrift.plans.oracle import ORACLE
from graphdrift.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _norm(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("None" if v is None or (isinstance(v, float) and v != v)
                         else (repr(float(v)) if isinstance(v, float) else str(v)) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    assert "CartesianProduct" not in buf.getvalue() and "BroadcastNestedLoopJoin" not in buf.getvalue()
    got = df.toPandas()
    want = con.execute(ORACLE[name]).df()
    assert len(want) > 0
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"id", "label", "x", "y", "dx", "dy"}
