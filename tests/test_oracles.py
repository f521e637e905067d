"""Every registered query with SQL against DuckDB, on whole tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from vecloom.plans.oracles import ORACLES
from vecloom.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(
        f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_DIR}/embeddings.parquet')"
    )
    return con


def _sorted(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted(tuple(r[i] for i in by) for r in rows)


def _positive_zero(rows):
    return all(
        math.copysign(1, v) > 0 for r in rows for v in r if isinstance(v, float) and v == 0.0
    )


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES.items() <= entry.queries().items()
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"sweep_timings"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    want_columns, want_rows = _sorted(names, want.fetchall())
    got_columns, got_rows = _sorted(got.columns, [tuple(r) for r in got.collect()])
    assert got_columns == want_columns
    assert len(got_rows) == len(want_rows) > 0
    assert got_rows == want_rows
    assert _positive_zero(got_rows) and _positive_zero(want_rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "neighbor_id", "score"]
    assert df.count() == 5000
