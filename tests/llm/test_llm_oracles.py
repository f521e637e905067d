"""The queries of this package that SQL can express, against DuckDB on whole tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from vecloom.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    want = duck.execute(ORACLES[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    want_rows = sorted(tuple(r[i] for i in at) for r in want.fetchall())
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == names
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want_rows
    assert want_rows


@pytest.mark.parametrize(
    "ids", [[0, 1000, 2000, 2001, *range(5000, 9000, 300)], [-70, -3, 5, 7, 640], [3, 300], [9]]
)
def test_preference_sql_pairs_lone_conversations(spark, tmp_path, ids):
    """Sparse ids, which the given table has not."""
    turns = [(i, t, r, f"{r} {i % 3}") for i in ids for t, r in enumerate(("user", "assistant"))]
    rows = spark.createDataFrame(
        [*turns, (77_777, 0, "user", "alone")], "conv_id bigint, turn bigint, role string, text string"
    )
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.execute(ORACLES["op2_preference_format"])
    names = [d[0] for d in want.description]
    want_rows = sorted(want.fetchall())
    got = QUERIES["op2_preference_format"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(tuple(r) for r in got) == want_rows
    assert bool(want_rows) == (len(ids) > 1)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
