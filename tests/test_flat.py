from __future__ import annotations

import numpy as np
import pytest

from tests.helpers import SF_DIR, brute, conf, queries, result, table
from vecloom.operators import flat
from vecloom.operators.flat import Sizes, choose, exact_knn, measure
from vecloom.plans.queries import scaled
from vecloom.sources.dataset import as_queries

STRATEGIES = ["broadcast_base", "broadcast_queries", "shuffle"]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_ties_go_to_the_lower_id(spark, strategy):
    base = [[1, 0]] * 7 + [[0, 1]] * 5 + [[1, 0]]
    ids = [50, 3, 9, 41, 2, 77, 8, 100, 101, 102, 103, 104, 1]
    asked = [[1, 0], [0, 1]]
    got = result(
        exact_knn(
            table(spark, base, ids).repartition(5), queries(spark, asked), 4, "l2", strategy=strategy
        )
    )
    assert got == brute(base, asked, 4, "l2", ids=ids)
    assert [r[2] for r in got] == [1, 2, 3, 8, 100, 101, 102, 103]


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_a_third_of_the_base_is_one_vector(spark, strategy):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((900, 6)).astype(np.float32)
    base[rng.permutation(900)[:300]] = base[0]
    asked = np.concatenate([base[:1], rng.standard_normal((9, 6)).astype(np.float32)])
    with conf(spark, blockBytes=2000, partitionBytes=5000):
        got = result(
            exact_knn(table(spark, base).repartition(6), queries(spark, asked), 20, "l2", strategy=strategy)
        )
    assert got == brute(base, asked, 20, "l2")


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_k_beyond_the_base(spark, strategy):
    base, asked = [[1, 2], [3, 4]], [[1, 1], [0, 1], [2, 2]]
    got = result(exact_knn(table(spark, base), queries(spark, asked), 10, "ip", strategy=strategy))
    assert got == brute(base, asked, 10, "ip") and len(got) == 6


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_empty_sides(spark, strategy):
    some, none = table(spark, [[1, 2]]), table(spark, [])
    for base, asked in [(some, none), (none, some), (none, none)]:
        df = exact_knn(base, as_queries(asked), 3, "l2", strategy=strategy)
        assert df.columns == ["query_id", "rank", "neighbor_id", "score"] and df.count() == 0


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_dimension_mismatch_fails(spark, strategy):
    base = table(spark, [[1, 2], [1, 2, 3]])
    with pytest.raises(Exception, match="dimension mismatch"):
        exact_knn(base, queries(spark, [[1, 2]]), 1, "l2", strategy=strategy).collect()
    with pytest.raises(Exception, match="dimension mismatch"):
        exact_knn(table(spark, [[1, 2]]), queries(spark, [[1, 2, 3]]), 1, "l2", strategy=strategy).collect()


def test_bad_arguments(spark):
    t, q = table(spark, [[1, 2]]), queries(spark, [[1, 2]])
    for bad in [
        {"metric": "cosine"},
        {"metric": "L2"},
        {"k": 0},
        {"order": "up"},
        {"precision": "f16"},
        {"strategy": "x"},
    ]:
        with pytest.raises(ValueError):
            exact_knn(t, q, **({"k": 1, "metric": "l2"} | bad))


def test_strategies_and_partitionings_agree(spark):
    base = scaled(spark, SF_DIR)
    asked = as_queries(base)
    want = result(exact_knn(base, asked, 10, "l2"))
    for strategy in STRATEGIES:
        for parts in (1, 3, 11):
            with conf(spark, blockBytes=20_000, partitionBytes=100_000):
                df = exact_knn(
                    base.repartition(parts), asked.repartition(parts), 10, "l2", strategy=strategy
                )
                assert result(df) == want


def test_small_work_is_spread(spark, monkeypatch):
    monkeypatch.setattr(flat, "_SPREAD_WORK", 1)
    base = scaled(spark, SF_DIR)
    df = exact_knn(base, as_queries(base), 3, "ip")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_choice_follows_the_bound(spark):
    df = table(spark, [[0.0]])
    asked = queries(spark, [[0.0]])
    with conf(spark, broadcastBytes=1000):
        assert choose(df, asked, Sizes(50, 10**9, 3), 10) == "broadcast_base"
        assert choose(df, asked, Sizes(10**9, 5, 3), 10) == "broadcast_queries"
        assert choose(df, asked, Sizes(10**9, 5, 3), 100) == "tiled"
        assert choose(df, asked, Sizes(10**9, 10**9, 3), 10) == "shuffle"


def test_streaming_scan_shuffles_only_the_candidates(spark):
    base = scaled(spark, SF_DIR)
    df = exact_knn(base, as_queries(base), 10, "ip", strategy="broadcast_queries")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    df = exact_knn(base, as_queries(base), 10, "ip", strategy="broadcast_base")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_bf16_and_farthest_by_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 6)).astype(np.float32)
    got = result(exact_knn(table(spark, base), queries(spark, base), 5, "ip", "farthest"))
    assert got == brute(base, base, 5, "ip", "farthest")
    bits = base.view(np.uint32).astype(np.uint64)
    rounded = ((bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    got = result(exact_knn(table(spark, base), queries(spark, base), 5, "ip", precision="bf16"))
    assert got == brute(rounded, rounded, 5, "ip")


def test_wide_results_are_made_in_slices(spark, monkeypatch):
    monkeypatch.setattr(flat, "_STATE_BYTES", 100)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 4)).astype(np.float32)
    got = result(exact_knn(table(spark, base), queries(spark, base), 29, "l2"))
    assert got == brute(base, base, 29, "l2")


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("value", [float("nan"), float("inf")])
def test_values_must_be_finite(spark, strategy, value):
    good, bad = [[1, 2]], [[1, 2], [value, 0]]
    with pytest.raises(Exception, match="finite"):
        exact_knn(table(spark, bad), queries(spark, good), 1, "l2", strategy=strategy).collect()
    with pytest.raises(Exception, match="finite"):
        exact_knn(table(spark, good), queries(spark, bad), 1, "ip", strategy=strategy).collect()


def test_tiles_leave_the_base_in_place(spark):
    base, asked = scaled(spark, SF_DIR), as_queries(scaled(spark, SF_DIR)).where("query_id % 3 = 0")
    want = result(exact_knn(base, asked, 10, "ip"))
    with conf(spark, broadcastBytes=20_000):
        sizes = measure(base, asked)
        assert choose(base, asked, sizes, 10) == "tiled"
        assert result(exact_knn(base, asked, 10, "ip")) == want
