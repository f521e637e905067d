from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import queries, table
from vecloom import session
from vecloom.operators.centroid_tree import centroid_tree, tree_assign, tree_probes
from vecloom.operators.ivf import build_ivf, ivf_assign, ivf_probes, ivf_search

DIM = 8


def _centroids(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "list_id int, centroid array<double>")
    return session.cut(df, "centroids")[0]


@pytest.fixture(scope="module")
def clustered(spark):
    """300 centroids in 15 places and 2,000 vectors near them."""
    rng = np.random.default_rng(5)
    places = rng.normal(size=(15, DIM)) * 20
    lists = places[np.arange(300) % 15] + rng.normal(size=(300, DIM))
    vectors = lists[rng.integers(300, size=2000)] + rng.normal(size=(2000, DIM)) / 4
    return _centroids(spark, lists), table(spark, vectors).cache()


def _lists(df):
    return sorted(tuple(r) for r in df.select("vec_id", "list_id").collect())


@pytest.fixture(scope="module", params=["l2", "ip"])
def tree(request, clustered):
    """In tiles of about 60 lists."""
    return centroid_tree(clustered[0], request.param, iters=2, held_bytes=60 * DIM * 8)


def test_lists_are_those_of_all_pairs(clustered, tree):
    centroids, base = clustered
    assert len(tree.tiles) > 3
    rows = tree_assign(base, tree).join(centroids, "list_id").collect()
    want = _lists(ivf_assign(base, centroids, tree.metric))
    assert sorted((r["vec_id"], r["list_id"]) for r in rows) == want
    apart = [np.linalg.norm(np.array(r["embedding"]) - np.array(r["centroid"])) for r in rows]
    np.testing.assert_allclose([r["reach"] for r in rows], apart, rtol=1e-12)


def test_a_leaf_for_every_list(clustered):
    centroids, base = clustered
    small = centroid_tree(centroids, iters=1, held_bytes=DIM * 8)
    assert small.sizes.max() < 20 and len(small.tiles) > 100
    assert _lists(tree_assign(base.limit(50), small)) == _lists(ivf_assign(base.limit(50), centroids))


def test_most_centroids_are_never_scored_and_vectors_stay(clustered):
    centroids, base = clustered
    got = tree_assign(base, centroid_tree(centroids))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.sum("scored")).head()[0] < 0.3 * base.count() * centroids.count()


@pytest.mark.parametrize("nprobe", [7, 1000])
def test_probes_are_those_of_all_pairs(clustered, tree, nprobe):
    centroids, base = clustered
    asked = base.limit(60).withColumnRenamed("vec_id", "query_id")
    want = ivf_probes(centroids, asked, nprobe, tree.metric)
    assert sorted(tree_probes(asked, tree, nprobe).collect()) == sorted(want.collect())


def test_equal_centroids_are_cut_into_leaves_and_the_first_wins(spark):
    centroids = _centroids(spark, [[1.0, 2.0]] * 200 + [[9.0, 9.0]])
    tree = centroid_tree(centroids, iters=1, held_bytes=40 * 2 * 8)
    assert tree.sizes.max() < 40
    got = tree_assign(table(spark, [[1, 2], [9, 8], [0, 0]]), tree)
    assert _lists(got) == [(0, 0), (1, 200), (2, 0)]


def test_data_without_clusters_is_still_right(spark):
    rng = np.random.default_rng(1)
    centroids = _centroids(spark, rng.normal(size=(90, 32)))
    base = table(spark, rng.normal(size=(200, 32)))
    for groups in (1, 4, 90):
        got = tree_assign(base, centroid_tree(centroids, groups=groups, iters=1))
        assert _lists(got) == _lists(ivf_assign(base, centroids))


def test_edges(spark):
    one = _centroids(spark, [[1.0, 1.0]])
    empty = table(spark, [])
    tree = centroid_tree(one)
    assert tree_assign(empty, tree).count() == 0
    assert _lists(tree_assign(table(spark, [[3, 4]]), tree)) == [(0, 0)]
    assert tree_probes(queries(spark, [[3, 4]]), tree, 5).collect() == [(0, 0, 1)]
    with pytest.raises(ValueError, match="at least one centroid"):
        centroid_tree(one.limit(0))
    with pytest.raises(ValueError, match="metric"):
        centroid_tree(one, "cosine")


def test_an_index_built_by_the_tree_is_the_same(clustered):
    centroids, base = clustered
    asked = base.limit(20).withColumnRenamed("vec_id", "query_id")
    plain = build_ivf(base, "l2", centroids=centroids)
    treed = build_ivf(base, "l2", centroids=centroids, tree=True)
    assert sorted(treed.table("sizes").collect()) == sorted(plain.table("sizes").collect())
    found = [sorted(ivf_search(i, asked, 5, 3).collect()) for i in (plain, treed)]
    assert found[0] == found[1]
