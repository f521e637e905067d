from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import SF_DIR, brute, conf, queries, result, scan_paths, table
from vecloom import session
from vecloom.operators.flat import exact_knn
from vecloom.operators import ivf, kmeans
from vecloom.operators.ivf import build_ivf, ivf_assign, ivf_probes, ivf_search
from vecloom.operators.kmeans import default_n_list, first_drawn, ivf_train, n_list_of
from vecloom.plans.evaluate import evaluate, recall_by_nprobe
from vecloom.plans.queries import embeddings, scaled
from vecloom.plans.workflow import ground_truth
from vecloom.sources.dataset import as_queries


@pytest.fixture(scope="module")
def base(spark):
    return scaled(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def index(base):
    return build_ivf(base, "l2", n_list=16, iters=3)


def _centroids(df):
    table = df.toPandas().sort_values("list_id")
    return np.stack(table["centroid"].tolist())


@pytest.mark.parametrize(("n", "lists"), [(500, 89), (2000, 178), (10**6, 4000), (10**7, 12649)])
def test_n_list(spark, n, lists):
    assert default_n_list(n) == lists
    assert n_list_of(spark.range(n)).head()["n_list"] == lists


def test_training_matches_numpy(spark, base):
    got = _centroids(ivf_train(base, n_list=12, iters=4, seed=3))
    pdf = base.toPandas().sort_values("vec_id")
    x = np.stack(pdf["embedding"].tolist()).astype(float)
    seeds = first_drawn(base, 12, len(x), 3).toPandas().sort_values("list_id")
    c = x[seeds["vec_id"]]
    for _ in range(4):
        near = np.square(x[:, None] - c[None]).sum(-1).argmin(1)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(12)])
    np.testing.assert_allclose(got, c, atol=1e-9)


def test_training_does_not_depend_on_partitioning(base):
    one = _centroids(ivf_train(base.coalesce(1), n_list=10, iters=3))
    many = _centroids(ivf_train(base.repartition(13), n_list=10, iters=3))
    np.testing.assert_allclose(one, many, atol=1e-9)


def test_shuffled_training_equals_broadcast_training(spark, base):
    for spherical in (False, True):
        want = _centroids(ivf_train(base, n_list=9, iters=2, spherical=spherical))
        with conf(spark, broadcastBytes=1000, blockBytes=30_000):
            got = _centroids(ivf_train(base, n_list=9, iters=2, spherical=spherical))
        np.testing.assert_allclose(got, want, atol=1e-9)
    np.testing.assert_allclose(np.linalg.norm(got, axis=1), 1)


def test_vectors_stay_in_place_beyond_the_bound(spark, base, monkeypatch):
    """With centroids that no task may hold whole, nothing that is shuffled or joined has a vector."""
    centroids = ivf_train(base, n_list=11, iters=1).cache()
    with conf(spark, broadcastBytes=1500, blockBytes=9000):
        assigned = ivf_assign(base, centroids)
        assert not any("Exchange" in step or "Join" in step for p in scan_paths(assigned) for step in p)
        seen = []
        cut = session.cut
        monkeypatch.setattr(session, "cut", lambda df, name: (seen.append(df), cut(df, name))[1])
        ivf_train(base, n_list=11, iters=1)
    moved = [p for df in seen[1:] for p in scan_paths(df) if "MapInArrow" in p]
    assert moved
    for path in moved:
        # From the scan of the vectors up to the sums there is no exchange.
        last = max(i for i, step in enumerate(path) if step == "MapInArrow")
        assert not any("Exchange" in step for step in path[last:])


def test_more_lists_than_vectors_and_empty_lists(spark):
    vectors = [[0, 0], [0, 0], [9, 9]]
    centroids = ivf_train(table(spark, vectors), n_list=50, iters=2)
    assert centroids.count() == 3
    index = build_ivf(table(spark, vectors), "l2", centroids=centroids)
    assert index.table("sizes").count() == 2
    got = result(ivf_search(index, queries(spark, [[0, 0]]), 5, nprobe=50))
    assert got == brute(vectors, [[0, 0]], 5, "l2")
    with pytest.raises(ValueError, match="empty"):
        ivf_train(table(spark, []))


@pytest.mark.parametrize("coarse", ["l2", "ip"])
def test_assignment_is_the_exact_nearest_centroid(spark, base, coarse):
    centroids = ivf_train(base, n_list=11, iters=2).cache()
    as_base = centroids.select(
        F.col("list_id").cast("bigint").alias("vec_id"), F.col("centroid").alias("embedding")
    )
    want = exact_knn(as_base, as_queries(base), 1, coarse).select("query_id", "neighbor_id")
    want = sorted(map(tuple, want.collect()))
    got = ivf_assign(base, centroids, coarse)
    assert sorted(map(tuple, got.select("vec_id", "list_id").collect())) == want
    with conf(spark, broadcastBytes=500, blockBytes=20_000):
        got = ivf_assign(base, centroids, coarse).select("vec_id", "list_id").collect()
    assert sorted(map(tuple, got)) == want
    probes = ivf_probes(centroids, as_queries(base), 1, coarse).select("query_id", "list_id")
    assert sorted(map(tuple, probes.collect())) == want


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_all_lists_probed_equals_exact(base, index, strategy):
    asked = as_queries(base)
    want = result(exact_knn(base, asked, 10, "l2"))
    assert result(ivf_search(index, asked, 10, 16, strategy)) == want


def test_strategies_agree_with_small_files_and_blocks(spark, base):
    with conf(spark, partitionBytes=20_000, blockBytes=5_000):
        index = build_ivf(base, "ip", n_list=16, iters=3)
        assert index.meta.n_bucket > 1
        asked = as_queries(base)
        want = result(ivf_search(index, asked, 10, 3, "broadcast"))
        assert result(ivf_search(index, asked, 10, 3, "shuffle")) == want
        with conf(spark, broadcastBytes=1000):
            assert result(ivf_search(index, asked, 10, 3)) == want


def test_hot_list_is_split(spark):
    """Two thirds of all vectors lie in one list; its files and blocks stay bounded."""
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((600, 4)).astype(np.float32)
    vectors[:400] = vectors[:400] * 1e-3 + 5
    centroids = spark.createDataFrame(
        [(0, [5.0] * 4), (1, [0.0] * 4), (2, [-1.0] * 4)], "list_id int, centroid array<double>"
    )
    base = table(spark, vectors)
    with conf(spark, partitionBytes=1600, blockBytes=800):
        index = build_ivf(base, "l2", centroids=centroids)
        sizes = index.table("lists").groupBy(F.input_file_name()).count().toPandas()["count"]
        assert sizes.max() <= 200 and len(sizes) >= 6
        got = result(ivf_search(index, as_queries(base), 6, 3, "shuffle"))
    assert got == brute(vectors, vectors, 6, "l2")


def test_only_probed_buckets_are_scanned(spark, base):
    with conf(spark, partitionBytes=10_000):
        index = build_ivf(base, "l2", n_list=16, iters=2)
        assert index.meta.n_bucket >= 8
        one = as_queries(base).where("query_id = 7")
        for strategy in ("broadcast", "shuffle"):
            plan = ivf_search(index, one, 5, 1, strategy)._jdf.queryExecution().toString()
            assert re.search(r"PartitionFilters: \[[^]]*list_bucket#\d+ (=|IN)", plan)
            assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_recall_does_not_fall_with_nprobe(spark):
    base = embeddings(spark, SF_DIR)
    index = build_ivf(base, "ip")
    asked = as_queries(base)
    truth = ground_truth(base, asked, 10, "ip").cache()
    rows = recall_by_nprobe(index, asked, truth, 10, [89, 1, 4, 16]).orderBy("nprobe").collect()
    assert [r["nprobe"] for r in rows] == [1, 4, 16, 89]
    recalls = [r["recall"] for r in rows]
    assert recalls == sorted(recalls) and recalls[0] > 0.1 and recalls[-1] == 1.0
    for row in rows[:2]:
        alone = evaluate(index, asked, 10, nprobe=row["nprobe"]).head()["recall"]
        assert alone == pytest.approx(row["recall"])


def test_arguments(spark, base, index):
    asked = as_queries(base)
    with pytest.raises(ValueError):
        ivf_search(index, asked, 0)
    with pytest.raises(ValueError):
        ivf_search(index, asked, 5, 0)
    with pytest.raises(ValueError):
        ivf_search(index, asked, 5, 1, "fast")
    with pytest.raises(ValueError):
        build_ivf(base, "euclid")
    assert ivf_search(index, asked.where("query_id < 0"), 5).count() == 0


def test_list_ranges_cover_and_join_the_nearest(monkeypatch):
    lists = np.array([1, 2, 3, 10, 11, 40, 41, 90])
    assert ivf.list_ranges(lists, lists) == [(1, 3), (10, 11), (40, 41), (90, 90)]
    monkeypatch.setattr(ivf, "_MAX_RANGES", 2)
    assert ivf.list_ranges(lists, lists) == [(1, 41), (90, 90)]
    assert ivf.list_ranges(lists[:0], lists[:0]) == []


def test_scan_filter_has_the_probed_lists(spark, base):
    index = build_ivf(base, "l2", n_list=50, iters=1)
    asked = as_queries(base).where("query_id = 7")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = ivf_search(index, asked, 5, nprobe=2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan, re.S).group(1)
    assert "GreaterThanOrEqual(list_id" in pushed and "LessThanOrEqual(list_id" in pushed


def test_offsets_follow_list_order(spark):
    rows = [(i, 1 + i % 3) for i in range(0, 20_000, 7)]
    got = ivf._offsets(spark.createDataFrame(rows, "list_id int, n bigint")).collect()
    at = 0
    for row in sorted(got):
        assert row["start"] == at
        at += row["n"]


@pytest.fixture(scope="module")
def clustered(spark):
    """Far more spread between clusters than inside, some vectors repeated."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 30, (40, 3))
    vectors = (centres[rng.integers(0, 40, 3000)] + rng.normal(0, 1, (3000, 3))).astype(np.float32)
    vectors[100:130] = vectors[7]
    base = table(spark, vectors).repartition(8).cache()
    with conf(spark, partitionBytes=3000):
        return vectors, base, {m: build_ivf(base, m, n_list=60, iters=4) for m in ("l2", "ip")}


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact_search_visits_only_lists_that_can_win(spark, clustered, metric, monkeypatch):
    vectors, base, indexes = clustered
    index, asked = indexes[metric], as_queries(base).where("query_id % 30 = 7")
    want = brute(vectors, vectors[7::30], 10, metric)
    want = [(7 + 30 * q, *rest) for q, *rest in want]
    visited = []
    stream = ivf._stream_lists
    monkeypatch.setattr(
        ivf, "_stream_lists", lambda *a: (visited.append(a[3].num_rows), stream(*a))[1]
    )
    got = [(*r[:3], pytest.approx(r[3], rel=1e-5, abs=1e-5)) for r in result(ivf_search(index, asked, 10, None))]
    assert got == want
    assert sum(visited) < 0.6 * 100 * 60
    # In tiles, with k above the size of the first lists, and with more than there is.
    with conf(spark, broadcastBytes=20_000):
        tiled = result(ivf_search(index, asked, 10, None))
    assert [r[:3] for r in tiled] == [r[:3] for r in want]
    few = asked.where("query_id < 100")
    every = result(exact_knn(base, few, 3001, metric))
    assert result(ivf_search(index, few, 3001, None)) == every


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_two_passes_send_fewer_candidates(spark, clustered, metric):
    _, base, indexes = clustered
    index, asked = indexes[metric], as_queries(base).where("query_id % 10 = 0")
    want = result(ivf_search(index, asked, 10, 20, "broadcast"))
    assert result(ivf_search(index, asked, 10, 20, "two_pass")) == want
    probes = ivf_probes(index.table("centroids"), asked, 20).toArrow()
    with conf(spark, partitionBytes=3000):
        once = ivf._stream_lists(index, asked, 10, probes.select(["query_id", "list_id"])).count()
        twice = ivf._two_pass(index, asked, 10, lambda _: probes, probes).count()
    assert twice < 0.7 * once


def test_exact_search_needs_radii(spark, base, tmp_path):
    index = build_ivf(base, "l2", str(tmp_path / "old"), n_list=4, iters=1)
    sizes = index.table("sizes").drop("radius").toPandas()
    spark.createDataFrame(sizes, "list_id int, n bigint").write.mode("overwrite").parquet(f"{index.path}/sizes")
    with pytest.raises(Exception, match="radii"):
        ivf_search(index, as_queries(base), 3, None).collect()
    assert ivf_search(index, as_queries(base), 3, 2).count() == 3 * base.count()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_pairs_of_exact_search_stay_off_the_driver(spark, metric, monkeypatch):
    """Every query reaches every list here, and vectors are collected once."""
    vectors = np.random.default_rng(3).standard_normal((900, 24)).astype(np.float32)
    base = table(spark, vectors).repartition(4).cache()
    index = build_ivf(base, metric, n_list=50, iters=2)
    asked = as_queries(base).where("query_id % 3 = 0")
    want = result(exact_knn(base, asked, 5, metric))
    rows, frame = [], type(base)
    collect = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: (t := collect(df), rows.append(t.num_rows))[0])
    assert result(ivf_search(index, asked, 5, None)) == want
    # Vectors, first lists, floors and reached lists.
    assert sum(rows) <= 300 * (2 + ivf._first_lists(index, 5)) + 2 * 50


def test_exact_search_of_repeated_queries(spark, clustered):
    _, base, indexes = clustered
    asked = as_queries(base).where("query_id < 40")
    want = result(ivf_search(indexes["l2"], asked, 10, None))
    assert result(ivf_search(indexes["l2"], asked.unionAll(asked), 10, None)) == want


def test_tiles_of_centroids_are_read_in_one_job(spark, monkeypatch):
    rows = [(i, [float(i), 1.0]) for i in range(37)]
    centroids = spark.createDataFrame(rows, "list_id int, centroid array<double>")
    jobs, frame = [], type(centroids)
    collect = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: (jobs.append(1), collect(df))[1])
    for block_bytes, wanted in ((1 << 20, 1), (10 * 2 * 8, 4), (1, 8)):
        jobs.clear()
        with conf(spark, blockBytes=block_bytes):
            tiles = kmeans.CentroidTiles(centroids, 5, "l2").tiles
        assert len(jobs) == wanted
        assert [t.value[0].tolist() for t in tiles] == [[*range(a, min(a + 5, 37))] for a in range(0, 37, 5)]
        assert np.concatenate([t.value[1] for t in tiles])[:, 0].tolist() == [*range(37)]
