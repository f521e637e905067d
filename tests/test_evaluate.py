from __future__ import annotations

import pytest

from tests.helpers import SF_DIR, conf, queries, table
from vecloom.operators.flat import exact_knn
from vecloom.operators.ivf import build_ivf
from vecloom.operators.recall import recall_at_k
from vecloom.plans import evaluate as evaluation
from vecloom.plans.evaluate import SweepPoint, evaluate, recall_by_ef, recall_by_nprobe, sweep
from vecloom.plans.queries import QUERIES, embeddings, scaled
from vecloom.plans.workflow import build_flat, build_index, ground_truth
from vecloom.sources.dataset import as_queries, prefix


def test_recall_counts_slots_of_all_queries(spark):
    truth = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "query_id long, neighbor_id long")
    found = spark.createDataFrame([(0, 2), (0, 9)], "query_id long, neighbor_id long")
    assert recall_at_k(found, truth, 2, 2).head()["recall"] == 0.25
    assert recall_at_k(truth, truth, 2, 2).head()["recall"] == 1.0
    assert recall_at_k(found.limit(0), truth, 2, 2).head()["recall"] == 0.0
    doubled = found.union(found)
    assert recall_at_k(doubled, truth, 2, 2).head()["recall"] == 0.5


def test_exact_index_has_full_recall_under_its_own_metric(spark):
    base = scaled(spark, SF_DIR)
    for metric in ("l2", "ip"):
        assert evaluate(build_flat(base, metric), as_queries(base), 10).head()["recall"] == 1.0


def test_truth_base_must_match_the_index(spark):
    base = embeddings(spark, SF_DIR)
    index = build_ivf(base, "ip", n_list=5, iters=1)
    with pytest.raises(ValueError, match="500"):
        evaluate(index, as_queries(base), 10, base=prefix(base, 100))
    assert evaluate(index, as_queries(base), 10, nprobe=5, base=base).head()["recall"] == 1.0


def test_recall_is_low_when_few_vectors_exist(spark):
    base, asked = table(spark, [[1, 2], [2, 1]]), queries(spark, [[1, 1]])
    truth = ground_truth(base, asked, 10, "ip")
    assert recall_at_k(exact_knn(base, asked, 10, "ip"), truth, 10, 1).head()["recall"] == 0.2


def test_recall_by_ef(spark):
    base = embeddings(spark, SF_DIR)
    index = build_index(base, "graph", "l2", m=8, candidates="exact")
    asked = as_queries(base)
    rows = recall_by_ef(index, asked, ground_truth(base, asked, 10, "l2"), 10, [500, 10]).collect()
    recalls = {r["ef"]: r["recall"] for r in rows}
    assert recalls[10] <= recalls[500] == 1.0


def test_sweep(spark):
    base = embeddings(spark, SF_DIR)
    points = [
        SweepPoint("flat", 200, 50),
        SweepPoint("ivf", 200, 50, (1, 20), {"n_list": 20, "iters": 2}),
        SweepPoint("ivf", 200, 10, (20,), {"n_list": 20, "iters": 2}),
    ]
    timings, recalls = sweep(base, as_queries(base), points, "ip", 10, reps=3)
    rows = {(r["index"], r["n_query"], r["knob"]): r["recall"] for r in recalls.collect()}
    assert rows[("flat", 50, 0)] == rows[("ivf", 50, 20)] == rows[("ivf", 10, 20)] == 1.0
    assert rows[("ivf", 50, 1)] < 1.0
    phases = [(r["index"], r["phase"], r["rep"]) for r in timings.collect()]
    assert phases.count(("ivf", "train", 0)) == phases.count(("ivf", "add", 0)) == 1
    assert phases.count(("flat", "search", 2)) == 1 and phases.count(("ivf", "search", 2)) == 3
    assert all(r["millis"] >= 0 for r in timings.collect())


def test_queries_without_sql(spark):
    rows = QUERIES["graph_recall_sweep_ef"](spark, SF_DIR).orderBy("ef").collect()
    assert [r["ef"] for r in rows] == [10, 32, 128]
    assert rows[0]["recall"] > 0.9 and rows[-1]["recall"] == 1.0
    timings = QUERIES["sweep_timings"](spark, SF_DIR)
    assert {r[0] for r in timings.select("index").collect()} == {"flat", "ivf", "graph"}


def test_a_sweep_of_large_tables_collects_no_vectors(spark, monkeypatch):
    base = embeddings(spark, SF_DIR).cache()
    asked = as_queries(base)
    points = [
        SweepPoint("flat", knobs=(1,), precision="bf16"),
        SweepPoint("ivf", knobs=(4,), options={"n_list": 10, "iters": 1}),
    ]
    # Written to the end: a search of another strategy than before has the same rows.
    want = sweep(base, asked, points, "ip", 5, reps=1)[1].collect()
    rows, frame = [], type(base)
    collect = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: (t := collect(df), rows.append(t.num_rows))[0])
    monkeypatch.setattr(evaluation, "_COLLECTED", 1000)
    assert sweep(base, asked, points, "ip", 5, reps=1)[1].collect() == want
    # Centroids and block plans, but neither vectors nor probes.
    assert max(rows) <= 10


def test_partitions_of_a_probe_sweep_follow_its_candidates(spark, monkeypatch):
    base = embeddings(spark, SF_DIR)
    index, asked = build_ivf(base, "ip", n_list=20, iters=1), as_queries(base)
    plans, best = [], evaluation.top_k

    def seen(df, *args, **named):
        plans.append((named["by"], df._jdf.queryExecution().toString()))
        return best(df, *args, **named)

    monkeypatch.setattr(evaluation, "top_k", seen)
    truth = ground_truth(base, asked, 5, "ip")
    with conf(spark, partitionBytes=10_000):
        recall_by_nprobe(index, asked, truth, 5, (1, 4))
    (by, plan), (then, _) = plans
    # 500 queries, 4 lists, 5 candidates of 64 bytes.
    assert "band" in by and "nprobe" in then and "hashpartitioning(query_id" in plan
    assert ", 64), REPARTITION_BY_NUM" in plan
