"""Brute force in numpy, and small tables."""

from __future__ import annotations

import numpy as np

SF_DIR = "/root/testdata/sf0.001"


def table(spark, vectors, ids=None, id_col="vec_id"):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{id_col} bigint, embedding array<float>")


def queries(spark, vectors, ids=None):
    return table(spark, vectors, ids, "query_id")


def brute(base, asked, k, metric, order="nearest", ids=None):
    """(query position, rank, id, score) rows, lower id first on ties."""
    ids = np.arange(len(base)) if ids is None else np.asarray(ids)
    base = np.asarray(base, np.float32).astype(float)
    asked = np.asarray(asked, np.float32).astype(float)
    rows = []
    for q, v in enumerate(asked):
        s = base @ v if metric == "ip" else np.square(base - v).sum(axis=1)
        larger = (metric == "ip") == (order == "nearest")
        best = np.lexsort((ids, -s if larger else s))[:k]
        rows += [(q, r + 1, int(ids[i]), round(float(s[i]), 6)) for r, i in enumerate(best)]
    return rows


def result(df):
    rows = df.select("query_id", "rank", "neighbor_id", "score").collect()
    return sorted((r[0], r[1], r[2], round(r[3], 6)) for r in rows)


def ids_of(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in df.collect())


class conf:
    """Session settings for the length of a block."""

    def __init__(self, spark, **values):
        self.spark, self.values = spark, {f"spark.vecloom.{k}": str(v) for k, v in values.items()}

    def __enter__(self):
        for key, value in self.values.items():
            self.spark.conf.set(key, value)

    def __exit__(self, *_):
        for key in self.values:
            self.spark.conf.unset(key)


def scan_paths(df):
    """For every scan of the plan, the names of the operators from the root down to it."""
    paths = []
    adaptive = "spark.sql.adaptive.enabled"
    was = df.sparkSession.conf.get(adaptive)
    df.sparkSession.conf.set(adaptive, "false")

    def walk(node, above):
        above = [*above, node.nodeName()]
        children = node.children()
        if children.size() == 0:
            paths.append(above)
        for i in range(children.size()):
            walk(children.apply(i), above)

    try:
        walk(df._jdf.queryExecution().executedPlan(), [])
    finally:
        df.sparkSession.conf.set(adaptive, was)
    return paths
