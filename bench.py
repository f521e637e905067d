"""Headline timings: prints one JSON line.

Training, adding and searching are timed apart, each search forced to the end by a no-op write.
`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the cores. With `BENCH_REFERENCE` set, `reference_*`
timings over 100,000 vectors of 200 values follow; they take minutes and are not part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from vecloom import session  # noqa: E402
from vecloom.operators.flat import exact_knn  # noqa: E402
from vecloom.operators.graph import build_graph, graph_search  # noqa: E402
from vecloom.operators.ivf import build_ivf, ivf_search  # noqa: E402
from vecloom.operators.kmeans import ivf_train  # noqa: E402
from vecloom.operators.recall import recall_at_k  # noqa: E402
from vecloom.plans.queries import QUERIES, embeddings, scaled  # noqa: E402
from vecloom.sources.dataset import as_queries  # noqa: E402

REPS = 2
#: Vectors, values of each and queries of the smallest size that the reference's scripts search.
REFERENCE_SIZE = (100_000, 200, 1_000)
REGISTERED = (
    "flat_ip_topk",
    "flat_l2_topk_scaled",
    "flat_ip_stream_base",
    "flat_ip_shuffle",
    "flat_ip_tiled",
    "flat_ip_farthest",
    "flat_bf16_topk",
    "recall_bf16",
    "pair_scores",
    "bf16_round",
    "ground_truth",
    "knn_graph_exact",
    "fbin_roundtrip",
    "i64bin_roundtrip",
)


def reference_table(base: DataFrame, n: int, dim: int) -> DataFrame:
    """`n` vectors of `dim` values from the test vectors by a fixed rule: repeated values, shifted by copy,
    with a wave added that differs in every vector."""
    copies = -(-n // base.count())
    number = F.col("vec_id") * copies + F.col("copy")

    def value(d):
        own = F.get("embedding", ((d * 7 + F.col("copy")) % F.size("embedding")).cast("int"))
        return (own + 0.3 * F.sin(0.37 * F.col("vec_id") + 1.7 * F.col("copy") + 0.91 * d)).cast("float")

    rows = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    vectors = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)
    return rows.select(number.alias("vec_id"), vectors.alias("embedding")).where(F.col("vec_id") < n)


def reference_point(base: DataFrame, timed) -> dict[str, float]:
    """Flat, IVF and graph search at the reference's smallest size; returns recall@10 of the latter two."""
    n, dim, n_query = REFERENCE_SIZE
    table, _ = session.cut(reference_table(base, n, dim).repartition(16), "reference")
    asked = as_queries(table.where(F.col("vec_id") % (n // n_query) == 0))
    found = timed("reference_flat", lambda: exact_knn(table, asked, 10, "ip"), 1)
    truth, _ = session.cut(found, "reference-truth")
    ivf = timed("reference_ivf_build", lambda: build_ivf(table, "ip"), 1)
    graph = timed("reference_graph_build", lambda: build_graph(table, "ip"), 1)
    by_ivf = timed("reference_ivf_nprobe32", lambda: ivf_search(ivf, asked, 10, 32), 1)
    by_graph = timed("reference_graph_ef32", lambda: graph_search(graph, asked, 10, 32), 1)
    results = {"reference_ivf_nprobe32": by_ivf, "reference_graph_ef32": by_graph}
    return {
        name: recall_at_k(df, truth, 10, n_query).head()["recall"] for name, df in results.items()
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vecloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, action, reps=REPS):
        """Least time of some runs; the first one pays for compiling plans."""
        for _ in range(reps):
            start = time.perf_counter()
            value = action()
            if isinstance(value, DataFrame):
                value.write.format("noop").mode("overwrite").save()
            taken = round(time.perf_counter() - start, 3)
            seconds[name] = min(taken, seconds.get(name, taken))
        return value

    base = embeddings(spark, sf_dir)
    asked = as_queries(base)
    # Starts the Python workers and compiles the common plans.
    exact_knn(base, asked, 10, "l2").write.format("noop").mode("overwrite").save()

    for name in REGISTERED:
        timed(name, lambda: QUERIES[name](spark, sf_dir))

    table = scaled(spark, sf_dir)
    centroids, _ = session.cut(timed("ivf_train", lambda: ivf_train(table)), "bench-centroids")
    index = timed("ivf_add", lambda: build_ivf(table, "ip", centroids=centroids))
    for nprobe in (8, 32, 64):
        timed(f"ivf_search_nprobe{nprobe}", lambda: ivf_search(index, asked, 10, nprobe))
    timed("ivf_search_shuffle_nprobe32", lambda: ivf_search(index, asked, 10, 32, "shuffle"))

    graph = timed("graph_build", lambda: build_graph(base, "l2"))
    timed("graph_search_ef32", lambda: graph_search(graph, asked, 10, 32))

    total = round(sum(seconds.values()), 3)
    recall = reference_point(base, timed) if os.environ.get("BENCH_REFERENCE") else None

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "recall": recall,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
