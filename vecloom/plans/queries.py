"""Named queries over an `embeddings` table; base and queries are all of its vectors.

`scaled` multiplies each vector by 1 to 5, since on unit vectors both metrics rank alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions.vectors import bf16_vector, inner_product, l2_squared
from vecloom.operators import inspect
from vecloom.operators.centroid_tree import centroid_tree, tree_assign, tree_probes
from vecloom.operators.flat import Sizes, exact_knn
from vecloom.operators.graph import build_graph, graph_search, knn_graph
from vecloom.operators.ivf import build_ivf, ivf_assign, ivf_probes, ivf_search
from vecloom.operators.kmeans import ivf_train, n_list_of
from vecloom.operators.recall import recall_at_k
from vecloom.plans.evaluate import SweepPoint, evaluate, recall_by_ef, recall_by_nprobe, sweep
from vecloom.plans.workflow import build_flat, ground_truth, search
from vecloom.sources.binary import fbin_shape, read_fbin, read_i64bin, write_fbin, write_i64bin
from vecloom.sources.dataset import as_queries, load_dataset, prefix
from vecloom.sources.index_store import VectorIndex, load_index, save_index
from vecloom.sources.single_file import write_fbin_file, write_i64bin_file

K = 10
NPROBE = 8
NPROBES = (1, 4, 16, 32)
EFS = (10, 32, 128)
DESCENT_ROUNDS = 3
GRAPH_M = 32
#: Bytes of centroids that the tiled queries hold at a time.
_TILE_BYTES = 8 << 10

Query = Callable[[SparkSession, str], DataFrame]


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = 1 + F.col("vec_id") % 5
    return embeddings(spark, sf_dir).select(
        "vec_id", F.transform("embedding", lambda x: (x * factor).cast("float")).alias("embedding")
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to 6 places, without negative zeros."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in columns})


def _neighbours(df: DataFrame) -> DataFrame:
    return rounded(df.select("query_id", "rank", "neighbor_id", "score"), "score")


def _flat(table: Callable, metric: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = table(spark, sf_dir)
        return _neighbours(exact_knn(base, as_queries(base), K, metric, **options))

    return query


def _long(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    exploded = df.select(id_col, F.posexplode(vector).alias("pos", "value"))
    return exploded.withColumn("value", F.col("value").cast("double"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both metrics between every vector and the next one, as plain column expressions."""
    a = scaled(spark, sf_dir).withColumnRenamed("embedding", "a")
    b = scaled(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    scores = a.join(b, "vec_id").select(
        "vec_id", inner_product("a", "b").alias("ip"), l2_squared("a", "b").alias("l2")
    )
    return rounded(scores, "ip", "l2")


def bf16_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = embeddings(spark, sf_dir)
    return _long(df.withColumn("embedding", bf16_vector("embedding")), "vec_id", "embedding")


def recall_bf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    queries = as_queries(base)
    truth = ground_truth(base, queries, K, "ip")
    found = exact_knn(base, queries, K, "ip", precision="bf16")
    return rounded(recall_at_k(found, truth, K, queries.count()), "recall")


def prefix_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search in the first half of the base, the prefix being what a learn limit selects."""
    base = embeddings(spark, sf_dir)
    half = base.count() // 2
    return _neighbours(exact_knn(prefix(base, half), as_queries(base), K, "ip"))


def dataset_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.shape(embeddings(spark, sf_dir))


def _preview(layout: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        grid = inspect.preview(embeddings(spark, sf_dir), layout=layout)
        return grid.withColumn("value", F.col("value").cast("double"))

    return query


def n_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_list_of(embeddings(spark, sf_dir))


def truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scaled(spark, sf_dir)
    path = session.scratch_path(spark, "truth")
    return _neighbours(ground_truth(base, as_queries(base), K, "ip", path))


def ground_truth_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scaled(spark, sf_dir)
    shown = inspect.truth_preview(ground_truth(base, as_queries(base), K, "ip"))
    return shown.select("query_id", F.array_join("neighbors", " ").alias("neighbors"))


def ivf_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_long(ivf_train(embeddings(spark, sf_dir)), "list_id", "centroid"), "value")


def ivf_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    return ivf_assign(base, ivf_train(base)).select("vec_id", "list_id")


def ivf_centroids_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained with a few of the centroids in a task at a time."""
    trained = ivf_train(embeddings(spark, sf_dir), held_bytes=_TILE_BYTES)
    return rounded(_long(trained, "list_id", "centroid"), "value")


def ivf_lists_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    centroids, _ = session.cut(ivf_train(base), "centroids")
    return ivf_assign(base, centroids, held_bytes=_TILE_BYTES).select("vec_id", "list_id")


def ivf_lists_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned through a tree of centroids, which leaves out lists that cannot be the nearest."""
    base = embeddings(spark, sf_dir)
    centroids, _ = session.cut(ivf_train(base), "centroids")
    return tree_assign(base, centroid_tree(centroids)).select("vec_id", "list_id")


def ivf_probe_lists_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    centroids, _ = session.cut(ivf_train(base), "centroids")
    return tree_probes(as_queries(base), centroid_tree(centroids), NPROBE)


def ivf_probe_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    return ivf_probes(ivf_train(base), as_queries(base), NPROBE)


def _ivf(metric: str, coarse_metric: str = "l2", strategy: str = "auto", reload: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scaled(spark, sf_dir)
        index = build_ivf(base, metric, coarse_metric=coarse_metric)
        if reload:
            path = session.scratch_path(spark, "saved-ivf")
            save_index(index, path)
            index = load_index(spark, path, "ivf")
        return _neighbours(ivf_search(index, as_queries(base), K, NPROBE, strategy))

    return query


def _ivf_exact(metric: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scaled(spark, sf_dir)
        return _neighbours(ivf_search(build_ivf(base, metric), as_queries(base), K, nprobe=None))

    return query


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    index = build_ivf(base, "ip")
    return rounded(evaluate(index, as_queries(base), K, nprobe=NPROBE, base=base), "recall")


def recall_sweep_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    queries = as_queries(base)
    truth = ground_truth(base, queries, K, "ip")
    return rounded(recall_by_nprobe(build_ivf(base, "ip"), queries, truth, K, NPROBES), "recall")


def flat_saved_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scaled(spark, sf_dir)
    path = session.scratch_path(spark, "saved-flat")
    build_flat(base, "l2", path)
    return _neighbours(search(load_index(spark, path, "flat"), as_queries(base), K))


def knn_graph_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = knn_graph(embeddings(spark, sf_dir), GRAPH_M, "l2", candidates="exact")
    return rounded(edges.select("src", "dst", "rank", "score"), "score")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    base = embeddings(spark, sf_dir)
    return build_graph(base, "l2", m=GRAPH_M), base


def knn_graph_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as it is built by default, with neighbours found through inverted lists."""
    edges = knn_graph(embeddings(spark, sf_dir), GRAPH_M, "l2")
    return rounded(edges.select("src", "dst", "rank", "score"), "score")


def knn_graph_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph built from two lists per vector and rounds of neighbour descent."""
    edges = knn_graph(
        embeddings(spark, sf_dir), GRAPH_M, "l2", candidates="descent", rounds=DESCENT_ROUNDS
    )
    return rounded(edges.select("src", "dst", "rank", "score"), "score")


def graph_search_ef32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam much narrower than the table, over exact edges."""
    base = embeddings(spark, sf_dir)
    index = build_graph(base, "l2", m=GRAPH_M, candidates="exact")
    return _neighbours(graph_search(index, as_queries(base), K, ef=32))


def graph_search_full_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as the table visits all of it, so the result is exact."""
    index, base = _graph(spark, sf_dir)
    return _neighbours(graph_search(index, as_queries(base), K, ef=index.meta.n_base))


def graph_recall_sweep_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, base = _graph(spark, sf_dir)
    queries = as_queries(base)
    truth = ground_truth(base, queries, K, "l2")
    return rounded(recall_by_ef(index, queries, truth, K, EFS), "recall")


def fbin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.scratch_path(spark, "fbin")
    write_fbin(embeddings(spark, sf_dir), path)
    return _long(read_fbin(spark, path), "vec_id", "embedding")


def fbin_dataset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and query files from one folder, the base limited to half its rows, then searched."""
    table = scaled(spark, sf_dir)
    folder = session.scratch_path(spark, "dataset")
    write_fbin(table, f"{folder}/dataset.bin")
    write_fbin(table, f"{folder}/query.bin")
    n, dim = fbin_shape(f"{folder}/query.bin")
    base, queries = load_dataset(spark, folder, learn_limit=n // 2)
    return _neighbours(exact_knn(base, queries, K, "l2", sizes=Sizes(n // 2, n, dim)))


def i64bin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scaled(spark, sf_dir)
    queries = as_queries(base)
    path = session.scratch_path(spark, "i64bin")
    write_i64bin(ground_truth(base, queries, K, "ip"), queries, path, K)
    return read_i64bin(spark, path, K)


def fbin_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.scratch_path(spark, "one-fbin")
    write_fbin_file(embeddings(spark, sf_dir), path)
    return _long(read_fbin(spark, path), "vec_id", "embedding")


def i64bin_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scaled(spark, sf_dir)
    queries = as_queries(base)
    path = session.scratch_path(spark, "one-i64bin")
    write_i64bin_file(ground_truth(base, queries, K, "ip"), queries, path, K)
    return read_i64bin(spark, path, K)


def _points() -> list[SweepPoint]:
    return [
        SweepPoint("flat"),
        SweepPoint("ivf", knobs=(NPROBE, 4 * NPROBE)),
        SweepPoint("graph", knobs=(32,)),
    ]


def sweep_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    return sweep(base, as_queries(base), _points(), "ip", K, reps=2)[0]


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps a sweep times; the times themselves are only checked not to be negative."""
    timings = sweep_timings(spark, sf_dir)
    return timings.withColumn("timed", F.col("millis") >= 0).drop("millis")


def sweep_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    points = [
        SweepPoint("flat"),
        SweepPoint("flat", knobs=(1,), precision="bf16"),
        SweepPoint("ivf", knobs=(NPROBE, 4 * NPROBE)),
    ]
    return rounded(sweep(base, as_queries(base), points, "ip", K, reps=1)[1], "recall")


QUERIES: dict[str, Query] = {
    "flat_ip_topk": _flat(embeddings, "ip"),
    "flat_l2_topk": _flat(embeddings, "l2"),
    "flat_ip_topk_scaled": _flat(scaled, "ip"),
    "flat_l2_topk_scaled": _flat(scaled, "l2"),
    "flat_ip_stream_base": _flat(scaled, "ip", strategy="broadcast_queries"),
    "flat_l2_stream_base": _flat(scaled, "l2", strategy="broadcast_queries"),
    "flat_ip_shuffle": _flat(scaled, "ip", strategy="shuffle"),
    "flat_l2_shuffle": _flat(scaled, "l2", strategy="shuffle"),
    "flat_ip_tiled": _flat(scaled, "ip", strategy="tiled"),
    "flat_ip_farthest": _flat(scaled, "ip", order="farthest"),
    "flat_l2_farthest": _flat(scaled, "l2", order="farthest"),
    "flat_bf16_topk": _flat(scaled, "ip", precision="bf16"),
    "flat_bf16_farthest": _flat(scaled, "ip", order="farthest", precision="bf16"),
    "flat_saved_search": flat_saved_search,
    "pair_scores": pair_scores,
    "bf16_round": bf16_round,
    "recall_bf16": recall_bf16,
    "prefix_limit": prefix_limit,
    "dataset_shape": dataset_shape,
    "dataset_preview": _preview("vectors"),
    "dataset_preview_buffer": _preview("buffer"),
    "n_list": n_list,
    "ground_truth": truth_table,
    "ground_truth_preview": ground_truth_preview,
    "ivf_centroids": ivf_centroids,
    "ivf_assign": ivf_lists,
    "ivf_centroids_tiled": ivf_centroids_tiled,
    "ivf_assign_tiled": ivf_lists_tiled,
    "ivf_assign_tree": ivf_lists_tree,
    "ivf_probes": ivf_probe_lists,
    "ivf_probes_tree": ivf_probe_lists_tree,
    "ivf_search_l2": _ivf("l2"),
    "ivf_search_ip": _ivf("ip"),
    "ivf_search_ip_coarse_ip": _ivf("ip", coarse_metric="ip"),
    "ivf_search_shuffle": _ivf("ip", strategy="shuffle"),
    "ivf_search_two_pass": _ivf("ip", strategy="two_pass"),
    "ivf_search_exact": _ivf_exact("l2"),
    "ivf_search_exact_ip": _ivf_exact("ip"),
    "ivf_saved_search": _ivf("l2", reload=True),
    "ivf_recall": ivf_recall,
    "recall_sweep_nprobe": recall_sweep_nprobe,
    "knn_graph_exact": knn_graph_exact,
    "knn_graph_ivf": knn_graph_ivf,
    "knn_graph_descent": knn_graph_descent,
    "graph_search_ef32": graph_search_ef32,
    "graph_search_full_width": graph_search_full_width,
    "graph_recall_sweep_ef": graph_recall_sweep_ef,
    "fbin_roundtrip": fbin_roundtrip,
    "fbin_dataset_search": fbin_dataset_search,
    "i64bin_roundtrip": i64bin_roundtrip,
    "fbin_single_file": fbin_single_file,
    "i64bin_single_file": i64bin_single_file,
    "sweep_timings": sweep_timings,
    "sweep_recalls": sweep_recalls,
    "sweep_grid": sweep_grid,
}
