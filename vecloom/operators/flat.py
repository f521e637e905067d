"""Exact k-nearest-neighbour join of two vector tables.

Three ways to run it, all with the same result:

``broadcast_base``
    The base fits the broadcast bound. Query rows stream past it, each is finished where it is
    read: no shuffle at all.
``broadcast_queries``
    The queries, and k result slots for each, fit the bound. Base rows stream past them, every task
    keeps its running best k and emits it once; a window merges the tasks' lists.
``shuffle``
    Neither fits. Both sides are cut into blocks of bounded size and each pair of blocks is one
    cogroup (see `keyed.py`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions import blocks
from vecloom.functions.vectors import bf16_vector
from vecloom.operators.keyed import keyed_knn
from vecloom.operators.topk import top_k
from vecloom.schema import METRICS, NEIGHBOURS, ORDERS, PRECISIONS, one_of, positive

STRATEGIES = ("auto", "broadcast_base", "broadcast_queries", "tiled", "shuffle")

#: Multiply-adds below which spreading a small table over more tasks costs more than it saves.
_SPREAD_WORK = 1 << 30
#: Bytes of result slots a task holds at a time for streamed queries.
_STATE_BYTES = 64 << 20


@dataclass(frozen=True)
class Sizes:
    """Rows of both sides, and the dimension of their vectors."""

    base: int
    queries: int
    dim: int


def vector_bytes(df: DataFrame, dim: int, vector: str = "embedding") -> int:
    """Bytes of one vector, from the declared element type."""
    return dim * (4 if df.schema[vector].dataType.elementType.typeName() == "float" else 8)


def measure(base: DataFrame, queries: DataFrame) -> Sizes:
    """Row counts of both sides in one job, and the dimension of the first vector."""
    sides = base.select(F.lit(1).alias("base"), F.lit(0).alias("queries")).unionAll(
        queries.select(F.lit(0), F.lit(1))
    )
    counts = sides.agg(F.sum("base").alias("base"), F.sum("queries").alias("queries")).head()
    first = base.select(F.size("embedding").alias("dim")).head()
    return Sizes(counts["base"] or 0, counts["queries"] or 0, first["dim"] if first else 0)


def choose(base: DataFrame, queries: DataFrame, sizes: Sizes, k: int, wanted: str = "auto") -> str:
    """The strategy to run: the one wanted if its broadcast fits the bound, else the best that does."""
    bound = session.broadcast_bytes(base.sparkSession)
    held = {
        "broadcast_base": sizes.base * (vector_bytes(base, sizes.dim) + 8),
        "broadcast_queries": sizes.queries * (vector_bytes(queries, sizes.dim) + 8 + k * 16),
    }
    # Beyond the bound, the larger side stays where it is if the queries are the smaller one.
    beyond = ["tiled", "shuffle"] if sizes.queries < sizes.base else ["shuffle", "tiled"]
    fitting = [name for name, size in held.items() if size <= bound] + beyond
    return wanted if wanted in fitting else fitting[0]


def collect_vectors(df: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """A table already proven small, as ids and matrix in id order."""
    table = df.select(id_col, "embedding").toArrow()
    ids = table.column(id_col).to_numpy()
    by = np.argsort(ids, kind="stable")
    return ids[by], blocks.matrix(table.column("embedding"))[by]


def spread(df: DataFrame, id_col: str, rows: int, sizes: Sizes) -> DataFrame:
    """Spread a streamed side over all cores if it is small but its scoring is not."""
    spark = df.sparkSession
    work = sizes.base * sizes.queries * sizes.dim
    if rows * vector_bytes(df, sizes.dim) > session.broadcast_bytes(spark) or work < _SPREAD_WORK:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, id_col)


def exact_knn(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    order: str = "nearest",
    precision: str = "f32",
    strategy: str = "auto",
    sizes: Sizes | None = None,
) -> DataFrame:
    """The k best base vectors for every query: `query_id, rank, neighbor_id, score`.

    `base` has `vec_id, embedding`; `queries` has `query_id, embedding`. With fewer than k base
    rows the result has fewer ranks. `precision="bf16"` rounds both sides to bfloat16 first.
    `strategy` is a preference: a broadcast beyond the bound is not made. `sizes`, where the caller
    knows them, saves counting both sides.
    """
    positive("k", k)
    one_of("metric", metric, METRICS)
    one_of("order", order, ORDERS)
    one_of("precision", precision, PRECISIONS)
    one_of("strategy", strategy, STRATEGIES)
    spark = session.ship(base.sparkSession)
    sizes = sizes or measure(base, queries)
    base = base.select("vec_id", "embedding")
    queries = queries.select("query_id", "embedding")
    if sizes.base == 0 or sizes.queries == 0:
        return spark.createDataFrame([], NEIGHBOURS)
    if precision == "bf16":
        base = base.withColumn("embedding", bf16_vector("embedding"))
        queries = queries.withColumn("embedding", bf16_vector("embedding"))
    strategy = choose(base, queries, sizes, k, strategy)
    if strategy == "broadcast_base":
        streamed = spread(queries, "query_id", sizes.queries, sizes)
        return _against_base(base, streamed, k, metric, order)
    if strategy == "broadcast_queries":
        return _against_queries(base, queries, k, metric, order, sizes)[0]
    if strategy == "tiled":
        return _in_tiles(base, queries, k, metric, order, sizes)
    cores = spark.sparkContext.defaultParallelism
    large = sizes.base * sizes.queries * sizes.dim >= _SPREAD_WORK
    found = keyed_knn(
        base.withColumn("list_id", F.lit(0)),
        queries.withColumn("list_id", F.lit(0)),
        k,
        metric,
        order,
        sizes.dim,
        spark.createDataFrame([(0, sizes.base)], "list_id int, n bigint"),
        1,
        math.ceil(math.sqrt(2 * cores)) if large else 1,
    )
    return _neighbours(top_k(found, k, metric, order))


def _neighbours(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "neighbor_id", "score")


def _against_base(base, queries, k, metric, order) -> DataFrame:
    held = base.sparkSession.sparkContext.broadcast(collect_vectors(base, "vec_id"))

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = held.value
        slots = min(k, len(ids))
        step = max(1, _STATE_BYTES // (slots * 16))
        sliced = (b.slice(s, step) for b in stream for s in range(0, b.num_rows, step))
        for batch in sliced:
            query_ids = batch.column("query_id").to_numpy()
            rows = blocks.matrix(batch.column("embedding"), vectors.shape[1])
            best = blocks.RunningTopK(rows, slots, metric, order)
            best.update(ids, vectors)
            position, rank, found, score = best.results()
            yield from blocks.batches(
                {
                    "query_id": pa.array(query_ids[position], pa.int64()),
                    "rank": pa.array(rank, pa.int32()),
                    "neighbor_id": pa.array(found, pa.int64()),
                    "score": pa.array(score, pa.float64()),
                }
            )

    return queries.mapInArrow(search, NEIGHBOURS)


def _tiles(queries: DataFrame, sizes: Sizes, k: int) -> int:
    """Hash tiles of the queries such that each, with its results, is within the broadcast bound."""
    bound = session.broadcast_bytes(queries.sparkSession)
    per_tile = max(1, bound // (vector_bytes(queries, sizes.dim) + 8 + k * 16))
    tiles = max(1, -(-sizes.queries // per_tile))
    while tiles < 2 * sizes.queries:
        counts = queries.groupBy(_tile(tiles).alias("tile")).count()
        if counts.agg(F.max("count")).head()[0] <= per_tile:
            break
        tiles *= 2
    return tiles


def _tile(tiles: int):
    return F.pmod(F.xxhash64("query_id"), F.lit(tiles))


def _in_tiles(base, queries, k, metric, order, sizes) -> DataFrame:
    """Neither side within the bound: the base is read in place once for each tile of the queries.

    A tile's broadcast is released before the next one is made, and no vector is shuffled.
    """
    spark = base.sparkSession
    tiles = _tiles(queries, sizes, k)
    path = session.scratch_path(spark, "tiles")
    for tile in range(tiles):
        part = queries.where(_tile(tiles) == tile)
        if part.isEmpty():
            continue
        found, held = _against_queries(base, part, k, metric, order, sizes)
        found.write.mode("append").parquet(path)
        held.unpersist()
    return spark.read.schema(NEIGHBOURS).parquet(path)


def _against_queries(base, queries, k, metric, order, sizes):
    """The neighbours, and the broadcast queries."""
    spark = base.sparkSession
    held = spark.sparkContext.broadcast(collect_vectors(queries, "query_id"))

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = held.value
        best = blocks.RunningTopK(vectors, k, metric, order)
        for batch in stream:
            rows = blocks.matrix(batch.column("embedding"), vectors.shape[1])
            best.update(batch.column("vec_id").to_numpy(), rows)
        position, _, found, score = best.results()
        yield from blocks.batches(
            {
                "query_id": pa.array(query_ids[position], pa.int64()),
                "neighbor_id": pa.array(found, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    streamed = spread(base, "vec_id", sizes.base, sizes)
    streamed = session.long_tasks(streamed, sizes.base, vector_bytes(base, sizes.dim))
    partial = streamed.mapInArrow(search, "query_id bigint, neighbor_id bigint, score double")
    return _neighbours(top_k(partial, k, metric, order)), held
