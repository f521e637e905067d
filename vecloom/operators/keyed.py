"""Exact k-nearest-neighbour join within a key, shuffled in blocks of bounded size.

A query row meets every base row of its key. A key may be hot on either side, so each side of it is
cut into hash chunks and one (key, base chunk, query chunk) triple is one cogroup: a block of base
vectors against a block of query vectors, of which only the best k per query leave the task.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions import blocks
from vecloom.schema import CANDIDATES


#: Shuffle partitions at most: the driver tracks each pair of map and reduce tasks.
MAX_TASKS = 50_000
#: Bytes of a candidate while it is sorted.
CANDIDATE_BYTES = 64


def block_tasks(spark: SparkSession, size: int) -> int:
    """Shuffle partitions for `size` bytes of vectors: of the usual size, or larger if too many."""
    tasks = min(MAX_TASKS, math.ceil(size / session.partition_bytes(spark)))
    return max(tasks, spark.sparkContext.defaultParallelism)


def value_bytes(df: DataFrame) -> int:
    """Bytes of one value of the vectors of `df`."""
    return 8 if dict(df.dtypes)["embedding"] == "array<double>" else 4


def _chunks(rows: str, per_chunk: int) -> Column:
    return F.ceil(F.col(rows) / F.lit(per_chunk)).cast("int")


def _chunk_of(id_col: str, chunks: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col(chunks)).cast("int")


def _every(chunks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))


def keyed_knn(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    order: str,
    dim: int,
    base_counts: DataFrame,
    n_keys: int,
    pieces: int = 1,
) -> DataFrame:
    """Candidates `query_id, list_id, neighbor_id, score`: the best k of each block pair.

    `base` has `list_id, vec_id, embedding`; `queries` has `list_id, query_id, embedding`, one row
    per key a query looks into, which is read twice. `base_counts` holds the rows per key
    (`list_id, n`), `n_keys` bounds the number of keys. Each side of a key is cut into at least `pieces`
    chunks, so that few keys are still work for all cores.
    """
    spark = session.ship(base.sparkSession)
    width, query_width = (dim * value_bytes(df) for df in (base, queries))
    per_chunk = max(1, session.block_bytes(spark) // width)
    per_query_chunk = max(1, session.block_bytes(spark) // (query_width + k * 16))
    query_counts = queries.groupBy("list_id").agg(F.count(F.lit(1)).alias("m"))
    plan = (
        base_counts.select("list_id", "n")
        .join(query_counts, "list_id")
        .select(
            "list_id",
            "n",
            "m",
            F.greatest(_chunks("n", per_chunk), F.lit(pieces)).alias("base_chunks"),
            F.greatest(_chunks("m", per_query_chunk), F.lit(pieces)).alias("query_chunks"),
        )
    )
    if n_keys * 32 <= session.broadcast_bytes(spark):
        plan = spark.createDataFrame(plan.toArrow())
    else:
        plan, _ = session.cut(plan, "block-plan")
    rows = plan.agg(
        F.sum(F.col("n") * F.col("query_chunks") + F.col("m") * F.col("base_chunks"))
    ).head()[0]
    if rows is None:
        return spark.createDataFrame([], CANDIDATES)
    tasks = block_tasks(spark, rows * max(width, query_width))
    if pieces > 1:
        tasks = max(tasks, 4 * pieces * pieces)
    plan = session.small(plan.select("list_id", "base_chunks", "query_chunks"), n_keys * 32)

    # Both sides may come from one table, so the query side gets its own column names.
    key = ["list_id", "base_chunk", "query_chunk"]
    asked_key = [f"q_{c}" for c in key]
    left = (
        base.select("list_id", "vec_id", "embedding")
        .join(plan, "list_id")
        .withColumn("base_chunk", _chunk_of("vec_id", "base_chunks"))
        .withColumn("query_chunk", _every("query_chunks"))
        .select(*key, "vec_id", "embedding")
        .repartition(tasks, *key)
    )
    right = (
        queries.select("list_id", "query_id", "embedding")
        .join(plan, "list_id")
        .withColumn("query_chunk", _chunk_of("query_id", "query_chunks"))
        .withColumn("base_chunk", _every("base_chunks"))
        .select(*[F.col(c).alias(f"q_{c}") for c in (*key, "query_id", "embedding")])
        .repartition(tasks, *asked_key)
    )

    def block(group, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        rows = blocks.matrix(asked.column("q_embedding"), dim)
        best = blocks.RunningTopK(rows, k, metric, order)
        best.update(
            vectors.column("vec_id").to_numpy(), blocks.matrix(vectors.column("embedding"), dim)
        )
        position, _, found, score = best.results()
        return pa.table(
            {
                "query_id": pa.array(asked.column("q_query_id").to_numpy()[position], pa.int64()),
                "list_id": pa.array([group[0].as_py()] * len(found), pa.int32()),
                "neighbor_id": pa.array(found, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    return left.groupBy(*key).cogroup(right.groupBy(*asked_key)).applyInArrow(block, CANDIDATES)
