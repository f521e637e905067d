"""Dataset reports: shape, preview, ground-truth preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.schema import one_of


def shape(df: DataFrame) -> DataFrame:
    """One row: number of vectors, least and greatest dimension."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("embedding")).alias("min_dim"),
        F.max(F.size("embedding")).alias("max_dim"),
    )


def preview(df: DataFrame, rows: int = 5, cols: int = 10, layout: str = "vectors") -> DataFrame:
    """A `rows` x `cols` grid of values as `row, col, value`, 0-based.

    `layout="vectors"` shows the first `cols` values of the first `rows` vectors. `"buffer"` shows
    the first `rows * cols` values of all vectors laid end to end.
    """
    one_of("layout", layout, ("vectors", "buffer"))
    if layout == "vectors":
        first = df.orderBy("vec_id").limit(rows).select("vec_id", "embedding")
        values = first.select("vec_id", F.posexplode(F.slice("embedding", 1, cols)).alias("col", "value"))
        ranked = values.withColumn("row", F.dense_rank().over(_by("vec_id")) - 1)
        return ranked.select("row", "col", "value")
    # Vectors hold at least one value each, so this many are enough.
    first = df.orderBy("vec_id").limit(rows * cols).select("vec_id", "embedding")
    values = first.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    flat = values.withColumn("at", F.row_number().over(_by("vec_id", "pos")) - 1)
    return flat.where(F.col("at") < rows * cols).select(
        F.floor(F.col("at") / cols).cast("int").alias("row"),
        (F.col("at") % cols).cast("int").alias("col"),
        "value",
    )


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def truth_preview(truth: DataFrame, n: int = 10) -> DataFrame:
    """Neighbour ids in rank order of the first `n` queries: `query_id, neighbors`."""
    first = truth.select("query_id").distinct().orderBy("query_id").limit(n)
    ranked = truth.join(F.broadcast(first), "query_id")
    lists = ranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))).alias("found")
    )
    return lists.select("query_id", F.col("found.neighbor_id").alias("neighbors"))
