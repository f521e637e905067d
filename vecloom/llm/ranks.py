"""Gapless ranks and running sums of keys of any size, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, the unit that one window sorts.
BUCKET_ROWS = 50_000


def ranked(df: DataFrame, key: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Adds `name`: the rank (from 0, without gaps) of each row among the rows of its `key`.

    Rows are dealt into hash buckets of `order`; each bucket ranks its own rows, and a bucket starts
    where the ones before it end. A key with most of all rows is thus spread over all buckets. The order
    of ranks is by bucket, then by `order`; rows that agree in `order` take any order. `rows` is the
    size of `df`, which sets the number of buckets. Nulls in `key` are a key of their own.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    if buckets == 1:
        inside = Window.partitionBy(*key).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(inside) - 1).cast("bigint")).drop("_bucket")
    sizes = df.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(inside) - 1)
    same: Column = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(key):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return (
        local.join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_bucket", "_b", "_start", "_local", *(f"_k{i}" for i in range(len(key))))
    )
