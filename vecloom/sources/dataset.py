"""A base and a query table from one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources.binary import read_fbin

BASE_FILE = "dataset.bin"
QUERY_FILE = "query.bin"


def prefix(df: DataFrame, limit: int, id_col: str = "vec_id") -> DataFrame:
    """Rows before position `limit`, for tables whose ids are positions."""
    return df.where(F.col(id_col) < limit)


def as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("query_id"), "embedding")


def load_dataset(
    spark: SparkSession,
    folder: str,
    learn_limit: int | None = None,
    search_limit: int | None = None,
    base_file: str = BASE_FILE,
    query_file: str = QUERY_FILE,
) -> tuple[DataFrame, DataFrame]:
    """`(base, queries)` from `dataset.bin` and `query.bin`, or from Parquet tables of those names."""
    base = _load(spark, f"{folder.rstrip('/')}/{base_file}", learn_limit)
    queries = _load(spark, f"{folder.rstrip('/')}/{query_file}", search_limit)
    return base, as_queries(queries)


def _load(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    if path.endswith(".parquet"):
        df = spark.read.parquet(path).select("vec_id", "embedding")
        return df if limit is None else prefix(df, limit)
    return read_fbin(spark, path, limit)
