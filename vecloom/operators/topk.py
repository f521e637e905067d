"""Per-key top-k with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.schema import METRICS, ORDERS, one_of, positive


def larger_first(metric: str, order: str = "nearest") -> bool:
    """Whether larger scores come first: nearest by inner product, or farthest by L2."""
    one_of("metric", metric, METRICS)
    one_of("order", order, ORDERS)
    return (metric == "ip") == (order == "nearest")


def score_order(metric: str, order: str = "nearest", score: str = "score") -> Column:
    return F.col(score).desc() if larger_first(metric, order) else F.col(score).asc()


def top_k(
    df: DataFrame,
    k: int,
    metric: str,
    order: str = "nearest",
    by: str | list[str] = "query_id",
    id_col: str = "neighbor_id",
    rank: str = "rank",
) -> DataFrame:
    """Best k rows per key, with a 1-based rank; equal scores go to the lower id.

    Spark limits each key before the shuffle (WindowGroupLimit), so a hot key sends at most k rows
    per task.
    """
    positive("k", k)
    window = Window.partitionBy(by).orderBy(score_order(metric, order), F.col(id_col))
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
