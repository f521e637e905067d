"""Vector expressions as Spark columns: inner product, squared L2, bfloat16 rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.schema import METRICS, one_of


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Inner product of two equally long arrays, accumulated in double; larger is nearer."""
    return _sum(
        F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    )


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance in double; smaller is nearer, exactly 0 for equal vectors."""

    def term(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(_column(a), _column(b), term))


def score(metric: str, a: Column | str, b: Column | str) -> Column:
    one_of("metric", metric, METRICS)
    return inner_product(a, b) if metric == "ip" else l2_squared(a, b)


def bf16(x: Column) -> Column:
    """One float rounded to bfloat16 (8 significant bits, half to even), returned as float.

    The step below a value in [2^e, 2^(e+1)) is 2^(e-7); below 2^-126 it stays at 2^-133.
    """
    v = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))) - 7, F.lit(-133)))
    finite = (v != 0) & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite, (F.rint(v / step) * step).cast("float")).otherwise(x.cast("float"))


def bf16_vector(embedding: Column | str) -> Column:
    return F.transform(_column(embedding), bf16)


def normalised(embedding: Column | str) -> Column:
    """The vector over its L2 norm, as doubles; a zero vector stays as it is."""
    v = _column(embedding)
    norm = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))
