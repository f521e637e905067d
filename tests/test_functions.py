from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import brute, table
from vecloom.functions import blocks
from vecloom.functions.vectors import bf16, bf16_vector, inner_product, l2_squared, normalised, score


def _bf16_bits(x):
    """Round to nearest even on the upper 16 bits."""
    bits = np.asarray(x, np.float32).view(np.uint32).astype(np.uint64)
    bits = (bits + 0x7FFF + ((bits >> 16) & 1)) & 0xFFFF0000
    return bits.astype(np.uint32).view(np.float32)


def test_bf16_equals_bit_rounding(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate(
        [
            rng.standard_normal(5000) * 10.0 ** rng.integers(-30, 30, 5000),
            [0.0, -0.0, 1.0, -1.0, 2.0**-126, 2.0**-133, 2.0**-134, 3 * 2.0**-134, 1e-40, 2.0**127],
            1 + np.arange(64) / 512,
        ]
    ).astype(np.float32)
    df = spark.createDataFrame(
        [(i, float(x)) for i, x in enumerate(values)], "i int, x float"
    ).select("i", bf16(F.col("x")).alias("y"))
    got = df.orderBy("i").toPandas()["y"].to_numpy(np.float32)
    np.testing.assert_array_equal(got, _bf16_bits(values))


def test_bf16_keeps_non_finite(spark):
    row = spark.sql("SELECT array(float('inf'), float('-inf'), float('nan'), float(0)) AS v")
    got = row.select(bf16_vector("v").alias("v")).head()["v"]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3] == 0


def test_scores_of_columns(spark):
    df = spark.sql("SELECT array(1f, 2f, 3f) AS a, array(4f, 5f, 6.5f) AS b")
    row = df.select(
        inner_product("a", "b").alias("ip"),
        l2_squared("a", "b").alias("l2"),
        score("l2", "a", "a").alias("zero"),
        normalised(F.col("a")).alias("unit"),
    ).head()
    assert (row["ip"], row["l2"], row["zero"]) == (33.5, 9 + 9 + 12.25, 0.0)
    assert sum(x * x for x in row["unit"]) == pytest.approx(1)
    with pytest.raises(ValueError, match="metric"):
        score("cosine", "a", "b")


def test_matrix_rejects_bad_columns():
    ok = pa.array([[1.0, 2.0], [3.0, 4.0]], pa.list_(pa.float32()))
    assert blocks.matrix(ok).tolist() == [[1, 2], [3, 4]]
    assert blocks.matrix(ok.slice(1)).tolist() == [[3, 4]]
    with pytest.raises(ValueError, match="dimension"):
        blocks.matrix(pa.array([[1.0], [3.0, 4.0]], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="dimension"):
        blocks.matrix(ok, 3)
    with pytest.raises(ValueError, match="null"):
        blocks.matrix(pa.array([[1.0, None]], pa.list_(pa.float32())))
    with pytest.raises(ValueError, match="null"):
        blocks.matrix(pa.array([None, [1.0, 2.0]], pa.list_(pa.float32())))


@settings(max_examples=60, deadline=None)
@given(
    seed=st.integers(0, 10**6),
    n=st.integers(1, 60),
    k=st.integers(1, 12),
    scale=st.sampled_from([1e-25, 1e-3, 1.0, 1e6, 1e25]),
    metric=st.sampled_from(["ip", "l2"]),
    order=st.sampled_from(["nearest", "farthest"]),
    copies=st.integers(1, 4),
)
def test_running_top_k_equals_sorting(seed, n, k, scale, metric, order, copies):
    """Any block size, feed order, scale or number of duplicates gives the sorted answer."""
    rng = np.random.default_rng(seed)
    base = np.tile(rng.standard_normal((n, 5)), (copies, 1)).astype(np.float32) * np.float32(scale)
    asked = np.concatenate([base[:2], rng.standard_normal((3, 5)).astype(np.float32)])
    ids = rng.permutation(len(base))
    best = blocks.RunningTopK(asked, k, metric, order)
    step = int(rng.integers(1, len(base) + 1))
    for s in range(0, len(base), step):
        best.update(ids[s : s + step], base[s : s + step])
    position, rank, found, _ = best.results()
    want = [r[:3] for r in brute(base, asked, k, metric, order, ids)]
    assert list(zip(position.tolist(), rank.tolist(), found.tolist())) == want


def test_running_top_k_tiles(monkeypatch):
    rng = np.random.default_rng(3)
    base, asked = rng.standard_normal((500, 8)), rng.standard_normal((90, 8))
    monkeypatch.setattr(blocks, "QUERY_TILE", 16)
    monkeypatch.setattr(blocks, "BASE_TILE", 64)
    monkeypatch.setattr(blocks, "_RESCORE_FLOATS", 128)
    best = blocks.RunningTopK(asked.astype(np.float32), 7, "l2")
    best.update(np.arange(500), base.astype(np.float32))
    position, rank, found, score_ = best.results()
    got = [(p, r, f, round(s, 6)) for p, r, f, s in zip(position, rank, found, score_)]
    assert got == brute(base, asked, 7, "l2")


def test_table_helper(spark):
    assert table(spark, [[1, 2]]).head()["embedding"] == [1.0, 2.0]
