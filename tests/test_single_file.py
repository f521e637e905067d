from __future__ import annotations

import numpy as np
import pytest

from tests.helpers import queries, table
from vecloom.sources.binary import read_fbin, read_i64bin
from vecloom.sources.single_file import write_fbin_file, write_i64bin_file

COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def test_one_file_in_id_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1000, 5)).astype("<f4")
    ids = rng.permutation(5000)[:1000]
    path = tmp_path / "new folder" / "base.bin"
    # Several ranges, though they are small.
    spark.conf.set(COALESCE, "false")
    try:
        write_fbin_file(table(spark, vectors, ids).repartition(4), str(path))
    finally:
        spark.conf.unset(COALESCE)
    want = np.array([1000, 5], "<u4").tobytes() + vectors[np.argsort(ids)].tobytes()
    assert path.read_bytes() == want
    assert [p.name for p in path.parent.iterdir()] == ["base.bin"]
    assert read_fbin(spark, str(path)).count() == 1000


def test_equal_ids_and_replacement(spark, tmp_path):
    path = tmp_path / "base.bin"
    write_fbin_file(table(spark, [[1, 2], [3, 4], [5, 6]], [7, 7, 1]), str(path))
    rows = np.frombuffer(path.read_bytes()[8:], "<f4").reshape(3, 2)
    assert rows[0].tolist() == [5, 6] and sorted(rows[1:].tolist()) == [[1, 2], [3, 4]]
    before = path.read_bytes()
    with pytest.raises(FileExistsError):
        write_fbin_file(table(spark, [[9, 9]]), str(path))
    with pytest.raises(ValueError, match="lengths"):
        write_fbin_file(table(spark, [[9, 9], [1]]), str(path), mode="overwrite")
    assert path.read_bytes() == before
    write_fbin_file(table(spark, [[9, 9]]), str(path), mode="overwrite")
    assert path.read_bytes() == np.array([1, 2], "<u4").tobytes() + np.array([9, 9], "<f4").tobytes()


def test_empty_table(spark, tmp_path):
    write_fbin_file(table(spark, []), str(tmp_path / "none.bin"))
    assert (tmp_path / "none.bin").read_bytes() == bytes(8)


def test_ids_in_one_file(spark, tmp_path):
    path = tmp_path / "truth.bin"
    found = spark.createDataFrame([(3, 1, 30), (3, 2, 31), (9, 1, 90)], "query_id int, rank int, neighbor_id bigint")
    write_i64bin_file(found, queries(spark, [[0], [0], [0]], [3, 5, 9]), str(path), 2)
    assert np.frombuffer(path.read_bytes(), "<i8").tolist() == [30, 31, -1, -1, 90, -1]
    assert sorted(map(tuple, read_i64bin(spark, str(path), 2).collect())) == [(0, 1, 30), (0, 2, 31), (2, 1, 90)]


def test_object_stores_are_refused(spark):
    with pytest.raises(ValueError, match="mounted"):
        write_fbin_file(table(spark, [[1]]), "s3a://bucket/base.bin")
