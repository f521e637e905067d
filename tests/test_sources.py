from __future__ import annotations

import pathlib
import struct

import numpy as np
import pytest

from tests.helpers import SF_DIR, brute, conf, ids_of, queries, result, table
from vecloom import session
from vecloom.operators.flat import exact_knn
from vecloom.operators.ivf import build_ivf, ivf_search
from vecloom.plans.queries import embeddings, scaled
from vecloom.plans.workflow import build_flat, build_index, search, vectors_of
from vecloom.sources import binary
from vecloom.sources.binary import (
    fbin_shape,
    read_fbin,
    read_i64bin,
    register,
    write_fbin,
    write_i64bin,
)
from vecloom.sources.dataset import as_queries, load_dataset, prefix
from vecloom.sources.index_store import load_index, save_index


def _file(path, vectors, rows=None):
    vectors = np.asarray(vectors, "<f4")
    path.write_bytes(struct.pack("<II", rows or len(vectors), vectors.shape[1]) + vectors.tobytes())
    return str(path)


def _rows(df):
    return sorted((r["vec_id"], list(r["embedding"])) for r in df.collect())


def test_one_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "_SPLIT_BYTES", 100)
    monkeypatch.setattr(binary, "_CHUNK_BYTES", 40)
    vectors = np.arange(60, dtype=np.float32).reshape(20, 3)
    path = _file(tmp_path / "dataset.bin", vectors)
    assert _rows(read_fbin(spark, path)) == [(i, v.tolist()) for i, v in enumerate(vectors)]
    for limit in (0, 1, 7, 20, 10_000):
        got = _rows(read_fbin(spark, path, limit))
        assert [r[0] for r in got] == list(range(min(limit, 20)))
        assert fbin_shape(path, limit) == ((min(limit, 20), 3) if limit else (0, 0))
    assert fbin_shape(path) == (20, 3)


def test_id_bound_is_pushed_into_the_reader(spark, tmp_path):
    path = _file(tmp_path / "v", np.zeros((50, 2)))
    register(spark)
    reader = binary.FbinReader({"path": path})
    from pyspark.sql.datasource import GreaterThan, LessThan, LessThanOrEqual

    other = GreaterThan(("vec_id",), 3)
    assert list(reader.pushFilters([LessThan(("vec_id",), 9), other])) == [other]
    assert reader.limit == 9
    assert list(reader.pushFilters([LessThanOrEqual(("vec_id",), 4)])) == [] and reader.limit == 5
    df = read_fbin(spark, path).where("vec_id < 9 and vec_id > 3")
    assert sorted(r[0] for r in df.select("vec_id").collect()) == [4, 5, 6, 7, 8]


def test_bad_files_fail(spark, tmp_path):
    short = _file(tmp_path / "short", np.zeros((5, 2)), rows=6)
    with pytest.raises(Exception, match="header says"):
        read_fbin(spark, short).count()
    (tmp_path / "tiny").write_bytes(b"abc")
    with pytest.raises(Exception, match="header"):
        read_fbin(spark, str(tmp_path / "tiny")).count()
    with pytest.raises(Exception, match="missing"):
        read_fbin(spark, str(tmp_path / "missing")).count()
    (tmp_path / "ids").write_bytes(b"\0" * 20)
    with pytest.raises(Exception, match="whole number"):
        read_i64bin(spark, str(tmp_path / "ids"), 2).count()


def test_folder_round_trip_keeps_positions(spark, monkeypatch):
    base = embeddings(spark, SF_DIR)
    want = _rows(base)
    path = session.scratch_path(spark, "fbin")
    with conf(spark):
        write_fbin(base.repartition(7), path)
    assert _rows(read_fbin(spark, path)) == want
    assert _rows(read_fbin(spark, f"file:{path}", 120)) == want[:120]
    with pytest.raises(Exception, match="Exists|exists"):
        write_fbin(base, path)
    write_fbin(prefix(base, 30), path, mode="overwrite")
    assert _rows(read_fbin(spark, path)) == want[:30]


def test_parts_of_a_folder_are_read_in_name_order(spark, tmp_path):
    for i, name in enumerate(["part-1", "part-0", "_hidden", "part-2"]):
        _file(tmp_path / name, np.full((i + 1, 2), i))
    got = _rows(read_fbin(spark, str(tmp_path)))
    assert [r[1][0] for r in got] == [1, 1, 0, 3, 3, 3, 3]
    assert [r[0] for r in got] == list(range(7))


def test_parts_of_late_attempts_are_not_read(spark):
    base = table(spark, [[1, 2], [3, 4], [5, 6]])
    path = session.scratch_path(spark, "fbin")
    write_fbin(base, path)
    _file(pathlib.Path(path) / "part-000000-000000-999", [[9, 9]])
    assert _rows(read_fbin(spark, path)) == _rows(base)


def test_ids_round_trip_with_empty_slots(spark):
    base = table(spark, [[1, 0], [0, 1]])
    asked = queries(spark, [[1, 0], [0, 1], [1, 1]])
    found = exact_knn(base, asked, 5, "l2").where("query_id <> 1")
    path = session.scratch_path(spark, "ids")
    write_i64bin(found, asked, path, 5)
    assert ids_of(read_i64bin(spark, path, 5)) == ids_of(found)
    assert read_i64bin(spark, path, 5, limit=1).count() == 2


def test_index_from_raw_files(spark, tmp_path):
    vectors = np.random.default_rng(0).standard_normal((80, 6)).astype(np.float32)
    _file(tmp_path / "dataset.bin", vectors)
    _file(tmp_path / "query.bin", vectors[:9])
    base, asked = load_dataset(spark, str(tmp_path), learn_limit=60)
    index = build_index(base, "ivf", "l2", stage=True, n_list=6, iters=2)
    assert index.meta.n_base == 60
    assert result(search(index, asked, 4, nprobe=6)) == brute(vectors[:60], vectors[:9], 4, "l2")


def test_load_dataset(spark, tmp_path):
    _file(tmp_path / "dataset.bin", np.arange(12).reshape(6, 2))
    _file(tmp_path / "query.bin", np.arange(8).reshape(4, 2))
    base, asked = load_dataset(spark, str(tmp_path), learn_limit=5, search_limit=3)
    assert base.columns == ["vec_id", "embedding"] and base.count() == 5
    assert asked.columns == ["query_id", "embedding"] and asked.count() == 3
    base, asked = load_dataset(
        spark, SF_DIR, 50, 20, base_file="embeddings.parquet", query_file="embeddings.parquet"
    )
    assert base.count() == 50 and asked.count() == 20


@pytest.mark.parametrize("index_type", ["flat", "ivf", "graph"])
def test_saved_index_searches_alike(spark, index_type):
    base = scaled(spark, SF_DIR)
    options = {"flat": {}, "ivf": {"n_list": 10, "iters": 2}, "graph": {"m": 8, "n_list": 10}}
    index = build_index(base, index_type, "l2", **options[index_type])
    path = session.scratch_path(spark, "saved")
    save_index(index, path)
    loaded = load_index(spark, path, index_type)
    assert loaded.meta == index.meta and loaded.meta.n_base == 500
    asked = as_queries(base)
    assert result(search(loaded, asked, 5, nprobe=3, ef=16)) == result(
        search(index, asked, 5, nprobe=3, ef=16)
    )
    assert _rows(vectors_of(loaded)) == _rows(base)
    with pytest.raises(ValueError, match="holds a"):
        load_index(spark, path, "ivf" if index_type != "ivf" else "flat")
    with pytest.raises(Exception, match="exists"):
        save_index(index, path)
    save_index(index, path, mode="overwrite")
    assert load_index(spark, path).meta == index.meta


def test_a_failed_replacement_leaves_no_index(spark):
    path = session.scratch_path(spark, "replaced")
    build_flat(table(spark, [[1, 2]]), "ip", path)
    with pytest.raises(FileExistsError):
        build_index(table(spark, [[1, 2]]), "ivf", "l2", path=path)
    bad = table(spark, [[1, 2], [1, 2, 3]])
    with pytest.raises(Exception, match="dimension"):
        build_index(bad, "ivf", "l2", path=path, mode="overwrite", n_list=1)
    with pytest.raises(Exception):
        load_index(spark, path)
    build_index(table(spark, [[1, 2]]), "ivf", "l2", path=path, mode="overwrite")
    assert load_index(spark, path, "ivf").meta.n_base == 1


def test_unfinished_index_does_not_load(spark):
    with pytest.raises(Exception):
        load_index(spark, session.scratch_path(spark, "nothing"))
    index = build_flat(table(spark, [[1, 2]]), "ip")
    with pytest.raises(ValueError, match="no table"):
        index.table("links")
    with pytest.raises(ValueError, match="not ivf"):
        ivf_search(index, queries(spark, [[1, 2]]))
    with pytest.raises(ValueError, match="index_type"):
        build_index(table(spark, [[1, 2]]), "hash", "ip")


def test_scratch_tables_lie_in_the_checkpoint_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df, path = session.cut(spark.range(5), "t")
    assert path.startswith(folder) and df.count() == 5
    session.drop(spark, path)
    assert build_ivf(table(spark, [[1, 2]]), "ip").path.startswith(folder)


@pytest.mark.parametrize("order", [(3, 4, 4, 2), (4, 2, 3, 4)])
def test_folder_of_mixed_dimensions_raises(spark, tmp_path, order):
    for i in (0, 1):
        rows, dim = order[2 * i : 2 * i + 2]
        data = np.zeros((rows, dim), "<f4")
        (tmp_path / f"part-{i}").write_bytes(struct.pack("<II", rows, dim) + data.tobytes())
    with pytest.raises(Exception, match="values a row|header says|whole number"):
        read_fbin(spark, str(tmp_path)).collect()


def test_paths_follow_spark():
    assert binary.arrow_uri("s3a://bucket/x") == "s3://bucket/x"
    assert binary.arrow_uri("hdfs://host:1/x") == "hdfs://host:1/x"
    assert binary.arrow_uri("file:/a/b") == binary.arrow_uri("file:///a/b") == "file:///a/b"
    assert binary.arrow_uri("/a/b") == "/a/b"
    assert binary.arrow_uri("/a/b", "hdfs://host:1") == "hdfs://host:1/a/b"
    assert binary.arrow_uri("/a/b", "s3a://bucket/") == "s3://bucket/a/b"
