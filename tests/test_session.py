from __future__ import annotations

from types import SimpleNamespace

import pytest

from tests.helpers import conf
from vecloom import session
from vecloom.operators.keyed import block_tasks
from vecloom.sources.binary import split_bytes
from vecloom.sources.index_store import exists


def _stub(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_scratch_is_the_folder_the_cluster_names():
    assert session.scratch_root(_stub("yarn", "hdfs://x/y")) == "hdfs://x/y"
    path = session.scratch_path(_stub("yarn", "hdfs://x/y/"), "beam")
    assert path.startswith("hdfs://x/y/vecloom/app-yarn/beam-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(_stub("spark://host:1"))
    local = session.scratch_root(_stub("local[2]"))
    assert local == session.scratch_root(_stub("local[2]"))


def test_small_tables_get_a_hint_only_within_the_bound(spark):
    left, right = spark.range(10), spark.range(10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with conf(spark, broadcastBytes=80):
            for size, found in [(80, True), (81, False)]:
                plan = left.join(session.small(right, size), "id")._jdf.queryExecution()
                assert ("BroadcastHashJoin" in plan.executedPlan().toString()) is found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_files_per_core(spark):
    cores = spark.sparkContext.defaultParallelism
    with conf(spark, partitionBytes=64 << 20):
        assert session.file_rows(spark, 10**9, 256) == (64 << 20) // 256
        assert session.file_rows(spark, 1_000_000, 256) == 1_000_000 // cores
        assert session.file_rows(spark, 1000, 256) == (4 << 20) // 256


def test_long_tasks_only_merge_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 10 * cores)
    assert session.long_tasks(many, 1000, 8).rdd.getNumPartitions() == 4 * cores
    assert session.long_tasks(spark.range(0, 10, 1, 2), 10, 8).rdd.getNumPartitions() == 2
    huge = session.long_tasks(many, 10 * cores * session.TASK_BYTES // 8, 8)
    assert huge.rdd.getNumPartitions() == 10 * cores


def test_scratch_scope_deletes_only_its_own(spark):
    kept, _ = session.cut(spark.range(3).toDF("a"), "kept")
    with session.Scratch(spark) as scratch:
        _, gone = session.cut(spark.range(3).toDF("a"), "gone")
    scratch.delete()
    assert kept.count() == 3 and not exists(spark, gone)


def test_partition_counts_stay_bounded_at_100_tb(spark):
    assert block_tasks(spark, 100 << 40) == 50_000
    assert 100 * (1 << 40) // split_bytes(100 << 40) <= 20_000
    assert block_tasks(spark, 1) == spark.sparkContext.defaultParallelism
