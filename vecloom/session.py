"""Session-level settings: size bounds, the shared scratch folder, shipping the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table (in bytes of vectors or result slots) that may be broadcast to the workers.
BROADCAST_CONF = "spark.vecloom.broadcastBytes"
BROADCAST_DEFAULT = 256 << 20

#: Bytes of vectors held by one side of one shuffled block.
BLOCK_CONF = "spark.vecloom.blockBytes"
BLOCK_DEFAULT = 128 << 20

#: Bytes of vectors in one output file / shuffle partition.
PARTITION_CONF = "spark.vecloom.partitionBytes"
PARTITION_DEFAULT = 128 << 20

#: Bytes below which spreading an output over more files is not worth it.
FILE_FLOOR_BYTES = 4 << 20

#: Bytes of vectors a summarising task reads at most.
TASK_BYTES = 4 << 30

_shipped: set[str] = set()
_made: dict[str, list[str]] = {}
_local_scratch: dict[str, str] = {}


def _size(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def broadcast_bytes(spark: SparkSession) -> int:
    return _size(spark, BROADCAST_CONF, BROADCAST_DEFAULT)


def block_bytes(spark: SparkSession) -> int:
    return _size(spark, BLOCK_CONF, BLOCK_DEFAULT)


def partition_bytes(spark: SparkSession) -> int:
    return _size(spark, PARTITION_CONF, PARTITION_DEFAULT)


def small(df: DataFrame, size: int) -> DataFrame:
    """`df` with a broadcast hint if its proven size is within the bound, else as it is."""
    return F.broadcast(df) if size <= broadcast_bytes(df.sparkSession) else df


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, as the cluster names it.

    Only a local session may fall back to a temporary folder, since there every task sees it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _local_scratch:
        _local_scratch[sc.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _local_scratch[sc.applicationId]


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/vecloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's scratch folder."""
    path = f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


class Scratch:
    """Remembers the scratch paths made while it is open, to delete them once nothing reads them.

    Results are lazy, so a caller deletes only after it has stored what was built inside.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        self._before = set(self._all())
        return self

    def __exit__(self, *_) -> None:
        self.paths += [p for p in self._all() if p not in self._before]

    def _all(self) -> list[str]:
        return _made.get(self.spark.sparkContext.applicationId, [])

    def delete(self) -> None:
        for path in self.paths:
            drop(self.spark, path)
        self.paths = []


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` as a Parquet table in the shared folder and read it back, ending its lineage.

    A lost executor then costs a re-read, and later scans prune columns. Returns the table and its
    path, for `drop`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table made by `cut`."""
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_rows(spark: SparkSession, rows: int, row_bytes: int) -> int:
    """Rows per output file: `partition_bytes` of them, or fewer so that every core gets a file."""
    per_core = rows // spark.sparkContext.defaultParallelism
    floor = FILE_FLOOR_BYTES // row_bytes
    return max(1, min(partition_bytes(spark) // row_bytes, max(per_core, floor)))


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results still reading them are lost."""
    drop(spark, _own_scratch(spark))


def long_tasks(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Fewer, longer scan tasks, for scans where each task emits one summary at its end.

    A few tasks per core remain, and a task reads at most about `TASK_BYTES`.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(4 * cores, rows * row_bytes // TASK_BYTES))


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "vecloom.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)
    return spark
