"""Indexes as directories of Parquet tables.

========== ======================================================= ==================
table      columns                                                 index types
========== ======================================================= ==================
meta       one row, see `schema.META`; written last                all
vectors    vec_id, embedding, node_bucket (partition)              flat
vectors    vec_id, embedding, bucketed and sorted by vec_id        graph
centroids  list_id, centroid                                       ivf
sizes      list_id, n, radius                                      ivf
lists      vec_id, embedding, list_id, list_bucket (partition)     ivf
links      src, neighbors, bucketed and sorted by src              graph
entries    vec_id, embedding                                       graph
========== ======================================================= ==================

Bucketed tables are read through the session's catalog, which alone tells Spark how files are clustered:
a join on the id then moves the other side only. They are external tables named after their path, so
dropping one from the catalog leaves its files.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vecloom import session
from vecloom.schema import CENTROIDS, META, VECTORS

TABLES = {
    "flat": ("vectors",),
    "ivf": ("centroids", "sizes", "lists"),
    "graph": ("vectors", "links", "entries"),
}
COLUMNS = {
    "vectors": f"{VECTORS}, node_bucket int",
    "centroids": CENTROIDS,
    "sizes": "list_id int, n bigint, radius double",
    "lists": f"{VECTORS}, list_id int, list_bucket int",
    "links": "src bigint, neighbors array<bigint>",
    "entries": VECTORS,
}
PARTITIONS = {"vectors": ["node_bucket"], "lists": ["list_bucket"]}
#: Tables of a graph that are bucketed, by column.
BUCKETED = {"vectors": "vec_id", "links": "src"}
BUCKETED_COLUMNS = {"vectors": VECTORS, "links": COLUMNS["links"]}


@dataclass(frozen=True)
class Meta:
    index_type: str
    metric: str
    coarse_metric: str | None
    dim: int
    n_base: int
    n_list: int | None = None
    m: int | None = None
    n_bucket: int | None = None


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: its one-row description and its tables, read lazily.

    `cache` is for what a search holds of this opened index between calls.
    """

    spark: SparkSession
    path: str
    meta: Meta
    cache: dict = field(default_factory=dict, compare=False, repr=False)

    def table(self, name: str) -> DataFrame:
        if name not in TABLES[self.meta.index_type]:
            raise ValueError(f"a {self.meta.index_type} index has no table {name!r}")
        if self.meta.index_type == "graph" and name in BUCKETED:
            return bucketed_table(self.spark, self.path, name, self.meta.n_bucket)
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self.path}/{name}")


def begin(spark: SparkSession, path: str, mode: str) -> None:
    """Before anything is written: refuse an existing index, or unmark it if it is replaced."""
    jvm = spark.sparkContext._jvm
    meta = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    system = meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(meta):
        return
    if mode != "overwrite":
        raise FileExistsError(f"an index already exists at {path}")
    session.drop(spark, f"{path}/meta")


def write_table(df: DataFrame, path: str, name: str, mode: str = "error") -> None:
    writer = df.select(*[c.split()[0] for c in COLUMNS[name].split(", ")]).write.mode(mode)
    if name in PARTITIONS:
        writer = writer.partitionBy(*PARTITIONS[name])
    writer.parquet(f"{path}/{name}")


def _catalog_name(path: str, name: str, buckets: int) -> str:
    place = hashlib.md5(f"{path.rstrip('/')}/{name}".encode()).hexdigest()
    return f"vecloom_{name}_{place[:16]}_{buckets}"


def write_bucketed(df: DataFrame, path: str, name: str, buckets: int, mode: str = "error") -> None:
    """Write a table of a graph in hash buckets of its id, one sorted file each."""
    spark, column, table = df.sparkSession, BUCKETED[name], _catalog_name(path, name, buckets)
    if mode == "overwrite":
        session.drop(spark, f"{path}/{name}")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    rows = df.select(*(c.split()[0] for c in BUCKETED_COLUMNS[name].split(", ")))
    writer = rows.repartition(buckets, column).write.bucketBy(buckets, column).sortBy(column)
    writer.option("path", f"{path}/{name}").format("parquet").saveAsTable(table)


def bucketed_table(spark: SparkSession, path: str, name: str, buckets: int) -> DataFrame:
    """A table written by `write_bucketed`, registered in this session's catalog if it is not yet."""
    table, column = _catalog_name(path, name, buckets), BUCKETED[name]
    if not spark.catalog.tableExists(table):
        place = f"{path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {table} ({BUCKETED_COLUMNS[name]}) USING parquet "
            f"CLUSTERED BY ({column}) SORTED BY ({column}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(table)


def write_meta(spark: SparkSession, path: str, meta: Meta, mode: str = "error") -> VectorIndex:
    """Finish an index: only a directory with `meta` loads."""
    row = tuple(asdict(meta).values())
    spark.createDataFrame([row], META).coalesce(1).write.mode(mode).parquet(f"{path}/meta")
    return VectorIndex(spark, path, meta)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at `path`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


#: Row order within the files of a table; tables not named here have none.
ROW_ORDER = {
    "lists": ("list_bucket", "list_id", "vec_id"),
    "vectors": ("node_bucket", "vec_id"),
}


def save_index(index: VectorIndex, path: str, mode: str = "error") -> VectorIndex:
    """Copy an index to `path`, keeping its partitioning and the row order within files."""
    if path.rstrip("/") == index.path.rstrip("/"):
        return index
    begin(index.spark, path, mode)
    for name in TABLES[index.meta.index_type]:
        rows = index.table(name)
        if index.meta.index_type == "graph" and name in BUCKETED:
            write_bucketed(rows, path, name, index.meta.n_bucket, mode)
            continue
        if name in ROW_ORDER:
            files = max(1, len(rows.inputFiles()))
            rows = rows.repartitionByRange(files, *ROW_ORDER[name])
            rows = rows.sortWithinPartitions(*ROW_ORDER[name])
        write_table(rows, path, name, mode)
    return write_meta(index.spark, path, index.meta, mode)


def load_index(spark: SparkSession, path: str, index_type: str | None = None) -> VectorIndex:
    """Open a stored index; `index_type` states what the caller expects to find."""
    row = spark.read.schema(META).parquet(f"{path}/meta").head()
    if row is None:
        raise ValueError(f"no index at {path}")
    meta = Meta(**row.asDict())
    if index_type is not None and meta.index_type != index_type:
        raise ValueError(f"{path} holds a {meta.index_type} index, not {index_type}")
    return VectorIndex(spark, path, meta)
