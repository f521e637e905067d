"""Raw vector and id files as Spark data sources.

``fbin``: a uint32 row count, a uint32 dimension, then the rows as little-endian float32.
``i64bin``: little-endian int64 values with no header.

A path is one file or a folder of part files, taken in name order. Row ids are positions in that
order, so they do not depend on how the read is split.
"""

from __future__ import annotations

import os
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from vecloom import session
from vecloom.functions import blocks
from vecloom.schema import VECTORS, positive

#: Names of a folder's committed part files.
COMMITTED = "_committed"
HEADER = struct.Struct("<II")
_SPLIT_BYTES = 64 << 20
#: Read partitions at most; splits grow beyond `_SPLIT_BYTES` to keep to it.
MAX_SPLITS = 20_000
#: Schemes that Hadoop and Arrow name differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_CHUNK_BYTES = 4 << 20


@dataclass
class Rows(InputPartition):
    """Rows `start` to `stop` of one file; `first_id` is the id of row `start`, `dim` the planned width."""

    path: str
    size: int
    start: int
    stop: int
    first_id: int
    dim: int = 0


def arrow_uri(path: str, default_fs: str = "file:///") -> str:
    """The path for Arrow, by Spark's rules: without a scheme it is on the default file system."""
    scheme, colon, rest = path.partition(":")
    if colon and "/" not in scheme:
        scheme = _SCHEMES.get(scheme, scheme)
        if scheme == "file":
            return "file:///" + rest.lstrip("/")
        return f"{scheme}:{rest}"
    if default_fs.startswith("file:"):
        return os.path.abspath(path)
    scheme, _, rest = default_fs.partition(":")
    root = f"{_SCHEMES.get(scheme, scheme)}:{rest.rstrip('/')}"
    return f"{root}/{path.lstrip('/')}"


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as an Arrow URI, with the default file system of the session."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf)
    return arrow_uri(path, default.toString())


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(arrow_uri(path))
    return fs.LocalFileSystem(), path


def _files(path: str, all_parts: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the folder's visible files in name order.

    A folder with a list of committed files counts only those, unless `all_parts` is set.
    """
    system, local = _open(path)
    info = system.get_file_info(local)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(local, info.size)]
    listed = system.get_file_info(fs.FileSelector(local))
    parts = [i for i in listed if i.is_file and not i.base_name.startswith(("_", "."))]
    if not all_parts and any(i.base_name == COMMITTED for i in listed):
        with system.open_input_file(posixpath.join(local, COMMITTED)) as source:
            kept = set(source.read().decode().split())
        parts = [i for i in parts if i.base_name in kept]
    return [(i.path, i.size) for i in sorted(parts, key=lambda i: i.base_name)]


def _rows_in(path: str, size: int, head: int, width: int) -> int:
    rows, rest = divmod(size - head, width) if size >= head else (0, 1)
    if rest:
        raise ValueError(f"{path}: {size} bytes is not a whole number of {width}-byte rows")
    return rows


def split_bytes(total: int) -> int:
    """Bytes of one read partition of `total` bytes."""
    return max(_SPLIT_BYTES, -(-total // MAX_SPLITS))


def _split(
    files: list[tuple[str, int]], head: int, width: int, limit: int | None, dim: int = 0
) -> list[Rows]:
    """Row ranges of about equal bytes; ranges beyond `limit` rows are not read at all."""
    step = max(1, split_bytes(sum(size for _, size in files)) // width)
    parts, seen = [], 0
    for path, size in files:
        rows = _rows_in(path, size, head, width)
        wanted = rows if limit is None else min(rows, limit - seen)
        for start in range(0, wanted, step):
            parts.append(Rows(path, size, start, min(start + step, wanted), seen + start, dim))
        seen += rows
        if limit is not None and seen >= limit:
            break
    return parts


def _option(options: dict, name: str) -> int | None:
    value = options.get(name)
    return None if value is None else int(value)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = _option(options, "limit")

    def read_rows(self, part: Rows, head: int, width: int, kind: str) -> Iterator:
        """(first id, flat values) of consecutive chunks of a row range."""
        step = max(1, _CHUNK_BYTES // width)
        system, _ = _open(self.path)
        with system.open_input_file(part.path) as source:
            source.seek(head + part.start * width)
            for start in range(part.start, part.stop, step):
                rows = min(step, part.stop - start)
                data = source.read(rows * width)
                if len(data) != rows * width:
                    raise ValueError(f"{part.path} ends early")
                yield part.first_id + start - part.start, np.frombuffer(data, kind)


class FbinReader(_Reader):
    def header(self, path: str) -> tuple[int, int]:
        system, _ = _open(self.path)
        with system.open_input_file(path) as source:
            data = source.read(HEADER.size)
        if len(data) != HEADER.size:
            raise ValueError(f"{path} has no header")
        return HEADER.unpack(data)

    def _check(self, path: str, size: int) -> int:
        rows, dim = self.header(path)
        if dim == 0 or size != HEADER.size + rows * dim * 4:
            raise ValueError(f"{path}: header says {rows} x {dim}, but the file has {size} bytes")
        return dim

    def pushFilters(self, filters):
        """Upper bounds on `vec_id` become the row limit."""
        for f in filters:
            if isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("vec_id",):
                bound = max(0, f.value + isinstance(f, LessThanOrEqual))
                self.limit = bound if self.limit is None else min(self.limit, bound)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        files = _files(self.path)
        if not files:
            return []
        # Sizes come from the listing, so one header is enough to plan; tasks check their own.
        dim = self._check(*files[0])
        return _split(files, HEADER.size, dim * 4, self.limit, dim)

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        dim = self._check(part.path, part.size)
        if dim != part.dim:
            raise ValueError(f"{part.path} has {dim} values a row, the first file {part.dim}")
        for first, values in self.read_rows(part, HEADER.size, dim * 4, "<f4"):
            rows = values.reshape(-1, dim)
            ids = pa.array(np.arange(first, first + len(rows)))
            yield pa.RecordBatch.from_arrays(
                [ids, blocks.vector_column(rows)], ["vec_id", "embedding"]
            )


class I64Reader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.k = positive("k", int(options.get("k", 10)))

    def partitions(self) -> list[Rows]:
        return _split(_files(self.path), 0, self.k * 8, self.limit)

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        for first, values in self.read_rows(part, 0, self.k * 8, "<i8"):
            queries = np.arange(first, first + len(values) // self.k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(queries, self.k)),
                    pa.array(np.tile(np.arange(1, self.k + 1, dtype=np.int32), len(queries))),
                    pa.array(values),
                ],
                ["query_id", "rank", "neighbor_id"],
            )


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Part files named by task, sequence and attempt; the commit lists the ones that count.

    So parts of failed or late attempts are never read. A part is written once it holds
    `_SPLIT_BYTES`, so a task's memory is bounded and no file is rewritten after the fact.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.overwrite = overwrite
        system, local = _open(self.path)
        if not overwrite and system.get_file_info(local).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def chunk(self, batch: pa.RecordBatch) -> np.ndarray:
        raise NotImplementedError

    def head(self, rows: np.ndarray) -> bytes:
        return b""

    def write(self, stream: Iterator[pa.RecordBatch]) -> Written:
        system, local = _open(self.path)
        system.create_dir(local)
        task = TaskContext.get()
        files, held, size = [], [], 0

        def flush():
            rows = np.concatenate(held)
            name = f"part-{task.partitionId():06d}-{len(files):06d}-{task.taskAttemptId()}"
            with system.open_output_stream(posixpath.join(local, name)) as out:
                out.write(self.head(rows))
                out.write(rows.tobytes())
            files.append(name)

        for batch in stream:
            if batch.num_rows:
                held.append(self.chunk(batch))
                size += held[-1].nbytes
            if size >= _SPLIT_BYTES:
                flush()
                held, size = [], 0
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, local = _open(self.path)
        system.create_dir(local)
        kept = {name for m in messages if m for name in m.files}
        with system.open_output_stream(posixpath.join(local, COMMITTED)) as out:
            out.write("\n".join(sorted(kept)).encode())
        for path, _ in _files(self.path, all_parts=True):
            if posixpath.basename(path) not in kept:
                system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, local = _open(self.path)
        for m in messages:
            for name in m.files if m else []:
                system.delete_file(posixpath.join(local, name))


class FbinWriter(_Writer):
    def chunk(self, batch: pa.RecordBatch) -> np.ndarray:
        return blocks.matrix(batch.column("embedding")).astype("<f4")

    def head(self, rows: np.ndarray) -> bytes:
        return HEADER.pack(*rows.shape)


class I64Writer(_Writer):
    def chunk(self, batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("neighbor_id").to_numpy().astype("<i8")


class FbinSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fbin"

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema) -> FbinReader:
        return FbinReader(self.options)

    def writer(self, schema, overwrite: bool) -> FbinWriter:
        return FbinWriter(self.options, overwrite)


class I64Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "i64bin"

    def schema(self) -> str:
        return "query_id bigint, rank int, neighbor_id bigint"

    def reader(self, schema) -> I64Reader:
        return I64Reader(self.options)

    def writer(self, schema, overwrite: bool) -> I64Writer:
        return I64Writer(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make `format("fbin")` and `format("i64bin")` known to the session."""
    session.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FbinSource)
    spark.dataSource.register(I64Source)
    return spark


def read_fbin(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """`vec_id, embedding` of the first `limit` rows in file order (all by default)."""
    reader = register(spark).read.format("fbin")
    return (reader if limit is None else reader.option("limit", limit)).load(qualified(spark, path))


def fbin_shape(path: str, limit: int | None = None) -> tuple[int, int]:
    """`(rows, dim)` of a file or folder from its first header and the file sizes, with no scan."""
    spark = SparkSession.getActiveSession()
    path = arrow_uri(path) if spark is None else qualified(spark, path)
    reader = FbinReader({"path": path, "limit": limit})
    parts = reader.partitions()
    if not parts:
        return 0, 0
    return sum(p.stop - p.start for p in parts), reader.header(parts[0].path)[1]


def write_fbin(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write `vec_id, embedding` in id order, one or more part files per task."""
    register(df.sparkSession)
    placed = df.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    placed.select("vec_id", "embedding").write.format("fbin").mode(_mode(mode)).save(
        qualified(df.sparkSession, path)
    )


def read_i64bin(spark: SparkSession, path: str, k: int, limit: int | None = None) -> DataFrame:
    """`query_id, rank, neighbor_id` of an id file with k slots per query; empty slots are left out."""
    reader = register(spark).read.format("i64bin").option("k", positive("k", k))
    rows = (reader if limit is None else reader.option("limit", limit)).load(qualified(spark, path))
    return rows.where("neighbor_id >= 0")


def id_slots(neighbours: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`query_id, rank, neighbor_id`: k slots of every query, -1 where there is no neighbour."""
    ranks = F.explode(F.sequence(F.lit(1), F.lit(positive("k", k)))).alias("rank")
    slots = queries.select("query_id", ranks)
    return slots.join(
        neighbours.select("query_id", "rank", "neighbor_id"), ["query_id", "rank"], "left"
    ).withColumn("neighbor_id", F.coalesce("neighbor_id", F.lit(-1)))


def write_i64bin(
    neighbours: DataFrame, queries: DataFrame, path: str, k: int, mode: str = "error"
) -> None:
    """Write neighbour ids in `(query_id, rank)` order, k slots per query, -1 where there is none."""
    register(neighbours.sparkSession)
    filled = id_slots(neighbours, queries, k)
    placed = filled.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank")
    placed.write.format("i64bin").mode(_mode(mode)).save(qualified(neighbours.sparkSession, path))


def _mode(mode: str) -> str:
    """Python sources know append and overwrite; "error" is an append that must find nothing."""
    return {"error": "append", "overwrite": "overwrite"}[mode]
