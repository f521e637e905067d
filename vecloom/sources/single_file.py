"""Raw vector and id files as one file, written by many tasks at once.

Rows are sorted into ranges of ids and stored with their place in the range; the sizes of the ranges, added
up, say where each begins in the file. Every task then writes its rows at their own offsets. A task that
runs again writes the same bytes to the same place, and no task, nor the driver, sees more than its share.

Writing at offsets takes a file system that is mounted at the driver and all executors (`file:` paths on
shared storage). Object stores have no such writes: `write_fbin` and `write_i64bin` give folders there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions import blocks
from vecloom.schema import one_of
from vecloom.sources.binary import HEADER, id_slots, qualified

#: `monotonically_increasing_id` has the partition above these bits and the place in it below.
_PLACE_BITS = 33
_MAX_ROWS = (1 << 32) - 1


def write_fbin_file(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write `vec_id, embedding` in id order as one `fbin` file.

    Rows of equal ids lie together, in any order; null ids come first. An empty table is a header of no rows
    and no dimension. `mode` is "error" or "overwrite"; the file has its name only once it is complete.
    """
    target = _target(df.sparkSession, path, mode)
    placed, stored = _placed(df.select("vec_id", "embedding"), ["vec_id"], "embedding")
    widths = placed.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).head()
    if widths[0] != widths[1] or (widths[0] is not None and widths[0] < 1):
        raise ValueError(f"embeddings have lengths from {widths[0]} to {widths[1]}")
    dim = widths[0] or 0
    starts, n = _starts(placed)
    if n > _MAX_ROWS:
        raise ValueError(f"the header counts rows in 32 bits, the table has {n}")

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return blocks.matrix(batch.column("embedding"), dim).astype("<f4", copy=False)

    _write(placed, starts, n, dim * 4, rows, HEADER.pack(n, dim), target)
    session.drop(df.sparkSession, stored)


def write_i64bin_file(
    neighbours: DataFrame, queries: DataFrame, path: str, k: int, mode: str = "error"
) -> None:
    """Write neighbour ids in `(query_id, rank)` order as one file, -1 in empty slots, as `write_i64bin`."""
    target = _target(neighbours.sparkSession, path, mode)
    slots = id_slots(neighbours, queries, k)
    placed, stored = _placed(slots, ["query_id", "rank"], "neighbor_id")
    starts, n = _starts(placed)

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("neighbor_id").to_numpy().astype("<i8", copy=False)

    _write(placed, starts, n, 8, rows, b"", target)
    session.drop(neighbours.sparkSession, stored)


def _target(spark: SparkSession, path: str, mode: str) -> Path:
    one_of("mode", mode, ("error", "overwrite"))
    where = urlsplit(qualified(spark, path))
    if where.scheme not in ("", "file"):
        raise ValueError(f"one file needs a mounted file system, not {where.scheme}: write a folder there")
    target = Path(unquote(where.path))
    if target.is_dir() or (mode == "error" and target.exists()):
        raise FileExistsError(str(target))
    return target


def _placed(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, str]:
    """`place, <value>`: rows in ranges of the first column, each with its range and its place there.

    It is stored, so places are fixed whatever runs again later.
    """
    sorted_ = df.repartitionByRange(by[0]).sortWithinPartitions(*by)
    return session.cut(sorted_.select(F.monotonically_increasing_id().alias("place"), value), "placed")


def _starts(placed: DataFrame) -> tuple[dict[int, int], int]:
    """The first row of each range in the file, and the number of rows: one count per range."""
    part = F.shiftright("place", _PLACE_BITS).alias("part")
    counts = sorted(placed.groupBy(part).count().collect())
    starts, n = {}, 0
    for part, count in counts:
        starts[part] = n
        n += count
    return starts, n


def _write(
    placed: DataFrame,
    starts: dict[int, int],
    n: int,
    width: int,
    rows: Callable[[pa.RecordBatch], np.ndarray],
    head: bytes,
    target: Path,
) -> None:
    """Reserve the file, let tasks write their rows, and give it its name."""
    target.parent.mkdir(parents=True, exist_ok=True)
    unfinished = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        with open(unfinished, "xb") as out:
            out.write(head)
            out.truncate(len(head) + n * width)
        if n:
            written = _write_rows(placed, starts, width, rows, len(head), str(unfinished))
            if written != n:
                raise OSError(f"{written} of {n} rows were written to {target}")
        os.replace(unfinished, target)
    finally:
        unfinished.unlink(missing_ok=True)


def _write_rows(
    placed: DataFrame,
    starts: dict[int, int],
    width: int,
    rows: Callable[[pa.RecordBatch], np.ndarray],
    skip: int,
    file: str,
) -> int:
    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Without O_CREAT: an executor that does not see the driver's file fails here.
        out = os.open(file, os.O_WRONLY)
        n = 0
        try:
            for batch in stream:
                if not batch.num_rows:
                    continue
                place = batch.column("place").to_numpy()
                part = place >> _PLACE_BITS
                values = rows(batch)
                # Runs of rows that lie together in the file.
                edges = np.flatnonzero(np.diff(place) != 1) + 1
                for a, b in zip([0, *edges], [*edges, len(place)], strict=True):
                    first = starts[int(part[a])] + int(place[a] & ((1 << _PLACE_BITS) - 1))
                    _put(out, memoryview(np.ascontiguousarray(values[a:b])).cast("B"), skip + first * width)
                n += len(place)
            os.fsync(out)
        finally:
            os.close(out)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return placed.mapInArrow(write, "n bigint").agg(F.sum("n")).head()[0] or 0


def _put(out: int, data: memoryview, offset: int) -> None:
    while len(data):
        done = os.pwrite(out, data, offset)
        data, offset = data[done:], offset + done
