"""k-means training of coarse centroids by repeated Spark aggregations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions import blocks
from vecloom.functions.vectors import normalised
from vecloom.operators.flat import vector_bytes
from vecloom.schema import CENTROIDS, positive

_HEX = 1 << 32
_MERGE_BYTES = 8 << 20
_SUMS = "list_id int, n bigint, total array<double>"


def default_n_list(n: int) -> int:
    """Number of inverted lists for n vectors."""
    return int(4 * np.sqrt(n))


def n_list_of(df: DataFrame) -> DataFrame:
    """The same number as a one-row table."""
    return df.agg(F.floor(4 * F.sqrt(F.count(F.lit(1)))).cast("int").alias("n_list"))


def draw(seed: int) -> Column:
    """A reproducible random key per vector, the same in any partitioning and any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")))


def _share(seed: int, wanted: float, n: int) -> Column:
    """True for a random share of about `wanted` of n vectors."""
    if wanted >= n:
        return F.lit(True)
    return draw(seed) < F.lit(f"{int(wanted / n * _HEX):08x}")


def first_drawn(base: DataFrame, count: int, n: int, seed: int) -> DataFrame:
    """The `count` vectors with the lowest random keys, numbered `list_id` in key order.

    Only ids are sorted, and only about twice as many as wanted; the vectors come by a join.
    """
    by = [F.col("draw"), F.col("vec_id")]
    ids = base.select("vec_id", draw(seed).alias("draw"))
    near = ids.where(_share(seed, 2 * count + 100, n))
    picked = near.orderBy(*by).limit(count)
    numbered = picked.select(
        "vec_id", (F.row_number().over(Window.orderBy(*by)) - 1).alias("list_id")
    )
    return base.select("vec_id", "embedding").join(session.small(numbered, count * 16), "vec_id")


def ivf_train(
    base: DataFrame,
    n_list: int | None = None,
    iters: int = 10,
    seed: int = 0,
    spherical: bool = False,
    held_bytes: int | None = None,
) -> DataFrame:
    """Centroids `list_id, centroid` of `base` (`vec_id, embedding`), trained with L2.

    Starts from `n_list` random vectors and runs `iters` Lloyd steps. A list that loses all its
    vectors keeps its centroid. `spherical` brings centroids to unit length after each step. Centroids of
    more than `held_bytes` (by default the broadcast bound) stay a table and reach tasks in tiles.
    """
    spark = session.ship(base.sparkSession)
    base = base.select("vec_id", "embedding")
    n = base.count()
    if n == 0:
        raise ValueError("cannot train on an empty table")
    n_list = min(n, positive("n_list", n_list or default_n_list(n)))
    dim = base.select(F.size("embedding").alias("dim")).head()["dim"]
    seeds = first_drawn(base, n_list, n, seed)
    held_bytes = held_bytes or session.broadcast_bytes(spark)
    train = session.long_tasks(base, n, vector_bytes(base, dim))
    if n_list * dim * 8 <= held_bytes:
        return _lloyd(train, seeds, iters, spherical, n)
    return _lloyd_tiled(train, seeds, iters, spherical, dim, tile_lists(held_bytes, dim))


def _unit(centroids: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(centroids, axis=1, keepdims=True)
    return np.divide(centroids, norm, out=centroids.copy(), where=norm > 0)


class _Sums:
    """Vectors added up per list."""

    def __init__(self, n_list: int, dim: int):
        self.counts = np.zeros(n_list, np.int64)
        self.totals = np.zeros((n_list, dim))

    def add(self, lists: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> None:
        if len(lists) == 0:
            return
        by = np.argsort(lists, kind="stable")
        found, start = np.unique(lists[by], return_index=True)
        self.totals[found] += np.add.reduceat(rows[by], start, axis=0, dtype=np.float64)
        self.counts[found] += np.add.reduceat(counts[by], start)

    def batches(self) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(self.counts)
        return blocks.batches(
            {
                "list_id": pa.array(used, pa.int32()),
                "n": pa.array(self.counts[used]),
                "total": blocks.vector_column(self.totals[used]),
            },
            rows=1024,
        )


def _partial_sums(held, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many vectors are nearest to each centroid, and their sum."""
    centroids = held.value
    lists = np.arange(len(centroids))
    sums = _Sums(*centroids.shape)
    for batch in stream:
        rows = blocks.matrix(batch.column("embedding"), centroids.shape[1])
        best = blocks.RunningTopK(rows, 1, "l2")
        best.update(lists, centroids)
        sums.add(best.ids[:, 0], rows, np.ones(len(rows), np.int64))
    yield from sums.batches()


def _merge_sums(n_list: int, dim: int, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shuffle partition: the tasks' sums added up, one row per list."""
    sums = _Sums(n_list, dim)
    for batch in stream:
        totals = blocks.matrix(batch.column("total"), dim)
        sums.add(batch.column("list_id").to_numpy(), totals, batch.column("n").to_numpy())
    yield from sums.batches()


def _merge_tasks(train: DataFrame, n: int, n_list: int, dim: int) -> int:
    """Shuffle partitions for the tasks' sums, from the most rows there can be."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    size = min(n, 4 * cores * n_list) * dim * 8
    return max(1, min(n_list, size // _MERGE_BYTES))


def _lloyd(train: DataFrame, seeds: DataFrame, iters: int, spherical: bool, n: int) -> DataFrame:
    """Centroids within the broadcast bound: sent to the tasks, updated from their sums."""
    spark = train.sparkSession
    table = seeds.select("list_id", "embedding").toArrow().sort_by("list_id")
    centroids = blocks.matrix(table.column("embedding")).astype(np.float64)
    if spherical:
        centroids = _unit(centroids)
    n_list, dim = centroids.shape
    tasks = _merge_tasks(train, n, n_list, dim)
    for _ in range(iters):
        held = spark.sparkContext.broadcast(centroids)
        # At most one row per task and list is shuffled, however hot a list is.
        summed = (
            train.select("embedding")
            .mapInArrow(partial(_partial_sums, held), _SUMS)
            .repartition(tasks, "list_id")
            .mapInArrow(partial(_merge_sums, n_list, dim), _SUMS)
            .toArrow()
        )
        held.unpersist()
        at = summed.column("list_id").to_numpy()
        means = blocks.matrix(summed.column("total")) / summed.column("n").to_numpy()[:, None]
        centroids = centroids.copy()
        centroids[at] = means
        if spherical:
            centroids = _unit(centroids)
    ids = pa.array(np.arange(len(centroids)), pa.int32())
    return spark.createDataFrame(
        pa.table({"list_id": ids, "centroid": blocks.vector_column(centroids)}), CENTROIDS
    )


def distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """L2 distances of rows, pair by pair, in double."""
    return np.linalg.norm(rows.astype(np.float64) - others, axis=1)


def tile_lists(held_bytes: int, dim: int) -> int:
    """Centroids of a tile of at most `held_bytes`."""
    return max(1, held_bytes // (dim * 8))


class CentroidTiles:
    """Stored centroids as broadcast tiles: tasks hold one at a time, however many there are.

    Tiles are read by ranges of lists, as many in one job as a block may hold, so the driver holds no more than
    that; on an executor the others are files. `nearest` reads vectors in groups and takes each group past all
    tiles.
    """

    def __init__(self, centroids: DataFrame, per_tile: int, metric: str):
        spark = centroids.sparkSession
        self.metric = metric
        self.dim = centroids.select(F.size("centroid").alias("dim")).head()["dim"]
        self.group_bytes = session.block_bytes(spark)
        last = centroids.agg(F.max("list_id")).head()[0]
        self.tiles = []
        per_job = per_tile * max(1, self.group_bytes // (per_tile * self.dim * 8))
        for first in range(0, last + 1, per_job):
            own = centroids.where(F.col("list_id").between(first, first + per_job - 1))
            table = own.select("list_id", "centroid").toArrow().sort_by("list_id")
            lists = table.column("list_id").to_numpy()
            vectors = blocks.matrix(table.column("centroid"), self.dim)
            ends = range(first + per_tile, first + per_job + per_tile, per_tile)
            cuts = np.unique(np.searchsorted(lists, ends))
            for a, b in zip([0, *cuts], cuts):
                if b > a:
                    self.tiles.append(spark.sparkContext.broadcast((lists[a:b], vectors[a:b])))

    def nearest(self, stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of rows, their vectors, the list nearest to each and the L2 distance to its centroid."""
        group, size = [], 0
        for batch in stream:
            group.append(batch)
            size += batch.num_rows * self.dim * 4
            if size >= self.group_bytes:
                yield self._group(group)
                group, size = [], 0
        if size:
            yield self._group(group)

    def _group(self, group: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(group)
        rows = blocks.matrix(table.column("embedding"), self.dim)
        best, reach = blocks.RunningTopK(rows, 1, self.metric), np.zeros(len(rows))
        for tile in self.tiles:
            lists, vectors = tile.value
            before = best.ids[:, 0].copy()
            best.update(lists, vectors)
            at = np.flatnonzero(best.ids[:, 0] != before)
            reach[at] = distances(rows[at], vectors[np.searchsorted(lists, best.ids[at, 0])])
            # The worker reads the tile's file again for the next group, so that it holds only one.
            vars(tile).pop("_value", None)
        return table, rows, best.ids[:, 0], reach

    def release(self) -> None:
        for tile in self.tiles:
            tile.unpersist()


def _tiled_sums(tiles: CentroidTiles, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group of vectors: how many are nearest to each list, and their sum."""
    for _, rows, lists, _ in tiles.nearest(stream):
        by = np.argsort(lists, kind="stable")
        found, start, counts = np.unique(lists[by], return_index=True, return_counts=True)
        totals = np.add.reduceat(rows[by], start, axis=0, dtype=np.float64)
        yield from blocks.batches(
            {
                "list_id": pa.array(found, pa.int32()),
                "n": pa.array(counts.astype(np.int64)),
                "total": blocks.vector_column(totals),
            },
            rows=1024,
        )


def _merge_tile(per_tile: int, dim: int, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range of lists: the groups' sums added up, one row per list."""
    sums, first = _Sums(per_tile, dim), 0
    for batch in stream:
        lists = batch.column("list_id").to_numpy()
        first = int(lists[0]) // per_tile * per_tile if len(lists) else first
        totals = blocks.matrix(batch.column("total"), dim)
        sums.add(lists - first, totals, batch.column("n").to_numpy())
    used = np.flatnonzero(sums.counts)
    yield from blocks.batches(
        {
            "list_id": pa.array(used + first, pa.int32()),
            "n": pa.array(sums.counts[used]),
            "total": blocks.vector_column(sums.totals[used]),
        },
        rows=1024,
    )


def _lloyd_tiled(
    train: DataFrame, seeds: DataFrame, iters: int, spherical: bool, dim: int, per_tile: int
) -> DataFrame:
    """Centroids beyond the bound: a table, cut once per step, that tasks see tile by tile.

    Vectors stay where they are read; only sums of vectors by list are shuffled, to the task that merges
    their range of lists.
    """
    spark = train.sparkSession
    shape = normalised if spherical else (lambda c: F.transform(c, lambda x: x.cast("double")))
    centroids, path = session.cut(
        seeds.select("list_id", shape(F.col("embedding")).alias("centroid")), "centroids"
    )
    ranges = math.ceil(centroids.count() / per_tile)
    for _ in range(iters):
        tiles = CentroidTiles(centroids, per_tile, "l2")
        summed = (
            train.select("embedding")
            .mapInArrow(partial(_tiled_sums, tiles), _SUMS)
            .repartitionById(ranges, F.floor(F.col("list_id") / per_tile).cast("int"))
            .mapInArrow(partial(_merge_tile, per_tile, dim), _SUMS)
            .select("list_id", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
        )
        stepped = centroids.join(summed, "list_id", "left").select(
            "list_id",
            F.when(F.col("mean").isNull(), F.col("centroid"))
            .otherwise(shape(F.col("mean")))
            .alias("centroid"),
        )
        centroids, done = session.cut(stepped, "centroids")
        tiles.release()
        session.drop(spark, path)
        path = done
    return centroids


def embedding_of_centroid() -> Column:
    return F.col("centroid").alias("embedding")
