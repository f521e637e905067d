"""A tree of two levels over coarse centroids: the nearest lists of a vector, without scoring all lists.

The centroids are clustered themselves, into about as many groups as their number has as its square root.
A leaf is a group or, of a large group, a piece of it, with the radius around the group's centre that its
lists stay within. A vector is scored against all centres and the lists of its nearest leaves. After that it
visits only leaves that can hold anything as good, which their radius tells by the triangle inequality
(under `ip`, by Cauchy and Schwarz). So lists, scores and ties are those of scoring everything.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions import blocks
from vecloom.operators.flat import collect_vectors
from vecloom.operators.kmeans import distances, embedding_of_centroid, ivf_train, tile_lists
from vecloom.schema import METRICS, one_of, positive

#: Bounds of rows and leaves that a task works out at a time.
_BOUNDS = 1 << 22


@dataclass
class _Tile:
    """A run of leaves whose lists tasks hold together: `lists, vectors`, leaf i at `ends[i - 1]:ends[i]`."""

    first: int
    ends: np.ndarray
    held: Broadcast


@dataclass
class CentroidTree:
    """Leaves of all centroids: centre, its norm, radius and number of lists of each, and tiles of leaves.

    Tasks hold one tile at a time. There are about `sqrt(n_list)` leaves, which all tasks hold.
    """

    metric: str
    n_list: int
    centres: np.ndarray
    norms: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray
    tiles: list[_Tile]
    group_bytes: int

    def release(self) -> None:
        for tile in self.tiles:
            tile.held.unpersist()

    def best_possible(self, rows: np.ndarray, leaves: slice) -> np.ndarray:
        """The best key (larger is better) that any list of a leaf can have for each row, never too low."""
        centres, norms, radius = self.centres[leaves], self.norms[leaves], self.radius[leaves]
        rows = rows.astype(np.float64)
        length = np.linalg.norm(rows, axis=1)[:, None]
        product = rows @ centres.T
        # What rounding can be off by: all terms are at most (|row| + |centre| + radius) squared.
        slack = (length + norms + radius) ** 2 * (rows.shape[1] + 16) * 1e-15
        if self.metric == "ip":
            return product + length * radius + slack
        apart = np.sqrt(np.maximum(length**2 - 2 * product + norms**2 - slack, 0))
        least = np.maximum(apart * (1 - 1e-12) - radius * (1 + 1e-12), 0)
        return slack - least**2

    def nearest(
        self, rows: np.ndarray, k: int
    ) -> tuple[blocks.RunningTopK, np.ndarray, np.ndarray]:
        """The k nearest lists of each row, the L2 distance to the nearest, and how many it was scored with."""
        best = blocks.RunningTopK(rows, k, self.metric)
        reach = np.zeros(len(rows))
        scored = np.full(len(rows), len(self.centres), np.int64)
        n = len(self.centres)
        some = min(n, math.ceil(4 * k * n / self.n_list))
        first = np.empty((len(rows), some), np.int32)
        step = max(1, _BOUNDS // n)
        for a in range(0, len(rows), step):
            bounds = self.best_possible(rows[a : a + step], slice(0, n)) if some < n else None
            first[a : a + step] = (
                np.arange(n) if bounds is None else np.argpartition(-bounds, some - 1, axis=1)[:, :some]
            )

        def visit(wanted: Callable[[np.ndarray, slice], Iterator[tuple[int, np.ndarray]]]) -> None:
            for tile in self.tiles:
                leaves = slice(tile.first, tile.first + len(tile.ends))
                size = max(1, _BOUNDS // len(tile.ends))
                held = None
                for a in range(0, len(rows), size):
                    for leaf, at in wanted(np.arange(a, min(a + size, len(rows))), leaves):
                        held = held or tile.held.value
                        i = leaf - tile.first
                        own = slice(tile.ends[i - 1] if i else 0, tile.ends[i])
                        lists, vectors = held[0][own], held[1][own]
                        before = best.ids[at, 0]
                        best.update(lists, vectors, at)
                        scored[at] += len(lists)
                        new = at[best.ids[at, 0] != before]
                        to = vectors[np.searchsorted(lists, best.ids[new, 0])]
                        reach[new] = distances(rows[new], to)
                if len(self.tiles) > 1:
                    # The worker reads the tile's file again when it comes back, so that it holds only one.
                    vars(tile.held).pop("_value", None)

        def near(at: np.ndarray, leaves: slice) -> Iterator[tuple[int, np.ndarray]]:
            row, leaf = np.repeat(at, some), first[at].ravel()
            inside = (leaf >= leaves.start) & (leaf < leaves.stop)
            row, leaf = row[inside], leaf[inside]
            by = np.argsort(leaf, kind="stable")
            found, start = np.unique(leaf[by], return_index=True)
            yield from zip(found, np.split(row[by], start[1:]))

        def possible(at: np.ndarray, leaves: slice) -> Iterator[tuple[int, np.ndarray]]:
            bounds = self.best_possible(rows[at], leaves)
            done = first[at]
            inside = (done >= leaves.start) & (done < leaves.stop)
            bounds[np.nonzero(inside)[0], done[inside] - leaves.start] = -np.inf
            left = (bounds > -np.inf) & (bounds >= best.best[at, -1][:, None])
            for i in np.flatnonzero(left.any(axis=0)):
                # Leaves visited before may have raised what is still worth a visit.
                still = left[:, i] & (bounds[:, i] >= best.best[at, -1])
                if still.any():
                    yield leaves.start + i, at[still]

        visit(near)
        if some < n:
            visit(possible)
        return best, reach, scored

    def groups(self, stream: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Rows and their vectors, in groups that are worth reading the tiles for."""
        group, size = [], 0
        for batch in stream:
            group.append(batch)
            size += batch.num_rows * self.centres.shape[1] * 4
            if len(self.tiles) == 1 or size >= self.group_bytes:
                yield self._table(group, column)
                group, size = [], 0
        if group:
            yield self._table(group, column)

    def _table(self, group: list[pa.RecordBatch], column: str) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(group)
        return table, blocks.matrix(table.column(column), self.centres.shape[1])


def centroid_tree(
    centroids: DataFrame,
    metric: str = "l2",
    groups: int | None = None,
    iters: int = 5,
    held_bytes: int | None = None,
) -> CentroidTree:
    """Cluster `centroids` (`list_id, centroid`, best a stored table) into a tree.

    A task holds lists of at most about `held_bytes` (by default the broadcast bound) at a time; a group of
    more than a quarter of that is cut into leaves by hash, so equal or crowded centroids make no large one.
    """
    one_of("metric", metric, METRICS)
    spark = session.ship(centroids.sparkSession)
    n_list = centroids.count()
    if n_list == 0:
        raise ValueError("a tree needs at least one centroid")
    dim = centroids.select(F.size("centroid").alias("dim")).head()["dim"]
    per_tile = tile_lists(held_bytes or session.broadcast_bytes(spark), dim)
    groups = min(n_list, positive("groups", groups or math.ceil(math.sqrt(n_list))))
    points = centroids.select(F.col("list_id").cast("bigint").alias("vec_id"), embedding_of_centroid())
    tops = ivf_train(points, groups, iters)
    # About the square root of the number of lists.
    _, centres = collect_vectors(tops.select("list_id", embedding_of_centroid()), "list_id")
    leaf_of, path = session.cut(_grouped(centroids, centres), "centroid-groups")
    counted = leaf_of.groupBy("top").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("top")
    top, n = counted["top"].to_numpy(), counted["n"].to_numpy()
    pieces = -(-n // max(1, per_tile // 4))
    starts = pa.table({"top": top, "first": np.cumsum(pieces) - pieces, "pieces": pieces})
    leaf = F.col("first") + F.pmod(F.xxhash64("list_id"), F.col("pieces"))
    placed = (
        leaf_of.join(session.small(spark.createDataFrame(starts), len(top) * 24), "top")
        .select(leaf.alias("leaf"), "top", "list_id", "centroid", "away")
        .repartitionByRange("leaf")
        .sortWithinPartitions("leaf", "list_id")
    )
    members, placed_path = session.cut(placed, "centroid-leaves")
    session.drop(spark, path)
    stats = members.groupBy("leaf", "top").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
    stats = stats.toArrow().sort_by("leaf")
    leaves, sizes = stats["leaf"].to_numpy(), stats["n"].to_numpy()
    tiles = [_tile(members, leaves, sizes, run) for run in _runs(sizes, per_tile)]
    session.drop(spark, placed_path)
    own = centres[stats["top"].to_numpy()].astype(np.float64)
    norms = np.linalg.norm(own, axis=1)
    radius = stats["radius"].to_numpy()
    return CentroidTree(metric, n_list, own, norms, radius, sizes, tiles, session.block_bytes(spark))


def _grouped(centroids: DataFrame, centres: np.ndarray) -> DataFrame:
    """`list_id, centroid, top, away`: every centroid with its nearest centre and the distance to it."""
    held = centroids.sparkSession.sparkContext.broadcast(centres)

    def group(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = held.value
        for batch in stream:
            rows = blocks.matrix(batch.column("centroid"), centres.shape[1])
            best = blocks.RunningTopK(rows, 1, "l2")
            best.update(np.arange(len(centres)), centres)
            top = best.ids[:, 0]
            batch = batch.append_column("top", pa.array(top, pa.int64()))
            yield batch.append_column("away", pa.array(distances(rows, centres[top])))

    return centroids.select("list_id", "centroid").mapInArrow(
        group, "list_id int, centroid array<double>, top bigint, away double"
    )


def _runs(sizes: np.ndarray, per_tile: int) -> list[slice]:
    """Runs of leaves with at most `per_tile` lists together, or of one leaf."""
    runs, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > per_tile:
            runs.append(slice(first, i))
            first, held = i, 0
        held += size
    return [*runs, slice(first, len(sizes))]


def _tile(members: DataFrame, leaves: np.ndarray, sizes: np.ndarray, run: slice) -> _Tile:
    """The tile of a run of leaves; the driver holds one at a time."""
    a, b = int(leaves[run][0]), int(leaves[run][-1])
    table = members.where(F.col("leaf").between(a, b)).select("leaf", "list_id", "centroid").toArrow()
    table = table.sort_by([("leaf", "ascending"), ("list_id", "ascending")])
    held = table["list_id"].to_numpy(), blocks.matrix(table["centroid"])
    return _Tile(run.start, np.cumsum(sizes[run]), members.sparkSession.sparkContext.broadcast(held))


def tree_assign(base: DataFrame, tree: CentroidTree) -> DataFrame:
    """`vec_id, embedding, list_id, reach, scored`: the rows of `ivf_assign`, assigned where they are read.

    `reach` is the L2 distance to the list's centroid, `scored` the number of centres and centroids that the
    vector was compared with.
    """
    session.ship(base.sparkSession)

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in tree.groups(stream, "embedding"):
            best, reach, scored = tree.nearest(rows, 1)
            table = table.append_column("list_id", pa.array(best.ids[:, 0], pa.int32()))
            table = table.append_column("reach", pa.array(reach))
            yield from table.append_column("scored", pa.array(scored)).to_batches()

    return base.select("vec_id", "embedding").mapInArrow(
        assign, "vec_id bigint, embedding array<float>, list_id int, reach double, scored bigint"
    )


def tree_probes(queries: DataFrame, tree: CentroidTree, nprobe: int = 32) -> DataFrame:
    """`query_id, list_id, probe_rank`: the rows of `ivf_probes`, found where the queries are read."""
    session.ship(queries.sparkSession)
    nprobe = min(positive("nprobe", nprobe), tree.n_list)

    def probe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in tree.groups(stream, "embedding"):
            ids = table["query_id"].to_numpy()
            position, rank, lists, _ = tree.nearest(rows, nprobe)[0].results()
            yield from blocks.batches(
                {
                    "query_id": pa.array(ids[position], pa.int64()),
                    "list_id": pa.array(lists, pa.int32()),
                    "probe_rank": pa.array(rank, pa.int32()),
                }
            )

    return queries.select("query_id", "embedding").mapInArrow(
        probe, "query_id bigint, list_id int, probe_rank int"
    )
