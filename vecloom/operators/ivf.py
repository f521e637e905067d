"""Inverted-list (IVF) index: assign vectors to their nearest centroid, search the probed lists."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import session
from vecloom.functions import blocks
from vecloom.operators.centroid_tree import centroid_tree, tree_assign
from vecloom.operators.flat import Sizes, collect_vectors, exact_knn, vector_bytes
from vecloom.operators.keyed import CANDIDATE_BYTES, block_tasks, keyed_knn
from vecloom.operators.kmeans import (
    CentroidTiles,
    distances,
    embedding_of_centroid,
    ivf_train,
    tile_lists,
)
from vecloom.operators.topk import top_k
from vecloom.schema import METRICS, NEIGHBOURS, one_of, positive
from vecloom.sources.index_store import COLUMNS, Meta, VectorIndex, begin, write_meta, write_table

STRATEGIES = ("auto", "broadcast", "two_pass", "shuffle")
_MAX_BUCKETS = 4096
#: Ranges of lists in one scan filter.
_MAX_RANGES = 64


def ivf_assign(
    base: DataFrame, centroids: DataFrame, coarse_metric: str = "l2", held_bytes: int | None = None
) -> DataFrame:
    """`vec_id, embedding, list_id`: every vector with the list of its nearest centroid.

    Vectors are assigned where they are read. Centroids of more than `held_bytes` (by default the
    broadcast bound) pass by in tiles of that size; `centroids` should then be a stored table.
    """
    return _assign(base, centroids, coarse_metric, held_bytes).drop("reach")


def _assign(
    base: DataFrame, centroids: DataFrame, coarse_metric: str, held_bytes: int | None = None
) -> DataFrame:
    """As `ivf_assign`, with `reach`, the L2 distance of a vector to its list's centroid."""
    one_of("coarse_metric", coarse_metric, METRICS)
    spark = session.ship(base.sparkSession)
    base = base.select("vec_id", "embedding")
    n_list = centroids.count()
    dim = centroids.select(F.size("centroid").alias("dim")).head()["dim"]
    held_bytes = held_bytes or session.broadcast_bytes(spark)
    assigned = "vec_id bigint, embedding array<float>, list_id int, reach double"
    if n_list * dim * 8 > held_bytes:
        tiles = CentroidTiles(centroids, tile_lists(held_bytes, dim), coarse_metric)

        def assign_in_tiles(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, _, lists, reach in tiles.nearest(stream):
                table = table.append_column("list_id", pa.array(lists, pa.int32()))
                yield from table.append_column("reach", pa.array(reach)).to_batches()

        return base.mapInArrow(assign_in_tiles, assigned)
    held = spark.sparkContext.broadcast(
        collect_vectors(centroids.select("list_id", embedding_of_centroid()), "list_id")
    )

    def assign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, vectors = held.value
        for batch in stream:
            rows = blocks.matrix(batch.column("embedding"), vectors.shape[1])
            best = blocks.RunningTopK(rows, 1, coarse_metric)
            best.update(lists, vectors)
            found = best.ids[:, 0]
            reach = distances(rows, vectors[np.searchsorted(lists, found)])
            batch = batch.append_column("list_id", pa.array(found, pa.int32()))
            yield batch.append_column("reach", pa.array(reach))

    return base.mapInArrow(assign, assigned)


def _bucket(n_list: int, buckets: int) -> Column:
    """Lists in equal, contiguous runs: the partition directory of each."""
    return F.floor(F.col("list_id").cast("bigint") * buckets / n_list).cast("int")


def write_lists(
    assigned: DataFrame, path: str, n_list: int, dim: int, mode: str = "error"
) -> tuple[int, int]:
    """Write the `sizes` and `lists` tables; returns the numbers of vectors and of buckets.

    Rows are placed by their list's offset in the whole, so files hold neighbouring lists in order,
    a list larger than a file is split over several tasks, and small lists share one.
    """
    spark = assigned.sparkSession
    staged, staging = session.cut(assigned, "assigned")
    sizes = staged.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"))
    write_table(sizes.coalesce(1), path, "sizes", mode)
    sizes = spark.read.schema(COLUMNS["sizes"]).parquet(f"{path}/sizes")
    offsets, placing = session.cut(_offsets(sizes), "offsets")
    n = offsets.agg(F.sum("n")).head()[0]

    per_file = session.file_rows(spark, n, dim * 4)
    files = math.ceil(n / per_file)
    buckets = min(files, n_list, _MAX_BUCKETS)
    slot = F.col("start") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    placed = (
        staged.join(session.small(offsets, n_list * 24), "list_id")
        .withColumn("list_bucket", _bucket(n_list, buckets))
        .repartitionById(files, F.floor(slot / F.lit(per_file)).cast("int"))
        .sortWithinPartitions("list_bucket", "list_id", "vec_id")
    )
    write_table(placed, path, "lists", mode)
    session.drop(spark, staging)
    session.drop(spark, placing)
    return n, buckets


def _offsets(sizes: DataFrame) -> DataFrame:
    """`list_id, n, start`: where each list begins if all are laid out in order.

    Sums run within runs of 4,096 lists and over the runs, so no task sorts all lists.
    """
    sizes = sizes.withColumn("run", F.floor(F.col("list_id") / 4096))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.groupBy("run").agg(F.sum("n").alias("rows"))
    runs = runs.select("run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("run").orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    start = (F.col("first") + F.col("local")).alias("start")
    return local.join(runs, "run").select("list_id", "n", start)


def build_ivf(
    base: DataFrame,
    metric: str,
    path: str | None = None,
    coarse_metric: str = "l2",
    centroids: DataFrame | None = None,
    mode: str = "error",
    tree: bool = False,
    **training,
) -> VectorIndex:
    """Train (unless `centroids` are given), assign and store an IVF index.

    `coarse_metric` picks lists and is kept with the index, so assignment and probing agree; it
    does not depend on `metric`, which scores vectors inside the lists. With `tree`, vectors find their
    lists through a tree of centroids, which gives the same index. Further arguments go to `ivf_train`.
    """
    one_of("metric", metric, METRICS)
    one_of("coarse_metric", coarse_metric, METRICS)
    spark = base.sparkSession
    path = path or session.scratch_path(spark, "ivf")
    begin(spark, path, mode)
    with session.Scratch(spark) as scratch:
        if centroids is None:
            centroids = ivf_train(base, **training)
        write_table(centroids, path, "centroids", mode)
        stored = spark.read.parquet(f"{path}/centroids")
        n_list = stored.count()
        dim = stored.select(F.size("centroid").alias("dim")).head()["dim"]
        if tree:
            assigned = tree_assign(base, centroid_tree(stored, coarse_metric)).drop("scored")
        else:
            assigned = _assign(base, stored, coarse_metric)
        n, buckets = write_lists(assigned, path, n_list, dim, mode)
    scratch.delete()
    meta = Meta("ivf", metric, coarse_metric, dim, n, n_list, n_bucket=buckets)
    return write_meta(spark, path, meta, mode)


def ivf_probes(
    centroids: DataFrame,
    queries: DataFrame,
    nprobe: int = 32,
    coarse_metric: str = "l2",
    sizes: Sizes | None = None,
) -> DataFrame:
    """The `nprobe` nearest lists of every query: `query_id, list_id, probe_rank`."""
    positive("nprobe", nprobe)
    lists = centroids.select(F.col("list_id").cast("bigint").alias("vec_id"), embedding_of_centroid())
    return exact_knn(lists, queries, nprobe, coarse_metric, sizes=sizes).select(
        "query_id",
        F.col("neighbor_id").cast("int").alias("list_id"),
        F.col("rank").alias("probe_rank"),
    )


def list_ranges(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """At most `_MAX_RANGES` ranges that cover the given ones (sorted), joined at the smallest gaps."""
    if len(first) == 0:
        return []
    gaps = first[1:] - last[:-1]
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: _MAX_RANGES - 1])
    cuts = cuts[gaps[cuts] > 1]
    starts = np.concatenate([[first[0]], first[cuts + 1]])
    ends = np.concatenate([last[cuts], [last[-1]]])
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def _probed_rows(
    index: VectorIndex, buckets: list[int], ranges: list[tuple[int, int]]
) -> DataFrame:
    """List rows of some bucket directories and ranges of lists.

    Other directories are not scanned. Files are in list order, so row groups outside the ranges are
    skipped too. Rows of other lists within the ranges are still there.
    """
    wanted = F.lit(False)
    for a, b in ranges:
        wanted |= F.col("list_id").between(a, b)
    return index.table("lists").where(F.col("list_bucket").isin(buckets) & wanted)


def ivf_search(
    index: VectorIndex,
    queries: DataFrame,
    k: int = 10,
    nprobe: int | None = 32,
    strategy: str = "auto",
) -> DataFrame:
    """Top-k over the probed lists, scored exactly: `query_id, rank, neighbor_id, score`.

    Queries, their probes and k result slots each are broadcast while they fit the bound, and the
    lists then stream past them unshuffled; beyond it, lists and queries meet in bounded blocks.
    `two_pass` first searches each query's nearest lists alone; the k-th score found bounds what tasks
    send of the others, so fewer candidates are shuffled, and none that cannot win.

    `nprobe=None` is exact search. After the first pass a query visits only lists that can hold anything
    better: by the triangle inequality, a list's radius bounds how near to the query its vectors can be
    (under `ip`, by Cauchy and Schwarz, how large their products). Queries go in tiles within the bound.
    """
    positive("k", k)
    one_of("strategy", strategy, STRATEGIES)
    if index.meta.index_type != "ivf":
        raise ValueError(f"{index.path} holds a {index.meta.index_type} index, not ivf")
    spark, meta = session.ship(index.spark), index.meta
    n = queries.count()
    if n == 0:
        return spark.createDataFrame([], NEIGHBOURS)
    if nprobe is None:
        return _exact_search(index, queries.select("query_id", "embedding"), k, n)
    nprobe = min(positive("nprobe", nprobe), meta.n_list)
    held = n * (vector_bytes(queries, meta.dim) + 8 + k * 16 + nprobe * 12)
    if strategy == "shuffle" or held > session.broadcast_bytes(spark):
        tasks = block_tasks(spark, n * nprobe * k * CANDIDATE_BYTES)
        found = ivf_candidates(index, queries, k, nprobe, n).repartition(tasks, "query_id")
    elif strategy == "two_pass":
        probes = _probe(index, queries, nprobe, n).toArrow()
        found = _two_pass(index, queries, k, lambda _: probes, probes)
    else:
        pairs = _probe(index, queries, nprobe, n).select("query_id", "list_id").toArrow()
        found = _stream_lists(index, queries, k, pairs)
    return top_k(found, k, meta.metric).select("query_id", "rank", "neighbor_id", "score")


def _first_lists(index: VectorIndex, k: int) -> int:
    """Lists of a first pass: enough for four times k vectors, if lists were of one size."""
    return min(index.meta.n_list, math.ceil(4 * k * index.meta.n_list / index.meta.n_base))


def _two_pass(
    index: VectorIndex,
    queries: DataFrame,
    k: int,
    pairs_within: Callable[[DataFrame], pa.Table],
    first: pa.Table,
) -> DataFrame:
    """Candidates of two passes: over the nearest lists of `first` (probes in rank order), then over the
    lists that `pairs_within` names, given the k-th scores, without those of the first pass."""
    nearest = first.filter(pc.less_equal(first["probe_rank"], _first_lists(index, k)))
    nearest = nearest.select(["query_id", "list_id"])
    metric = index.meta.metric
    found, _ = session.cut(top_k(_stream_lists(index, queries, k, nearest), k, metric), "first-pass")
    floors = found.where(F.col("rank") == k).select("query_id", "score").toArrow()
    rest = pairs_within(floors).select(["query_id", "list_id"])
    rest = rest.join(nearest, ["query_id", "list_id"], join_type="left anti")
    found = found.drop("rank")
    if rest.num_rows == 0:
        return found
    return found.unionByName(_stream_lists(index, queries, k, rest, floors))


def _exact_search(index: VectorIndex, queries: DataFrame, k: int, n: int) -> DataFrame:
    """All queries, in hash tiles that fit the bound with their results. Which lists a query visits is found
    where the lists are read: only vectors, floors and first lists of a tile pass through the driver, once."""
    spark, meta = index.spark, index.meta
    first_lists = _first_lists(index, k)
    row = vector_bytes(queries, meta.dim) + 8 + k * 16 + first_lists * 12
    tiles = math.ceil(n * row / session.broadcast_bytes(spark))
    out = None
    for tile in range(tiles):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(tiles)) == tile) if tiles > 1 else queries
        collected = collect_vectors(asked, "query_id")
        if len(collected[0]) == 0:
            continue
        nearest = _probe(index, asked, first_lists, n).select("query_id", "list_id").toArrow()
        found = top_k(_stream_lists(index, asked, k, nearest, None, collected), k, meta.metric)
        found, _ = session.cut(found, "first-pass")
        floors = found.where(F.col("rank") == k).select("query_id", "score").toArrow()
        rest = _stream_reachable(index, collected, k, nearest, floors)
        found = top_k(found.drop("rank").unionByName(rest), k, meta.metric)
        found = found.select("query_id", "rank", "neighbor_id", "score")
        if tiles > 1:
            found, _ = session.cut(found, "exact-tile")
        out = found if out is None else out.unionByName(found)
    return out


def _within_reach(
    metric: str, rows: np.ndarray, worst: np.ndarray, centres: np.ndarray, radius: np.ndarray
) -> np.ndarray:
    """Of each query and list, whether the list may hold a vector as good as the query's k-th so far, whose
    key (larger is better) is `worst`."""
    if np.isnan(radius).any():
        raise ValueError("the index has no radii; build it again for exact search")
    rows = rows.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1)[:, None]
    size = np.linalg.norm(centres, axis=1)
    product = rows @ centres.T
    # What rounding can be off by: all terms are at most (|q| + |c| + r) squared.
    scale = (norms + size + radius) ** 2 * (rows.shape[1] + 16) * 1e-15
    if metric == "ip":
        return product + norms * radius + scale >= worst[:, None]
    apart = norms**2 - 2 * product + size**2 - scale
    least = np.maximum(np.sqrt(np.maximum(apart, 0)) * (1 - 1e-12) - radius * (1 + 1e-12), 0)
    return least**2 <= scale - worst[:, None]


def _located(index: VectorIndex) -> DataFrame:
    bounds = index.table("sizes").select("list_id", "radius")
    return index.table("centroids").join(bounds, "list_id").select("list_id", "centroid", "radius")


def _reachable(index: VectorIndex, held) -> pa.Table:
    """`list_id` of all lists that any query can reach. `held` is the broadcast of `_stream_reachable`."""
    metric, dim = index.meta.metric, index.meta.dim

    def reachable(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vectors, worst, asking, *_ = held.value
        for batch in stream:
            centres = blocks.matrix(batch.column("centroid"), dim).astype(np.float64)
            radius = batch.column("radius").to_numpy(zero_copy_only=False)
            any_query = np.zeros(len(centres), bool)
            for a in range(0, len(asking), blocks.QUERY_TILE):
                q = asking[a : a + blocks.QUERY_TILE]
                any_query |= _within_reach(metric, vectors[q], worst[q], centres, radius).any(axis=0)
                if any_query.all():
                    break
            yield batch.select(["list_id"]).filter(pa.array(any_query))

    return _located(index).mapInArrow(reachable, "list_id int").toArrow()


def _stream_reachable(
    index: VectorIndex,
    collected: tuple[np.ndarray, np.ndarray],
    k: int,
    done: pa.Table,
    floors: pa.Table,
) -> DataFrame:
    """Best k per task and query of the lists that a query can reach, without those `done`; of a query in
    `floors` (`query_id, score`), only what is as good as that."""
    spark, meta = index.spark, index.meta
    query_ids, vectors = collected
    sign = -1 if meta.metric == "l2" else 1
    least = np.full(len(query_ids), -np.inf)
    least[np.searchsorted(query_ids, floors["query_id"].to_numpy())] = sign * floors["score"].to_numpy()
    # A query that comes twice is searched once.
    asking = np.flatnonzero(np.append(True, query_ids[1:] != query_ids[:-1])).astype(np.int32)
    done = done.sort_by("list_id")
    lists, starts = np.unique(done.column("list_id").to_numpy(), return_index=True)
    ends = np.append(starts, done.num_rows)
    visited = np.searchsorted(query_ids, done.column("query_id").to_numpy()).astype(np.int32)
    held = spark.sparkContext.broadcast((query_ids, vectors, least, asking, lists, ends, visited))
    metric, dim = meta.metric, meta.dim

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, least, asking, lists, ends, visited = held.value
        best = blocks.RunningTopK(vectors, k, metric)
        # Slots without an id hold the floor; an equal score with an id goes before them.
        best.best[:] = least[:, None]
        for batch in stream:
            if batch.num_rows == 0:
                continue
            ids = batch.column("vec_id").to_numpy()
            rows = blocks.matrix(batch.column("embedding"), dim)
            list_ids = batch.column("list_id").to_numpy()
            by = np.argsort(list_ids, kind="stable")
            found, start = np.unique(list_ids[by], return_index=True)
            centres = blocks.matrix(batch.column("centroid").take(pa.array(by[start])), dim).astype(np.float64)
            radius = batch.column("radius").to_numpy(zero_copy_only=False)[by[start]]
            step = max(blocks.QUERY_TILE, (1 << 22) // len(found))
            keep = np.zeros((len(found), len(query_ids)), bool)
            for a in range(0, len(asking), step):
                q = asking[a : a + step]
                keep[:, q] = _within_reach(metric, vectors[q], best.best[q, -1], centres, radius).T
            for i, members in enumerate(np.split(by, start[1:])):
                at = np.searchsorted(lists, found[i])
                if at < len(lists) and lists[at] == found[i]:
                    keep[i, visited[ends[at] : ends[at + 1]]] = False
                best.update(ids[members], rows[members], np.flatnonzero(keep[i]))
        position, _, found, score = best.results()
        yield from blocks.batches(
            {
                "query_id": pa.array(query_ids[position], pa.int64()),
                "neighbor_id": pa.array(found, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    wanted = np.sort(_reachable(index, held).column("list_id").to_numpy())
    located = session.small(_located(index), meta.n_list * (meta.dim * 8 + 24))
    rows = _rows_of(index, wanted).join(located, "list_id")
    rows = rows.select("list_id", "vec_id", "embedding", "centroid", "radius")
    return rows.mapInArrow(search, "query_id bigint, neighbor_id bigint, score double")


def _probe(index: VectorIndex, queries: DataFrame, nprobe: int, n: int) -> DataFrame:
    meta = index.meta
    sizes = Sizes(meta.n_list, n, meta.dim)
    return ivf_probes(index.table("centroids"), queries, nprobe, meta.coarse_metric, sizes)


def ivf_candidates(
    index: VectorIndex,
    queries: DataFrame,
    k: int,
    nprobe: int,
    n: int,
    probes: DataFrame | None = None,
) -> DataFrame:
    """Best k per query and probed list block: `query_id, list_id, neighbor_id, score`.

    `n` is the number of queries; `probes`, if at hand, must be a stored table.
    """
    meta = index.meta
    if probes is None:
        probes, _ = session.cut(_probe(index, queries, nprobe, n), "probes")
    asked = probes.select("query_id", "list_id").join(
        queries.select("query_id", "embedding"), "query_id"
    )
    bucket = _bucket(meta.n_list, meta.n_bucket)
    seen = probes.groupBy(bucket.alias("bucket")).agg(
        F.min("list_id").alias("first"), F.max("list_id").alias("last")
    )
    seen = sorted(seen.collect())  # one row per directory, at most _MAX_BUCKETS
    ends = [np.array([r[c] for r in seen], np.int64) for c in ("first", "last")]
    return keyed_knn(
        _probed_rows(index, [r["bucket"] for r in seen], list_ranges(*ends)),
        asked,
        k,
        meta.metric,
        "nearest",
        meta.dim,
        index.table("sizes"),
        meta.n_list,
    )


def _stream_lists(
    index: VectorIndex,
    queries: DataFrame,
    k: int,
    pairs: pa.Table,
    floors: pa.Table | None = None,
    collected: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """Best k per task and query from the lists of `pairs` (`query_id, list_id`), which the caller has
    bounded; of a query in `floors` (`query_id, score`), only what is as good as that. `collected` are the
    ids and vectors of the queries, if at hand."""
    spark, meta = index.spark, index.meta
    pairs = pairs.sort_by("list_id")
    query_ids, vectors = collected or collect_vectors(queries, "query_id")
    lists, starts = np.unique(pairs.column("list_id").to_numpy(), return_index=True)
    # The queries that probe lists[i] are at asking[bounds[i]:bounds[i + 1]].
    bounds = np.append(starts, pairs.num_rows)
    asking = np.searchsorted(query_ids, pairs.column("query_id").to_numpy()).astype(np.int32)
    least = np.full(len(query_ids), -np.inf)
    if floors is not None:
        sign = -1 if meta.metric == "l2" else 1
        least[np.searchsorted(query_ids, floors["query_id"].to_numpy())] = sign * floors["score"].to_numpy()
    held = spark.sparkContext.broadcast((query_ids, vectors, lists, bounds, asking, least))
    metric = meta.metric

    def search(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, lists, bounds, asking, least = held.value
        best = blocks.RunningTopK(vectors, k, metric)
        # Slots without an id hold the floor; an equal score with an id goes before them.
        best.best[:] = least[:, None]
        for batch in stream:
            ids = batch.column("vec_id").to_numpy()
            rows = blocks.matrix(batch.column("embedding"), vectors.shape[1])
            list_ids = batch.column("list_id").to_numpy()
            by = np.argsort(list_ids, kind="stable")
            found, start = np.unique(list_ids[by], return_index=True)
            for i, members in zip(np.searchsorted(lists, found), np.split(by, start[1:])):
                best.update(ids[members], rows[members], asking[bounds[i] : bounds[i + 1]])
        position, _, found, score = best.results()
        yield from blocks.batches(
            {
                "query_id": pa.array(query_ids[position], pa.int64()),
                "neighbor_id": pa.array(found, pa.int64()),
                "score": pa.array(score, pa.float64()),
            }
        )

    rows = _rows_of(index, lists).select("list_id", "vec_id", "embedding")
    return rows.mapInArrow(search, "query_id bigint, neighbor_id bigint, score double")


def _rows_of(index: VectorIndex, lists: np.ndarray) -> DataFrame:
    """The rows of `lists`, which are sorted."""
    spark, meta = index.spark, index.meta
    if len(lists) == meta.n_list:
        return index.table("lists")
    wanted = spark.createDataFrame(pa.table({"list_id": pa.array(lists, pa.int32())}))
    wanted = session.small(wanted, len(lists) * 16)
    buckets = np.unique(lists.astype(np.int64) * meta.n_bucket // meta.n_list)
    wide = lists.astype(np.int64)
    rows = _probed_rows(index, buckets.tolist(), list_ranges(wide, wide))
    return rows.join(wanted, "list_id", "left_semi")
