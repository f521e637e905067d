"""Block top-k: small numpy helpers used inside Arrow tasks.

Scores of a block come from one single-precision matrix product, which only picks candidates: a
row survives if the product, less a proven rounding bound, could still reach the best k. Survivors
are scored again in double by the direct formula, so ids and scores do not depend on block sizes,
partitioning or the BLAS in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

QUERY_TILE = 1024
BASE_TILE = 4096
#: Tiles of queries at most that meet a small block of base rows together.
_WIDEST = 16
_RESCORE_FLOATS = 1 << 22
_NO_ID = np.iinfo(np.int64).max


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as an (n, dim) array; every row must be a full vector of that length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, dim or 0), np.float32)
    values = column.flatten()
    if column.null_count or values.null_count:
        raise ValueError("embedding must not hold nulls")
    lengths = np.unique(np.diff(column.offsets.to_numpy()))
    width = int(lengths[0]) if dim is None else dim
    if len(lengths) != 1 or lengths[0] != width:
        raise ValueError(f"embedding dimension mismatch: want {width}, got {lengths.tolist()}")
    return values.to_numpy(zero_copy_only=False).reshape(n, width)


def vector_column(rows: np.ndarray) -> pa.Array:
    """An (n, dim) array as an Arrow list column."""
    n, dim = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel()))


class RunningTopK:
    """The best k base rows seen so far for each query of a fixed set, lower id first on ties.

    Keys are "larger is better": the score itself, negated where smaller scores win.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, order: str = "nearest"):
        self.queries = queries
        self.k = k
        self.l2 = metric == "l2"
        self.best = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), _NO_ID, np.int64)
        self._flip = -1.0 if order == "farthest" else 1.0
        self._square = _squares(queries)
        self._longest = np.sqrt(self._square.max(initial=0.0))

    def update(self, base_ids: np.ndarray, base: np.ndarray, rows: np.ndarray | None = None):
        """Offer base rows to all queries, or only to those at positions `rows`."""
        rows = np.arange(len(self.queries)) if rows is None else rows
        for b in range(0, len(base), BASE_TILE):
            block, block_ids = base[b : b + BASE_TILE], base_ids[b : b + BASE_TILE]
            square = _squares(block)
            peak = np.sqrt(square.max())
            kind = np.float32 if peak * (self._longest + peak) < 1e30 else np.float64
            side = self._side(block, square, kind)
            # Few base rows meet more queries at a time, so that a call is worth its cost.
            step = QUERY_TILE * min(_WIDEST, max(1, BASE_TILE // len(block)))
            for q in range(0, len(rows), step):
                self._offer(rows[q : q + step], block_ids, block, side, peak)

    def _side(self, base, square, kind):
        """Base columns whose product with `[q, 1]` orders rows as their keys do for that query."""
        side = base.T.astype(kind)
        if self.l2:
            side = np.concatenate([2 * side, -square[None].astype(kind)])
        return -side if self._flip < 0 else side

    def _offer(self, rows, base_ids, base, side, peak):
        kind, dim = side.dtype.type, base.shape[1]
        q = self.queries[rows].astype(kind, copy=False)
        if self.l2:
            q = np.concatenate([q, np.ones((len(q), 1), kind)], axis=1)
        approx = q @ side
        norm = np.sqrt(self._square[rows])
        unit = (dim + 8) * np.finfo(kind).eps
        slack = unit * norm * peak + dim * 1e-37
        floor = self.best[rows, -1]
        if self.l2:
            slack = 2 * slack + unit * peak * peak
            # The floor itself was rounded, in double, at the size of the whole distance.
            slack += (dim + 8) * np.finfo(np.float64).eps * (norm + peak) ** 2
            floor = floor + self._flip * self._square[rows]
        floor = floor - slack

        keep = None if np.isneginf(floor).all() else approx >= _below(floor, kind)
        crowded = keep is None or np.count_nonzero(keep) > 4 * self.k * len(rows)
        if crowded and len(base) > self.k:
            floor = np.maximum(floor, self._kth(approx) - 2 * slack)
            keep = approx >= _below(floor, kind)
        if keep is None:
            keep = np.ones(approx.shape, bool)
        r, c = np.divmod(np.flatnonzero(keep), len(base))
        if len(r):
            self._merge(rows, r, base_ids[c], self._exact(rows[r], base, c))

    def _kth(self, approx):
        if self.k == 1:
            return approx.max(axis=1).astype(np.float64)
        at = approx.shape[1] - self.k
        return np.partition(approx, at, axis=1)[:, at].astype(np.float64)

    def _exact(self, rows, base, cols):
        keys = np.empty(len(rows))
        step = max(1, _RESCORE_FLOATS // base.shape[1])
        for s in range(0, len(rows), step):
            q = self.queries[rows[s : s + step]].astype(np.float64)
            x = base[cols[s : s + step]].astype(np.float64)
            if self.l2:
                x -= q
                keys[s : s + step] = -np.square(x).sum(axis=1)
            else:
                keys[s : s + step] = (q * x).sum(axis=1)
        return self._flip * keys

    def _merge(self, rows, r, ids, keys):
        touched, local = np.unique(r, return_inverse=True)
        at = rows[touched]
        owner = np.concatenate([local, np.repeat(np.arange(len(at)), self.k)])
        keys = np.concatenate([keys, self.best[at].ravel()])
        ids = np.concatenate([ids, self.ids[at].ravel()])
        by = np.lexsort((ids, -keys, owner))
        owner, keys, ids = owner[by], keys[by], ids[by]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.k
        self.best[at[owner[kept]], place[kept]] = keys[kept]
        self.ids[at[owner[kept]], place[kept]] = ids[kept]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Filled slots as (query position, 1-based rank, base id, score)."""
        position, place = np.nonzero(self.ids != _NO_ID)
        keys = self._flip * self.best[position, place]
        return position, place + 1, self.ids[position, place], (-keys if self.l2 else keys) + 0.0


def _squares(rows: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", rows, rows, dtype=np.float64, casting="safe")
    if not np.isfinite(squares).all():
        raise ValueError("embedding must hold finite values")
    return squares


def _below(floor: np.ndarray, kind: type) -> np.ndarray:
    """Per-query thresholds as a column of `kind`, rounded down."""
    return np.nextafter(floor.astype(kind), kind(-np.inf))[:, None]


def batches(columns: dict[str, pa.Array], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Columns as record batches of bounded length."""
    table = pa.RecordBatch.from_pydict(columns)
    for start in range(0, table.num_rows, rows):
        yield table.slice(start, rows)
