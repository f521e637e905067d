"""Conversation prefix trie: which conversations share which turns, from sorted neighbours.

Conversations are sorted by the hashes of their turns and cut into blocks. In a block, the lengths of
the common prefixes of neighbours get a sparse table of range minima. A candidate prefix (a row and a
depth) then finds how far its members reach by two independent binary searches, to the left and to the
right, and its counts are differences of running sums. There is no stack and no order among candidates.

A prefix shared over a block's border is one piece in each block; pieces are few (borders times common
depth), are added up by the hash of the prefix, and go back to their blocks. So a prefix that a third of
all conversations share is spread over all blocks that hold them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.text import crc32_of, own_columns, read, whole

#: Turns in a block, and blocks at most; with more turns than both allow, blocks are larger.
BLOCK_TURNS = 20_000
MAX_BLOCKS = 20_000

#: Turns that one row holds. The rest of a longer conversation is a row of the next generation.
ROW_TURNS = 4_096

#: First turns that a conversation can take from another one.
HEAD_TURNS = 8

_EMPTY_SHA = hashlib.sha256().hexdigest()
_NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_PIECES = (
    "block int, starts boolean, open boolean, depth bigint, prefix binary, n_convs bigint, conv_id bigint, "
    "member_bytes bigint, node_bytes bigint, n_leaves bigint, n_children bigint, ends binary"
)
_MERGED = ("n_convs", "conv_id", "saved_tokens", "n_leaves", "n_children", "ends_sha256")


def _tasks(rows: int) -> int:
    return min(MAX_BLOCKS, max(1, -(-rows // BLOCK_TURNS)))


def _turns(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, role, digest, k1, k2, size`: what tells turns apart, without their texts."""
    turns = own_columns(
        conversations,
        conv_id=F.col("conv_id").cast("bigint"),
        turn=F.col("turn").cast("bigint"),
        role=whole(F.col("role")),
        text=whole(F.col("text")),
    ).where(F.col("conv_id").isNotNull())
    return turns.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
        F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "role", "text").alias("k2"),
        F.octet_length("text").cast("bigint").alias("size"),
    )


def _numbered(turns: DataFrame, order: list[str], keep: list[str], name: str) -> DataFrame:
    """`conv_id`, the columns of `keep` and `name`: the place (from 0) of a turn in its conversation.

    Turns are range-partitioned by conversation and order; a task counts along its sorted rows. A
    conversation that lies in several partitions goes on counting where the ones before it end.
    """
    rows = turns.count()
    ordered = turns.repartitionByRange(_tasks(rows), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    fields = ", ".join(f"{c} {dict(turns.dtypes)[c]}" for c in ["conv_id", *keep])

    def count(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch["conv_id"].to_numpy()
            if not len(ids):
                continue
            begins = np.concatenate([[True], ids[1:] != ids[:-1]])
            at = np.flatnonzero(begins)
            place = np.arange(len(ids)) - np.repeat(at, np.diff(np.append(at, len(ids))))
            first_run = at[1] if len(at) > 1 else len(ids)
            if last == ids[0]:
                place[:first_run] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            columns = [batch[c] for c in ["conv_id", *keep]]
            columns += [pa.array(np.full(len(ids), part, np.int32)), pa.array(place.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", *keep, "part", "place"])

    session.ship(turns.sparkSession)
    placed = ordered.select("conv_id", *keep).mapInArrow(count, f"{fields}, part int, place bigint")
    placed, _ = session.cut(placed, "numbered-turns")
    # At most one conversation goes over each border of partitions, so there are at most that many.
    cut_up = (
        placed.groupBy("conv_id")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"))
        .where(F.col("low") < F.col("high"))
        .select("conv_id")
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.join(F.broadcast(cut_up), "conv_id")  # at most MAX_BLOCKS rows
        .groupBy("conv_id", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("conv_id", "part", F.sum("n").over(before).alias("offset"))
        .where(F.col("offset").isNotNull())
    )
    return placed.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", *keep, (F.col("place") + F.coalesce("offset", F.lit(0))).alias(name)
    )


def head_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from another one, 0 to 8."""
    return crc32_of(conv_id) % 9


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations (`conv_id, k1, k2, size, pos`), and all `conv_id`.

    Conversation c begins with the first `head_turns` turns of conversation c - c % 5, and goes on with
    its own turns after as many of its own.
    """
    turns, _ = session.cut(_turns(conversations), "turn-hashes")
    own = _numbered(turns, ["turn", "role", "digest"], ["k1", "k2", "size"], "nth")
    own, _ = session.cut(own, "own-turns")
    ids = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id")
    heads = own.where((F.col("conv_id") % 5 == 0) & (F.col("nth") < HEAD_TURNS)).withColumnRenamed("conv_id", "base")
    taken = (
        ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
        .join(heads, "base")
        .where(F.col("nth") < head_turns(F.col("conv_id")))
    )
    columns = ["conv_id", F.lit(0).alias("side"), "nth", "k1", "k2", "size"]
    rest = own.where(F.col("nth") >= head_turns(F.col("conv_id")))
    columns_rest = [F.lit(1).alias("side") if not isinstance(c, str) else c for c in columns]
    rebuilt, _ = session.cut(taken.select(*columns).unionByName(rest.select(*columns_rest)), "rebuilt-turns")
    return _numbered(rebuilt, ["side", "nth"], ["k1", "k2", "size"], "pos"), ids


def _rows(turns: DataFrame, ids: DataFrame, row_turns: int) -> DataFrame:
    """`conv_id, gen, keys, sizes, more, above`: up to `row_turns` turns of a conversation as one row.

    A row of a later generation begins with a hash of all turns before it, as a turn without text;
    `above` is the smallest conversation that has all of these turns.
    """
    turn = F.struct("pos", "k1", "k2", "size")
    rows = turns.groupBy("conv_id", F.floor(F.col("pos") / row_turns).cast("int").alias("gen")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    keys = F.flatten(F.transform("turns", lambda t: F.array(t["k1"], t["k2"])))
    rows = rows.select("conv_id", "gen", keys.alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows, _ = session.cut(rows, "turn-rows")
    last = rows.where("gen > 0").groupBy("conv_id").agg(F.max("gen").alias("last"))
    none, nobody = F.array().cast("array<bigint>"), F.lit(None).cast("bigint").alias("above")
    bare = ids.join(rows.where("gen = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).alias("gen"), none.alias("keys"), none.alias("sizes"), F.lit(False).alias("more"), nobody
    )
    if last.isEmpty():
        return rows.select("*", F.lit(False).alias("more"), nobody).unionByName(bare)
    # A chain has one row per `row_turns` turns.
    before = Window.partitionBy("conv_id").orderBy("gen").rowsBetween(Window.unboundedPreceding, -1)
    for seed in ("p", "q"):
        own = F.xxhash64(F.lit(seed), "gen", "keys")
        rows = rows.withColumn(seed, F.coalesce(F.bit_xor(own).over(before), F.lit(0).cast("bigint")))
        rows = rows.withColumn(f"{seed}_after", F.col(seed).bitwiseXOR(own))
    rows, _ = session.cut(rows.join(last, "conv_id", "left"), "chained-rows")
    above = (
        rows.where(F.size("sizes") == row_turns)
        .groupBy((F.col("gen") + 1).alias("gen"), F.col("p_after").alias("p"), F.col("q_after").alias("q"))
        .agg(F.min("conv_id").alias("above"))
    )
    later = rows.where("gen > 0").join(above, ["gen", "p", "q"]).select(
        "conv_id", "gen", F.concat(F.array("p", "q"), "keys").alias("keys"),
        F.concat(F.array(F.lit(0).cast("bigint")), "sizes").alias("sizes"),
        (F.col("gen") < F.col("last")).alias("more"), "above",
    )
    first = rows.where("gen = 0").select(
        "conv_id", "gen", "keys", "sizes", F.coalesce(F.col("last") > 0, F.lit(False)).alias("more"), nobody
    )
    return first.unionByName(later).unionByName(bare)


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """`table[k][i]` is the least of the `2**k` values from i on."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def range_min(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least value of each range, both ends included."""
    power = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(power):
        here = power == k
        out[here] = np.minimum(table[k][first[here]], table[k][last[here] - (1 << k) + 1])
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last row that share `depth` turns with `row`, for each candidate on its own.

    `table` is the sparse table of common prefixes, where entry i is that of rows i - 1 and i. Both
    searches halve their step; a step is taken if the least common prefix over it is deep enough.
    """
    low, high = row.copy(), row.copy()
    end = len(table[0]) - 1
    for k in range(len(table) - 1, -1, -1):
        step, part = 1 << k, table[k]
        at = low - step
        go = at >= 0
        go[go] = part[at[go] + 1] >= depth[go]
        low[go] -= step
        go = high + step <= end
        go[go] = part[high[go] + 1] >= depth[go]
        high[go] += step
    return low, high


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two rows of keys share from the start."""
    n = min(len(a), len(b)) // 2
    differs = np.flatnonzero((a[: 2 * n] != b[: 2 * n]).reshape(-1, 2).any(axis=1))
    return int(differs[0]) if len(differs) else n


class Block:
    """Sorted rows of a block, the common prefixes of neighbours, and what all steps need of them."""

    def __init__(self, table: pa.Table, borders: pa.Table):
        table = table.sort_by("pos").combine_chunks()
        self.conv = table["conv_id"].to_numpy()
        self.more = table["more"].to_numpy(zero_copy_only=False)
        self.size = len(self.conv)
        keys = table["keys"].combine_chunks()
        sizes = table["sizes"].combine_chunks()
        self.keys = keys.flatten().to_numpy().reshape(-1, 2)
        edges = np.concatenate([[0], np.cumsum(sizes.value_lengths().to_numpy())]).astype(np.int64)
        self.at, self.length = edges[:-1], np.diff(edges)
        self.bytes = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy())]).astype(np.int64)
        self.extra = {c: table[c].to_numpy().astype(np.int64) for c in ("x_leaves", "x_saved", "x_children")}
        ends = [borders[c][0].as_py() for c in ("before", "after")]
        own = [self.row(0), self.row(self.size - 1)]
        self.left, self.right = (
            0 if end is None else _common(np.array(end, np.int64), keys_of.reshape(-1))
            for end, keys_of in zip(ends, own, strict=True)
        )
        self.shared = self._shared()
        following = np.append(self.shared[1:], self.right)
        total = self.prefix_bytes(np.arange(self.size), self.length)
        new = total - self.prefix_bytes(np.arange(self.size), np.minimum(self.shared, self.length))
        # A sequence that no other one goes on from is a leaf, counted at its last copy; copies that go
        # on in the next generation are sorted last.
        leaf = (following < self.length) & ~self.more
        self.total = self._running(total)
        self.new = self._running(new)
        self.leaves = self._running(leaf.astype(np.int64) + self.extra["x_leaves"])
        self.saved = self._running(self.extra["x_saved"])
        self.common_table = sparse_table(self.shared)
        self.conv_table = sparse_table(self.conv)
        same = (self.shared[1:] == self.length[1:]) & (self.length[1:] == self.length[:-1])
        breaks = np.append(np.flatnonzero(~same), self.size - 1)
        #: Last row with the same turns.
        self.copies = breaks[np.searchsorted(breaks, np.arange(self.size))]
        self.ended = self._running((~self.more).astype(np.int64))
        self.followed = self._running(self.extra["x_children"])

    @staticmethod
    def _running(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)])

    def row(self, i: int) -> np.ndarray:
        return self.keys[self.at[i] : self.at[i] + self.length[i]]

    def prefix_bytes(self, rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.bytes[self.at[rows] + depth] - self.bytes[self.at[rows]]

    def _shared(self) -> np.ndarray:
        """Turns that each row shares with the one before it."""
        n = np.minimum(self.length[1:], self.length[:-1])
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        differs = (self.keys[self.at[1:][which] + place] != self.keys[self.at[:-1][which] + place]).any(axis=1)
        shared = n.copy()
        rows, first = np.unique(which[differs], return_index=True)
        shared[rows] = place[differs][first]
        return np.concatenate([[self.left], shared]).astype(np.int64)

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and depth of every prefix that begins in this block, and its number by row."""
        n = np.maximum(self.length - self.shared, 0)
        begins = np.cumsum(n) - n
        row = np.repeat(np.arange(self.size), n)
        return row, self.shared[row] + 1 + np.arange(len(row)) - begins[row], begins

    def children(self, row: np.ndarray, depth: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of every node that begins here, and by depth of those that began in an earlier block.

        A row with new turns begins a child of the prefix it shares, which its left search finds; within
        a row each node is a child of the one above it.
        """
        inner = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
        counts = inner.astype(np.int64)
        fresh = np.flatnonzero(self.length > self.shared)
        at = self.shared[fresh]
        parent, _ = extents(self.common_table, fresh, at)
        earlier = (at == 0) | ((parent == 0) & (at <= self.left))
        by_depth = np.bincount(at[earlier], minlength=self.left + 1)[: self.left + 1]
        known = parent[~earlier]
        np.add.at(counts, begins[known] + at[~earlier] - self.shared[known] - 1, 1)
        ends = self.length[row] == depth
        counts[ends] += self.followed[self.copies[row[ends]] + 1] - self.followed[row[ends]]
        return counts, by_depth

    def sums(self, first, last, depth, started) -> dict[str, np.ndarray]:
        """Counts over ranges of rows that share `depth` turns; `started`: whether the prefix begins at
        the first row or goes on from an earlier block."""
        n = last - first + 1
        above = self.prefix_bytes(first, np.maximum(depth - 1, 0))
        span = lambda running, a=first: running[last + 1] - running[a]
        begun = self.total[first + 1] - self.total[first] - above
        node_bytes = np.where(started, span(self.new, first + 1) + begun, span(self.new))
        return {
            "n_convs": n,
            "conv_id": range_min(self.conv_table, first, last),
            "member_bytes": span(self.total) - n * above + span(self.saved),
            "node_bytes": node_bytes,
            "n_leaves": span(self.leaves),
        }

    def ended_at(self, row: int, depth: int) -> np.ndarray:
        """Conversations without a turn more than `depth`, of those that share them with `row`, which is
        the first such row here."""
        if self.length[row] != depth:
            return self.conv[:0]
        copies = self.conv[row : self.copies[row] + 1]
        return copies[~self.more[row : self.copies[row] + 1]]

    def prefixes(self, row: int, depth: int) -> list[bytes]:
        """Hashes of the first 0 to `depth` turns of a row."""
        state = hashlib.blake2b(digest_size=16)
        out = [state.digest()]
        for turn in self.row(row)[:depth]:
            state.update(turn.astype("<i8").tobytes())
            out.append(state.digest())
        return out


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _pieces(key: tuple, table: pa.Table, borders: pa.Table) -> pa.Table:
    """The prefixes that this block shares with its neighbours, and the root: this block's part of them."""
    block = Block(table, borders)
    row, depth, begins = block.nodes()
    children, by_depth = block.children(row, depth, begins)
    last_row = block.size - 1

    left_depth = np.arange(block.left + 1)
    zero = np.zeros(len(left_depth), np.int64)
    _, reach = extents(block.common_table, zero, left_depth)
    reach[0] = last_row
    ends = block.length[0] == left_depth
    followed = np.where(ends, block.followed[block.copies[0] + 1], 0)
    left = block.sums(zero, reach, left_depth, np.zeros(len(left_depth), bool))
    left |= {"n_children": by_depth + followed, "starts": np.zeros(len(left_depth), bool)}
    left |= {"depth": left_depth, "open": (reach == last_row) & (left_depth <= block.right)}
    left_prefix = block.prefixes(0, block.left)
    left_ends = [_joined(block.ended_at(0, d)) for d in left_depth.tolist()]

    # Of the prefixes that begin here, those of the last row that the next block shares.
    own_depth = np.arange(1, block.right + 1)
    first, _ = extents(block.common_table, np.full(len(own_depth), last_row), own_depth)
    begun = own_depth > block.shared[first]
    own_depth, first = own_depth[begun], first[begun]
    own = block.sums(first, np.full(len(first), last_row), own_depth, np.ones(len(first), bool))
    own |= {"n_children": children[begins[first] + own_depth - block.shared[first] - 1]}
    own |= {"starts": np.ones(len(first), bool), "depth": own_depth, "open": np.ones(len(first), bool)}
    right_prefix = block.prefixes(last_row, block.right)
    own_prefix = [right_prefix[d] for d in own_depth.tolist()]
    own_ends = [_joined(block.ended_at(i, d)) for i, d in zip(first.tolist(), own_depth.tolist(), strict=True)]

    n = len(left_depth) + len(own_depth)
    columns = {c: pa.array(np.concatenate([left[c], own[c]])) for c in left}
    columns |= {
        "block": pa.array([key[0].as_py()] * n, pa.int32()),
        "prefix": pa.array(left_prefix + own_prefix, pa.binary()),
        "ends": pa.array(left_ends + own_ends, pa.binary()),
    }
    names = [field.split()[0] for field in _PIECES.split(", ")]
    return pa.table({c: columns[c] for c in names})


def _block_nodes(key: tuple, table: pa.Table, edges: pa.Table) -> pa.Table:
    """All prefixes that begin in this block; those shared with the next ones take their merged counts."""
    borders = edges.filter(pc.is_null(edges["depth"]))
    block = Block(table, borders)
    merged = edges.filter(pc.is_valid(edges["depth"])).to_pylist()
    on_left = {e["depth"]: e for e in merged if not e["starts"]}
    on_right = {e["depth"]: e for e in merged if e["open"]}
    row, depth, begins = block.nodes()
    children, _ = block.children(row, depth, begins)
    last_row = block.size - 1

    _, reach = extents(block.common_table, row, depth)
    found = block.sums(row, reach, depth, np.ones(len(row), bool))
    columns = {
        "conv_id": found["conv_id"],
        "n_convs": found["n_convs"],
        "n_children": children,
        "n_leaves": found["n_leaves"],
        "saved_tokens": found["member_bytes"] - found["node_bytes"],
    }
    shas = np.full(len(row), _EMPTY_SHA, object)
    for i in np.flatnonzero(block.length[row] == depth).tolist():
        ended = block.ended_at(int(row[i]), int(depth[i]))
        if len(ended):
            shas[i] = hashlib.sha256(_joined(ended)).hexdigest()
    for i in np.flatnonzero((reach == last_row) & (depth <= block.right)).tolist():
        whole_node = on_right[int(depth[i])]
        for c in columns:
            columns[c][i] = whole_node[c]
        shas[i] = whole_node["ends_sha256"]

    above = depth - 1
    low, high = extents(block.common_table, row, above)
    parent = range_min(block.conv_table, low, high)
    earlier = (above == 0) | ((low == 0) & (above <= block.left))
    later = ~earlier & (high == last_row) & (above <= block.right)
    for where, known in ((earlier, on_left), (later, on_right)):
        at = np.flatnonzero(where)
        parent[at] = [known[d]["conv_id"] for d in above[at].tolist()]
    columns |= {"depth": depth, "parent_conv_id": parent, "ends_sha256": pa.array(shas, pa.string())}
    return pa.table({field.split()[0]: columns[field.split()[0]] for field in _NODES.split(", ")})


def _ends_hashes(pieces: DataFrame) -> DataFrame:
    """`depth, prefix, ends_sha256`: the hash of the ids that pieces list, in the order of blocks.

    The ids of a prefix stream through one hash, a piece at a time, so no list of them is gathered.
    """

    def hashes(batches):
        last, state = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.binary()), pa.array([state.hexdigest()])],
                ["depth", "prefix", "ends_sha256"],
            )

        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("depth", "prefix", "ends")), strict=True)
            for depth, prefix, ends in rows:
                if (depth, prefix) != last:
                    if last:
                        yield row()
                    last, state, any_before = (depth, prefix), hashlib.sha256(), False
                if ends:
                    state.update(b"," + ends if any_before else ends)
                    any_before = True
        if last:
            yield row()

    ordered = pieces.select("depth", "prefix", "block", "ends").repartition("depth", "prefix")
    ordered = ordered.sortWithinPartitions("depth", "prefix", "block").drop("block")
    return ordered.mapInArrow(hashes, "depth bigint, prefix binary, ends_sha256 string")


def _generation(rows: DataFrame, n_turns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of all prefixes of the rows, and the one node of the empty prefix."""
    blocks = _tasks(n_turns)
    order = ["keys", "more", "conv_id"]
    ordered = (
        rows.repartitionByRange(blocks, *order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("pos"))
    )
    ordered, _ = session.cut(ordered, "sorted-conversations")
    # One row per block; their number is bounded by MAX_BLOCKS.
    ends = ordered.groupBy("block").agg(
        F.min_by("keys", "pos").alias("first"), F.max_by("keys", "pos").alias("last")
    )
    by_block = Window.orderBy("block")
    borders = ends.select(
        "block", F.lag("last").over(by_block).alias("before"), F.lead("first").over(by_block).alias("after")
    )
    borders, _ = session.cut(borders, "block-borders")
    grouped = ordered.groupBy("block")
    pieces, _ = session.cut(grouped.cogroup(borders.groupBy("block")).applyInArrow(_pieces, _PIECES), "trie-pieces")
    merged = (
        pieces.groupBy("depth", "prefix")
        .agg(
            F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.sum(F.col("member_bytes") - F.col("node_bytes")).alias("saved_tokens"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("n_children").alias("n_children"),
        )
        .join(_ends_hashes(pieces), ["depth", "prefix"])
    )
    merged, _ = session.cut(merged, "trie-merged")
    edges = pieces.select("block", "starts", "open", "depth", "prefix").join(merged, ["depth", "prefix"])
    edges = edges.drop("prefix").unionByName(borders, allowMissingColumns=True)
    nodes = grouped.cogroup(edges.groupBy("block")).applyInArrow(_block_nodes, _NODES)
    return nodes, merged.where(F.col("depth") == 0)


def prefix_trie(conversations: DataFrame, row_turns: int = ROW_TURNS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations; columns as in `_NODES`.

    Turns go by number, null first, equal numbers by role and text; repeated rows are turns of their
    own. A null role or text is empty. Rows without `conv_id` belong to no conversation and are left
    out. A conversation that has no turns after it is rebuilt is a member of the root only. Extra columns
    are ignored; an empty table gives no rows.

    Turns are told apart by hashes of 128 bits. A conversation longer than `row_turns` goes on in rows of
    a next generation; generations are worked from the last to the first, each handing the counts of its
    subtrees to the rows above.
    """
    turns, ids = rebuild(conversations)
    rows, _ = session.cut(_rows(turns, ids, row_turns), "conversation-rows")
    sizes = rows.groupBy("gen").agg(F.sum(F.size("sizes") + 1).alias("n")).collect()  # one row each
    extra_columns = ("x_leaves", "x_saved", "x_children")
    none = rows.sparkSession.createDataFrame([], ", ".join(f"{c} bigint" for c in ("conv_id", *extra_columns)))
    out, extra = None, none
    for gen, n in sorted(((r["gen"], r["n"]) for r in sizes), reverse=True):
        here = rows.where(F.col("gen") == gen)
        own = here.drop("gen", "above").join(extra, "conv_id", "left")
        own = own.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in extra_columns})
        nodes, root = _generation(own, n)
        if gen:
            nodes, _ = session.cut(nodes, "trie-generation")
            # Depth 1 is all that came before: the counts of its subtree go to one member's row above.
            extra = nodes.where("depth = 1").select(
                "conv_id", F.col("n_leaves").alias("x_leaves"), F.col("saved_tokens").alias("x_saved"),
                F.col("n_children").alias("x_children"),
            )
            tops = here.select(F.col("conv_id").alias("parent_conv_id"), F.lit(2).alias("depth"), "above")
            nodes = (
                nodes.where("depth > 1")
                .join(tops, ["parent_conv_id", "depth"], "left")
                .withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
                .withColumn("depth", F.col("depth") + (gen * row_turns - 1))
                .drop("above")
            )
        else:
            leaf = F.greatest("n_leaves", (F.col("n_children") == 0).cast("bigint")).alias("n_leaves")
            root = root.select(
                "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children",
                leaf, "saved_tokens", "ends_sha256",
            )
            nodes = nodes.unionByName(root)
        out = nodes if out is None else out.unionByName(nodes)
    if out is None:
        return rows.sparkSession.createDataFrame([], _NODES)
    return out.select(*(field.split()[0] for field in _NODES.split(", ")))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''),
          lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table),
o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      md5(coalesce(text, ''))) - 1 AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, 0 AS side, nth, role, text FROM c JOIN o ON o.conv_id = c.base AND nth < h
  UNION ALL
  SELECT c.conv_id, 1, nth, role, text FROM c JOIN o USING (conv_id) WHERE nth >= h),
placed AS (
  SELECT conv_id, strlen(text) AS bytes, md5(strlen(role) || ':' || role || text) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY side, nth) AS depth
  FROM rebuilt),
path AS MATERIALIZED (
  SELECT conv_id, depth, bytes,
    md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key
  FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes
  FROM path GROUP BY ALL),
linked AS MATERIALIZED (
  SELECT n.*, p.key AS parent_key, u.conv_id AS parent_conv_id
  FROM node n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN node u ON u.depth = p.depth AND u.key = p.key),
kids AS (
  SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children
  FROM linked WHERE depth > 0 GROUP BY ALL),
marked AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, key)),
below AS (
  SELECT path.depth, path.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
    sum((n_convs - 1) * marked.bytes) AS saved_tokens
  FROM marked JOIN path ON path.conv_id = marked.conv_id AND path.depth <= marked.depth GROUP BY ALL),
ends AS (
  SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM path JOIN (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id)
    USING (conv_id, depth) GROUP BY ALL)
SELECT linked.conv_id, depth, linked.parent_conv_id, linked.n_convs, marked.n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM linked JOIN marked USING (depth, key) JOIN below USING (depth, key) LEFT JOIN ends USING (depth, key)
"""
