"""Source divergence audit: distances between the term distributions of sources, by a K²-tree.

The groups (sources of a language) and its terms span a matrix of counts that is mostly zero. The matrix
is cut into tiles of some groups by some terms; in a tile, the nonzero cells are held as a K²-tree: a
bitmap per level says which quadrants hold any. Two groups are compared by walking their trees
together. Where both quadrants are empty, all their cells cost the same, the distance of the two groups'
prices of an absent term, so only their number is counted; other quadrants are split down to cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.text import UPPER, own_columns, read, whole

#: Documents of a language that must have a term for it to count.
MIN_DOCS = 30
#: Added to every count.
SMOOTHING = 5
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: Terms reported per group.
TOP_TERMS = 50

#: Groups on one side of a tile, and pairs of cells that a tile may hold.
TILE_GROUPS = 256
TILE_PAIRS = 1 << 17

#: Entries (group and term) that a task counts before it passes them on.
HELD_ENTRIES = 400_000

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
_SUMS = "lang string, a bigint, b bigint, value bigint"

#: Bytes of letters map to themselves (A-Z to lower case), all others to a space. Every byte of a
#: character beyond ASCII is a letter's.
_LETTERS = bytes(
    c if c >= 0x80 or chr(c).islower() else ord(chr(c).lower()) if chr(c) in UPPER else 0x20
    for c in range(256)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, docs`: occurrences and documents of each term in each group.

    Tasks count before they send, so that a frequent term is a few rows per task. Every group also has a
    row with an empty term and no occurrences, so groups without terms are there. Null text, lang and
    source are empty; every row is a document; extra columns are ignored.
    """
    session.ship(docs.sparkSession)
    texts = own_columns(
        docs, lang=whole(F.col("lang")), source=whole(F.col("source")), text=whole(F.col("text"))
    )

    def rows_of(held):
        """A batch per group, its counts let go as it is made."""
        names = ["lang", "source", "term", "n", "docs"]
        while held:
            (lang, source), counts = held.popitem()
            columns = [
                pa.array([lang] * len(counts)),
                pa.array([source] * len(counts)),
                pa.array(list(counts), pa.binary()).cast(pa.string()),
                pa.array([n for n, _ in counts.values()], pa.int64()),
                pa.array([docs for _, docs in counts.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    def count(batches):
        held: dict[tuple, dict[bytes, list[int]]] = {}
        size = 0
        for batch in batches:
            keys = zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True)
            for key, text in zip(keys, batch["text"].cast(pa.binary()), strict=True):
                group = held.setdefault(key, {b"": [0, 0]})
                own: dict[bytes, int] = {}
                for term in text.as_py().translate(_LETTERS).split():
                    own[term] = own.get(term, 0) + 1
                size -= len(group)
                for term, n in own.items():
                    entry = group.get(term)
                    if entry is None:
                        group[term] = [n, 1]
                    else:
                        entry[0] += n
                        entry[1] += 1
                size += len(group)
                if size >= HELD_ENTRIES:
                    yield from rows_of(held)
                    size = 0
        yield from rows_of(held)

    # By source too, so that a term of every text is no larger a key than its sources' share.
    return (
        texts.mapInArrow(count, _COUNTS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def _price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact for any count."""
    over = (F.lit(SCALE).cast("decimal(10,0)")) * (n + SMOOTHING).cast("decimal(20,0)")
    under = (total + SMOOTHING * terms).cast("decimal(20,0)")
    return F.call_function("div", over, under) + 1


class QuadTree:
    """A K²-tree (K = 2) over `rows` by `columns`, from the nonzero cells.

    `levels[l]` holds four flags per nonzero quadrant of level l, and where the children of each begin
    on the next level; `values` are those of the cells, in the order of the last level.
    """

    def __init__(self, height: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        code = np.zeros(len(rows), np.int64)
        for bit in range(height - 1, -1, -1):
            code = code << 2 | ((rows >> bit) & 1) << 1 | ((columns >> bit) & 1)
        order = np.argsort(code, kind="stable")
        code, self.values = code[order], values[order]
        self.levels: list[np.ndarray] = []
        above = np.zeros(min(1, len(code)), np.int64)
        for level in range(1, height + 1):
            here = np.unique(code >> 2 * (height - level))
            children = np.full(4 * len(above), -1, np.int64)
            children[4 * np.searchsorted(above, here >> 2) + (here & 3)] = np.arange(len(here))
            self.levels.append(children)
            above = here

    def child(self, level: int, nodes: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The index on the next level of a quadrant of each node, -1 where it is empty."""
        found = np.full(len(nodes), -1, np.int64)
        inside = nodes >= 0
        found[inside] = self.levels[level][4 * nodes[inside] + quadrant[inside]]
        return found


def tree_distances(
    left: QuadTree, right: QuadTree, height: int, width: int, zero_left: np.ndarray, zero_right: np.ndarray
) -> np.ndarray:
    """Sum over all columns of |left - right| for each pair of rows of two trees.

    `zero_left` and `zero_right` price an empty cell of each row. Both trees are walked level by level
    with all pairs of quadrants over the same columns; pairs of empty ones only add their real columns
    (`width` of them in all) to a count per pair of row ranges. For a tree and itself, only pairs of a row
    and a later one are right.
    """
    n_left, n_right = len(zero_left), len(zero_right)
    pairs = [np.array([0 if len(t.values) else -1], np.int64) for t in (left, right)]
    rows = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
    columns = np.zeros(1, np.int64)
    empty = np.zeros((n_left, n_right), np.int64)

    def price_empty(level, at_left, at_right, at_columns):
        span = 1 << (height - level)
        real = np.clip(width - at_columns * span, 0, span)
        shape = (1 << level, 1 << level)
        counts = np.bincount(at_left * shape[1] + at_right, real, shape[0] * shape[1])
        counts = counts.astype(np.int64).reshape(shape)
        above_left, above_right = np.arange(n_left) // span, np.arange(n_right) // span
        return counts[above_left[:, None], above_right[None, :]]

    for level in range(height + 1):
        bare = (pairs[0] < 0) & (pairs[1] < 0)
        if bare.any():
            empty += price_empty(level, rows[0][bare], rows[1][bare], columns[bare])
        go = ~bare
        pairs, rows, columns = [p[go] for p in pairs], [r[go] for r in rows], columns[go]
        if level == height:
            break
        way = np.tile(np.arange(8), len(columns))
        up, down, side = way >> 2, (way >> 1) & 1, way & 1
        pairs = [
            tree.child(level, np.repeat(nodes, 8), half << 1 | side)
            for tree, nodes, half in zip((left, right), pairs, (up, down), strict=True)
        ]
        rows = [np.repeat(r, 8) << 1 | half for r, half in zip(rows, (up, down), strict=True)]
        columns = np.repeat(columns, 8) << 1 | side
        span = 1 << (height - level - 1)
        real = (rows[0] * span < n_left) & (rows[1] * span < n_right) & (columns * span < width)
        if left is right:
            real &= rows[0] <= rows[1]
        pairs, rows, columns = [p[real] for p in pairs], [r[real] for r in rows], columns[real]

    def prices(tree, nodes, at, zero):
        out = zero[at]
        out[nodes >= 0] = tree.values[nodes[nodes >= 0]]
        return out

    found = prices(left, pairs[0], rows[0], zero_left) - prices(right, pairs[1], rows[1], zero_right)
    # Prices are below 2**31 and a tile's columns below 2**22, so the sums are exact.
    sums = np.bincount(rows[0] * n_right + rows[1], np.abs(found), n_left * n_right)
    sums = sums.astype(np.int64).reshape(n_left, n_right)
    return sums + empty * np.abs(zero_left[:, None] - zero_right[None, :])


def _tile(key: tuple, table: pa.Table, tile_groups: int) -> pa.Table:
    """Distances of all pairs of groups of one tile: rows with a null term give the groups and their
    prices of an absent term, the others the nonzero cells."""
    lang, block_a, block_b = key[0].as_py(), key[1].as_py(), key[2].as_py()
    group = table["at"].to_numpy()
    price = table["price"].to_numpy()
    is_cell = table["term"].is_valid().to_numpy()
    columns = table["term"].filter(pa.array(is_cell)).combine_chunks().dictionary_encode()
    column = columns.indices.to_numpy().astype(np.int64)
    width = int(table["width"][0].as_py())
    sides = []
    size = max(1, width)
    for block in (block_a, block_b):
        own = group // tile_groups == block
        heads = own & ~is_cell
        names = group[heads]
        order = np.argsort(names)
        names, zero = names[order], price[heads][order]
        cells = own[is_cell]
        rows = np.searchsorted(names, group[is_cell][cells])
        sides.append((names, zero, rows, column[cells], price[is_cell][cells]))
        size = max(size, len(names))
    height = (size - 1).bit_length()
    left = QuadTree(height, *sides[0][2:])
    right = left if block_a == block_b else QuadTree(height, *sides[1][2:])
    found = tree_distances(left, right, height, width, sides[0][1], sides[1][1])
    a = np.repeat(sides[0][0], len(sides[1][0]))
    b = np.tile(sides[1][0], len(sides[0][0]))
    once = a < b
    return pa.table(
        {
            "lang": pa.array([lang] * int(once.sum()), pa.string()),
            "a": a[once],
            "b": b[once],
            "value": found.reshape(-1)[once],
        }
    )


def group_distances(
    groups: DataFrame, cells: DataFrame, tile_groups: int = TILE_GROUPS, tile_pairs: int = TILE_PAIRS
) -> DataFrame:
    """`lang, a, b, value` for every pair `a < b` of the numbered groups of a language.

    `groups` has `lang, at, n_groups, n_terms, zero` (the price of an absent term), `cells` the nonzero
    `lang, at, n_groups, n_terms, term, price`. A tile holds at most `tile_groups` groups a side and, by
    the hash of the term, a share of the columns, so that neither a language with many sources nor one
    with most of the cells is one task.
    """
    blocks = F.ceil(F.col("n_groups") / tile_groups).cast("int")
    side = F.least("n_groups", F.lit(tile_groups))
    tiles = F.greatest(F.ceil(F.col("n_terms") * side * side / tile_pairs), F.lit(1)).cast("bigint")
    own = F.floor(F.col("at") / tile_groups).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    pairs = F.transform(
        every, lambda x: F.struct(F.least(x, own).alias("block_a"), F.greatest(x, own).alias("block_b"))
    )
    placed = cells.select(
        "lang", "at", "term", "price", F.explode(pairs).alias("pair"),
        F.pmod(F.xxhash64("term"), tiles).alias("tile"),
    )
    columns = cells.select("lang", "term", F.pmod(F.xxhash64("term"), tiles).alias("tile")).distinct()
    width = columns.groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("width"))
    heads = groups.select(
        "lang", "at", F.lit(None).cast("string").alias("term"), F.col("zero").alias("price"),
        F.explode(pairs).alias("pair"), tiles.alias("tiles"),
    ).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    heads = heads.join(width, ["lang", "tile"], "left")
    rows = heads.select(
        "lang", "pair.block_a", "pair.block_b", "tile", "at", "term", "price",
        F.coalesce("width", F.lit(0)).alias("width"),
    ).unionByName(
        placed.select(
            "lang", "pair.block_a", "pair.block_b", "tile", "at", "term", "price",
            F.lit(None).cast("bigint").alias("width"),
        )
    )

    def distances(key, table):
        # The heads carry the number of columns; they are put first.
        heads_first = table.sort_by([("width", "descending")])
        return _tile(key, heads_first, tile_groups)

    tiled = rows.groupBy("lang", "block_a", "block_b", "tile").applyInArrow(distances, _SUMS)
    return tiled.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, **tiles: int
) -> DataFrame:
    """`lang, source, part, item, value, rank`: distances between sources, and each one's own terms.

    Part `pair` ranks the other sources of a language by the sum of absolute differences of term shares;
    part `term` the `top_terms` terms that a source uses more than its language. Shares are smoothed and
    in billionths, all arithmetic is on integers. Null text, lang and source are empty; empty texts make
    groups without terms, which count; every row is a document, also with a repeated id; other columns
    are ignored; an empty table gives no rows. `tiles` are those of `group_distances`.
    """
    counted, _ = session.cut(term_counts(docs), "term-counts")
    in_lang = Window.partitionBy("lang", "term")
    kept = (
        counted.where(F.col("term") != "")
        .withColumn("lang_docs", F.sum("docs").over(in_lang))
        .withColumn("lang_n", F.sum("n").over(in_lang))
        .withColumn("first", F.row_number().over(in_lang.orderBy("source")) == 1)
        .where(F.col("lang_docs") >= min_docs)
        .drop("docs", "lang_docs")
    )
    kept, _ = session.cut(kept, "kept-terms")
    # One row per language, and one per group; both are as small as the report itself.
    langs = kept.groupBy("lang").agg(
        F.sum(F.col("first").cast("bigint")).alias("n_terms"), F.sum("n").alias("lang_total")
    )
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        counted.where(F.col("term") == "")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source",
            *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "n_terms", "lang_total")),
        )
        .withColumn("at", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint"))
        .withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    )
    zero = F.when(F.col("n_terms") > 0, _price(F.lit(0).cast("bigint"), F.col("total"), F.col("n_terms")))
    groups = groups.withColumn("zero", F.coalesce(zero, F.lit(0).cast("bigint")))
    groups, _ = session.cut(groups, "groups")
    held = session.small(groups, 128 * groups.count())
    cells = kept.join(held, ["lang", "source"]).select(
        "lang", "source", "at", "n_groups", "n_terms", "term",
        _price(F.col("n"), F.col("total"), F.col("n_terms")).alias("price"),
        _price(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("lang_price"),
    )
    names = groups.select("lang", "at", "source")
    once = group_distances(groups, cells, **tiles)
    both = once.unionByName(once.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    item = names.select("lang", F.col("at").alias("b"), F.col("source").alias("item"))
    pairs = (
        both.join(session.small(names, 64 * groups.count()).withColumnRenamed("at", "a"), ["lang", "a"])
        .join(session.small(item, 64 * groups.count()), ["lang", "b"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    own = cells.where(F.col("price") > F.col("lang_price")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("price") - F.col("lang_price")).alias("value"),
    )
    ranking = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = own.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(ranking)).unionByName(ranked)


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (
  SELECT id, lang, source, translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(x.n, 0) AS n
  FROM g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM c JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50
"""
