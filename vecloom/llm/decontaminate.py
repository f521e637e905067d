"""Benchmark decontamination with a distributed positional inverted index of the training tokens.

The index is a table of shards. A shard covers some documents and has, for each of their terms, the
sorted list of its positions; positions count through the shard, with a gap between documents. Every
shard answers all phrases by itself, so neither building nor searching moves postings between tasks.
A phrase is looked up from its rarest term: that term's positions, less the term's offset, are the
possible starts, and each next rarer list, shifted by its own offset, removes starts that it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vecloom import session
from vecloom.llm.text import boxed, own_columns, row_keys, unboxed, whole

WINDOW = 10

#: Bytes of text in one index shard; a longer document has a shard of its own.
SHARD_BYTES = 2 << 20

#: Positions between two documents of a shard; a proximity search reaches less far.
GAP = 64

#: Bytes of benchmark text that one pass over the index searches for.
BLOCK_BYTES = 4 << 20

INDEX = (
    "part int, shard int, doc_ids array<bigint>, text_hashes array<bigint>, n_words array<int>, "
    "terms binary, ends binary, positions binary"
)
#: `item` is bigint, or string if the benchmark's ids are no integers.
MATCHES = (
    "part int, shard int, doc int, doc_id bigint, text_hash bigint, n_words bigint, "
    "spans array<struct<item_id:{item},start:int,length:int>>, near_items array<{item}>"
)

#: Every byte that is no part of a word becomes a space, A-Z become a-z; bytes from 0x80 on, which make
#: up all other characters, stay.
_FOLD = bytes(
    c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20
    for c in range(256)
)


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and all characters beyond ASCII, in UTF-8."""
    return text.translate(_FOLD).split()


def _index_shard(texts: list[bytes]) -> tuple[list[int], bytes, bytes, bytes]:
    """Words per document; terms joined by a new line; where each list of positions ends; positions."""
    all_words: list[bytes] = []
    sizes = []
    for text in texts:
        own = tokens(text)
        sizes.append(len(own))
        all_words += own
    terms = list(set(all_words))
    number = {t: i for i, t in enumerate(terms)}
    codes = np.fromiter(map(number.__getitem__, all_words), np.int32, len(all_words))
    shift = np.repeat(GAP * np.arange(len(sizes)), sizes)
    order = np.argsort(codes, kind="stable")
    positions = (np.arange(len(codes)) + shift)[order]
    ends = np.cumsum(np.bincount(codes, minlength=len(terms)))
    return sizes, b"\n".join(terms), ends.astype("<i4").tobytes(), positions.astype("<i4").tobytes()


def build_index(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Index all words of `docs` (`doc_id, text`) into the table at `path`.

    A null text has no words; equal or null ids stay rows of their own. Extra columns are ignored.
    """
    session.ship(docs.sparkSession)
    text = whole(F.col("text"))
    documents = own_columns(
        docs,
        doc_id=F.col("doc_id").cast("bigint"),
        text_hash=F.xxhash64(text),
        text=text.cast("binary"),
    )

    def index(batches):
        part = TaskContext.get().partitionId()
        names = [f.split()[0] for f in INDEX.split(", ")]
        shard = 0
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        kinds += [pa.list_(pa.int32())] + [pa.binary()] * 3
        for ids, hashes, texts in _groups(batches, shard_bytes):
            sizes, *blobs = _index_shard(texts)
            row = [part, shard, ids, hashes, sizes, *blobs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names
            )
            shard += 1

    documents.mapInArrow(index, INDEX).write.option("compression", "zstd").parquet(path)


def _groups(batches, size: int) -> Iterator[tuple[list[int | None], list[int], list[bytes]]]:
    """Ids, text hashes and texts of documents that have `size` bytes of text together."""
    group: tuple[list, list, list] = ([], [], [])
    held = 0
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("doc_id", "text_hash", "text"))
        for row in zip(*columns, strict=True):
            for values, value in zip(group, row, strict=True):
                values.append(value)
            held += len(row[2])
            if held >= size:
                yield group
                group, held = ([], [], []), 0
    if group[0]:
        yield group


@dataclass(frozen=True)
class Phrases:
    """Windows of benchmark items; rows of `windows[n]` are n term numbers, `items[n]` whose they are."""

    terms: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[int | str]]]


def phrases(items: list[tuple[int | str, str | None]], window: int = WINDOW) -> Phrases:
    """All different windows of the items; an item of fewer words is one window, of none has none."""
    terms: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for item_id, text in items:
        own = [terms.setdefault(t, len(terms)) for t in tokens((text or "").encode())]
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).add(item_id)
    return Phrases(
        terms,
        {n: np.array(list(x), np.int32) for n, x in found.items()},
        {n: [sorted(ids) for ids in x.values()] for n, x in found.items()},
    )


class Shard:
    """One shard of the index, as far as some phrases need it."""

    def __init__(self, terms: bytes, ends: bytes, positions: bytes, wanted: dict[bytes, int]):
        ends_of = np.concatenate([[0], np.frombuffer(ends, "<i4")])
        self.first = np.zeros(len(wanted), np.int64)
        self.last = np.zeros(len(wanted), np.int64)
        for i, term in enumerate(terms.split(b"\n")):
            number = wanted.get(term)
            if number is not None and term:
                self.first[number], self.last[number] = ends_of[i], ends_of[i + 1]
        self.counts = self.last - self.first
        self.positions = np.frombuffer(positions, "<i4")

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.last[term]]

    def exact(self, window: np.ndarray) -> np.ndarray:
        """Positions at which the window starts."""
        order = np.argsort(self.counts[window], kind="stable")
        starts = self.postings(window[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            there = self.postings(window[i])
            at = np.searchsorted(there, starts + i)
            starts = starts[there[np.minimum(at, len(there) - 1)] == starts + i]
        return starts

    def near(self, window: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term of the window within `slop` words."""
        different = np.unique(window)
        order = different[np.argsort(self.counts[different], kind="stable")]
        anchors = self.postings(order[0])
        for term in order[1:]:
            if not len(anchors):
                break
            there = self.postings(term)
            at = np.searchsorted(there, anchors)
            after = there[np.minimum(at, len(there) - 1)]
            before = there[np.maximum(at - 1, 0)]
            gap = np.minimum(np.abs(after - anchors), np.abs(before - anchors))
            anchors = anchors[gap <= slop]
        return anchors


def _spans(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches that windows of n words at the sorted `starts` cover."""
    breaks = np.flatnonzero(np.diff(starts) > n) + 1
    runs = np.split(starts, breaks)
    return [(int(r[0]), int(r[-1] - r[0]) + n) for r in runs]


def _search_shard(row: dict, asked: Phrases, slop: int) -> tuple[list[list], list[list[int | str]]]:
    """Spans and near items of each document of a shard."""
    sizes = np.array(row["n_words"], np.int64)
    first = np.cumsum(sizes) - sizes + GAP * np.arange(len(sizes))
    shard = Shard(row["terms"], row["ends"], row["positions"], asked.terms)
    starts_of: dict[tuple[int | str, int], list[np.ndarray]] = {}
    near: list[set[int | str]] = [set() for _ in sizes]
    for n, windows in asked.windows.items():
        for w in np.flatnonzero(shard.counts[windows].min(axis=1) > 0):
            starts = shard.exact(windows[w])
            for item in asked.items[n][w]:
                if len(starts):
                    starts_of.setdefault((item, n), []).append(starts)
            if slop:
                anchors = shard.near(windows[w], slop)
                for d in np.unique(np.searchsorted(first, anchors, side="right") - 1):
                    near[d].update(asked.items[n][w])
    spans: list[list[tuple[int | str, int, int]]] = [[] for _ in sizes]
    for (item, n), found in sorted(starts_of.items()):
        for start, length in _spans(np.unique(np.concatenate(found)), n):
            d = int(np.searchsorted(first, start, side="right")) - 1
            spans[d].append((item, start - int(first[d]), length))
    return spans, [sorted(x) for x in near]


def search_index(
    spark: SparkSession,
    path: str,
    benchmark: DataFrame,
    window: int = WINDOW,
    slop: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per indexed document: `part, shard, doc, doc_id, text_hash, n_words, spans, near_items`.

    `spans` are the stretches of words inside exact occurrences of an item's windows; `near_items` the
    items with a window whose words all lie within `slop` words of its rarest one, in any order (0: not
    searched). `part, shard, doc` tell rows with equal ids apart. The benchmark is the query set: it is
    searched in blocks of `block_bytes`, one pass over the index each, and the blocks are put together.
    Items without an id are left out; equal ids are one item. Ids that are no integers are strings in the
    result. An empty benchmark matches nothing.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}, got {slop}")
    session.ship(spark)
    index = spark.read.schema(INDEX).parquet(path)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    items = own_columns(benchmark, item_id=F.col("item_id"), text=F.col("text"))
    item = "bigint" if isinstance(items.schema["item_id"].dataType, IntegralType) else "string"
    items = items.withColumn("item_id", F.col("item_id").cast(item))
    matches = MATCHES.format(item=item)
    item_kind = pa.int64() if item == "bigint" else pa.string()
    span = pa.struct([("item_id", item_kind), ("start", pa.int32()), ("length", pa.int32())])
    kinds += [pa.list_(span), pa.list_(item_kind)]
    names = [f.split()[0] for f in matches.split(", ")]

    def pass_over(asked: Phrases) -> DataFrame:
        held = spark.sparkContext.broadcast(asked)

        def search(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    spans, near = _search_shard(row, held.value, slop)
                    n = len(spans)
                    columns = [
                        [row["part"]] * n,
                        [row["shard"]] * n,
                        range(n),
                        row["doc_ids"],
                        row["text_hashes"],
                        row["n_words"],
                        [[dict(zip(span.names, s, strict=True)) for s in x] for x in spans],
                        near,
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                    )

        return index.mapInArrow(search, matches)

    found = [pass_over(phrases(block, window)) for block in _blocks(items, block_bytes)]
    if len(found) == 1:
        return found[0]
    key = ["part", "shard", "doc"]
    merged = found[0]
    for other in found[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy(*key).agg(
        F.any_value("doc_id").alias("doc_id"),
        F.any_value("text_hash").alias("text_hash"),
        F.any_value("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )


def _blocks(items: DataFrame, size: int) -> Iterator[list[tuple[int | str, str | None]]]:
    """The items (`item_id, text`) in blocks of about `size` bytes, one empty block if there are none."""
    block: list[tuple[int | str, str | None]] = []
    held = 0
    any_block = False
    for item_id, text in items.where(F.col("item_id").isNotNull()).toLocalIterator():
        block.append((item_id, text))
        held += len(text or "")
        if held >= size:
            yield block
            block, held, any_block = [], 0, True
    if block or not any_block:
        yield block


def covered_words(spans: Column) -> Column:
    """Number of words inside any of the spans of a document."""
    ordered = F.array_sort(
        F.transform(
            spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["length"]).alias("b"))
        )
    )
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], done["end"]))).alias("n"),
            F.greatest(done["end"], s["b"]).alias("end"),
        ),
        lambda done: done["n"].cast("bigint"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of a benchmark item occurs."""
    spark = docs.sparkSession
    path = session.scratch_path(spark, "positional-index")
    build_index(docs, path)
    found = search_index(spark, path, benchmark, window, slop=0)
    hit = (
        found.where(F.size("spans") > 0)
        .select(F.xxhash64("doc_id", "text_hash").alias("_row"), F.col("text_hash").alias("_hash"))
        .distinct()
    )
    hit, _ = session.cut(hit, "contaminated")
    kept = row_keys(boxed(docs)).join(
        session.small(hit, 96 * hit.count()), ["_row", "_hash"], "left_anti"
    )
    return unboxed(kept, docs.columns)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = session.scratch_path(spark, "positional-index")
    build_index(docs, path)
    found = search_index(spark, path, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_distinct(F.transform("spans", lambda s: s["item_id"]))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return (
        found.withColumn("items", items)
        .withColumn("n_hit", covered_words(F.col("spans")))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b) WHERE n > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, win)),
word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
