"""Sequence packing over the length histogram, shortest pack first.

Documents are cut into pieces of at most one sequence. Only the histogram of piece lengths (at most one
row per length) goes to the driver. Lengths are placed longest first, each into the packs that are
shortest so far, as counts of equal packing patterns rather than single packs. Patterns then go back to
pieces by rank: the r-th piece of a length takes the r-th place that the patterns have for that length.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.ranks import ranked
from vecloom.llm.text import own_columns, whole
from vecloom.llm.tokens import Encoder, crc_of, encoder

SEQUENCE = 4096
END_ID = 2

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "text_hash bigint"
)


@dataclass(frozen=True)
class Places:
    """Where the pieces go, as parallel arrays sorted by length and first rank.

    `first[i]` is the rank, over all pieces sorted by length, of the first piece of run i; the piece of
    rank r in that run goes to sequence `sequence[i] + r - first[i]` at `offset[i]`. `base[n]` is the
    number of pieces shorter than n.
    """

    base: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    n_sequences: int


def shortest_pack_first(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many packs have each, for `histogram[n]` pieces of length n.

    Each length splits one group of equal packs at most and opens two, so there are at most three
    patterns per length, however many pieces there are.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []

    def put(pattern: tuple[int, ...], count: int, left: int) -> None:
        if left not in open_packs:
            open_packs[left] = []
            heapq.heappush(room, -left)
        open_packs[left].append((pattern, count))

    for length in range(size, 0, -1):
        todo = int(histogram[length])
        while todo:
            most = -room[0] if room else -1
            if most < length:
                # No pack has room: open packs and fill each before the next one is opened.
                each = size // length
                full, rest = divmod(todo, each)
                if full:
                    put((length,) * each, full, size - each * length)
                if rest:
                    put((length,) * rest, 1, size - rest * length)
                todo = 0
                continue
            pattern, count = open_packs[most].pop()
            if not open_packs[most]:
                del open_packs[most]
                heapq.heappop(room)
            taken = min(count, todo)
            if taken < count:
                put(pattern, count - taken, most)
            put((*pattern, length), taken, most - length)
            todo -= taken
    return [x for group in open_packs.values() for x in group]


def places(histogram: np.ndarray, size: int) -> Places:
    """The places of all pieces of the histogram; sequences are numbered by pattern, fullest first."""
    patterns = sorted(shortest_pack_first(histogram, size), key=lambda x: (-sum(x[0]), x[0]))
    base = np.concatenate([[0], np.cumsum(histogram)])[: size + 1]
    used = base.copy()
    runs = []
    sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            runs.append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    first, numbers, offsets = (
        np.array(sorted(runs), np.int64).reshape(-1, 3).T if runs else np.zeros((3, 0), np.int64)
    )
    return Places(base, first, numbers, offsets, sequence)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    size: int = SEQUENCE,
    with_ids: bool = False,
    keep_encoder: bool = True,
) -> DataFrame:
    """The pieces of all documents: `doc_id, start, length, ids_crc32, doc_tokens` (and `ids`).

    A document's ids and its end id are cut into pieces of `size`, the rest being the last piece.
    Workers keep their encoder, with all words it has met, for their next task, or without `keep_encoder`
    let go of it at the end of one: jobs that follow in the same workers then have its memory.
    """
    documents = own_columns(
        docs,
        doc_id=F.col("doc_id").cast("bigint"),
        text=whole(F.col("text")),
        text_hash=F.xxhash64(whole(F.col("text"))),
    )
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches):
        encode = encoder(tokenizer) if keep_encoder else Encoder(tokenizer)
        for batch in batches:
            rows = []
            keys = zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), strict=True)
            texts = batch["text"].to_pylist()
            for (doc_id, text_hash), ids in zip(keys, encode.batch(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                for start in range(0, len(ids), size):
                    own = ids[start : start + size]
                    row = [doc_id, start, len(own), crc_of(own), len(ids), text_hash]
                    rows.append([*row, own.astype(np.int32)] if with_ids else row)
            columns = list(zip(*rows, strict=True)) or [[]] * (7 if with_ids else 6)
            arrays = [pa.array(c, pa.int64()) for c in columns[:6]]
            if with_ids:
                arrays.append(pa.array(columns[6], pa.list_(pa.int32())))
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return documents.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    size: int = SEQUENCE,
    with_ids: bool = False,
    keep_encoder: bool = True,
) -> DataFrame:
    """Each piece with its `sequence_id` and its `offset` there.

    Null texts are empty documents: one piece with the end id alone. Rows with equal or null ids are
    documents of their own; equal pieces are interchangeable. Extra columns are ignored, an empty table
    gives no rows. Pieces are computed once and stored, so texts are read and encoded once.
    """
    spark = session.ship(docs.sparkSession)
    cut = pieces(docs, tokenizer, end_id, size, with_ids, keep_encoder)
    table, _ = session.cut(cut, "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for row in table.groupBy("length").count().collect():  # at most `size` rows
        histogram[row["length"]] = row["count"]
    where = places(histogram, size)
    held = spark.sparkContext.broadcast(where)  # a few runs per length and pack depth
    order = ["doc_id", "start", "ids_crc32", "text_hash"]
    by_rank = ranked(table, ["length"], order, "rank", int(histogram.sum()))

    def place(batches):
        at = held.value
        for batch in batches:
            rank = at.base[batch["length"].to_numpy()] + batch["rank"].to_numpy()
            run = np.searchsorted(at.first, rank, side="right") - 1
            sequence = pa.array(at.sequence[run] + rank - at.first[run])
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in kept), sequence, pa.array(at.offset[run])],
                [*kept, "sequence_id", "offset"],
            )

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return by_rank.select(*table.columns, "rank").mapInArrow(
        place, f"{schema}, sequence_id bigint, offset bigint"
    )


def sequences(packed: DataFrame, size: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """The sequences of `pack(..., with_ids=True)`: `sequence_id, n_tokens, ids, documents`.

    `documents` has the number (from 1) of the piece that each id belongs to, 0 for padding. A sequence
    is padded to `size` unless its length is a power of two. A group is one sequence, so it is bounded.
    """
    part = F.struct("offset", "length", "ids").alias("part")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    n = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["length"])
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    numbers = F.flatten(
        F.transform("parts", lambda p, i: F.array_repeat(i + 1, p["length"].cast("int")))
    )
    padding = F.when(F.bit_count("n_tokens") == 1, F.lit(0)).otherwise(F.lit(size) - F.col("n_tokens"))
    pad = lambda value: F.array_repeat(F.lit(value), padding.cast("int"))
    return grouped.select("sequence_id", n.alias("n_tokens"), "parts").select(
        "sequence_id",
        "n_tokens",
        F.concat(ids, pad(pad_id)).alias("ids"),
        F.concat(numbers, pad(0)).alias("documents"),
    )


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.drop("text_hash")
