"""Token files: documents as token ids in document order, coded by rANS segments.

A token file set is a Parquet table whose rows are segments: `part, segment, before, n_tokens, payload`.
Parts are ranges of document ids; within a part, segments follow one another, and `before` counts the
ids of its earlier segments. Each payload stands alone (see `rans`), so segments decode in parallel.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm import rans
from vecloom.llm.text import own_columns, whole
from vecloom.llm.tokens import encoder

END_ID = 2

#: Text bytes of one part.
PART_BYTES = 32 << 20

#: Ids after which a segment ends at the next document.
SEGMENT_TOKENS = 4 << 20

SEGMENTS = (
    "part int, segment int, before bigint, n_tokens bigint, n_docs bigint, payload binary"
)
DECODED = "doc_id bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    part_bytes: int = PART_BYTES,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode every document, its end id appended, in ascending order of id into token files at `path`.

    A null text is empty; null ids come first and stay null; rows with equal ids follow each other by
    text. Extra columns are ignored. An empty table gives a file set without segments. A task holds one
    segment: `segment_tokens` ids and the document that passes them, never a whole part.
    """
    spark = session.ship(docs.sparkSession)
    documents = own_columns(docs, doc_id=F.col("doc_id").cast("bigint"), text=whole(F.col("text")))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    ordered = (
        documents.withColumn("text_hash", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash")
    )

    def encode(batches):
        part = TaskContext.get().partitionId()
        encode_texts = encoder(tokenizer)
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        tokens = before = segment = 0

        def close():
            documents = rans.Documents(
                np.array([0 if x is None else x for x in doc_ids], np.int64),
                np.array([x is None for x in doc_ids]),
                np.array([len(x) for x in held], np.uint32),
            )
            payload = rans.encode(np.concatenate(held), documents)
            row = [part, segment, before, tokens, len(doc_ids), payload]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "segment", "before", "n_tokens", "n_docs", "payload"]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)], names
            )

        for batch in batches:
            keys = batch["doc_id"].to_pylist()
            texts = batch["text"].to_pylist()
            for doc_id, ids in zip(keys, encode_texts.batch(texts), strict=True):
                held.append(np.append(ids, np.uint32(end_id)))
                doc_ids.append(doc_id)
                tokens += len(held[-1])
                if tokens >= segment_tokens:
                    yield close()
                    before, segment = before + tokens, segment + 1
                    held, doc_ids, tokens = [], [], 0
        if held:
            yield close()

    segments = ordered.select("doc_id", "text").mapInArrow(encode, SEGMENTS)
    segments.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every document, decoded from token files.

    `start` is the number of ids of all documents before it. A segment that does not match its
    checksums raises.
    """
    session.ship(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row per part
    starts: dict[int, int] = {}
    total = 0
    for row in sorted(totals):
        starts[row["part"]] = total
        total += row["n"]

    def decode(batches):
        for batch in batches:
            rows = zip(
                batch["part"].to_pylist(), batch["before"].to_pylist(), batch["payload"], strict=True
            )
            for part, before, payload in rows:
                segment = rans.Segment(payload.as_py())
                ids = segment.tokens()
                lengths = segment.documents.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                if (ends[-1] if len(ends) else 0) != segment.n_tokens:
                    raise rans.CorruptSegment("document lengths do not add up")
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [
                    zlib.crc32(data[4 * (end - n) : 4 * end])
                    for n, end in zip(lengths.tolist(), ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(segment.documents.ids, mask=segment.documents.null),
                        pa.array(np.full(len(lengths), part, np.int32)),
                        pa.array(starts[part] + before + ends - lengths),
                        pa.array(lengths),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                )

    slim = segments.select("part", "before", "payload")
    return slim.mapInArrow(decode, DECODED).drop("part")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = session.scratch_path(spark, "token-files")
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
