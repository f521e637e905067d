"""From documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as a table, and returns what it keeps with the columns of
`documents`; the last one returns the places of all pieces in the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from vecloom.llm.text import crc32_of, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from four fifths of the labels."""
    labels = read(spark, sf_dir, "labels")
    learned = labels.where(crc32_of(F.col("doc_id")) % 5 != 0)
    model = toxicity.fit(read(spark, sf_dir, "documents"), learned)
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay where they come first."""
    return line_dedup.dedup_lines(docs, min_docs=10, policy="keep_first")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity of 0.8 or more)."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4,096 tokens."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack(docs, tokenizer, keep_encoder=False)
    return packed.drop("text_hash")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The toxicity model, the similarity join and the tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written as Parquet and read again.

    What a stage leaves in the scratch folder is deleted once its result is written, and a result once
    the next one is.
    """
    docs = read(spark, sf_dir, "documents")
    before: str | None = None
    for name, stage in STAGES[:-1]:
        path = session.scratch_path(spark, f"pipeline-{name}")
        with session.Scratch(spark) as scratch:
            stage(spark, docs, sf_dir).write.parquet(path)
        scratch.delete()
        if before:
            session.drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
