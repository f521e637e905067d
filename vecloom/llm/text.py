"""Column expressions and row helpers for document texts, shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z in lower case and every other character as it is.

    `lower` does the same on plain ASCII and is much faster than `translate`.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """Array of the words of `text`."""
    parts = F.split(F.translate(whole(text), SPACE[1:], " " * (len(SPACE) - 1)), " +")
    return F.array_remove(parts, "")


def crc32_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def own_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the named columns, whatever else `df` has: extra columns can't clash with internal ones."""
    return df.select(*(c.alias(name) for name, c in columns.items()))


def boxed(df: DataFrame) -> DataFrame:
    """All columns of `df` as one struct `row`, so that their names can't clash with internal ones."""
    return df.select(F.struct("*").alias("row"))


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The named fields of `row` as columns again, some of them replaced."""
    return df.select(
        *(replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns)
    )


def row_keys(df: DataFrame) -> DataFrame:
    """Adds `_row` and `_hash` to boxed documents: hashes of id and text together, and of the text."""
    text_hash = F.xxhash64(whole(F.col("row.text")))
    keyed = df.withColumn("_hash", text_hash)
    return keyed.withColumn("_row", F.xxhash64(F.col("row.doc_id").cast("bigint"), "_hash"))
