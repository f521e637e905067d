"""Line deduplication by streaming range-partitioned line hashes; keep bitmaps instead of text.

Lines are reduced to (hash, document, position). The hashes are range-partitioned and sorted by hash,
document and position, so that one pass over each partition sees a line's first occurrence before its
repeats and can count its documents. Lines so frequent that they would fill a partition are counted
beforehand by partial aggregation and leave the stream: there are at most a few per partition.

All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.text import SPACE, ascii_lower, boxed, own_columns, unboxed, whole

POLICIES = ("drop_all", "keep_first")

#: Rows of line hashes in one partition of the stream.
PARTITION_ROWS = 400_000


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _documents(docs: DataFrame) -> DataFrame:
    text = whole(F.col("text"))
    return own_columns(docs, doc_id=F.col("doc_id"), text=text, text_hash=F.xxhash64(text))


def _line_rows(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per eligible line; two hashes of 96 bits together stand for the line."""
    exploded = documents.select(
        "doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    ).select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    return exploded.where(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "doc_id", "text_hash", "pos"
    )


def keep_bitmaps(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, policy: str = "drop_all"
) -> DataFrame:
    """`doc_id, text_hash, n_dropped, kept_bits` of the documents that lose lines.

    A line counts if its key has `min_chars` code points or more; it is frequent if `min_docs`
    documents or more have it. `drop_all` drops frequent lines everywhere, `keep_first` keeps the first
    occurrence by document id, text and position. `kept_bits` maps a block of 64 lines to the bits of
    the lines that stay (bit i: line 64 * block + i); blocks that lose nothing are not stored.

    A document is an id and a text: rows that agree in both, a null id included, are one document and share
    a bitmap; one id with several texts is several documents. Null text is one empty line. An empty table
    gives no rows. Extra columns are ignored.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, got {policy!r}")
    spark = docs.sparkSession
    rows, _ = session.cut(_line_rows(_documents(docs), min_chars), "line-hashes")
    total = rows.count()
    partitions = max(1, -(-total // PARTITION_ROWS))

    # At most 64 keys per partition can have that many rows, so the table below is bounded by the
    # number of partitions; the size check decides whether it may be broadcast.
    hot_rows = max(min_docs, PARTITION_ROWS // 64)
    hot = (
        rows.groupBy("h", "g")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= hot_rows)
        .select("h", "g")
    )
    hot, _ = session.cut(hot, "hot-lines")
    hot_keys = session.small(hot, 32 * hot.count())
    occurrence = F.struct("doc_id", "text_hash", "pos")
    hot_seen = (
        rows.join(hot_keys, ["h", "g"])
        .groupBy("h", "g", "doc_id", "text_hash")
        .agg(F.collect_list("pos").alias("positions"))
        .withColumn("pos", F.array_min("positions"))
    )
    per_key = hot_seen.groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min(occurrence).alias("first")
    )
    hot_lines = (
        hot_seen.drop("pos")
        .join(session.small(per_key, 64 * hot.count()), ["h", "g"])
        .where(F.col("n_docs") >= min_docs)
        .select("doc_id", "text_hash", "first", F.explode("positions").alias("pos"))
        .withColumn("is_first", occurrence.eqNullSafe(F.col("first")))
        .drop("first")
    )

    cold = (
        rows.join(hot_keys, ["h", "g"], "left_anti")
        .repartitionByRange(partitions, "h")
        .sortWithinPartitions("h", "g", "doc_id", "text_hash", "pos")
    )
    stream = Window.partitionBy("h", "g").orderBy("doc_id", "text_hash", "pos")
    document = F.struct("doc_id", "text_hash")
    counted = (
        cold.withColumn("nth", F.row_number().over(stream))
        .withColumn("new", ~document.eqNullSafe(F.lag(document).over(stream)))
        .withColumn("n_docs", F.sum(F.col("new").cast("int")).over(Window.partitionBy("h", "g")))
    )
    cold_lines = counted.where(F.col("n_docs") >= min_docs).select(
        "doc_id", "text_hash", "pos", (F.col("nth") == 1).alias("is_first")
    )

    dropped = hot_lines.unionByName(cold_lines)
    if policy == "keep_first":
        dropped = dropped.where(~F.col("is_first"))
    bit = F.expr("shiftleft(1L, pos % 64)")
    blocks = (
        dropped.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / 64).alias("block"))
        .agg(F.bit_or(bit).alias("lost"))
    )
    return blocks.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("lost")).cast("bigint").alias("n_dropped"),
        F.map_from_entries(
            F.collect_list(F.struct(F.col("block"), F.bitwise_not("lost").alias("bits")))
        ).alias("kept_bits"),
    )


def _kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`row` (all columns of a document), `kept` (its text without lost lines), `n_lines`, `n_dropped`."""
    text = whole(F.col("row.text"))
    joined = boxed(docs).join(
        bitmaps,
        F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash")),
        "left",
    )
    bits = lambda i: F.coalesce(F.col("kept_bits")[F.floor(i / 64)], F.lit(-1))
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: F.getbit(bits(i), i % 64) == 1)
    newlines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return joined.select(
        "row",
        F.when(F.col("kept_bits").isNull(), F.col("row.text"))
        .otherwise(F.array_join(kept, "\n"))
        .alias("kept"),
        (newlines + 1).cast("bigint").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`docs` with its text cut to the kept lines, plus `n_lines` and `n_dropped`.

    The bitmaps go back to their documents by id and text hash. A null text stays null. Columns of
    `docs` that are named like the two new ones are replaced.
    """
    new = ("n_lines", "n_dropped")
    cut = _kept_text(docs, bitmaps)
    columns = [c for c in docs.columns if c not in new]
    fields = [F.col("kept") if c == "text" else F.col("row").getField(c) for c in columns]
    return cut.select(*(f.alias(c) for f, c in zip(fields, columns, strict=True)), *new)


def dedup_lines(docs: DataFrame, min_docs: int = 10, policy: str = "keep_first") -> DataFrame:
    """`docs` with its columns and frequent lines cut; `n_chars`, if there, counts the new text.

    A document that had words and keeps none is left out: all it said is in the lines kept elsewhere.
    """
    cut = _kept_text(docs, keep_bitmaps(docs, min_docs, policy=policy))
    word = r"[^\x20\x09-\x0D]"
    nothing_left = (F.col("n_dropped") > 0) & ~F.col("kept").rlike(word)
    kept = cut.where(~F.coalesce(nothing_left, F.lit(False)))
    replaced = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        chars = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars"))
        replaced["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return unboxed(kept, docs.columns, **replaced)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = apply_bitmaps(docs, keep_bitmaps(docs))
    return cut.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(whole(F.col("text")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH split AS (
  SELECT id, doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents)),
keyed AS (
  SELECT id, doc_id, text, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key
  HAVING count(DISTINCT md5(coalesce(doc_id::VARCHAR, '-') || ':' || text)) >= 10),
marked AS (
  SELECT id, doc_id, pos, line, key IN (SELECT key FROM frequent) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
         AS kept_sha256
FROM marked GROUP BY id, doc_id
"""
