"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document. The ledger keeps its measurements and one bit per failed
rule, so that a policy, which is a set of rules, is a bitwise test on the stored mask: texts are not
read again for another policy or for an ablation. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.text import own_columns, whole

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"



#: Rules of each version of the policy.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "word_length"),
}


def _rules() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 100 * F.col("n_symbols") > 10 * n,
        "repeated_lines": 2 * F.col("n_dup_lines") > F.col("n_text_lines"),
        "capitals": (F.col("n_capitals") > 20) & (2 * F.col("n_capitals") > F.col("word_chars")),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 30 * n),
    }


def rule_names() -> tuple[str, ...]:
    return tuple(_rules())


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows found twice or more, given the hash of each window.

    Sorting (hash, position) puts equal windows side by side; the positions of those are then sorted
    again and each adds the words that the window before it has not covered.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.array(pairs),
        F.lit(0),
        lambda total, sorted_pairs: total + _covered(_repeated_positions(sorted_pairs)),
    )


def _repeated_positions(pairs: Column) -> Column:
    def repeated(pair, i):
        before = F.when(i > 0, F.get(pairs, i - 1)["h"] == pair["h"])
        after = F.get(pairs, i + 1)["h"] == pair["h"]
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.array_sort(F.transform(F.filter(pairs, repeated), lambda pair: pair["i"]))


def _covered(positions: Column) -> Column:
    return F.aggregate(
        positions,
        F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last")),
        lambda done, p: F.struct(
            (done["words"] + F.least(F.lit(WINDOW), p - done["last"])).alias("words"),
            p.alias("last"),
        ),
        lambda done: done["words"],
    )


def measure(docs: DataFrame) -> DataFrame:
    """`doc_id` and the measurements, all counts, of every row of `docs`.

    Words are runs without white space, windows five words. A null text has no words and no lines with
    a word. Rows with equal or null ids are measured one by one; extra columns are ignored.
    """
    text = whole(F.col("text"))
    base = own_columns(docs, doc_id=F.col("doc_id"), text=text).select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = base.select(
        "doc_id",
        n.alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("n_capitals"),
        F.size("lines").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("windows"),
    )
    repeats = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(
        _repeat_words(F.col("windows"))
    )
    counts = [c for c in counted.columns if c not in ("doc_id", "windows")]
    return counted.select(
        "doc_id",
        *(F.col(c).cast("bigint").alias(c) for c in counts),
        repeats.cast("bigint").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements of `docs` plus `failed`, a bit mask with one bit per rule in rule order."""
    bits = [
        F.when(rule, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(_rules().values())
    ]
    return measure(docs).withColumn("failed", sum(bits[1:], bits[0]).cast("bigint"))


def policy_mask(version: str) -> int:
    if version not in POLICIES:
        raise ValueError(f"policy must be one of {tuple(POLICIES)}, got {version!r}")
    names = rule_names()
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def fails(version: str, failed: Column | None = None) -> Column:
    """Whether a document of the ledger fails that version of the policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(policy_mask(version)) != 0


def ablate(entries: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that stay without it.

    The ledger is first counted by mask, so only one row per mask that occurs is left to look at.
    """
    mask = policy_mask(version)
    masks = entries.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = rule_names()
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).alias("bit"))
                for r in POLICIES[version]
            )
        )
    ).alias("r")
    one = masks.select("failed", "n", rows).select("failed", "n", "r.rule", "r.bit")
    failed = F.col("failed")
    count = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("bigint")
    return one.groupBy("rule").agg(
        count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(failed == F.col("bit")).alias("n_failed_alone"),
        count((failed == 0) | (failed == F.col("bit"))).alias("n_kept_without"),
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        fails("base").alias("base_failed"),
        (~fails("v2")).alias("kept"),
        "failed",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, w[i:i + 4] AS win FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n >= 2),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *,
    (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (100 * n_symbols > 10 * n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
    + 16 * (n_capitals > 20 AND 2 * n_capitals > word_chars)::INT
    + 32 * (word_chars < 2 * n_words OR word_chars > 30 * n_words)::INT AS failed
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept,
  failed::BIGINT AS failed
FROM f
"""
