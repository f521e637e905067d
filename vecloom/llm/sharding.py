"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group that stays together, unless it would fill much of a shard; then it is cut into
even pieces. Groups are counted by class of like size vectors, and only the classes go to the driver.
There, from the largest class down, each group goes to the shard where the dot product of its vector
with the residual capacity is highest. A class with more groups than shards first gives every shard the
same number. Groups then take the places of their class by rank.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.ranks import ranked
from vecloom.llm.text import own_columns, whole

ROW_BYTES = 16

#: A group larger than this part of a shard is cut into pieces of at most this size.
SPLIT_SHARE = 1 / 8

#: Classes that the driver places at most; the size steps are doubled until that holds.
MAX_CLASSES = 30_000

#: Steps of a class per doubling of (bytes, tokens, rows) to begin with.
STEPS = (1024, 256, 256)

#: Weights of (bytes, tokens, rows) in the dot product: bytes come first, for the law that is promised.
WEIGHTS = (16, 1, 1)

_GROUP = ["text_hash", "text_crc32", "size"]


def _items(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    text = whole(F.col("text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return own_columns(
        docs,
        doc_id=F.col("doc_id").cast("bigint"),
        size=(F.octet_length(text) + ROW_BYTES).cast("bigint"),
        text_crc32=F.crc32(text.cast("binary")),
        text_hash=F.xxhash64(text),
        tokens=(words + 1).cast("bigint"),
        **{f"carried_{c}": F.col(c) for c in carry},
    )


def _class(steps: tuple[int, int, int]) -> Column:
    step = lambda c, n: F.floor(F.log2(F.col(c).cast("double")) * n)
    names = ("bytes", "tokens", "rows")
    return F.concat_ws(":", *(step(c, n).cast("string") for c, n in zip(names, steps, strict=True)))


def allocate(vectors: np.ndarray, counts: np.ndarray, n_shards: int) -> list[list[int]]:
    """For each class (mean vector, number of groups), the shards of the groups beyond the even share.

    Every shard first gets `count // n_shards` groups of a class. The classes go from large to small by
    their largest share of a shard, so the small ones even out what the large ones left.
    """
    total = (vectors * counts[:, None]).sum(axis=0)
    share = vectors * n_shards / np.where(total > 0, total, 1)
    pull = share * WEIGHTS
    residual = np.ones((n_shards, vectors.shape[1]))
    extra: list[list[int]] = [[] for _ in counts]
    for i in np.lexsort((np.arange(len(counts)), -share.max(axis=1))):
        even, rest = divmod(int(counts[i]), n_shards)
        residual -= even * share[i]
        for _ in range(rest):
            best = int(np.argmax(residual @ pull[i]))
            residual[best] -= share[i]
            extra[i].append(best)
    return extra


def assign_shards(docs: DataFrame, n_shards: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """`doc_id, size, text_crc32, text_hash, shard, slot` of every row, plus the columns in `carry`.

    `size` is the UTF-8 bytes of the text and 16 more. `slot` numbers the rows of a shard from 0. A null
    text is an empty one. Rows with equal or null ids are placed as any others; texts are taken as equal
    if size, CRC-32 and 64-bit hash agree. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items, _ = session.cut(_items(docs, carry), "shard-items")
    totals = items.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    ).first()
    limit = max(1.0, SPLIT_SHARE * totals["bytes"] / n_shards)

    # Fewer than n_shards / SPLIT_SHARE groups can be above the limit.
    groups = items.groupBy(*_GROUP, "tokens").agg(F.count(F.lit(1)).alias("rows"))
    large = groups.where((F.col("rows") > 1) & (F.col("rows") * F.col("size") > limit)).select(
        *_GROUP,
        F.least("rows", F.ceil(F.col("rows") * F.col("size") / limit)).cast("int").alias("pieces"),
    )
    large, _ = session.cut(large, "large-groups")
    held = F.broadcast(large)
    rank_rows = items.join(held, _GROUP)
    cut_rows = ranked(rank_rows, _GROUP, ["doc_id"], "nth", totals["rows"]).withColumn(
        "piece", (F.col("nth") % F.col("pieces")).cast("int")
    )
    whole_rows = items.join(held, _GROUP, "left_anti").withColumn("piece", F.lit(0))
    rows, _ = session.cut(
        whole_rows.unionByName(cut_rows.select(*whole_rows.columns)), "shard-rows"
    )

    unit_key = [*_GROUP, "piece"]
    units = rows.groupBy(*unit_key).agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    units, _ = session.cut(units, "shard-units")
    n_units = units.count()
    steps = STEPS
    while True:
        classes = units.groupBy(_class(steps).alias("class")).agg(
            F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("bytes", "tokens", "rows"))
        )
        if classes.count() <= MAX_CLASSES:
            break
        steps = tuple(max(0.01, n / 2) for n in steps)
    found = sorted(classes.collect())  # at most MAX_CLASSES rows
    counts = np.array([r["n"] for r in found], np.int64)
    sums = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in found], float).reshape(-1, 3)
    extra = allocate(sums / np.maximum(counts, 1)[:, None], counts, n_shards)
    plan = spark.createDataFrame(
        [(r["class"], int(n) // n_shards, x) for r, n, x in zip(found, counts, extra, strict=True)],
        "class string, even bigint, extra array<int>",
    )
    # Of each class, ranks go round all shards `even` times; the rest take the extra places.
    in_class = ranked(units.withColumn("class", _class(steps)), ["class"], unit_key, "r", n_units)
    dealt = F.col("even") * n_shards
    placed_units = in_class.join(F.broadcast(plan), "class").select(
        *unit_key,
        F.when(F.col("r") < dealt, F.col("r") % n_shards)
        .otherwise(F.get("extra", (F.col("r") - dealt).cast("int")))
        .cast("int")
        .alias("shard"),
    )
    placed, _ = session.cut(rows.join(placed_units, unit_key), "shard-places")
    out = ranked(placed, ["shard"], ["doc_id", *_GROUP], "slot", totals["rows"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        "text_hash",
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        *(F.col(f"carried_{c}").alias(c) for c in carry),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, file_rows: int = 500_000) -> None:
    """Write `docs` as folders `shard=n`, rows in slot order; large shards span several files."""
    placed = assign_shards(docs, n_shards, ("text",))
    files = max(1, -(-placed.count() // file_rows))
    (
        placed.repartitionByRange(max(n_shards, files), "shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
