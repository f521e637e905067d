"""Preference formatting: a shared prompt, rendered once, and two masked completions.

The prompt of a pair is the longest common prefix of turns of its chosen and rejected conversation. It is
found by comparing fingerprints turn by turn, which partial aggregation makes; no conversation is
gathered into one row. The result has one row per rendered turn with its place in the prompt or
completion, so a conversation of any length spreads over tasks. All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.ranks import ranked
from vecloom.llm.text import own_columns, whole

#: Turns that share one running sum; the sums of blocks are added up apart.
BLOCK_TURNS = 256

#: Bytes that a row of numbers takes in a broadcast table, at most.
ROW_BYTES = 128
LAST = (1 << 63) - 1

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE))


def _turns(df: DataFrame, side: str) -> DataFrame:
    return own_columns(
        df,
        pair_id=F.col("pair_id"),
        turn=F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)),
        role=F.coalesce(F.col("role").cast("string"), F.lit("unknown")),
        text=whole(F.col("text")),
        side=F.lit(side),
    )


def _divergence(turns: DataFrame) -> DataFrame:
    """The first turn of each pair at which its sides differ; null if they never do."""
    line = F.concat_ws("\n", "role", "text")
    prints = []
    for side in ("chosen", "rejected"):
        here = F.col("side") == side
        prints += [
            F.count(F.when(here, 1)).alias(f"n_{side}"),
            F.bit_xor(F.when(here, F.xxhash64("role", "text"))).alias(f"x_{side}"),
            F.sum(F.when(here, F.crc32(line.cast("binary")))).alias(f"c_{side}"),
        ]
    differs = F.lit(False)
    each = turns.groupBy("pair_id", "turn").agg(*prints)
    for kind in ("n", "x", "c"):
        differs |= ~F.col(f"{kind}_chosen").eqNullSafe(F.col(f"{kind}_rejected"))
    return each.groupBy(F.col("pair_id").alias("_pair")).agg(
        F.min(F.when(differs, F.col("turn"))).alias("_diverges")
    )


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per rendered turn: `pair_id, part, turn, role, rendered, char_start, train_start, train_chars`.

    Both inputs have `pair_id, turn, role, text`. `part` is `prompt` (common turns, once), `chosen` or
    `rejected`; `char_start` is the place of the turn in its part. Only text and end mark of the
    assistant turns of a completion are trained on: `train_start` is their place in the part and
    `train_chars` their length, 0 for all that is masked.

    Turns go by number; equal numbers are one step, within it by role and text, repeated rows included,
    and the steps are equal if they hold the same rows. A null number comes last, a null role is
    `unknown`, a null text empty, a null pair id one pair of its own. A pair with one side only has no
    prompt; equal sides are all prompt. Extra columns are ignored; empty inputs give no rows.
    """
    turns, _ = session.cut(
        _turns(chosen, "chosen").unionByName(_turns(rejected, "rejected")), "turns"
    )
    diverges, _ = session.cut(_divergence(turns), "divergence")
    joined = turns.join(
        session.small(diverges, ROW_BYTES * diverges.count()),
        F.col("pair_id").eqNullSafe(F.col("_pair")),
    )
    common = F.col("_diverges").isNull() | (F.col("turn") < F.col("_diverges"))
    rows = (
        joined.where(~common | (F.col("side") == "chosen"))
        .withColumn("part", F.when(common, "prompt").otherwise(F.col("side")))
        .withColumn("rendered", F.concat(header(F.col("role")), "text", F.lit(END)))
        .withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
        .withColumn("chars", F.char_length("rendered").cast("bigint"))
    )
    place = ["pair_id", "part"]
    inside = (
        Window.partitionBy(*place, "block")
        .orderBy("turn", "role", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*place).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*place, "block")
        .agg(F.sum("chars").alias("_chars"))
        .select(
            F.col("pair_id").alias("_p"),
            F.col("part").alias("_part"),
            F.col("block").alias("_block"),
            F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_start"),
        )
    )
    starts, _ = session.cut(starts, "part-starts")
    starts = session.small(starts, ROW_BYTES * starts.count())
    same = (
        F.col("pair_id").eqNullSafe(F.col("_p"))
        & (F.col("part") == F.col("_part"))
        & (F.col("block") == F.col("_block"))
    )
    local = F.coalesce(F.sum("chars").over(inside), F.lit(0))
    placed = (
        rows.withColumn("_local", local)
        .join(starts, same)
        .withColumn("char_start", F.col("_start") + F.col("_local"))
    )
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    head = F.char_length(header(F.col("role")))
    return placed.select(
        "pair_id",
        "part",
        F.when(F.col("turn") != LAST, F.col("turn")).alias("turn"),
        "role",
        "rendered",
        "char_start",
        (F.col("char_start") + head).cast("bigint").alias("train_start"),
        F.when(trained, F.col("chars") - head).otherwise(F.lit(0)).cast("bigint").alias("train_chars"),
    )


def _partners(df: DataFrame) -> DataFrame:
    return df.select(
        "pair_id", F.col("reply.turn").alias("_turn"), F.col("other.text").alias("_other")
    )


def _lone_partners(sized: DataFrame) -> DataFrame:
    """Partners of the conversations whose block has no other: a ring of them, by gapless rank.

    One conversation of a larger block is in the ring too, so that even a single one finds a reply.
    """
    lone = sized.where(F.col("size") == 1).select("pair_id", "reply", F.lit(True).alias("alone"))
    least = F.min(F.struct("pair_id", "reply")).alias("least")
    another = (
        sized.where(F.col("size") > 1)
        .agg(least)
        .where(F.col("least").isNotNull())
        .select("least.pair_id", "least.reply", F.lit(False).alias("alone"))
    )
    ring, _ = session.cut(lone.unionByName(another), "lone-conversations")
    n = ring.count()
    if n < 2:
        # Nobody is alone, or there is nobody else.
        return _partners(ring.limit(0).withColumn("other", F.col("reply")))
    placed = ranked(ring.withColumn("_all", F.lit(0)), ["_all"], ["pair_id"], "rank", n)
    before = F.pmod(F.col("rank") - 1, F.lit(n))
    following = placed.select(before.alias("rank"), F.col("reply").alias("other"))
    return _partners(placed.where("alone").join(following, "rank"))


def contrast_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns for conversations that come without ratings.

    Chosen is each conversation up to its last assistant turn. Rejected has the reply of another
    conversation there: the next by id among those of the same `conv_id div 64`, the last taking the
    first. Conversations that are alone in their block, and one of the others, take the reply of the
    next by rank among themselves. So only a conversation without an assistant turn, or the only one
    with such a turn in the table, has no pair. Null ids and turn numbers are left out, since they name
    no conversation or place.
    """
    turns = own_columns(
        conversations.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()),
        pair_id=F.col("conv_id").cast("bigint"),
        turn=F.col("turn").cast("bigint"),
        role=F.col("role"),
        text=whole(F.col("text")),
    )
    reply = F.max(F.struct("turn", "text")).alias("reply")
    last = turns.where(F.col("role") == "assistant").groupBy("pair_id").agg(reply)
    block = Window.partitionBy(F.floor(F.col("pair_id") / 64)).orderBy("pair_id")
    everyone = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = last.withColumn("size", F.count(F.lit(1)).over(everyone))
    partners = _partners(
        sized.withColumn("first", F.first("reply").over(everyone))
        .withColumn("other", F.coalesce(F.lead("reply").over(block), F.col("first")))
        .where(F.col("size") > 1)
    ).unionByName(_lone_partners(sized))
    chosen = turns.join(partners, "pair_id").where(F.col("turn") <= F.col("_turn"))
    rejected = chosen.where(F.col("turn") < F.col("_turn")).unionByName(
        partners.select(
            "pair_id",
            F.col("_turn").alias("turn"),
            F.lit("assistant").alias("role"),
            F.col("_other").alias("text"),
            "_turn",
            "_other",
        )
    )
    columns = ["pair_id", "turn", "role", "text"]
    return chosen.select(*columns), rejected.select(*columns)


def op2_preference_format(spark, sf_dir: str) -> DataFrame:
    return preference_segments(
        *contrast_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    )


ORACLE = r"""
WITH last AS (
  SELECT conv_id AS p, max(turn) AS t, arg_max(coalesce(text, ''), turn) AS reply
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
partner AS (
  SELECT p, t, reply,
    coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other,
    count(*) OVER (PARTITION BY floor(p / 64)) AS n
  FROM last WINDOW w AS (PARTITION BY floor(p / 64) ORDER BY p)),
ring AS (
  SELECT p, t, reply, true AS alone FROM partner WHERE n = 1
  UNION ALL SELECT * FROM (SELECT p, t, reply, false FROM partner WHERE n > 1 ORDER BY p LIMIT 1)),
lone AS (
  SELECT p, t, alone, coalesce(lead(reply) OVER w, first_value(reply) OVER w) AS other,
    count(*) OVER () AS n
  FROM ring WINDOW w AS (ORDER BY p)),
pairs AS (
  SELECT p, t, other FROM partner WHERE n > 1
  UNION ALL SELECT p, t, other FROM lone WHERE alone AND n > 1),
chosen AS (
  SELECT p, turn, role, coalesce(text, '') AS text FROM conversations JOIN pairs ON conv_id = p
  WHERE turn <= t),
rejected AS (
  SELECT c.* FROM chosen c JOIN pairs USING (p) WHERE turn < t
  UNION ALL SELECT p, t, 'assistant', other FROM pairs),
div AS (
  SELECT p, min(turn) FILTER (WHERE NOT same) AS d FROM (
    SELECT coalesce(c.p, r.p) AS p, coalesce(c.turn, r.turn) AS turn,
      coalesce(c.role = r.role AND c.text = r.text, false) AS same
    FROM chosen c FULL JOIN rejected r ON c.p = r.p AND c.turn = r.turn)
  GROUP BY p),
parts AS (
  SELECT c.*, CASE WHEN d IS NULL OR turn < d THEN 'prompt' ELSE 'chosen' END AS part
  FROM chosen c JOIN div USING (p)
  UNION ALL SELECT r.*, 'rejected' FROM rejected r JOIN div USING (p) WHERE turn >= d),
drawn AS (SELECT *, '<|' || role || '|>' || chr(10) AS head FROM parts),
text AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM drawn),
placed AS (
  SELECT *, (sum(length(rendered)) OVER (PARTITION BY p, part ORDER BY turn)
             - length(rendered))::BIGINT AS char_start FROM text)
SELECT p AS pair_id, part, turn, role, rendered, char_start,
  (char_start + length(head))::BIGINT AS train_start,
  (CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(rendered) - length(head)
   ELSE 0 END)::BIGINT AS train_chars
FROM placed
"""
