"""N-gram language model as a weighted backoff automaton, trained and applied by blocks of documents.

Every word and the end of a text is a token. All training tokens are counted, and unigrams leave the
weight of one unknown word. Every n-gram found twice or more is an arc, its history a state. A state has
a failure arc to the history that is one token shorter, which carries the weight that its own arcs leave.

The automaton grows with the corpus and is never held in one place. Documents are packed into blocks. For
each order, a block sends each of its n-grams once to the bucket of its history; the bucket adds up the
counts of all blocks and sends back to each block the counts of its own n-grams and the sums over the
arcs of its own histories, so each block holds the states and arcs that its texts meet. Nothing is
broadcast. A history with more than the mean load of a bucket is spread over as many buckets as it needs.
An n-gram is only sent if both n-grams of the order below that it contains are arcs, without which it
cannot be one.

The state before a token is the longest history there that has arcs, so the weights along the path of a
text (failure arcs, then the arc of the token) are found for all tokens of a block at once, order by order.

Words are named by 64-bit hashes, n-grams by the numbers that their buckets give them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.text import own_columns, whole

#: N-grams of two tokens or more that the training texts hold so often become arcs, at any size of corpus.
LEAST = 2
ORDER = 3

#: Discount of every count of an arc.
DISCOUNT = 0.75

#: Bytes of text in one block; a longer document is a block of its own.
BLOCK_BYTES = 24 << 20

#: Tokens for which there is one bucket, and buckets at least.
BUCKET_TOKENS = 1 << 21
LEAST_BUCKETS = 64

#: Whether Spark deletes the shuffle files of a query at its end.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Tokens of a block whose probabilities are worked out together.
AT_ONCE = 1 << 18

#: The end of a text. A word holds no white space, so no word has this name.
END = b"\n"

BLOCKS = (
    "part int, block int, doc_ids array<bigint>, train array<boolean>, sizes array<int>, "
    "names binary, codes binary"
)
MESSAGES = "part int, block int, bucket int, body binary"
#: Rows without a part are totals over the words of a bucket.
REPLIES = (
    "part int, block int, level int, bucket int, body binary, "
    "words bigint, once bigint, twice bigint, tokens bigint"
)
SCORES = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double"
)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _bundle(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one string; bytes of equal weight lie together, since high ones are mostly zero."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    values = np.concatenate([sizes, *(a.astype(np.int64, copy=False) for a in arrays)])
    return _pack(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T))


def _unbundle(data: bytes, n: int) -> list[np.ndarray]:
    values = np.ascontiguousarray(_unpack(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.split(values[n:], np.cumsum(values[: n - 1]))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the place of each key among them, from one sort.

    `np.unique` without places hashes, and finding places by binary search misses the cache at each step;
    both take several times as long on millions of keys.
    """
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    distinct = keys[new]
    del keys
    nth = np.cumsum(new, dtype=np.int32)
    nth -= 1
    place = np.empty(len(order), np.int32)
    place[order] = nth
    return distinct, place


def _give_back() -> None:
    """Free memory that allocators keep; else a worker holds the peaks of its earlier blocks and tasks too."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def word_name(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _coded(pieces: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens of some texts, END first; the codes of all tokens; tokens of each text.

    Arrow's functions for ASCII take bytes one by one, so texts that are no valid UTF-8 are no error.
    """
    # The copy starts at 0: `ascii_lower` errs on an array that starts within its bytes, as a cast slice does.
    texts = pa.concat_arrays([pa.array([], pa.binary()), *(p.cast(pa.binary()) for p in pieces)])
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    found = words.flatten().dictionary_encode()
    different = found.dictionary.view(pa.binary()).to_pylist()
    # White space at either end of a text leaves empty strings, which are no words.
    is_word = np.array([w != b"" for w in different], bool)
    code, index = np.cumsum(is_word, dtype=np.int32), found.indices.to_numpy()
    kept = is_word[index]
    ends = np.cumsum(pc.list_value_length(words).to_numpy())
    sizes = np.diff(np.append(0, np.cumsum(kept))[ends], prepend=0) + 1
    codes = np.zeros(sizes.sum(), np.int32)
    at_word = np.ones(len(codes), bool)
    at_word[np.cumsum(sizes) - 1] = False
    codes[at_word] = code[index[kept]]
    tokens = [END, *filter(None, different)]
    return np.fromiter(map(word_name, tokens), np.uint64, len(tokens)), codes, sizes


def _blocks(docs: DataFrame, train: Column, block_bytes: int) -> DataFrame:
    """Documents as arrays of word codes; a block has its own code for each of its words.

    `names[code]` is the hash of the word; `sizes` are the tokens of each document, its end included.
    """
    documents = own_columns(
        docs,
        doc_id=F.col("doc_id").cast("bigint"),
        train=F.coalesce(train, F.lit(False)),
        text=whole(F.col("text")).cast("binary"),
    )
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    kinds += [pa.list_(pa.int32())] + [pa.binary()] * 2

    def pack(batches):
        part = TaskContext.get().partitionId()
        block = held = 0
        pieces = []

        def close():
            hashes, codes, sizes = _coded([p["text"] for p in pieces])
            ids, trained = ([v for p in pieces for v in p[c].to_pylist()] for c in ("doc_id", "train"))
            row = [part, block, ids, trained, sizes.tolist()]
            row += [_pack(hashes), _pack(codes)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names
            )

        for batch in batches:
            filled = np.cumsum(pc.binary_length(batch["text"]).to_numpy(), dtype=np.int64)
            first = before = 0
            while first < len(filled):
                last = first + 1 + np.searchsorted(filled[first:-1], before + block_bytes - held)
                pieces.append(batch.slice(first, last - first))
                held += filled[last - 1] - before
                first, before = last, filled[last - 1]
                if held >= block_bytes:
                    yield close()
                    block, held, pieces = block + 1, 0, []
        if pieces:
            yield close()
        batch = pieces = None
        _give_back()

    return documents.select("doc_id", "train", "text").mapInArrow(pack, BLOCKS)


@dataclass
class _Level:
    """The distinct n-grams of one order in a block, and what their buckets reply.

    Per token: `at`, the place of the n-gram that ends there, and `history`, the place of its history in
    the order below, both -1 where there is none or it is too rare to matter. Per n-gram: `own` training
    occurrences in the block; `totals` in all (0 for those that are no arcs) and `ids` once replied. Per
    history of the order below: `state`, whether it has arcs, and `taken`, the sum of the discounted counts
    of all its arcs, of other blocks too. `order` and `bucket` say which n-grams went to which bucket, in the order sent.
    """

    at: np.ndarray
    history: np.ndarray
    own: np.ndarray | None
    words: np.ndarray | None
    order: np.ndarray | None
    bucket: np.ndarray | None
    asked: np.ndarray | None
    asked_ids: np.ndarray | None
    asked_bucket: np.ndarray | None
    under: np.ndarray | None
    totals: np.ndarray | None = None
    ids: np.ndarray | None = None
    taken: np.ndarray | None = None
    state: np.ndarray | None = None


@dataclass(frozen=True)
class _Plan:
    buckets: int
    least: float = LEAST
    tokens: int = 0

    @property
    def load(self) -> int:
        """The mean load of a bucket; a history with more is spread."""
        return max(1, -(-self.tokens // self.buckets))


_NONE = np.zeros(0, np.int64)


def _scatter(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


class _Block:
    def __init__(self, row: dict, replies: list[dict], plan: _Plan):
        self.row = row
        self.plan = plan
        self.names = _unpack(row["names"], np.uint64)
        self.codes = _unpack(row["codes"], np.int32)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(np.array(row["train"], bool), self.sizes)
        self.levels: list[_Level] = []
        for level in range(1, 1 + max((r["level"] for r in replies), default=0)):
            own = sorted((r for r in replies if r["level"] == level), key=lambda r: r["bucket"])
            self._replied(self.open(), [r["body"] for r in own])
            _give_back()

    def open(self) -> _Level:
        level = self._grams() if self.levels else self._words()
        self.levels.append(level)
        return level

    def _words(self) -> _Level:
        bucket = (self.names % np.uint64(self.plan.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own = np.bincount(self.codes[self.training], minlength=len(self.names))
        words = self.names.view(np.int64)
        return _Level(
            self.codes, _NONE, own, words, order, bucket[order], _NONE, _NONE, _NONE, _NONE
        )

    def _grams(self) -> _Level:
        plan, lower, n_words = self.plan, self.levels[-1], len(self.names)
        history = np.full(len(self.codes), -1, np.int32)
        history[1:] = lower.at[:-1]
        history[self.starts] = -1
        often = np.append(lower.totals >= plan.least, False)
        history[~often[history]] = -1
        wanted = (history >= 0) & often[lower.at]
        grams, place = _distinct(history[wanted].astype(np.int64) * n_words + self.codes[wanted])
        at = np.full(len(self.codes), -1, np.int32)
        at[wanted] = place
        del place, wanted
        own = np.bincount(at[self.training & (at >= 0)], minlength=len(grams)).astype(np.int32)
        first, last = (grams // n_words).astype(np.int32), self.levels[0].ids[grams % n_words]
        del grams
        spread = np.minimum(plan.buckets, -(-lower.totals // plan.load))
        bucket = (lower.ids[first] + _scatter(last) % spread[first]) % plan.buckets
        bucket = bucket.astype(np.int32)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        # Histories ask for their sums, each in all buckets that it is spread over.
        used = np.zeros(len(lower.totals), bool)
        used[history[history >= 0]] = True
        used = np.flatnonzero(used).astype(np.int32)
        times = spread[used]
        asked = np.repeat(used, times)
        turn = np.arange(len(asked)) - np.repeat(np.cumsum(times) - times, times)
        del used, times, spread
        asked_bucket = ((lower.ids[asked] + turn) % plan.buckets).astype(np.int32)
        del turn
        by = np.argsort(asked_bucket, kind="stable")
        asked, asked_bucket = asked[by], asked_bucket[by]
        del by
        bucket = bucket[order]
        sent = bucket * np.int64(len(lower.totals)) + first[order]
        ask = asked_bucket * np.int64(len(lower.totals)) + asked
        # Both are in order, and every history that sends asks too.
        heads = np.flatnonzero(np.diff(sent, prepend=-1))
        under = np.zeros(len(ask), np.int64)
        under[np.searchsorted(ask, sent[heads])] = np.diff(heads, append=len(sent))
        asked_ids = lower.ids[asked]
        if lower is not self.levels[0]:
            lower.ids = None
        return _Level(
            at, history, own, last, order, bucket, asked, asked_ids, asked_bucket, under
        )

    def messages(self) -> pa.Table:
        """One row for each bucket: histories, how many n-grams each has, their last words and counts."""
        level = self.open()
        buckets = np.unique(np.concatenate([level.bucket, level.asked_bucket]))
        edges = [
            zip(np.searchsorted(b, buckets, "left"), np.searchsorted(b, buckets, "right"), strict=True)
            for b in (level.bucket, level.asked_bucket)
        ]
        words, own = level.words[level.order], level.own[level.order]
        bodies = [
            _bundle(level.asked_ids[c:d], level.under[c:d], words[a:b], own[a:b])
            for (a, b), (c, d) in zip(*edges, strict=True)
        ]
        n = len(buckets)
        columns = [np.full(n, self.row["part"], np.int32), np.full(n, self.row["block"], np.int32)]
        columns.append(buckets.astype(np.int32))
        arrays = [*map(pa.array, columns), pa.array(bodies, pa.binary())]
        return pa.Table.from_arrays(arrays, ["part", "block", "bucket", "body"])

    def _replied(self, level: _Level, bodies: list[bytes]) -> None:
        # What was only sent goes before the answers come in, bucket by bucket.
        level.words = level.bucket = level.asked_ids = level.asked_bucket = level.under = None
        n = len(level.own)
        level.own = None
        level.totals = np.zeros(n, np.int64)
        level.ids = np.full(n, -1, np.int64)
        asked = level.asked if len(self.levels) > 1 else _NONE
        n = len(self.levels[-2].totals) if len(self.levels) > 1 else 0
        level.taken, level.state = np.zeros(n), np.zeros(n, bool)
        a = c = 0
        for body in bodies:
            totals, ids, arc_sum, arcs = _unbundle(body, 4)
            here = level.order[a : a + len(totals)]
            level.totals[here] = totals
            level.ids[here[totals >= LEAST]] = ids
            # A bucket answers for a history once.
            histories = asked[c : c + len(arcs)]
            level.taken[histories] += arc_sum - DISCOUNT * arcs
            level.state[histories] |= arcs > 0
            a, c = a + len(totals), c + len(arcs)
        level.order = level.asked = None

    def probabilities(self, unigrams: np.ndarray) -> np.ndarray:
        """Probability of every token after the tokens before it; `unigrams` has that of each word."""
        out = unigrams[self.codes]
        for lower, level in zip(self.levels[:-1], self.levels[1:], strict=True):
            state, counts = np.append(level.state, False), np.append(level.totals, 0)
            for a in range(0, len(out), AT_ONCE):
                here = a + np.flatnonzero(state[level.history[a : a + AT_ONCE]])
                history = level.history[here]
                total = lower.totals[history]
                left = 1 - level.taken[history] / total
                count = counts[level.at[here]]
                out[here] = np.maximum(count - DISCOUNT, 0) / total + left * out[here]
        return out


def _reply(table: pa.Table, level: int, plan: _Plan) -> pa.Table:
    """Add up the n-grams of one bucket and answer every block: its counts, numbers of its arcs, and sums
    of the arcs of its histories. The histories of a bucket are whole, or spread as `_Block` does."""
    bucket = table["bucket"][0].as_py()
    bodies = [_unbundle(b, 4) for b in table["body"].to_pylist()]
    asked, under, words, own = map(np.concatenate, zip(*bodies, strict=True))
    histories, asked_at = np.unique(asked, return_inverse=True)
    keys = words
    if level > 1:
        top = int(words.max(initial=0)) + 1
        if len(histories) * top >= 1 << 62:
            words = np.unique(words, return_inverse=True)[1]
            top = len(words)
        first = np.repeat(asked_at, under)
        keys = first * top + words
    grams, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, own, len(grams)).astype(np.int64)
    stats = [(totals > 0).sum(), (totals == 1).sum(), (totals == 2).sum(), totals.sum()]
    if level > 1:
        totals[totals < plan.least] = 0
    # Frequent n-grams get small numbers, which pack well.
    ids = np.empty(len(grams), np.int64)
    ids[np.argsort(-totals, kind="stable")] = np.arange(len(grams)) * plan.buckets + bucket
    arc_sum = arcs = np.zeros(len(histories), np.int64)
    if level > 1:
        kept = np.flatnonzero(totals)
        arc_history = grams[kept] // top
        arc_sum = np.bincount(arc_history, totals[kept], len(histories)).astype(np.int64)
        arcs = np.bincount(arc_history, minlength=len(histories))
    answers = []
    a = c = 0
    for body in bodies:
        b, d = a + len(body[2]), c + len(body[0])
        count, number = totals[at[a:b]], ids[at[a:b]]
        history = asked_at[c:d]
        answers.append(
            _bundle(count, number[count >= LEAST], arc_sum[history], arcs[history])
        )
        a, c = b, d
    n = len(answers)
    columns = [
        pa.concat_arrays([table[c].combine_chunks(), pa.nulls(1, pa.int32())])
        for c in ("part", "block")
    ]
    columns += [pa.array(np.full(n + 1, x, np.int32)) for x in (level, bucket)]
    columns.append(pa.array([*answers, None], pa.binary()))
    columns += [pa.array([None] * n + [int(x)], pa.int64()) for x in stats]
    return pa.Table.from_arrays(columns, [f.split()[0] for f in REPLIES.split(", ")])


def _with_replies(blocks: DataFrame, replies: DataFrame, plan: _Plan, use, schema: str) -> DataFrame:
    """`use` of every block with all that its buckets have replied so far."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.select(["level", "bucket", "body"]).to_pylist()
        used = []
        for row in left.to_pylist():
            used.append(use(_Block(row, answers, plan)))
            _give_back()
        return pa.concat_tables(used)

    own = replies.where("part IS NOT NULL").select("part", "block", "level", "bucket", "body")
    return (
        blocks.groupBy("part", "block")
        .cogroup(own.groupBy("part", "block"))
        .applyInArrow(run, schema)
    )


def train_and_score(
    docs: DataFrame,
    train: Column,
    share: float = 0.0,
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Train on the rows of `docs` where `train` holds and score all: `SCORES`.

    `base_score` is the add-one unigram score. `score` is the automaton's log10 probability of the text
    and its end, over the same events: the words of the training texts, the end, and one unknown word.
    N-grams found twice or more are arcs; a caller may ask for those with a `share` of all training
    tokens only. A null text is empty: its end alone. Rows with equal or null ids are documents of their
    own. Without training texts every token is unknown. Extra columns are ignored; an empty table gives
    no rows.
    """
    if not 0 <= share < 1 or order not in (1, 2, 3):
        raise ValueError("share must be at least 0 and below 1, order 1, 2 or 3")
    session.ship(docs.sparkSession)
    blocks, _ = session.cut(_blocks(docs, train, block_bytes), "lm-blocks")
    held = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = blocks.agg(F.sum(held)).first()[0] or 0
    plan = _Plan(max(LEAST_BUCKETS, -(-n // BUCKET_TOKENS)))

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _Block(row, [], plan).messages().to_batches()
                _give_back()

    replies = None
    words = once = twice = tokens = 0
    for level in range(1, order + 1):
        if replies is None:
            messages = blocks.mapInArrow(send, MESSAGES)
        else:
            messages = _with_replies(blocks, replies, plan, _Block.messages, MESSAGES)
        answer = _answers(messages, level, plan)
        answer = _stored(answer, f"lm-replies-{level}")
        if replies is None:
            sums = [F.sum(c) for c in ("words", "once", "twice", "tokens")]
            words, once, twice, tokens = (x or 0 for x in answer.agg(*sums).first())
            plan = _Plan(plan.buckets, max(LEAST, share * tokens), tokens)
        replies = answer if replies is None else replies.unionByName(answer)
    # One discount for all unigrams (n1 / (n1 + 2 n2)); what it takes away is the unknown word's.
    discount = once / (once + 2 * twice) if 0 < once and 0 < twice else 0.5
    unknown = discount * words / tokens if tokens else 1.0

    def score(block: _Block) -> pa.Table:
        counts = block.levels[0].totals
        known = np.maximum(counts - discount, 0) / max(tokens, 1)
        base = np.log10((counts + 1) / (tokens + words + 1))
        base = np.add.reduceat(base[block.codes], block.starts)
        found = block.probabilities(np.where(counts > 0, known, unknown))
        columns = [
            pa.array(block.row["doc_ids"], pa.int64()),
            pa.array([not t for t in block.row["train"]]),
            pa.array(block.sizes),
            pa.array(np.add.reduceat((counts > 0)[block.codes], block.starts, dtype=np.int64)),
            pa.array(np.full(len(block.sizes), tokens, np.int64)),
            pa.array(base),
            pa.array(np.add.reduceat(np.log10(found, out=found), block.starts)),
        ]
        return pa.Table.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])

    return _with_replies(blocks, replies, plan, score, SCORES)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """`session.cut`, after which Spark deletes the shuffle files of `df`, which nothing reads again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        return session.cut(df, name)[0]
    finally:
        if before is None:
            conf.unset(CLEANUP_CONF)
        else:
            conf.set(CLEANUP_CONF, before)


def _answers(messages: DataFrame, level: int, plan: _Plan) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        answer = _reply(table, level, plan)
        _give_back()
        return answer

    return messages.groupBy("bucket").applyInArrow(run, REPLIES)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return train_and_score(docs, remainder != 2)
