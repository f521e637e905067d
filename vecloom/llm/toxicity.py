"""Toxicity from a learned lexicon, matched by Levenshtein automata and weighed by context.

The lexicon has words and stems that stand out in texts labelled toxic. It is stored as a trie. A token is
matched by running the Levenshtein automata of all entries over the trie at once: a state is a set of
(trie node, errors so far), states are made when first needed, and a token costs one step per character
until no entry is left within its number of errors. So misspelled terms are found as fast as exact ones.

A hit counts by its context window: inside quotation marks or near a reporting word it is taken as
quotation, near a word of address as abuse. A logistic regression weighs the counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import session
from vecloom.llm.text import crc32_of, own_columns, whole

#: Labelled rows of each class (toxic, clean) that the fit takes at most, by lowest hash of the id.
SAMPLE_ROWS = 8_000

#: Entries are kept if their log odds ratio is that many standard errors above zero.
LEAST_Z = 3.2

#: And if so much of their share lies in toxic texts: 0.98 is a share 49 times that in clean texts.
LEAST_WEIGHT = 0.98

#: Lengths of stems that the fit tries.
STEMS = (4, 8)

#: Tokens on each side of a hit that make its context.
CONTEXT = 8

#: Tokens that a worker remembers as no match.
MEMO_TOKENS = 300_000

_EDGE = ".,;:!?…()[]{}<>\"'`´“”„«»‹›*_~-–—/\\|#"
_OPENING = "\"“„«‹`"
_CLOSING = "\"”“»›`"

# Words that report speech, and words of address, in English, German, French and Spanish.
_REPORTING = frozenset(
    """said says say saying wrote writes called calls term word quote quoted quoting according
    reported alleged sagte sagt schrieb nannte genannt wort begriff zitat zitiert laut dit disait écrit
    appelé mot terme citation selon dijo dice escribió llamó palabra término cita según""".split()
)
_ADDRESS = frozenset(
    """you your you're youre ur u yourself du dich dir dein deine ihr euch tu toi te ton vous votre
    tú ti tus usted eres""".split()
)

FEATURES = ("bias", "plain", "misspelled", "quoted", "addressed", "density")

#: Coefficients before the data speak, and how strongly they hold.
PRIOR = np.array([-3.0, 3.0, 2.0, 0.3, 0.7, 0.5])
HOLD = 0.5


@dataclass(frozen=True)
class Entry:
    text: str
    is_stem: bool
    weight: float

    @property
    def errors(self) -> int:
        """Errors that a match may have; a short entry allows none."""
        n = len(self.text)
        if self.is_stem:
            return 1 if n >= 7 else 0
        return 0 if n < 5 else 1 if n < 9 else 2


class Matcher:
    """All Levenshtein automata of a lexicon, intersected with its trie and made deterministic lazily."""

    def __init__(self, entries: list[Entry], exceptions: frozenset[str] = frozenset()):
        self.exceptions = exceptions
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[Entry]] = [[]]
        for entry in entries:
            node = 0
            for c in entry.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(entry)
        # The most errors that any entry below a node allows.
        self.most = [-1] * len(self.children)
        for node in reversed(range(len(self.children))):
            own = [e.errors for e in self.ends[node]]
            below = [self.most[x] for x in self.children[node].values()]
            self.most[node] = max([-1, *own, *below])
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, Entry] | None] = []
        self.stems: list[tuple[int, Entry] | None] = []
        self.dead = self._state({})
        self.first = self._state(self._closed({0: 0}) if entries else {})

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that are reached by leaving out characters of entries."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            errors = nodes[node] + 1
            for child in self.children[node].values():
                if errors <= self.most[child] and errors < nodes.get(child, 99):
                    nodes[child] = errors
                    todo.append(child)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            hits = [
                (errors, entry)
                for node, errors in nodes.items()
                for entry in self.ends[node]
                if errors <= entry.errors
            ]
            best = lambda x: (x[0], x[1].is_stem, -x[1].weight, x[1].text)
            self.accepts.append(min(hits, key=best, default=None))
            self.stems.append(min((h for h in hits if h[1].is_stem), key=best, default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        new: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.most[node] and errors < new.get(node, 99):
                new[node] = errors

        for node, errors in self.sets[state].items():
            reach(node, errors + 1)
            for letter, child in self.children[node].items():
                reach(child, errors + (letter != c))
        to = self.moves[state][c] = self._state(self._closed(new))
        return to

    def match(self, token: str) -> tuple[int, Entry] | None:
        """Errors and entry of the best match of a lower-case token, or None."""
        state, stem = self.first, None
        for c in token:
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                break
            found = self.stems[state]
            if found and (stem is None or found[0] < stem[0]):
                stem = found
        found = self.accepts[state]
        if stem and (found is None or stem[0] < found[0]):
            found = stem
        if found and found[0] and token in self.exceptions:
            return None
        return found


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(token: str) -> str:
    return token.strip(_EDGE)


@dataclass(frozen=True)
class Model:
    entries: tuple[Entry, ...]
    exceptions: frozenset[str]
    coefficients: tuple[float, ...]


class Scorer:
    def __init__(self, model: Model):
        self.matcher = Matcher(list(model.entries), model.exceptions)
        self.coefficients = np.array(model.coefficients)
        self.hits: dict[str, tuple[int, Entry]] = {}
        self.misses: set[str] = set()

    def features(self, texts: list[str]) -> np.ndarray:
        """One row of FEATURES per text."""
        out = np.zeros((len(texts), len(FEATURES)))
        for row, text in zip(out, texts, strict=True):
            own = tokens(text)
            different = set(own)
            for token in different.difference(self.misses).difference(self.hits):
                found = self.matcher.match(bare(token))
                if found:
                    self.hits[token] = found
                elif len(self.misses) < MEMO_TOKENS:
                    self.misses.add(token)
            row[0] = 1
            if not different.isdisjoint(self.hits):
                row[1:] = self._counts(own)
        return out

    def _counts(self, own: list[str]) -> np.ndarray:
        plain = misspelled = quoted = addressed = 0.0
        spans = _quotations(own)
        for i, token in enumerate(own):
            found = self.hits.get(token)
            if found is None:
                continue
            errors, entry = found
            near = [bare(x) for x in own[max(0, i - CONTEXT) : i + CONTEXT + 1]]
            if spans[i] or not _REPORTING.isdisjoint(near):
                quoted += entry.weight
                continue
            if errors:
                misspelled += entry.weight
            else:
                plain += entry.weight
            addressed += not _ADDRESS.isdisjoint(near)
        abuse = plain + misspelled
        density = 10 * abuse / (10 + len(own))
        return np.log1p([plain, misspelled, quoted, addressed, density])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-features @ self.coefficients))


def _quotations(own: list[str]) -> list[bool]:
    """Whether each token stands in quotation marks that open and close at most 60 tokens apart."""
    inside = [False] * len(own)
    start = None
    for i, token in enumerate(own):
        if start is None and token[0] in _OPENING:
            start = i
        if start is not None and token.rstrip(".,;:!?")[-1:] in _CLOSING and (
            start < i or len(token) > 2
        ):
            if i - start <= 60:
                inside[start : i + 1] = [True] * (i + 1 - start)
            start = None
        elif start is not None and i - start > 60:
            start = None
    return inside


def _sketch(own: list[str]) -> int:
    """One hash that near copies mostly share: the least of all long words (or words, if none is long)."""
    words = {t for t in own if len(t) >= 8} or set(own)
    return min(xxhash.xxh3_64_intdigest(w) >> 1 for w in words)


def _strings(own: list[str]) -> set[str]:
    """Words, each with an end mark, and stems of a text."""
    found = set()
    for token in set(own):
        word = bare(token)
        found.add(word + "\n")
        found.update(word[:n] for n in range(STEMS[0], min(STEMS[1], len(word)) + 1))
    return found


def _count_strings(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """`string, sketch` pairs of the texts, of the wanted strings alone if given."""
    held = sample.sparkSession.sparkContext.broadcast(wanted)

    def pairs(batches):
        for batch in batches:
            for text in batch["text"].to_pylist():
                own = tokens(text)
                if not own:
                    continue
                strings = _strings(own)
                if held.value is not None:
                    strings &= held.value
                # A text without wanted strings gives an empty batch, whose type cannot be told from values.
                sketches = pa.array([_sketch(own)] * len(strings), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(strings, pa.string()), sketches], ["string", "sketch"]
                )

    return sample.select("text").mapInArrow(pairs, "string string, sketch bigint")


def _choose(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[Entry]:
    """Entries from counts of (string, toxic texts, clean texts).

    Among strings that extend each other, the longest one that still covers 90 % of what the shorter
    covers is taken, so a word that is always the same becomes a word and a variable one a stem.
    """
    count = {s: (a, b) for s, a, b in rows}

    def z(s: str) -> float:
        a, b = count[s]
        odds = np.log((a + 0.5) / (toxic - a + 0.5)) - np.log((b + 0.5) / (clean - b + 0.5))
        return float(odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))

    def weight(s: str) -> float:
        a, b = (n / max(all_, 1) for n, all_ in zip(count[s], (toxic, clean), strict=True))
        return round(a / (a + b), 4)

    def stands_out(s: str) -> bool:
        return z(s) >= LEAST_Z and weight(s) >= LEAST_WEIGHT

    longer: dict[str, list[str]] = defaultdict(list)
    roots = []
    for s in count:
        parent = s[:-1]
        while parent and parent not in count:
            parent = parent[:-1]
        (longer[parent] if parent else roots).append(s)
    chosen: list[str] = []
    todo = roots
    while todo:
        s = todo.pop()
        below = longer[s]
        if not stands_out(s):
            todo += below
            continue
        while more := [x for x in longer[s] if count[x][0] >= 0.9 * count[s][0] and stands_out(x)]:
            s = max(more, key=lambda x: (count[x][0], x))
        chosen.append(s)
    chosen = sorted(chosen, key=lambda s: (-z(s), s))
    words = [s for s in chosen if s.rstrip("\n")]
    return [Entry(s.rstrip("\n"), not s.endswith("\n"), weight(s)) for s in words]


def _regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression held near PRIOR, by Newton's method.

    Both classes weigh the same in total, and equal rows are one row with a weight.
    """
    w = PRIOR.copy()
    if not len(x):
        return w
    rows, which = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
    weight = np.bincount(which.reshape(-1)).astype(float)
    x, y = rows[:, :-1], rows[:, -1]
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (y - p)) - HOLD * (w - PRIOR)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + HOLD * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    # More hits never make a text less toxic.
    return np.concatenate([w[:1], np.maximum(w[1:], 0)])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows of `labels` (`doc_id, toxic`) and their texts.

    At most `sample_rows` rows of each class are used, those with the lowest hash of their id. Labels
    that are null or have no document are left out, as are empty texts. Near copies count once. Without
    toxic labels the lexicon is empty and every text gets the same low score.
    """
    spark = session.ship(docs.sparkSession)
    named = own_columns(
        labels, doc_id=F.col("doc_id").cast("bigint"), toxic=F.col("toxic").cast("int")
    ).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    picked = None
    for value in (0, 1):
        own = named.where(F.col("toxic") == value).dropDuplicates(["doc_id"])
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = own if picked is None else picked.unionByName(own)
    texts = own_columns(docs, doc_id=F.col("doc_id").cast("bigint"), text=whole(F.col("text")))
    # At most 2 * sample_rows ids.
    sample = texts.join(F.broadcast(picked), "doc_id").select("toxic", "text").distinct()
    parts = spark.sparkContext.defaultParallelism
    sample, path = session.cut(sample.repartition(parts, "text"), "toxic-sample")

    def distinct_texts(df: DataFrame) -> DataFrame:
        return df.groupBy("string").agg(F.count_distinct("sketch").alias("n"))

    def total(df: DataFrame) -> int:
        # The least string of a text names its sketch once.
        one = _count_strings(df, None).select("sketch").distinct()
        return one.count()

    toxic_rows, clean_rows = sample.where("toxic = 1"), sample.where("toxic = 0")
    toxic, clean = total(toxic_rows), total(clean_rows)
    least = max(3, round(toxic / 400))
    seen = distinct_texts(_count_strings(toxic_rows, None)).where(F.col("n") >= least).toArrow()
    in_toxic = dict(zip(seen["string"].to_pylist(), seen["n"].to_pylist(), strict=True))
    wanted = _count_strings(clean_rows, frozenset(in_toxic))
    seen = distinct_texts(wanted).toArrow()
    in_clean = dict(zip(seen["string"].to_pylist(), seen["n"].to_pylist(), strict=True))
    entries = _choose([(s, n, in_clean.get(s, 0)) for s, n in in_toxic.items()], toxic, clean)

    # Words of clean texts that a misspelling might be taken for.
    matcher_entries = list(entries)
    held = spark.sparkContext.broadcast(matcher_entries)

    def alike(batches):
        scorer = Matcher(held.value)
        words = {bare(t) for batch in batches for x in batch["text"].to_pylist() for t in tokens(x)}
        found = [w for w in words if (hit := scorer.match(w)) and hit[0]]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["word"])

    near = clean_rows.select("text").mapInArrow(alike, "word string").distinct().toArrow()
    exceptions = frozenset(near["word"].to_pylist())
    start = Model(tuple(entries), exceptions, tuple(PRIOR))
    rows = _features(sample, start, ["toxic"]).toArrow()
    x = np.column_stack([rows[f].to_numpy() for f in FEATURES]) if len(rows) else np.zeros((0, 6))
    y = rows["toxic"].to_numpy() if len(rows) else np.zeros(0)
    session.drop(spark, path)
    return Model(tuple(entries), exceptions, tuple(float(c) for c in _regress(x, y)))


def _features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in `keep`, the features and the score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{f} double" for f in FEATURES])

    def measure(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            x = scorer.features(batch["text"].to_pylist())
            columns = [batch[c] for c in keep] + [pa.array(v) for v in x.T]
            columns.append(pa.array(scorer.scores(x)))
            yield pa.RecordBatch.from_arrays(columns, [*keep, *FEATURES, "score"])

    return docs.select(*keep, "text").mapInArrow(measure, schema + ", score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, text_hash, score, predicted` and the features of every row of `docs`.

    A null text is empty, and an empty text has no hits. Equal or null ids stay rows of their own. Extra
    columns are ignored; an empty table gives no rows.
    """
    session.ship(docs.sparkSession)
    text = whole(F.col("text"))
    rows = own_columns(
        docs, doc_id=F.col("doc_id").cast("bigint"), text_hash=F.xxhash64(text), text=text
    )
    scored = _features(rows, model, ["doc_id", "text_hash"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below `threshold`."""
    spark = session.ship(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def clean(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            texts = ["" if x is None else str(x) for x in batch["text"].to_pylist()]
            low = scorer.scores(scorer.features(texts)) < threshold
            yield batch.filter(pa.array(low))

    return docs.mapInArrow(clean, docs.schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc32_of(F.col("doc_id")) % 5 == 0
    model = fit(docs, labels.where(~held_out))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(True)).alias("held_out"),
        "score",
        "predicted",
        *FEATURES[1:],
    )
