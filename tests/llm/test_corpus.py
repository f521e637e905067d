"""Language model, sharding, decontamination, similarity join."""

from __future__ import annotations

import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_documents, similar_groups, table
from vecloom import session
from vecloom.llm import components, decontaminate, language_model, ngram_join, sharding
from vecloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


# Language model


def split_tokens(text):
    return [*(text or "").encode().lower().split(), language_model.END]


def test_lm_base_scores(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op3_lm_scoring"](spark, SF_DIR).collect()}
    docs = {d["doc_id"]: split_tokens(d["text"]) for d in table(spark, SF_DIR, "documents").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 7 == 2}
    counts = Counter(t for i, x in docs.items() if i not in held for t in x)
    n, v = counts.total(), len(counts)
    assert set(rows) == set(docs)
    for i, own in docs.items():
        r = rows[i]
        assert r["held_out"] == (i in held) and r["n_tokens"] == len(own)
        assert r["n_known"] == sum(counts[t] > 0 for t in own) and r["train_tokens"] == n
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    total = lambda c: sum(rows[i][c] for i in held)
    assert total("score") > total("base_score")


def reference_model(texts, share, order):
    """(token, history) -> probability, straight from the definition of the smoothed n-grams."""
    docs = [split_tokens(t) for t in texts]
    grams = Counter()
    for own in docs:
        for n in range(1, order + 1):
            grams.update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    unigrams = {g[0]: c for g, c in grams.items() if len(g) == 1}
    total = sum(unigrams.values())
    once, twice = (sum(c == k for c in unigrams.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    least = max(2.0, share * total)
    kept = {g: c for g, c in grams.items() if len(g) > 1 and c >= least}

    def p(token, history):
        if not history:
            c = unigrams.get(token, 0)
            return (c - d) / total if c else d * len(unigrams) / total
        arcs = {g[-1]: c for g, c in kept.items() if g[:-1] == history}
        if not arcs:
            return p(token, history[1:])
        n = grams[history]
        left = 1 - sum(c - language_model.DISCOUNT for c in arcs.values()) / n
        own = max(arcs.get(token, 0) - language_model.DISCOUNT, 0) / n
        return own + left * p(token, history[1:])

    return p, unigrams


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton_equals_definition(spark, order):
    random = np.random.default_rng(order)
    vocabulary = ["a", "b", "c", "d", "e", "rare"]
    weights = [0.3, 0.25, 0.2, 0.15, 0.09, 0.01]
    texts = [" ".join(random.choice(vocabulary, random.integers(0, 30), p=weights)) for _ in range(60)]
    texts += ["unseen words a b c", "a b a b a b", "", None]
    docs = documents(spark, texts)
    train = F.col("doc_id") < 60
    for block_bytes in (200, 1 << 20):
        scored = language_model.train_and_score(docs, train, 0.02, order, block_bytes).collect()
        p, unigrams = reference_model(texts[:60], 0.02, order)
        for r in scored:
            own = split_tokens(texts[r["doc_id"]])
            want = sum(
                math.log10(p(t, tuple(own[max(0, i - order + 1) : i]))) for i, t in enumerate(own)
            )
            assert r["score"] == pytest.approx(want, rel=1e-9)
    # The weights of all events after any history add up to one.
    for history in [(), (b"a",), (b"a", b"b"), (b"rare", b"a")]:
        events = [*unigrams, b"never seen"]
        assert sum(p(t, history[-order + 1 :] if order > 1 else ()) for t in events) == pytest.approx(1)


def test_lm_arcs_do_not_depend_on_corpus_size(spark):
    """N-grams found twice are arcs however many other tokens there are, with histories spread or not."""
    random = np.random.default_rng(7)
    filler = [" ".join(f"w{i}" for i in random.zipf(1.3, 400) % 5000) for _ in range(100)]
    texts = ["one rare pair", "another rare pair", *filler, "rare pair", "common the " * 50]
    docs = documents(spark, texts)
    train = F.col("doc_id") < 102
    p, _ = reference_model(texts[:102], 0, 3)
    for block_bytes in (2_000, 1 << 20):
        rows = language_model.train_and_score(docs, train, block_bytes=block_bytes).collect()
        scores = {r["doc_id"]: r["score"] for r in rows}
        assert len(scores) == len(texts)
        for i in (0, 1, 2, 50, 102, 103):
            own = split_tokens(texts[i])
            want = sum(math.log10(p(t, tuple(own[max(0, j - 2) : j]))) for j, t in enumerate(own))
            assert scores[i] == pytest.approx(want, rel=1e-9)


def test_lm_odd_tables(spark):
    docs = odd_documents(spark)
    assert language_model.train_and_score(docs, F.col("doc_id") >= 0).count() == docs.count()
    rows = language_model.train_and_score(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == 0 for r in rows)
    assert language_model.train_and_score(documents(spark, []), F.lit(True)).count() == 0


def test_lm_distinct_keys():
    random = np.random.default_rng(3)
    for keys in (random.integers(-9, 9, 200), random.integers(0, 1 << 60, 50), np.zeros(0, np.int64)):
        distinct, place = language_model._distinct(keys)
        assert distinct.tolist() == sorted(set(keys.tolist()))
        assert distinct[place].tolist() == keys.tolist()


def test_lm_codes_of_words():
    """Words are split at six bytes and lower-cased in ASCII only, whatever their other bytes."""
    texts = [b"", b" \t", b"  A b\x0bA\x0ca\rB\n", b"\xff a \xc3\xc9"]
    texts += ["\xc9 \xe9\x85\xa0\x1cZ".encode(), b"\x00 a"]
    for first, last, kind in ((0, 6, pa.binary()), (2, 5, pa.large_binary()), (5, 6, pa.large_binary())):
        own = [[*t.lower().split(), language_model.END] for t in texts[first:last]]
        array = pa.array(texts, kind).slice(first, last - first)
        pieces = [array.slice(0, 1), array.slice(1)] if len(array) > 1 else [array]
        names, codes, sizes = language_model._coded(pieces)
        assert sizes.tolist() == [len(x) for x in own]
        assert names[codes].tolist() == [language_model.word_name(w) for x in own for w in x]
        assert len(set(names.tolist())) == len(names) == len({w for x in own for w in x})


def lm_block(n_tokens, n_words, n_docs):
    """A block of training texts of one length, low codes more often than high ones."""
    random = np.random.default_rng(11)
    codes = (n_words * random.random(n_tokens) ** 2).astype(np.int64)
    row = {"part": 0, "block": 0, "doc_ids": list(range(n_docs)), "train": [True] * n_docs}
    row["sizes"] = [n_tokens // n_docs] * n_docs
    row["names"] = language_model._pack(random.integers(0, 1 << 63, n_words).astype(np.uint64))
    row["codes"] = language_model._pack(codes.astype(np.int32))
    return row


def lm_answers(row, plan, level, replies):
    table = language_model._Block(row, replies, plan).messages()
    out = []
    for b in range(len(table)):
        answer = language_model._reply(table.slice(b, 1).combine_chunks(), level, plan)
        out += [r for r in answer.to_pylist() if r["part"] is not None]
    return out


@pytest.mark.parametrize("buckets", [3, 64])
def test_lm_messages_count_grams_of_each_history(buckets):
    """The n-grams under a history are the ones that it sends to that bucket, spread or not."""
    row = lm_block(6_000, 300, 20)
    plan = language_model._Plan(buckets, 2, 6_000)
    replies = lm_answers(row, plan, 1, [])
    level = language_model._Block(row, replies, plan)
    lower, level = level.levels[0], level.open()
    codes = language_model._unpack(row["codes"], np.int32)
    inside = np.arange(1, 6_000)[np.arange(1, 6_000) % 300 > 0]
    pairs = {(int(codes[i - 1]), int(codes[i])) for i in inside}
    often = lower.totals >= 2
    pairs = {p for p in pairs if often[p[0]] and often[p[1]]}
    sent = Counter()
    for a, b in pairs:
        spread = min(buckets, -(-int(lower.totals[a]) // plan.load))
        scatter = int(language_model._scatter(lower.ids[b : b + 1])[0])
        sent[a, (int(lower.ids[a]) + scatter % spread) % buckets] += 1
    asked = list(zip(level.asked.tolist(), level.asked_bucket.tolist(), strict=True))
    assert len(asked) == len(set(asked)) and set(sent) <= set(asked)
    assert level.under.tolist() == [sent[x] for x in asked]


def test_lm_block_finds_its_ngrams_in_a_few_sorts():
    """Work of a block: at a million tokens, hashing n-grams and searching each takes far longer."""
    n = 1 << 20
    row = lm_block(n, 1 << 13, 1 << 8)
    plan = language_model._Plan(64, 2, n)
    replies = lm_answers(row, plan, 1, [])
    keys = np.random.default_rng(5).integers(0, 1 << 40, n)

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    def opened():
        blocks.pop().open()

    blocks = [language_model._Block(row, replies, plan) for _ in range(3)]
    ratio = seconds(opened) / seconds(lambda: np.argsort(keys, kind="stable"))
    assert ratio < 4, ratio


# Sharding


def shard_figures(rows):
    size, slots = Counter(), {}
    for r in rows:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, slots


def test_sharding_query_balances_bytes(spark):
    rows = QUERIES["op5_sharding"](spark, "/root/testdata/sf0.01").collect()
    docs = {d["doc_id"]: (d["text"] or "").encode() for d in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    size, slots = shard_figures(rows)
    assert len(rows) == len(docs) and set(size) == set(range(40))
    assert all(r["size"] == len(docs[r["doc_id"]]) + 16 for r in rows)
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) for r in rows)
    mean = sum(size.values()) / 40
    assert max(size.values()) < 1.04 * mean and min(size.values()) > 0.96 * mean
    assert max(map(len, slots.values())) <= 1.2 * len(rows) / 40


def test_hot_group_is_cut_and_small_groups_stay(spark):
    texts = ["the same text again"] * 400 + [f"text number {i // 2}" for i in range(600)]
    rows = sharding.assign_shards(documents(spark, texts), 10).collect()
    size, _ = shard_figures(rows)
    shards = {}
    for r in rows:
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert len(shards.pop("the same text again")) == 10
    assert all(len(s) == 1 for s in shards.values())
    assert max(size.values()) < 1.1 * sum(size.values()) / 10


def test_sharding_odd_tables(spark, tmp_path):
    docs = odd_documents(spark)
    rows = sharding.assign_shards(docs, 3).collect()
    assert len(rows) == docs.count()
    shard_figures(rows)
    assert sharding.assign_shards(documents(spark, []), 3).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 3)
    assert spark.read.parquet(path).count() == docs.count()


# Decontamination


def test_phrases_and_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [f"x {item} y", "x " + " ".join(item.split()[1:11]).upper(), " ".join(reversed(item.split()))]
    texts += ["short one here", "short, ONE", "one short", item.replace("delta", "DELTA!"), None, ""]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame(
        [(1, item), (2, "Short one"), (3, ""), (4, None), (None, "x"), (2, "short one")],
        "item_id bigint, text string",
    )
    for block_bytes in (1 << 20, 1):
        path = session.scratch_path(spark, "index")
        decontaminate.build_index(docs, path, shard_bytes=60)
        found = decontaminate.search_index(spark, path, benchmark, block_bytes=block_bytes)
        rows = {r["doc_id"]: r for r in found.collect()}
        spans = {i: sorted((s["item_id"], s["start"], s["length"]) for s in r["spans"]) for i, r in rows.items()}
        assert spans[0] == [(1, 1, 12)] and spans[1] == [(1, 1, 10)] and spans[2] == []
        assert spans[3] == [(2, 0, 2)] and spans[4] == [(2, 0, 2)] and spans[5] == []
        assert spans[6] == [(1, 0, 12)] and spans[7] == spans[8] == []
        near = {i: r["near_items"] for i, r in rows.items()}
        assert near[2] == [1] and near[5] == [2] and near[7] == []


def test_benchmark_ids_of_any_type(spark):
    docs = documents(spark, ["say one two three", "nothing"])
    benchmark = [("q-1", "one two three"), ("q-01", "say one"), (None, "nothing")]
    named = spark.createDataFrame(benchmark, "item_id string, text string")
    path = session.scratch_path(spark, "index")
    decontaminate.build_index(docs, path)
    found = {r["doc_id"]: r for r in decontaminate.search_index(spark, path, named).collect()}
    assert [s["item_id"] for s in found[0]["spans"]] == ["q-01", "q-1"]
    assert found[0]["near_items"] == ["q-01", "q-1"] and found[1]["spans"] == []
    assert decontaminate.drop_contaminated(docs, named).count() == 1
    small = spark.createDataFrame([(3, "one two three")], "item_id int, text string")
    found = {r["doc_id"]: r for r in decontaminate.search_index(spark, path, small).collect()}
    assert [s["item_id"] for s in found[0]["spans"]] == [3]


def test_decontamination_odd_tables(spark):
    docs = odd_documents(spark)
    benchmark = spark.createDataFrame([(1, "same line other")], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(documents(spark, []), benchmark).count() == 0


# Similarity join


def groups_of(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, groups, copies, words=60):
    random = np.random.default_rng(seed)
    texts = []
    for g in range(groups):
        base = [f"g{g}w{random.integers(50)}" for _ in range(words + g)]
        for _ in range(copies):
            own = list(base)
            for at in random.integers(0, len(own), random.integers(0, 4)):
                own[at] = f"new{random.integers(1000)}"
            texts.append(" ".join(own))
    return texts


def test_join_query_equals_all_pairs(spark):
    docs = sorted(table(spark, SF_DIR, "documents").collect())
    want = similar_groups([d["doc_id"] for d in docs], [d["text"] for d in docs], 4, 85)
    assert groups_of(QUERIES["op9_ngram_join"](spark, SF_DIR)) == want


@pytest.mark.parametrize("n, percent", [(5, 80), (2, 60), (1, 100)])
def test_join_in_small_blocks(spark, monkeypatch, n, percent):
    texts = near_copies(n, 4, 12) + ["a b", "A  B", "b a", "a", "", None, " \n"]
    texts += ["shared passage of many words that all have " + f"own{i} " * i for i in range(1, 12)]
    want = similar_groups(list(range(len(texts))), texts, n, percent)
    docs = documents(spark, texts)
    assert groups_of(ngram_join.similar_documents(docs, n, percent)) == want
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 4)
    monkeypatch.setattr(ngram_join, "CELL_SHINGLES", 300)
    assert groups_of(ngram_join.similar_documents(docs, n, percent)) == want


def test_histograms_bound_the_overlap():
    random = np.random.default_rng(0)
    sets = [np.unique(random.integers(0, 3000, k).astype(np.uint64)) * np.uint64(2**50 + 7) for k in (40, 200, 210, 900, 1000)]
    sizes = np.array([len(s) for s in sets])
    bound = ngram_join.Bound([ngram_join.histogram(s).astype(np.uint32) for s in sets], sizes)
    for i in range(len(sets) - 1):
        most = bound.overlap(i, i + 1, len(sets))
        common = [len(np.intersect1d(sets[i], s)) for s in sets[i + 1 :]]
        assert (most >= common).all() and (most <= sizes[i]).all()


def test_keep_one_odd_tables(spark):
    docs = odd_documents(spark)
    kept = ngram_join.keep_one(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in rows)
    # Of repeated rows one stays; texts without words all stay.
    assert ids == {0: 1, 1: 1, 2: 1, 3: 1, 5: 1, 7: 1, None: 2}
    assert ngram_join.keep_one(documents(spark, [])).count() == 0


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 150)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 100}
    assert got == want
    assert components.components(df.limit(0)).count() == 0
