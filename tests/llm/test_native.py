"""Preference formatting, quality rules and line deduplication."""

from __future__ import annotations


import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tests.llm.helpers import DOCUMENTS, documents, odd_documents
from vecloom.llm import line_dedup, preference, quality_rules, ranks

PAIRS = "pair_id bigint, turn bigint, role string, text string"


def sides(spark, chosen, rejected):
    return spark.createDataFrame(chosen, PAIRS), spark.createDataFrame(rejected, PAIRS)


def test_prompt_is_longest_common_prefix(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")]
    rejected = [*chosen[:3], (1, 3, "assistant", "c")]
    rows = preference.preference_segments(*sides(spark, chosen, rejected)).collect()
    by = {(r["part"], r["turn"]): r for r in rows}
    assert set(by) == {("prompt", 0), ("prompt", 1), ("prompt", 2), ("chosen", 3), ("rejected", 3)}
    assert by["rejected", 3]["rendered"] == "<|assistant|>\nc<|end|>\n"
    assert by["chosen", 3]["train_chars"] == len("b<|end|>\n")
    assert by["prompt", 1]["train_chars"] == 0
    assert by["prompt", 2]["char_start"] == sum(len(by["prompt", t]["rendered"]) for t in (0, 1))


def test_long_conversations_keep_their_places(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(1000)]
    rows = preference.preference_segments(*sides(spark, turns, turns[:700])).collect()
    assert Counter(r["part"] for r in rows) == {"prompt": 700, "chosen": 300}
    for part in ("prompt", "chosen"):
        at = 0
        for r in sorted((r for r in rows if r["part"] == part), key=lambda r: r["turn"]):
            assert r["char_start"] == at
            at += len(r["rendered"])


def test_preference_odd_rows(spark):
    chosen = [(1, None, None, None), (None, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    rejected = [(2, 0, "user", "x"), (3, 0, "assistant", "only rejected")]
    left, right = sides(spark, chosen, rejected)
    left = left.withColumns({c: F.lit("x") for c in ("part", "side", "block", "_pair")})
    rows = preference.preference_segments(left, right).collect()
    parts = Counter((r["pair_id"], r["part"]) for r in rows)
    # Pair 2 holds the turn twice on one side only, so there it differs.
    assert parts == {
        (1, "chosen"): 1, (None, "chosen"): 1, (2, "chosen"): 2, (2, "rejected"): 1, (3, "rejected"): 1
    }
    assert [r["rendered"] for r in rows if r["pair_id"] == 1] == ["<|unknown|>\n<|end|>\n"]
    assert preference.preference_segments(left.limit(0), right.limit(0)).count() == 0


def test_every_conversation_finds_a_partner(spark, monkeypatch):
    """Sparse ids leave conversations alone in their block of 64; they are paired all the same."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 3)
    schema = "conv_id bigint, turn bigint, role string, text string"
    for ids in ([0, 1000, 2000, 2001, *range(5000, 9000, 300)], [5, 7, 640], [3, 300], [9]):
        turns = [(i, t, r, f"{r} {i}") for i in ids for t, r in enumerate(("user", "assistant"))]
        # One without an assistant turn has no reply to contrast.
        table = spark.createDataFrame([*turns, (77_777, 0, "user", "alone")], schema)
        chosen, rejected = preference.contrast_pairs(table)
        want = set(ids) if len(ids) > 1 else set()
        assert sorted(r["pair_id"] for r in chosen.collect()) == sorted([*want, *want])
        replies = {r["pair_id"]: r["text"] for r in rejected.where("turn = 1").collect()}
        assert set(replies) == want
        assert all(x != f"assistant {i}" and x.startswith("assistant") for i, x in replies.items())


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {p for i, w in enumerate(windows) if w in twice for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    texts = ["a b c d e a b c d e", "x " * 30, "a b c d e f a b c d e f g\nq\nq\n\n", "# * é 😀 |", "\x0bA\x1cB"]
    texts += [None, "", "1 2 3 4 5 6 7 8 9 10 1 2 3 4 5 6 7 x 5 6 7 8 9"]
    docs = documents(spark, texts)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in quality_rules.ledger(docs).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}
    assert quality_rules.ledger(odd_documents(spark)).count() == 10
    assert quality_rules.ledger(documents(spark, [])).count() == 0


def test_policies_and_ablation(spark):
    texts = ["word " * 3, " ".join(f"word{i}" for i in range(30)), " ".join(f"w{i}#" for i in range(30))]
    entries = quality_rules.ledger(documents(spark, texts))
    failed = {r["doc_id"]: r["failed"] for r in entries.collect()}
    assert failed[1] == 0 and failed[2] == 4 and failed[0] & 1
    kept = {r["doc_id"] for r in entries.where(~quality_rules.fails("base")).collect()}
    assert kept == {1, 2}
    rows = {r["rule"]: r for r in quality_rules.ablate(entries, "v1").collect()}
    assert rows["symbols"]["n_failed_alone"] == 1 and rows["symbols"]["n_kept_without"] == 2
    assert rows["few_words"]["n_failed"] == 1


def brute_lines(texts, min_docs, policy):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    docs = Counter(k for lines in split for k in {key(x) for x in lines})
    seen, out = set(), []
    for lines in split:
        kept = []
        for x in lines:
            frequent = key(x) and docs[key(x)] >= min_docs
            if not frequent or (policy == "keep_first" and key(x) not in seen):
                kept.append(x)
            seen.add(key(x))
        out.append("\n".join(kept))
    return out


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    texts = [f"Common line\n{'rare' + str(i)}\n\n common LINE \nÉa B" for i in range(30)]
    texts += [f"few {i // 3}\nmid {i // 12}\nCOMMON line" for i in range(60)] + ["", None, "\n\n"]
    for partition_rows in (400_000, 20):
        monkeypatch.setattr(line_dedup, "PARTITION_ROWS", partition_rows)
        for policy in line_dedup.POLICIES:
            docs = documents(spark, texts)
            cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 10, policy=policy))
            got = {r["doc_id"]: r["text"] or "" for r in cut.collect()}
            assert got == dict(enumerate(brute_lines(texts, 10, policy)))


def test_line_dedup_odd_tables(spark):
    docs = odd_documents(spark)
    cut = line_dedup.dedup_lines(docs, min_docs=2)
    rows = cut.collect()
    assert cut.columns == docs.columns
    # Equal rows share their bitmap, so both keep the first occurrence.
    assert sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] in (3, 5)) == [
        (3, "one two"), (3, "one two"), (5, "same line\nother"), (5, "same line\nother")
    ]
    assert all(r["row"] == r["n_lines"] == "x" for r in rows)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_documents_of_lines_kept_elsewhere_go(spark):
    docs = documents(spark, ["a line\nb line"] * 12 + ["a line\nown"])
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert rows == {0: ("a line\nb line", 13), 12: ("a line\nown", 10)} or rows == {
        0: ("a line\nb line", 13),
        12: ("own", 3),
    }


def test_native_plans_have_no_python(spark):
    docs = documents(spark, ["a\nb"] * 3)
    for df in (quality_rules.ledger(docs), line_dedup.dedup_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_counts_documents_by_id_and_text(spark):
    """One rule in code, docstring and SQL: equal rows are one document, other texts of an id others."""
    equal = [((1, None)[i % 2], f"same {i % 2}\nown") for i in range(20)]
    several = [(2, f"line of one id\n{i}") for i in range(10)] + [(None, f"line of none\n{i}") for i in range(10)]
    nine = [(i, "nine\nof them") for i in range(100, 109)]
    rows = [(i, t, "en", "s", len(t)) for i, t in equal + several + nine]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    cut = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    got = cut.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
    duck = duckdb.connect()
    duck.register("documents", docs.toArrow())
    want = duck.execute(line_dedup.ORACLE).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert Counter(r["n_dropped"] for r in got.collect()) == {0: 29, 1: 20}
