from __future__ import annotations

import zlib

import pytest

from tests.llm.helpers import documents, odd_documents, table
from vecloom.llm import toxicity
from vecloom.llm.queries import QUERIES
from vecloom.llm.toxicity import Entry, Matcher, Model, Scorer

SF_DIR = "/root/testdata/sf0.01"
PRIOR = tuple(toxicity.PRIOR)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automata_equal_edit_distance():
    entries = [Entry(t, False, 1.0) for t in ("scum", "idiot", "moron", "worthless", "pathetic")]
    matcher = Matcher(entries)
    tokens = ["scum", "scam", "idiot", "idlot", "idiiot", "idot", "diot", "xidiot", "mron", "morron"]
    tokens += ["worthles", "w0rthl3ss", "wothlesss", "w0rthl3zs", "pathetick", "path", "", "i", "oron"]
    for token in tokens:
        want = min((distance(token, e.text), e.text) for e in entries if distance(token, e.text) <= e.errors) if any(
            distance(token, e.text) <= e.errors for e in entries
        ) else None
        got = matcher.match(token)
        assert (got and (got[0], got[1].text)) == want, token


def test_stems_match_any_ending_and_exceptions_none():
    matcher = Matcher([Entry("vequ", True, 1.0), Entry("moron", False, 1.0)], frozenset({"oron"}))
    assert matcher.match("vequique")[0] == 0 and matcher.match("vequ") and not matcher.match("veq")
    assert matcher.match("moron") and matcher.match("mooron") and not matcher.match("oron")


def test_quotation_counts_less_than_abuse():
    scorer = Scorer(Model((Entry("idiot", False, 1.0),), frozenset(), PRIOR))
    texts = ["you are an idiot and an idiot", 'they said the word "idiot" and "idiot"', "nothing", ""]
    abuse, quoted, nothing, empty = scorer.scores(scorer.features(texts))
    assert abuse > 0.5 > quoted > nothing == empty


def test_held_out_accuracy(spark):
    rows = QUERIES["op1_toxicity"](spark, SF_DIR).collect()
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF_DIR, "labels").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held)
    assert not any(r["predicted"] for r in held if labels[r["doc_id"]] == 0)


def test_held_out_recall_on_all_toxic_rows(spark):
    """Of a table with labels enough: all toxic rows count, in whatever language or spelling."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    rows = QUERIES["op1_toxicity"](spark, sf_dir).where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if labels.get(r["doc_id"]) == x] for x in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_every_entry_that_stands_out_is_kept():
    many = [(f"{i:05d}\n", 20, 0) for i in range(5000)]
    assert len(toxicity._choose(many, 40, 700)) == 5000


def test_odd_tables(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(0, 1), (3, 0), (None, 1), (7, None), (99, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    empty = documents(spark, [])
    model = toxicity.fit(empty, labels.limit(0))
    assert model.entries == () and toxicity.score(empty, model).count() == 0


def test_sample_bound_holds(spark):
    texts = [f"some words number {i}" + (" hateful" if i % 2 else "") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark, texts), labels, sample_rows=20)
    assert [e.text for e in model.entries] == ["hateful"]


@pytest.mark.parametrize("text", ["hateful", "Hateful!", "(hatefull)", "hatful"])
def test_misspelled_documents_are_caught(spark, text):
    model = Model((Entry("hateful", False, 1.0),), frozenset(), PRIOR)
    score = Scorer(model)
    assert score.features([f"you are {text} and {text}"])[0, 1:3].sum() > 0


def test_clean_texts_without_any_toxic_string(spark):
    """Sampled texts that share no string with toxic texts give empty batches among others."""
    texts = [f"you are a scum numbered{i}" for i in range(12)]
    texts += [f"you are a good zzz{i}" for i in range(60)] + [f"zzz{i} qqqq{i}" for i in range(60)]
    labels = [(i, int(i < 12)) for i in range(len(texts))]
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(documents(spark, texts), labels)
    assert "scum" in [e.text for e in model.entries]
