"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import re


import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.helpers import documents, odd_documents, similar_groups, table
from tests.llm.test_native import brute_lines

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Input and rows of each stage."""
    docs, found = table(spark, SF_DIR, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        result = stage(spark, docs, SF_DIR)
        assert name == "packing" or result.columns == docs.columns
        result.write.parquet(path)
        after = spark.read.parquet(path)
        found[name] = ({r["doc_id"]: r for r in docs.collect()}, after.collect())
        docs = after
    return found


def test_stages_are_named_and_registered():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontamination", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_toxic_documents_go_and_clean_ones_stay(spark, results):
    before, after = results["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF_DIR, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    assert all(i in kept for i in before if labels.get(i) == 0)
    toxic = [i for i in before if labels.get(i) == 1 and re.search("moron|scum|clown", before[i]["text"])]
    assert toxic and not any(i in kept for i in toxic)
    assert all(r == before[r["doc_id"]] for r in after)


def test_lines(results):
    before, after = results["line_dedup"]
    ids = sorted(before)
    want = dict(zip(ids, brute_lines([before[i]["text"] for i in ids], 10, "keep_first"), strict=True))
    got = {r["doc_id"]: r["text"] for r in after}
    assert all(got[i] == want[i] for i in got)
    assert all(not want[i].strip() for i in set(ids) - set(got))


def test_one_of_each_group_stays(results):
    before, after = results["ngram_join"]
    ids = sorted(before)
    groups = similar_groups(ids, [before[i]["text"] for i in ids], 5, 80)
    want = {i for i, (size, first) in groups.items() if not size or first == i}
    assert {r["doc_id"] for r in after} == want


def test_benchmark_passages_go(spark, results):
    before, after = results["decontamination"]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = set()
    for item in table(spark, SF_DIR, "benchmark").collect():
        w = fold(item["text"])
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}

    def clean(text):
        w = fold(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert {r["doc_id"] for r in after} == {i for i, r in before.items() if clean(r["text"])}


def test_packing_takes_all(results):
    before, after = results["packing"]
    assert {r["doc_id"] for r in after} == set(before)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after}
    assert sum(r["length"] for r in after) == sum(tokens.values())


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables_pass_all_stages(spark, tmp_path, empty):
    docs = documents(spark, []) if empty else odd_documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, SF_DIR)
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
    rows = docs.collect()
    if empty:
        assert rows == []
    else:

        assert {0, 1, 3, 5, 7} <= {r["doc_id"] for r in rows}
