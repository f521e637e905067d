"""Small document tables and brute-force versions."""

from __future__ import annotations

from collections import Counter

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Names that operators use inside.
CLASHING = ["row", "_row", "_hash", "kept", "n_lines", "n_dropped", "size", "words", "part", "score"]


def documents(spark, texts, ids=None, extra=()):
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, "en", "s", None if t is None else len(t), *(["x"] * len(extra)))
        for i, t in zip(ids, texts, strict=True)
    ]
    schema = DOCUMENTS + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame(rows, schema)


def odd_documents(spark, extra=CLASHING):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text, extra columns."""
    words = [f"w{i}" for i in range(40_000)]
    texts = [None, "", " \n ", "one two", "one two", "same line\nother", "same line\nother"]
    texts += [" ".join(words), "a b c d e f\nshared shared shared\ng", None]
    ids = [0, 1, 2, 3, 3, 5, 5, 7, None, None]
    return documents(spark, texts, ids, extra)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shingle_sets(texts, n):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        if len(w) >= n:
            sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
        else:
            sets.append({tuple(w)} if w else set())
    return sets


def similar_groups(ids, texts, n, percent):
    """{id: (set size, smallest id reachable)} by testing all pairs that share a shingle."""
    sets = shingle_sets(texts, n)
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)), key=lambda r: ids[r])
                parent[b] = a
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root(i)]) for i in range(len(ids))}
