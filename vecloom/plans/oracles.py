"""The same queries in SQL (DuckDB dialect), straight from their definitions."""

from __future__ import annotations

from vecloom.plans.queries import DESCENT_ROUNDS, EFS, GRAPH_M, K, NPROBE, NPROBES

LLOYD_STEPS = 10
#: Rounds of a beam; a round on a finished beam changes nothing, so more than are needed do no harm.
BEAM_ROUNDS = 10
#: Lists that the default graph build probes.
GRAPH_NPROBE = 32
#: Lists that neighbour descent starts from.
DESCENT_PROBES = 2
#: Edges that a vector keeps while it runs.
DESCENT_WIDTH = max(24, GRAPH_M)

_PLAIN = "embedding"
_SCALED = "list_transform(embedding, lambda x: CAST(x * (1 + vec_id % 5) AS FLOAT))"
_BF16 = """list_transform({vector}, lambda x: CASE WHEN x = 0 THEN x ELSE CAST(
    round_even(CAST(x AS DOUBLE) / pow(2, floor(log2(abs(CAST(x AS DOUBLE)))) - 7), 0)
    * pow(2, floor(log2(abs(CAST(x AS DOUBLE)))) - 7) AS FLOAT) END)"""

_SCORE = {
    "ip": "list_inner_product({a}, {b})",
    "l2": "power(list_distance({a}, {b}), 2)",
}


def _score(metric: str, a: str, b: str) -> str:
    return _SCORE[metric].format(a=a, b=b)


def _dir(metric: str, order: str = "nearest") -> str:
    return "DESC" if (metric == "ip") == (order == "nearest") else "ASC"


def _vectors(vector: str, name: str = "v") -> str:
    return f"{name} AS MATERIALIZED (SELECT vec_id, CAST({vector} AS DOUBLE[]) AS e FROM embeddings)"


def _knn(
    metric: str, order: str = "nearest", base: str = "v", queries: str = "v", name: str = "knn"
) -> str:
    score = _score(metric, "q.e", "b.e")
    return f"""{name} AS MATERIALIZED (
        SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id, {score} AS score,
            CAST(row_number() OVER (
                PARTITION BY q.vec_id ORDER BY {score} {_dir(metric, order)}, b.vec_id
            ) AS INTEGER) AS rank
        FROM {queries} q, {base} b QUALIFY rank <= {K})"""


def _result(name: str = "knn") -> str:
    return f"SELECT query_id, rank, neighbor_id, round(score, 6) + 0.0 AS score FROM {name}"


def _with(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


def _flat(vector: str, metric: str, order: str = "nearest") -> str:
    return _with(_vectors(vector), _knn(metric, order), select=_result())


def _centroids() -> list[str]:
    """k-means from the vectors with the lowest hashes; the last table is `centroids`."""
    ctes = [
        "n AS (SELECT count(*) AS n, CAST(floor(4 * sqrt(count(*))) AS INTEGER) AS n_list FROM v)",
        """c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id) - 1 AS INTEGER)
                AS list_id, e AS c
            FROM v QUALIFY list_id < (SELECT n_list FROM n))""",
    ]
    for i in range(LLOYD_STEPS):
        ctes += [
            _assign(f"a{i}", f"c{i}", "l2"),
            f"""m{i} AS MATERIALIZED (
                SELECT list_id, list(mean ORDER BY pos) AS c FROM (
                    SELECT list_id, pos, avg(value) AS mean FROM (
                        SELECT list_id, unnest(e) AS value, generate_subscripts(e, 1) AS pos
                        FROM a{i} JOIN v USING (vec_id)
                    ) GROUP BY list_id, pos
                ) GROUP BY list_id)""",
            f"""c{i + 1} AS MATERIALIZED (
                SELECT list_id, coalesce(m{i}.c, c{i}.c) AS c
                FROM c{i} LEFT JOIN m{i} USING (list_id))""",
        ]
    return ctes + [f"centroids AS (SELECT list_id, c FROM c{LLOYD_STEPS})"]


def _assign(name: str, centroids: str, metric: str) -> str:
    return f"""{name} AS MATERIALIZED (
        SELECT vec_id, list_id FROM v, {centroids} QUALIFY row_number() OVER (
            PARTITION BY vec_id ORDER BY {_score(metric, 'e', 'c')} {_dir(metric)}, list_id) = 1)"""


def _probes(metric: str, nprobe: int) -> str:
    return f"""probes AS MATERIALIZED (
        SELECT vec_id AS query_id, list_id, CAST(row_number() OVER (
            PARTITION BY vec_id ORDER BY {_score(metric, 'e', 'c')} {_dir(metric)}, list_id
        ) AS INTEGER) AS probe_rank
        FROM v, centroids QUALIFY probe_rank <= {nprobe})"""


def _ivf(metric: str, coarse: str, nprobe: int) -> list[str]:
    """All scored pairs of queries with vectors in their probed lists, as `pairs`."""
    return [
        *_centroids(),
        _assign("lists", "centroids", coarse),
        _probes(coarse, nprobe),
        f"""pairs AS MATERIALIZED (
            SELECT query_id, vec_id AS neighbor_id, probe_rank, {_score(metric, 'q.e', 'b.e')} AS score
            FROM probes JOIN lists USING (list_id) JOIN v b USING (vec_id)
                JOIN (SELECT vec_id AS query_id, e FROM v) q USING (query_id))""",
    ]


def _best(metric: str, where: str = "true", name: str = "best", extra: str = "") -> str:
    return f"""{name} AS MATERIALIZED (
        SELECT query_id, neighbor_id, score, {extra} CAST(row_number() OVER (
            PARTITION BY query_id ORDER BY score {_dir(metric)}, neighbor_id) AS INTEGER) AS rank
        FROM pairs WHERE {where} QUALIFY rank <= {K})"""


def _ivf_search(metric: str, coarse: str = "l2") -> str:
    return _with(
        _vectors(_SCALED), *_ivf(metric, coarse, NPROBE), _best(metric), select=_result("best")
    )


def _hits(result: str, truth: str = "knn") -> str:
    return (
        f"(SELECT round(count(*) / ({K} * (SELECT count(*) FROM v)), 6) + 0.0 "
        f"FROM {result} JOIN {truth} USING (query_id, neighbor_id))"
    )


def _nprobe_results(nprobes: tuple[int, ...]) -> list[str]:
    return [
        _vectors(_PLAIN),
        _knn("ip"),
        *_ivf("ip", "l2", max(nprobes)),
        *[_best("ip", f"probe_rank <= {p}", f"best{p}") for p in nprobes],
    ]


def _recall_by_nprobe() -> str:
    rows = [f"SELECT {p} AS nprobe, {_hits(f'best{p}')} AS recall" for p in NPROBES]
    return _with(*_nprobe_results(NPROBES), select=" UNION ALL ".join(rows))


def _sweep_recalls() -> str:
    knobs = (NPROBE, 4 * NPROBE)
    count = "(SELECT count(*) FROM v)"
    row = "SELECT '{0}' AS index, {1} AS k, {2} AS n_base, {2} AS n_query, {3} AS knob, {4} AS recall"
    rows = [row.format("flat", K, count, 0, _hits("knn k2"))]
    rows += [row.format("flat", K, count, 1, _hits("knn16"))]
    rows += [row.format("ivf", K, count, p, _hits(f"best{p}")) for p in knobs]
    bf16 = [_vectors(_BF16_PLAIN, "w"), _knn("ip", base="w", queries="w", name="knn16")]
    return _with(*_nprobe_results(knobs), *bf16, select=" UNION ALL ".join(rows))


def _sweep_grid() -> str:
    """The rows of the timed steps of `sweep_timings`."""
    steps = [("flat", "add", 0, 1), ("ivf", "train", 0, 1), ("ivf", "add", 0, 1), ("graph", "add", 0, 1)]
    steps += [("flat", "search", 0, 2), ("graph", "search", 32, 2)]
    steps += [("ivf", "search", p, 2) for p in (NPROBE, 4 * NPROBE)]
    rows = [
        f"SELECT '{index}' AS index, '{phase}' AS phase, n AS n_base, "
        f"{'n' if phase == 'search' else 0} AS n_query, {knob} AS knob, {rep} AS rep, true AS timed FROM c"
        for index, phase, knob, reps in steps
        for rep in range(reps)
    ]
    return _with("c AS (SELECT count(*) AS n FROM embeddings)", select=" UNION ALL ".join(rows))


def _beam(ef: int) -> list[str]:
    """Beam search of width `ef` over `edges` from the drawn entries; `found{ef}` has the best k."""

    def best(rows: str, name: str) -> str:
        return f"""{name} AS MATERIALIZED (
            SELECT query_id, node, score, expanded FROM ({rows}) QUALIFY row_number() OVER (
                PARTITION BY query_id ORDER BY score, node) <= {ef})"""

    score = _score("l2", "q.e", "n.e")
    ctes = [
        best(
            f"""SELECT q.vec_id AS query_id, n.vec_id AS node, {score} AS score, false AS expanded
            FROM v q, v n WHERE n.vec_id IN (SELECT vec_id FROM entries)""",
            f"beam{ef}_0",
        )
    ]
    for i in range(BEAM_ROUNDS):
        old, reached = f"beam{ef}_{i}", f"reached{ef}_{i}"
        ctes += [
            f"""{reached} AS MATERIALIZED (
                SELECT DISTINCT b.query_id, a.dst AS node FROM {old} b JOIN linked a ON a.src = b.node
                WHERE NOT b.expanded AND (b.query_id, a.dst) NOT IN (
                    SELECT (query_id, node) FROM {old}))""",
            best(
                f"""SELECT query_id, node, score, true AS expanded FROM {old} UNION ALL
                SELECT r.query_id, r.node, {score}, false FROM {reached} r
                JOIN v q ON q.vec_id = r.query_id JOIN v n ON n.vec_id = r.node""",
                f"beam{ef}_{i + 1}",
            ),
        ]
    return [
        *ctes,
        f"""found{ef} AS MATERIALIZED (
            SELECT query_id, node AS neighbor_id, score, CAST(row_number() OVER (
                PARTITION BY query_id ORDER BY score, node) AS INTEGER) AS rank
            FROM beam{ef}_{BEAM_ROUNDS} QUALIFY rank <= {K})""",
    ]


def _half(metric: str, vector: str) -> str:
    half = """half AS MATERIALIZED (
        SELECT * FROM v WHERE vec_id < (SELECT floor(count(*) / 2) FROM v))"""
    return _with(_vectors(vector), half, _knn(metric, base="half"), select=_result())


def _long(source: str, id_col: str, vector: str, value: str) -> str:
    return f"""SELECT {id_col}, CAST(pos - 1 AS INTEGER) AS pos, {value} AS value FROM (
        SELECT {id_col}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS pos
        FROM {source})"""


_BF16_PLAIN = _BF16.format(vector=_PLAIN)
_BF16_SCALED = _BF16.format(vector=f"({_SCALED})")

_FORWARD = f"""forward AS MATERIALIZED (
    SELECT a.vec_id AS src, b.vec_id AS dst, {_score('l2', 'a.e', 'b.e')} AS score,
        row_number() OVER (
            PARTITION BY a.vec_id ORDER BY {_score('l2', 'a.e', 'b.e')}, b.vec_id) AS rank
    FROM v a, v b WHERE a.vec_id <> b.vec_id QUALIFY rank <= {GRAPH_M})"""

_REVERSE = f"""reverse AS MATERIALIZED (
    SELECT f.dst AS src, f.src AS dst, f.score,
        {GRAPH_M} + row_number() OVER (PARTITION BY f.dst ORDER BY f.score, f.src) AS rank
    FROM forward f ANTI JOIN forward g ON f.dst = g.src AND f.src = g.dst
    QUALIFY rank <= {2 * GRAPH_M})"""

_EDGES = """SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(score, 6) + 0.0 AS score
    FROM (SELECT * FROM forward UNION ALL SELECT * FROM reverse)"""

#: The forward edges of a graph built through inverted lists.
_IVF_FORWARD = f"""forward AS MATERIALIZED (
    SELECT query_id AS src, neighbor_id AS dst, score, row_number() OVER (
        PARTITION BY query_id ORDER BY score, neighbor_id) AS rank
    FROM pairs WHERE query_id <> neighbor_id QUALIFY rank <= {GRAPH_M})"""

#: Edges as searched: one more to each vector that none leads to, along chains of a neighbour.
_LINKED = [
    "both_ways AS (SELECT * FROM forward UNION ALL SELECT * FROM reverse)",
    """linked AS MATERIALIZED (
        SELECT src, dst FROM both_ways UNION ALL
        SELECT coalesce(lag(src) OVER (PARTITION BY dst, src % 64 ORDER BY score, src), dst), src
        FROM forward WHERE rank = 1 AND src NOT IN (SELECT dst FROM both_ways))""",
    """entries AS MATERIALIZED (
        SELECT vec_id FROM v QUALIFY row_number() OVER (ORDER BY md5('0:' || vec_id), vec_id)
            <= (SELECT floor(4 * sqrt(count(*))) FROM v))""",
]

_IVF_GRAPH = [_vectors(_PLAIN), *_ivf("l2", "l2", GRAPH_NPROBE), _IVF_FORWARD, _REVERSE]



def _descent(probes: int, width: int, rounds: int) -> list[str]:
    """Edges after rounds in which the ends of each vector's edges are compared, as `forward` and `reverse`.

    Vectors keep `width` edges in the rounds.
    """
    reverse = _REVERSE.replace(f"<= {2 * GRAPH_M}", f"<= {GRAPH_M + width}")
    ctes = [
        _vectors(_PLAIN),
        *_ivf("l2", "l2", probes),
        _IVF_FORWARD.replace("forward AS", "forward0 AS", 1).replace(f"<= {GRAPH_M}", f"<= {width}"),
    ]
    for i in range(rounds):
        ctes += [
            reverse.replace("forward", f"forward{i}").replace("reverse AS", f"reverse{i} AS", 1),
            f"""both{i} AS MATERIALIZED (
                SELECT src, dst FROM forward{i} UNION ALL SELECT src, dst FROM reverse{i})""",
            f"""offered{i} AS MATERIALIZED (
                SELECT a.dst AS src, b.dst AS dst FROM both{i} a JOIN both{i} b ON a.src = b.src
                WHERE a.dst <> b.dst UNION SELECT src, dst FROM forward{i})""",
            f"""forward{i + 1} AS MATERIALIZED (
                SELECT src, dst, score, row_number() OVER (
                    PARTITION BY src ORDER BY score, dst) AS rank
                FROM (SELECT src, dst, {_score('l2', 's.e', 'd.e')} AS score FROM offered{i}
                    JOIN v s ON s.vec_id = src JOIN v d ON d.vec_id = dst)
                QUALIFY rank <= {width})""",
        ]
    return [*ctes, f"forward AS (SELECT * FROM forward{rounds} WHERE rank <= {GRAPH_M})", _REVERSE]


_IP_SCALED = _flat(_SCALED, "ip")
_L2_SCALED = _flat(_SCALED, "l2")

ORACLES: dict[str, str] = {
    "flat_ip_topk": _flat(_PLAIN, "ip"),
    "flat_l2_topk": _flat(_PLAIN, "l2"),
    "flat_ip_topk_scaled": _IP_SCALED,
    "flat_l2_topk_scaled": _L2_SCALED,
    "flat_ip_stream_base": _IP_SCALED,
    "flat_l2_stream_base": _L2_SCALED,
    "flat_ip_shuffle": _IP_SCALED,
    "flat_l2_shuffle": _L2_SCALED,
    "flat_ip_tiled": _IP_SCALED,
    "flat_ip_farthest": _flat(_SCALED, "ip", "farthest"),
    "flat_l2_farthest": _flat(_SCALED, "l2", "farthest"),
    "flat_bf16_topk": _flat(_BF16_SCALED, "ip"),
    "flat_bf16_farthest": _flat(_BF16_SCALED, "ip", "farthest"),
    "flat_saved_search": _L2_SCALED,
    "pair_scores": _with(
        _vectors(_SCALED),
        select=f"""SELECT a.vec_id, round({_score('ip', 'a.e', 'b.e')}, 6) + 0.0 AS ip,
            round({_score('l2', 'a.e', 'b.e')}, 6) + 0.0 AS l2
            FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
    ),
    "bf16_round": _long(
        f"(SELECT vec_id, {_BF16_PLAIN} AS e FROM embeddings)", "vec_id", "e", "CAST(x AS DOUBLE)"
    ),
    "recall_bf16": _with(
        _vectors(_PLAIN),
        _vectors(_BF16_PLAIN, "w"),
        _knn("ip"),
        _knn("ip", base="w", queries="w", name="knn16"),
        select=f"SELECT {_hits('knn16')} AS recall",
    ),
    "prefix_limit": _half("ip", _PLAIN),
    "dataset_shape": """SELECT count(*) AS n, CAST(min(len(embedding)) AS INTEGER) AS min_dim,
        CAST(max(len(embedding)) AS INTEGER) AS max_dim FROM embeddings""",
    "dataset_preview": """SELECT CAST(row AS INTEGER) AS row, CAST(pos - 1 AS INTEGER) AS col,
        CAST(value AS DOUBLE) AS value FROM (
            SELECT row, unnest(e) AS value, generate_subscripts(e, 1) AS pos FROM (
                SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding[1:10] AS e
                FROM embeddings QUALIFY row < 5))""",
    "dataset_preview_buffer": """SELECT CAST(floor(place / 10) AS INTEGER) AS row,
        CAST(place % 10 AS INTEGER) AS col, CAST(value AS DOUBLE) AS value FROM (
            SELECT value, row_number() OVER (ORDER BY vec_id, pos) - 1 AS place FROM (
                SELECT vec_id, unnest(embedding) AS value,
                    generate_subscripts(embedding, 1) AS pos FROM embeddings)
            QUALIFY place < 50)""",
    "n_list": "SELECT CAST(floor(4 * sqrt(count(*))) AS INTEGER) AS n_list FROM embeddings",
    "ground_truth": _IP_SCALED,
    "ground_truth_preview": _with(
        _vectors(_SCALED),
        _knn("ip"),
        select="""SELECT query_id, string_agg(CAST(neighbor_id AS VARCHAR), ' ' ORDER BY rank)
            AS neighbors FROM knn
            WHERE query_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 10) GROUP BY query_id""",
    ),
    "ivf_centroids": _with(
        _vectors(_PLAIN),
        *_centroids(),
        select=_long("centroids", "list_id", "c", "round(x, 6) + 0.0"),
    ),
    "ivf_assign": _with(
        _vectors(_PLAIN),
        *_centroids(),
        _assign("lists", "centroids", "l2"),
        select="SELECT vec_id, list_id FROM lists",
    ),
    "ivf_probes": _with(
        _vectors(_PLAIN),
        *_centroids(),
        _probes("l2", NPROBE),
        select="SELECT query_id, list_id, probe_rank FROM probes",
    ),
    "ivf_search_l2": _ivf_search("l2"),
    "ivf_search_ip": _ivf_search("ip"),
    "ivf_search_ip_coarse_ip": _ivf_search("ip", "ip"),
    "ivf_search_shuffle": _ivf_search("ip"),
    "ivf_search_two_pass": _ivf_search("ip"),
    "ivf_search_exact": _L2_SCALED,
    "ivf_search_exact_ip": _IP_SCALED,
    "ivf_saved_search": _ivf_search("l2"),
    "ivf_recall": _with(
        _vectors(_PLAIN),
        _knn("ip"),
        *_ivf("ip", "l2", NPROBE),
        _best("ip"),
        select=f"SELECT {_hits('best')} AS recall",
    ),
    "recall_sweep_nprobe": _recall_by_nprobe(),
    "knn_graph_exact": _with(_vectors(_PLAIN), _FORWARD, _REVERSE, select=_EDGES),
    "knn_graph_ivf": _with(*_IVF_GRAPH, select=_EDGES),
    "knn_graph_descent": _with(*_descent(DESCENT_PROBES, DESCENT_WIDTH, DESCENT_ROUNDS), select=_EDGES),
    "graph_search_ef32": _with(
        _vectors(_PLAIN), _FORWARD, _REVERSE, *_LINKED, *_beam(32), select=_result("found32")
    ),
    "graph_search_full_width": _flat(_PLAIN, "l2"),
    "graph_recall_sweep_ef": _with(
        *_IVF_GRAPH,
        _knn("l2"),
        *_LINKED,
        *(cte for ef in EFS for cte in _beam(ef)),
        select=" UNION ALL ".join(f"SELECT {ef} AS ef, {_hits(f'found{ef}')} AS recall" for ef in EFS),
    ),
    "fbin_roundtrip": _long("embeddings", "vec_id", "embedding", "CAST(x AS DOUBLE)"),
    "fbin_dataset_search": _half("l2", _SCALED),
    "i64bin_roundtrip": _with(
        _vectors(_SCALED), _knn("ip"), select="SELECT query_id, rank, neighbor_id FROM knn"
    ),
    "sweep_recalls": _sweep_recalls(),
    "sweep_grid": _sweep_grid(),
}
ORACLES |= {f"{name}_tiled": ORACLES[name] for name in ("ivf_centroids", "ivf_assign")}
ORACLES |= {f"{name}_tree": ORACLES[name] for name in ("ivf_assign", "ivf_probes")}
ORACLES |= {f"{name}_single_file": ORACLES[f"{name}_roundtrip"] for name in ("fbin", "i64bin")}
