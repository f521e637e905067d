"""Table schemas and argument checks shared by all operators."""

from __future__ import annotations

METRICS = ("l2", "ip")
ORDERS = ("nearest", "farthest")
PRECISIONS = ("f32", "bf16")

NEIGHBOURS = "query_id bigint, rank int, neighbor_id bigint, score double"
CANDIDATES = "query_id bigint, list_id int, neighbor_id bigint, score double"
PROBES = "query_id bigint, list_id int, probe_rank int"
CENTROIDS = "list_id int, centroid array<double>"
VECTORS = "vec_id bigint, embedding array<float>"
META = (
    "index_type string, metric string, coarse_metric string, dim int, n_base bigint, "
    "n_list int, m int, n_bucket int"
)
TIMINGS = (
    "index string, phase string, n_base bigint, n_query bigint, knob int, rep int, millis bigint"
)


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
    return value


def positive(name: str, value: int) -> int:
    if int(value) != value or value < 1:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return int(value)
