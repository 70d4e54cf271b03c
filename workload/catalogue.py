"""All registered queries."""

from __future__ import annotations

from workload import (  # noqa: F401  (imports register the queries)
    a_sources, b_sessions, c_joins, d_retrieval, e_aggregates, f_ranking, g_texts, h_scalars,
    i_features, j_learning, k_training, l_responses, s_serving,
)
from workload.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
