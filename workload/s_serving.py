"""S: the whole way from histories to top-20 lists, over a stored model small enough to write down."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.lineage import materialize, scratch_path
from refrain.operators import ranking as RK, trees as TR
from workload import tables as T
from workload.f_ranking import FINAL
from workload.i_features import features
from workload.j_learning import scored
from workload.registry import query
from workload.sql import q

# Inner nodes are (feature, threshold, left, right); left takes what is at most the threshold.
SMALL = {
    "base": [("rrf_rank_inv", 0.0713, ("popularity", 0.3371, -0.3, 0.2), ("r54_cosine", 0.4567, 0.5, 1.1)),
             ("recency_score", 0.618, ("als_dot", 0.1234, 0.0, 0.35), 0.7), ("n_sources", 2.5, -0.1, 0.45)],
    "large": [("r84_cosine", 0.5123, ("src_b_rank_inv", 0.0317, -0.2, 0.4), 0.9), ("last_tag_jaccard", 0.2871, 0.05, ("popularity", 0.4519, 0.6, 0.15))],
    "second": [("r84_rank_inv", 0.0519, ("query_meta_tok_overlap", 1.5, 0.1, 0.55), ("pool_artist_frac", 0.0477, 0.8, 0.3)), ("als_dot", 0.2468, -0.25, 0.25)],
}


def model_rows(name: str, trees: list) -> list[tuple]:
    """Rows of a model table."""
    def rows(tree, node, at):
        if not isinstance(at, tuple):
            return [(name, tree, node, None, None, float(at))]
        feature, threshold, left, right = at
        return [(name, tree, node, feature, threshold, None), *rows(tree, 2 * node, left), *rows(tree, 2 * node + 1, right)]
    return [r for i, t in enumerate(trees) for r in rows(i, 1, t)]


def model_sql(trees: list) -> str:
    def case(at) -> str:
        return f"{float(at)}" if not isinstance(at, tuple) else f"(CASE WHEN {at[0]} <= {at[1]} THEN {case(at[2])} ELSE {case(at[3])} END)"
    return "(" + " + ".join(map(case, trees)) + ")::double"


def small_models(spark) -> dict:
    rows = [r for name, trees in SMALL.items() for r in model_rows(name, trees)]
    table = materialize(spark.createDataFrame(rows, TR.MODEL), scratch_path(spark, "small-models"))
    return {name: table.where(F.col("model") == name) for name in SMALL}


_SERVED = FINAL.replace("FROM scored", "FROM sv").replace("FROM returned r", "FROM plays r")
S1_SQL = q("f_ctx f_src f_glob f_alb f_trip plays", f"""
WITH sv AS (SELECT case_id, item_id, pool_pos, {', '.join(f"{model_sql(t)} AS s_{n}" for n, t in SMALL.items())}
  FROM f_ctx JOIN f_src USING (case_id, item_id) JOIN f_glob USING (case_id, item_id) JOIN f_alb USING (case_id, item_id) JOIN f_trip USING (case_id, item_id)),
{_SERVED} SELECT case_id, item_id, rank FROM ordered WHERE rank <= 20""")


@query("S1_serve_top20", S1_SQL)
def s1(spark, sf):
    """All sources, fused pool, features, three stored models, routing, blend, mask, cut."""
    served = RK.rank_top(scored(features(spark, sf), small_models(spark)), T.plays(spark, sf).select("case_id", "item_id").distinct())
    return served.select("case_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("S1_lists", S1_SQL.replace("SELECT case_id, item_id, rank FROM ordered WHERE rank <= 20",
                                  "SELECT case_id, string_agg(item_id, ',' ORDER BY rank) AS ids FROM ordered WHERE rank <= 20 GROUP BY 1"))
def s1_lists(spark, sf):
    served = RK.rank_top(scored(features(spark, sf), small_models(spark)), T.plays(spark, sf).select("case_id", "item_id").distinct())
    return RK.recommendations(served).select("case_id", F.array_join("predicted_track_ids", ",").alias("ids"))
