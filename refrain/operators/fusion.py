"""Weighted reciprocal-rank fusion over the long candidate table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refrain.config import DEFAULTS, LIVE_SOURCES
from refrain.operators.topk import top_k

SCORE_DIGITS = 12


def weight_of(weights: dict[str, float]):
    """Fusion weight of the row's source; sources without one weigh nothing."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    return F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0))


def weighted_rrf(candidates: DataFrame, weights: dict[str, float] = DEFAULTS.weights,
                 topk: int = DEFAULTS.pool_k, k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Fused pool ``(case_id, item_id, rrf, pool_pos)``; equal scores keep first-seen order."""
    w = weight_of(weights)
    fused = (candidates.withColumn("_w", w).where("_w <> 0").groupBy("case_id", "item_id")
             .agg(F.round(F.sum(F.col("_w") / (k + F.col("rank"))), SCORE_DIGITS).alias("rrf"),
                  F.min(F.struct("source_ord", "rank")).alias("seen")))
    return top_k(fused, ["case_id"], [F.desc("rrf"), F.asc("seen")], topk, "pool_pos").drop("seen")


def fused_pool(candidates: DataFrame, weights: dict[str, float] = DEFAULTS.weights,
               topk: int = DEFAULTS.pool_k, k: int = DEFAULTS.rrf_k,
               pool_sources: list[str] | None = None) -> DataFrame:
    """Fusion that also keeps each pool row's per-source rank and retriever score.

    Zero-weight sources, or sources outside ``pool_sources``, add no score but still give
    ranks, so the feature step needs no second join with the candidates.
    """
    w = weight_of(weights)
    if pool_sources is not None:
        w = F.when(F.col("source").isin(pool_sources), w).otherwise(F.lit(0.0))
    ranks = [F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"r_{code}")
             for code, s in LIVE_SOURCES.items()]
    kept = F.col("rank") <= topk
    for code, s in {"text": "text_retriever", "base": "struct_base", "large": "struct_large"}.items():
        ranks.append(F.min(F.when((F.col("source") == s) & kept, F.col("rank"))).alias(f"r_{code}"))
    for code, s in {"base": "struct_base", "large": "struct_large"}.items():
        ranks.append(F.max(F.when(F.col("source") == s, F.col("score"))).alias(f"s_{code}"))
    fused = (candidates.withColumn("_w", w).groupBy("case_id", "item_id")
             .agg(F.round(F.sum(F.col("_w") / (k + F.col("rank"))), SCORE_DIGITS).alias("rrf"),
                  F.min(F.when(F.col("_w") != 0, F.struct("source_ord", "rank"))).alias("seen"), *ranks)
             .where("seen is not null"))
    return top_k(fused, ["case_id"], [F.desc("rrf"), F.asc("seen")], topk, "pool_pos").drop("seen")
