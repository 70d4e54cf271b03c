"""Scoring a pool: routing, z-space blending, masking, cutting. Windows see one pool (<= 300 rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refrain.config import DEFAULTS
from refrain.operators.joins import growing
from refrain.operators.topk import ordered_list, top_k

def per_case():
    return W.partitionBy("case_id")


def zscore(value: Column) -> Column:
    """Population z-score per case, 0 when the scores are flat."""
    over = per_case()
    sd = F.stddev_pop(value).over(over)
    return F.when(sd > 1e-9, (value - F.avg(value).over(over)) / sd).otherwise(F.lit(0.0))


def zscore_nan(value: Column) -> Column:
    """Z-score over the usable scores; missing ones become a neutral 0."""
    v = F.when(~F.isnan(value), value)
    return F.coalesce(zscore(v), F.lit(0.0))


def margins(scored: DataFrame, score: str = "s_base") -> DataFrame:
    """Gap between the two best scores of each case, played items included."""
    two = top_k(scored.select("case_id", score, "pool_pos"), ["case_id"],
                [F.desc(score), F.asc("pool_pos")], 2, "_r")
    best = F.max(F.when(F.col("_r") == 1, F.col(score)))
    second = F.max(F.when(F.col("_r") == 2, F.col(score)))
    return two.groupBy("case_id").agg(F.coalesce(best - second, F.lit(0.0)).alias("margin"))


def with_route(scored: DataFrame, low: float = DEFAULTS.route_low, high: float = DEFAULTS.route_high) -> DataFrame:
    """Pick the large ranker when the base margin says nothing (too small or implausibly large)."""
    rn = F.row_number().over(per_case().orderBy(F.desc("s_base"), F.asc("pool_pos")))
    two = scored.withColumn("_r", rn)
    best = F.max(F.when(F.col("_r") == 1, F.col("s_base"))).over(per_case())
    second = F.max(F.when(F.col("_r") == 2, F.col("s_base"))).over(per_case())
    out = two.withColumn("margin", F.coalesce(best - second, F.lit(0.0))).drop("_r")
    out = out.withColumn("used_large", (F.col("margin") < low) | (F.col("margin") >= high))
    return out.withColumn("s_routed", F.when(F.col("used_large"), F.col("s_large")).otherwise(F.col("s_base")))


def blended(routed: DataFrame, weight: float = DEFAULTS.blend_weight) -> DataFrame:
    """Routed scores plus the second ranker in z-space; weight 0 leaves the routed scores."""
    if weight == 0:
        return routed.withColumn("final", F.col("s_routed"))
    return routed.withColumn("final", zscore(F.col("s_routed")) + weight * zscore_nan(F.col("s_second")))


def mask_played(rows: DataFrame, played: DataFrame) -> DataFrame:
    return rows.join(growing(played.select("case_id", "item_id")), ["case_id", "item_id"], "left_anti")


def rank_full(scored: DataFrame, played: DataFrame, weight: float = DEFAULTS.blend_weight,
              digits: int = 12) -> DataFrame:
    """Whole ranking of each case without played items; equal scores keep pool order."""
    final = blended(with_route(scored), weight).withColumn("final", F.round("final", digits))
    left = mask_played(final, played)
    order = F.row_number().over(per_case().orderBy(F.desc("final"), F.asc("pool_pos")))
    return left.withColumn("rank", order)


def rank_top(scored: DataFrame, played: DataFrame, k: int = DEFAULTS.top_k,
             weight: float = DEFAULTS.blend_weight) -> DataFrame:
    return rank_full(scored, played, weight).where(F.col("rank") <= k)


def recommendations(ranked: DataFrame) -> DataFrame:
    return ordered_list(ranked, "case_id", "predicted_track_ids")
