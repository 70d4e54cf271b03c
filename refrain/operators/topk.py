"""Top-k per group. ``row_number() <= k`` is pruned per task before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def top_k(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def by_score(df: DataFrame, key: str, k: int, name: str = "rank") -> DataFrame:
    """Highest score first, item id breaks ties."""
    return top_k(df, [key], [F.desc("score"), F.asc("item_id")], k, name)


def last_k_array(plays: DataFrame, key: str, order: list, k: int, value: str, out: str) -> DataFrame:
    """Newest ``k`` values of each group as an array, newest first."""
    kept = top_k(plays, [key], order, k, "_r")
    return (kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("a"))
            .select(key, F.transform("a", lambda s: s[value]).alias(out)))


def ordered_list(ranked: DataFrame, key: str, out: str, rank: str = "rank", value: str = "item_id") -> DataFrame:
    """Ranked rows back to one ordered array per case (lists are at most top-k long)."""
    return (ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank, value))).alias("a"))
            .select(key, F.transform("a", lambda s: s[value]).alias(out)))
