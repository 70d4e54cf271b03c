"""Set, vector and score expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v,
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit vector; an all-zero vector stays as it is."""
    length = norm(v)
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(v, lambda x: x.cast("double") / safe)


def rank_inv(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def presence(rank: Column) -> Column:
    return F.when(rank.isNotNull(), 1.0).otherwise(0.0)
