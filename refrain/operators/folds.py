"""Leakage-safe folds and hash-ordered permutations that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from refrain.config import DEFAULTS
from refrain.operators.joins import growing
from refrain.operators.positions import ordinal


def hash_order(seed: int, *keys: str) -> Column:
    """Shuffle key: MD5 over seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def session_folds(cases: DataFrame, k: int = DEFAULTS.folds, seed: int = DEFAULTS.fold_seed) -> DataFrame:
    """Round-robin folds over hash-ordered sessions: all turns of a session share a fold."""
    sessions = cases.select("session_id").distinct()
    placed = ordinal(sessions, hash_order(seed, "session_id"))
    return placed.select("session_id", ((F.col("ordinal") - 1) % k).cast("int").alias("fold"))


def with_folds(cases: DataFrame, k: int = DEFAULTS.folds, seed: int = DEFAULTS.fold_seed) -> DataFrame:
    return cases.join(growing(session_folds(cases, k, seed)), "session_id")


def held_in(cases: DataFrame, fold: int) -> DataFrame:
    return cases.where(F.col("fold") != fold)


def held_out(cases: DataFrame, fold: int) -> DataFrame:
    return cases.where(F.col("fold") == fold)


def permutation(rows: DataFrame, seed: int, *keys: str, name: str = "perm") -> DataFrame:
    """Seeded shuffle as a position column; ``keys`` identify a row."""
    return ordinal(rows, F.concat_ws(":", hash_order(seed, *keys), *[F.col(k).cast("string") for k in keys]), name)
