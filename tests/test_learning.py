"""Registered learning queries fit at the lengths of the operators, and read stored models."""

import inspect

import pytest
from pyspark.sql import functions as F

from refrain.lineage import fingerprint, shared_dir, stored
from refrain.operators import boosting as B, trees as TR
from workload import j_learning as J, tables as T


def test_models_have_their_full_lengths():
    assert {n: p for n, (_, _, p) in J.MODELS.items()} == {"base": TR.LISTWISE, "large": TR.LISTWISE, "second": TR.PERMUTED}
    assert (TR.LISTWISE.trees, TR.LISTWISE.leaves, TR.LISTWISE.step, TR.LISTWISE.min_leaf) == (300, 31, 0.05, 10)
    assert (TR.PERMUTED.trees, TR.PERMUTED.depth, TR.PERMUTED.step) == (600, 8, 0.05)
    assert (TR.SHIFT.trees, TR.SHIFT.leaves, TR.SHIFT.step) == (200, 15, 0.05)
    als = {k: v.default for k, v in inspect.signature(B.als_factors).parameters.items()}
    assert (als["rank"], als["iters"], als["alpha"], als["reg"]) == (128, 20, 100.0, 0.05)


def test_queries_fit_what_the_table_of_models_says(monkeypatch, spark):
    asked = []

    def fit(rows, features, params, name, **more):
        asked.append((name, params, len(features)))
        return spark.createDataFrame([(name, 0, 1, None, None, 0.5)], TR.MODEL)

    monkeypatch.setattr(TR, "fit", fit)
    monkeypatch.setattr(J, "_key", lambda *a: f"test-{id(asked)}")
    rows = spark.createDataFrame([("c", "i", 1, 1.0, 1)], "case_id string, item_id string, pool_pos int, label double, gt_pos int")
    from refrain.operators import features as FE
    for c in [*FE.FEATURES, *FE.BASE_TRIPLE, *FE.LARGE_TRIPLE]:
        rows = rows.withColumn(c, F.lit(0.0))
    monkeypatch.setattr(J, "MATRICES", {8: lambda *a: rows, 9: lambda *a: rows})
    monkeypatch.setattr(J, "features", lambda *a: rows)
    monkeypatch.setattr(J, "candidates", lambda *a: rows)
    monkeypatch.setattr(J, "training_candidates", lambda *a: rows)
    monkeypatch.setattr(T, "plays", lambda *a: spark.createDataFrame([("c", "z")], "case_id string, item_id string"))
    assert J.j2(spark, "x").count() == 2 and J.j8(spark, "x").count() == 1
    assert sorted(asked) == sorted([("base", TR.LISTWISE, 37), ("large", TR.LISTWISE, 37), ("second", TR.PERMUTED, 37)])  # j8 read j2's


def test_a_stored_table_is_built_once_and_found_again(spark):
    name, calls = f"test-{id(spark)}", []
    build = lambda: calls.append(1) or spark.range(3)
    assert stored(spark, name, build).count() == stored(spark, name, build).count() == 3 and len(calls) == 1


def test_changed_inputs_change_the_fingerprint(spark, tmp_path):
    path = f"{shared_dir(spark)}/test-{tmp_path.name}"
    spark.range(5).write.parquet(path)
    before = fingerprint(spark, [path])
    assert fingerprint(spark, [path]) == before
    spark.range(6).write.mode("append").parquet(path)
    assert fingerprint(spark, [path]) != before


def test_als_solves_its_cases(spark):
    plays = spark.range(4000).select((F.col("id") % 60).cast("string").alias("case_id"), F.pmod(F.xxhash64("id"), F.lit(80)).cast("string").alias("item_id"))
    cases, items, counts = B.als_factors(plays, rank=8, iters=3)
    got = B.als_residuals(cases, items, counts)
    assert got.count() == 60 and got.agg(F.max("residual")).first()[0] < 1e-3
    moved = cases.withColumn("vec", F.transform("vec", lambda x: x * 1.1))
    assert B.als_residuals(moved, items, counts).agg(F.min("residual")).first()[0] > 1e-2
