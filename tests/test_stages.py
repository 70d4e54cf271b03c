"""What stages send through their shuffles."""

import pytest

from refrain.llm import simhash
from refrain.operators import features as FE, queries as Q, sessions as S
from workload import d_retrieval as D, tables as T


class Seen(Exception):
    pass


def test_plays_are_placed_by_numbers(spark, monkeypatch):
    def look(df, path):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(T, "materialize", look)
    monkeypatch.setattr(T, "_STAGED", {})
    with pytest.raises(Seen) as seen:
        T.all_plays(spark, "/root/testdata/sf0.001")
    lines = str(seen.value).splitlines()
    below = lines[next(i for i, line in enumerate(lines) if "Window" in line):]
    assert not any("as string" in line for line in below)


def test_a_task_spreads_a_bounded_number_of_fingerprints(spark, monkeypatch):
    def look(df, name):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(simhash, "KEYED_ROWS", 10, raising=False)
    monkeypatch.setattr(simhash, "stage", look)
    with pytest.raises(Seen) as seen:
        simhash.linked(spark.range(95).selectExpr("id * 7919 as fp").coalesce(1))
    assert "RepartitionByExpression" in str(seen.value) and ", 10" in str(seen.value)


def test_tables_that_grow_are_not_broadcast(spark):
    """Files of sf0.001 are far below any threshold, so sizes alone would broadcast every one of these."""
    sf = "/root/testdata/sf0.001"
    c = T.corpus(spark, sf)
    feats = FE.item_features(c.items)
    for df in (T.purchases(spark, sf), c.cases, c.said, Q.last_item_parts(c.cases, c.plays, c.items),
               Q.conversation_parts(c.cases, c.said, c.plays, c.items), FE.with_attributes(T.scored(spark, sf), feats),
               FE.played_albums(c.plays, feats), T.last_vectors(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, plan


def test_sessions_are_not_broadcast(spark):
    """Positions in a session, its cases, its gold and its look-back are joined where they lie, however few the rows."""
    sf = "/root/testdata/sf0.001"
    turns, c = T.turns(spark, sf), T.corpus(spark, sf)
    feats = FE.item_features(c.items)
    recency = FE.recency_parts(FE.with_attributes(T.scored(spark, sf), feats), c.plays, feats)
    for df in (S.plays_of(turns), S.dev_cases(turns), S.train_transitions(turns), S.history(turns, S.last_requests(turns)),
               D.text_queries(spark, sf), D.played_before(spark, sf), *recency):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, plan


def test_pairs_and_negatives_are_not_broadcast(spark):
    """The catalog, its texts and the batches' own texts grow with the input."""
    from refrain.operators import pairs as P
    from workload import k_training as K
    sf = "/root/testdata/sf0.001"
    turns, items = T.turns(spark, sf), T.items(spark, sf)
    excluded = turns.where("session_id = '1'").select("session_id")
    for df in (P.train_pairs(turns, items, excluded), P.random_negatives(P.batches(K.train_pairs(spark, sf), 7), items, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, plan
