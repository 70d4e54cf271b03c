"""K: training-set construction for the text retrievers."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.config import DEFAULTS
from refrain.operators import folds as FO, pairs as P, retrieval as R, sessions as S
from workload import tables as T
from workload.g_texts import DEV_STRUCT, TRAIN_CASES, structured_sql
from workload.registry import query
from workload.sql import ITEM_TEXT, dot, q, ranked

TRAIN = (f"SELECT s.case_id, tc.session_id, tc.item_id, s.query, i.item_text FROM ({structured_sql('SELECT * FROM tc WHERE user_query IS NOT NULL', 2)}) s "
         f"JOIN tc USING (case_id) JOIN (SELECT item_id, {ITEM_TEXT} AS item_text FROM items) i USING (item_id)")


@T.staged("train_pairs")
def train_pairs(spark, sf):
    return P.train_pairs(T.turns(spark, sf), T.items(spark, sf))


@query("K1_grouped_session_folds", q("dev_cases sess_folds", "SELECT case_id, session_id, fold FROM dev_cases JOIN sess_folds USING (session_id)"))
def k1(spark, sf):
    return FO.with_folds(T.dev_cases(spark, sf)).select("case_id", "session_id", "fold")


@query("K2_dev_pairs", q("dev_cases sess_folds turns items", f"""
SELECT d.case_id, f.fold, s.query, i.item_text FROM dev_cases d JOIN sess_folds f USING (session_id) JOIN ({DEV_STRUCT}) s USING (case_id)
JOIN (SELECT item_id, {ITEM_TEXT} AS item_text FROM items) i ON i.item_id = d.gt WHERE f.fold <> 0"""))
def k2(spark, sf):
    t, items = T.turns(spark, sf), T.items(spark, sf)
    cases = FO.held_in(FO.with_folds(T.dev_cases(spark, sf)), 0)
    queries = P.structured_queries(cases, S.utterances_of(t), S.plays_of(t), items)
    return P.dev_pairs(cases, queries, items).select("case_id", "fold", "query", "item_text")


@query("K3_train_pairs", q("turns items", f"""
WITH tc AS ({TRAIN_CASES}), ex AS (SELECT DISTINCT cast(user_id AS varchar) AS s FROM events WHERE event_type = 'error' AND value > 150)
SELECT case_id, query, item_text FROM ({TRAIN}) WHERE session_id NOT IN (SELECT s FROM ex)"""))
def k3(spark, sf):
    excluded = T.table(spark, sf, "events").where("event_type = 'error' and value > 150").select(T.text_id("user_id").alias("session_id"))
    return P.train_pairs(T.turns(spark, sf), T.items(spark, sf), excluded).select("case_id", "query", "item_text")


@query("K4_capped_sample", q("turns items", f"""
WITH tc AS ({TRAIN_CASES}), c AS (SELECT *, md5('0:' || case_id) AS h, row_number() OVER (PARTITION BY session_id ORDER BY md5('0:' || case_id), case_id) AS r FROM ({TRAIN}))
SELECT case_id, query, item_text FROM c WHERE r <= 2 ORDER BY h, case_id LIMIT 20000"""))
def k4(spark, sf):
    return P.capped_sample(train_pairs(spark, sf)).select("case_id", "query", "item_text")


BATCHED = "b AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || case_id), case_id) AS perm FROM ({0})), bb AS (SELECT *, cast((perm - 1) // 32 AS bigint) AS batch_id FROM b)"


@query("K5_random_negatives", q("turns items", f"""
WITH tc AS ({TRAIN_CASES}), {BATCHED.format(TRAIN)},
num AS (SELECT item_id, {ITEM_TEXT} AS item_text, row_number() OVER (ORDER BY item_id) AS no FROM items),
dr AS (SELECT batch_id, d AS draw, cast('0x' || left(md5('3:' || batch_id || ':' || d), 8) AS bigint) % (SELECT count(*) FROM items) + 1 AS no
  FROM (SELECT DISTINCT batch_id FROM bb) CROSS JOIN range(1, 321) r(d)),
ju AS (SELECT dr.*, num.item_id, num.item_text, EXISTS (SELECT 1 FROM bb WHERE bb.batch_id = dr.batch_id AND bb.item_text = num.item_text)
  OR row_number() OVER (PARTITION BY dr.batch_id, num.item_text ORDER BY draw) > 1 AS bad FROM dr JOIN num USING (no)),
ct AS (SELECT *, sum(bad::int) OVER w AS rejected, sum((NOT bad)::int) OVER w AS neg_no FROM ju WINDOW w AS (PARTITION BY batch_id ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT batch_id, cast(neg_no AS bigint) AS neg_no, item_id, item_text FROM ct WHERE NOT bad AND neg_no <= 64 AND rejected < 256"""))
def k5(spark, sf):
    return P.random_negatives(P.batches(train_pairs(spark, sf), 7), T.items(spark, sf), 3)


@query("K6_seeded_permutation", q("dev_cases sess_folds", """
SELECT fold, case_id, row_number() OVER (ORDER BY md5('11:' || fold || ':' || case_id), fold || ':' || case_id) AS perm FROM dev_cases JOIN sess_folds USING (session_id)"""))
def k6(spark, sf):
    rows = FO.with_folds(T.dev_cases(spark, sf)).select("fold", "case_id")
    return FO.permutation(rows, 11, "fold", "case_id").select("fold", "case_id", "perm")


@query("K7_contrastive_batches", q("turns items", f"WITH tc AS ({TRAIN_CASES}), {BATCHED.format(TRAIN)} SELECT batch_id, case_id, query, item_text FROM bb"))
def k7(spark, sf):
    return P.batches(train_pairs(spark, sf), 7, DEFAULTS.batch_size).select("batch_id", "case_id", "query", "item_text")


@query("K8_oof_stitch", q("plays vfold cust_folds", ranked(f"""
SELECT p.case_id, v.item_id, fo.fold, round({dot('a.vec', 'v.vec')}, 6) AS score
FROM (SELECT * FROM plays WHERE pos = pos_total) p JOIN cust_folds fo ON fo.session_id = p.case_id
JOIN vfold a ON a.item_id = p.item_id AND a.fold = fo.fold JOIN vfold v ON v.fold = fo.fold""", 50)))
def k8(spark, sf):
    """Each fold's model ranks only its held-out cases; the case id makes stitching a union."""
    folds = FO.session_folds(T.cases(spark, sf).select(F.col("case_id").alias("session_id"))).withColumnRenamed("session_id", "case_id")
    queries, items = T.fold_queries(spark, sf).join(folds, ["case_id", "fold"]), T.fold_vectors(spark, sf)
    out = None
    for k in range(DEFAULTS.folds):
        part = R.masked_topk(FO.held_out(queries, k).select("case_id", "vec"), FO.held_out(items, k).select("item_id", "vec"), 50, digits=6)
        part = part.withColumn("fold", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("case_id", "item_id", "fold", "score", F.col("rank").cast("long").alias("rank"))
