"""E: fusion, aggregations, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.config import DEFAULTS, POOL_SOURCES_8, POOL_SOURCES_9
from refrain.functions.text import bigrams
from refrain.operators import boosting as B, evaluation as EV, features as FE, responses as RS, weighting as WT
from refrain.operators.folds import with_folds
from refrain.operators.fusion import fused_pool, weighted_rrf
from refrain.operators.topk import ordered_list
from workload import tables as T
from workload.d_retrieval import candidates
from workload.registry import query
from workload.sql import q, rrf


def pool_out(df):
    return df.select("case_id", "item_id", "rrf", F.col("pool_pos").cast("long").alias("pool_pos"))


@query("E1_weighted_rrf", q("pool", "SELECT case_id, item_id, rrf, pool_pos FROM pool"))
def e1(spark, sf):
    return pool_out(weighted_rrf(candidates(spark, sf)))


IN8 = "WHERE source IN (" + ", ".join(f"'{s}'" for s in POOL_SOURCES_8) + ")"
IN9 = "WHERE source IN (" + ", ".join(f"'{s}'" for s in POOL_SOURCES_9) + ")"


@query("E2_pool_sources", q("cands", f"""
SELECT 8 AS n, case_id, item_id, rrf, pool_pos FROM ({rrf('cands', extra=IN8)})
UNION ALL SELECT 9, case_id, item_id, rrf, pool_pos FROM ({rrf('cands', extra=IN9)})"""))
def e2(spark, sf):
    c = candidates(spark, sf)
    part = lambda n, s: pool_out(fused_pool(c, pool_sources=s)).withColumn("n", F.lit(n))
    return part(8, POOL_SOURCES_8).unionByName(part(9, POOL_SOURCES_9)).select("n", "case_id", "item_id", "rrf", "pool_pos")


@query("E3_play_popularity", q("plays", "SELECT item_id, count(*) AS plays FROM plays GROUP BY 1"))
def e3(spark, sf):
    return FE.play_popularity(T.plays(spark, sf))


@query("E4_max_popularity", q("plays", """
SELECT item_id, round(plays::double / (SELECT coalesce(max(n), 1) FROM (SELECT count(*) AS n FROM plays GROUP BY item_id)), 9) AS popularity
FROM (SELECT item_id, count(*) AS plays FROM plays GROUP BY 1)"""))
def e4(spark, sf):
    p = FE.play_popularity(T.plays(spark, sf))
    return p.select("item_id", F.round(F.col("plays") / FE.max_popularity(p), 9).alias("popularity"))


@query("E5_play_matrix", q("plays", """
SELECT dense_rank() OVER (ORDER BY case_id) - 1 AS case_no, dense_rank() OVER (ORDER BY item_id) - 1 AS item_no, n
FROM (SELECT case_id, item_id, count(*) AS n FROM plays GROUP BY 1, 2)"""))
def e5(spark, sf):
    p = T.plays(spark, sf)
    m = B.play_matrix(p).join(B.numbered(p, "case_id", "case_no"), "case_id").join(B.numbered(p, "item_id", "item_no"), "item_id")
    return m.select(F.col("case_no").cast("long").alias("case_no"), F.col("item_no").cast("long").alias("item_no"), "n")


def attributed(spark, sf):
    return FE.with_attributes(T.scored(spark, sf), FE.item_features(T.items(spark, sf)))


@query("E6_pool_artist_counts", q("scored feats", """
SELECT case_id, artist_key, count(*) AS n FROM scored JOIN feats USING (item_id) WHERE artist_key <> '' AND pool_pos <= 300 GROUP BY 1, 2"""))
def e6(spark, sf):
    counted = FE.pool_counts(attributed(spark, sf)).where((F.col("artist_key") != "") & (F.col("pool_pos") <= DEFAULTS.pool_k))
    return counted.select("case_id", "artist_key", F.col("_artist_n").cast("long").alias("n")).distinct()


@query("E7_pool_album_counts", q("scored feats", """
SELECT case_id, item_id, round(count(*) OVER (PARTITION BY case_id, album_key)::double / count(*) OVER (PARTITION BY case_id), 9) AS share
FROM scored JOIN feats USING (item_id)"""))
def e7(spark, sf):
    feats = FE.item_features(T.items(spark, sf))
    return FE.album_features(FE.pool_counts(attributed(spark, sf)), T.plays(spark, sf), feats).select(
        "case_id", "item_id", F.round("pool_same_album_count", 9).alias("share"))


@query("E8_played_album_histogram", q("plays feats", """
SELECT case_id, album_key, count(*) AS n FROM plays JOIN feats USING (item_id) WHERE album_key <> '' GROUP BY 1, 2"""))
def e8(spark, sf):
    albums = FE.played_albums(T.plays(spark, sf), FE.item_features(T.items(spark, sf)))
    return albums.select("case_id", "album_key", F.col("_hist").alias("n"))


LIVE = "('qwen_recent', 'bm25_lastmusic', 'bm25_convo', 'qwen_neighbors', 'cfbpr_recent', 'als_session')"


@query("E9_source_agreement", q("cands pool", f"""
SELECT p.case_id, p.item_id, cast(count(DISTINCT source) AS double) AS n_sources FROM pool p
LEFT JOIN (SELECT * FROM cands WHERE source IN {LIVE}) c USING (case_id, item_id) GROUP BY 1, 2"""))
def e9(spark, sf):
    return FE.source_features(fused_pool(candidates(spark, sf))).select("case_id", "item_id", "n_sources")


def pool_of(spark, sf):
    return fused_pool(candidates(spark, sf))


@query("E10_pool_recall", q("pool gold", """
SELECT round(avg(CASE WHEN s.item_id IS NULL THEN 0.0 ELSE 1.0 END), 9) AS recall, count(*) AS n_cases
FROM gold p LEFT JOIN pool s ON s.case_id = p.case_id AND s.item_id = p.item_id"""))
def e10(spark, sf):
    pos = FE.case_gold_positions(pool_of(spark, sf), T.gold(spark, sf))
    return EV.pool_recall(pos).select(F.round("recall", 9).alias("recall"), "n_cases")


def gold_cases(spark, sf):
    """Each customer's last purchase is the gold item, which the history lacks; folds by customer."""
    return with_folds(T.gold(spark, sf).select("case_id", F.col("case_id").alias("session_id"), "gt"))


@query("E11_hit_at_k", q("gold pool", """
WITH g AS (SELECT case_id, item_id AS gt FROM gold),
f AS (SELECT case_id, cast((row_number() OVER (ORDER BY md5('0:' || case_id)) - 1) % 5 AS int) AS fold FROM g),
h AS (SELECT g.case_id, fold, CASE WHEN s.item_id IS NULL THEN 0.0 ELSE 1.0 END AS hit FROM g JOIN f USING (case_id)
  LEFT JOIN pool s ON s.case_id = g.case_id AND s.item_id = g.gt AND s.pool_pos <= 200)
SELECT fold, round(avg(hit), 9) AS hit, count(*) AS n_cases FROM h GROUP BY ROLLUP (fold)"""))
def e11(spark, sf):
    lists = pool_of(spark, sf).select("case_id", "item_id", F.col("pool_pos").alias("rank"))
    return EV.hit_rate(gold_cases(spark, sf), lists, 200).select("fold", F.round("hit", 9).alias("hit"), "n_cases")


@query("E12_ndcg", q("gold pool", """
SELECT round(avg(coalesce(1.0 / log2(s.pool_pos + 1), 0.0)), 9) AS ndcg, count(*) AS n_cases
FROM gold p LEFT JOIN pool s ON s.case_id = p.case_id AND s.item_id = p.item_id AND s.pool_pos <= 20"""))
def e12(spark, sf):
    lists = pool_of(spark, sf).select("case_id", "item_id", F.col("pool_pos").alias("rank"))
    return EV.ndcg(gold_cases(spark, sf), lists).select(F.round("ndcg", 9).alias("ndcg"), "n_cases")


@query("E13_list_agreement", q("scored", """
WITH a AS (SELECT case_id, list(item_id ORDER BY pool_pos) AS l FROM scored WHERE pool_pos <= 3 GROUP BY 1),
b AS (SELECT case_id, list(item_id ORDER BY r) AS l FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s_base + s_large DESC, item_id) AS r FROM scored) WHERE r <= 3 GROUP BY 1)
SELECT case_id AS session_id, a.l = b.l AS same FROM a JOIN b USING (case_id)"""))
def e13(spark, sf):
    from refrain.operators.topk import by_score
    s = T.scored(spark, sf)
    recs = ordered_list(s.where("pool_pos <= 3"), "case_id", "predicted_track_ids", "pool_pos")
    again = by_score(s.withColumn("score", F.col("s_base") + F.col("s_large")), "case_id", 3)
    golden = ordered_list(again, "case_id", "predicted_track_ids")
    name = lambda df: df.withColumnRenamed("case_id", "session_id")
    return EV.list_agreement(name(recs), name(golden))


@query("E14_roc_auc", """
WITH s AS (SELECT n_chars AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s),
a AS (SELECT sum(CASE WHEN label = 1 THEN rk ELSE 0 END)::double AS rp, sum(label)::double AS p, count(*) - sum(label)::double AS n FROM r)
SELECT round((rp - p * (p + 1) / 2) / (p * n), 9) AS auc FROM a""")
def e14(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "n_chars").join(
        T.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return EV.roc_auc(d, "n_chars", "quality").select(F.round("auc", 9).alias("auc"))


def shifted(spark, sf):
    """A positive score per order."""
    return T.table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000 + 0.01).alias("p"))


@query("E15_importance_weights", """
SELECT o_orderkey, round(p / avg(p) OVER (), 9) AS w FROM (SELECT o_orderkey, o_totalprice / 500000 + 0.01 AS p FROM orders)""")
def e15(spark, sf):
    return WT.mean_one(shifted(spark, sf), "p", "w").select("o_orderkey", F.round("w", 9).alias("w"))


@query("E16_tempered_weights", """
SELECT o_orderkey, round(pow(p, 0.25) / avg(pow(p, 0.25)) OVER (), 9) AS w FROM (SELECT o_orderkey, o_totalprice / 500000 + 0.01 AS p FROM orders)""")
def e16(spark, sf):
    return WT.mean_one(shifted(spark, sf), "p", "w", DEFAULTS.transfer_alpha).select("o_orderkey", F.round("w", 9).alias("w"))


@query("E17_weight_quantiles", """
SELECT round(quantile_cont(v, 0.1), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q5, round(quantile_cont(v, 0.9), 6) AS q9, round(quantile_cont(v, 0.99), 6) AS q99
FROM (SELECT o_totalprice AS v FROM orders)""")
def e17(spark, sf):
    r = WT.quantiles(T.table(spark, sf, "orders").select("o_totalprice"), "o_totalprice", [0.1, 0.5, 0.9, 0.99])
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


OVERUSED = r"""
WITH w AS (SELECT string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM conversations),
b AS (SELECT w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
SELECT bigram, n FROM (SELECT bigram, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, bigram LIMIT 20) WHERE n >= 3"""


@query("E18_overused_bigrams", OVERUSED)
def e18(spark, sf):
    rows = T.table(spark, sf, "conversations").select(F.explode(bigrams(F.col("text"))).alias("bigram"))
    return RS.overused_bigrams(rows)


@query("E19_run_manifest", q("plays vmeta", """
SELECT 'plays' AS stage, count(*) AS n_rows, count(item_id) AS n_keyed FROM plays
UNION ALL SELECT 'vectors', count(*), count(item_id) FROM vmeta"""))
def e19(spark, sf):
    m = EV.run_manifest(T.plays(spark, sf), "plays", "item_id").unionByName(
        EV.run_manifest(T.raw_vectors(spark, sf), "vectors", "item_id"))
    return m.drop("built_at")


@query("E20_duplicate_ids", """
SELECT 'part' AS source, count(*) AS n_rows, count(DISTINCT p_partkey) AS n_ids, count(*) = count(DISTINCT p_partkey) AS unique_ids FROM part
UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_partkey), count(*) = count(DISTINCT l_partkey) FROM lineitem""")
def e20(spark, sf):
    a = EV.duplicate_ids(T.items(spark, sf)).withColumn("source", F.lit("part"))
    b = EV.duplicate_ids(T.table(spark, sf, "lineitem"), "l_partkey").withColumn("source", F.lit("lineitem"))
    return a.unionByName(b).select("source", "n_rows", "n_ids", "unique_ids")


@query("E21_oof_coverage", q("cases returned", "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM returned)"))
def e21(spark, sf):
    return EV.uncovered(T.cases(spark, sf), T.returned(spark, sf)).select("case_id")
