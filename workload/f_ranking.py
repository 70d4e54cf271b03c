"""F: windows, ranking, sorts, limits."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from refrain.config import DEFAULTS
from refrain.operators import pairs as P, ranking as RK, retrieval as R, sessions as S
from refrain.operators.fusion import weighted_rrf
from refrain.operators.features import play_popularity, recency_weights
from refrain.operators.folds import session_folds
from refrain.operators.topk import by_score, last_k_array, ordered_list, top_k
from refrain.plans import serving
from workload import tables as T
from workload.registry import query
from workload.sql import max_recent, q, rrf


@query("F1_rank_numbers", q("scored", "SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY s_large DESC, item_id) AS rank FROM scored"))
def f1(spark, sf):
    s = T.scored(spark, sf).withColumn("score", F.col("s_large"))
    return by_score(s, "case_id", DEFAULTS.pool_k).select("case_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("F2_partial_topk", """
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5""")
def f2(spark, sf):
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select(
        "o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("F3_last_k", q("plays", """
SELECT case_id, string_agg(item_id, ',' ORDER BY pos DESC) AS items FROM plays WHERE pos > pos_total - 5 GROUP BY 1"""))
def f3(spark, sf):
    return last_k_array(T.plays(spark, sf), "case_id", [F.desc("pos")], 5, "item_id", "items").select(
        "case_id", F.array_join("items", ",").alias("items"))


@query("F4_recency_weights", q("plays", "SELECT case_id, item_id, round(sum(1.0 / (pos_total - pos + 1)), 9) AS w FROM plays GROUP BY 1, 2"))
def f4(spark, sf):
    return recency_weights(T.plays(spark, sf)).select("case_id", "item_id", F.round("w", 9).alias("w"))


@query("F5_geometric_decay", q("plays factors", """
WITH k AS (SELECT p.case_id, p.item_id, p.pos, row_number() OVER (PARTITION BY p.case_id ORDER BY p.pos) AS rn, count(*) OVER (PARTITION BY p.case_id) AS n
  FROM plays p SEMI JOIN factors f ON f.item_id = p.item_id)
SELECT case_id, item_id, round(sum(o), 9) AS w_oldest, round(sum(nw), 9) AS w_newest FROM (
  SELECT case_id, item_id, pow(0.8, rn - 1) / sum(pow(0.8, rn - 1)) OVER (PARTITION BY case_id) AS o,
    pow(0.8, n - rn) / sum(pow(0.8, n - rn)) OVER (PARTITION BY case_id) AS nw FROM k) GROUP BY 1, 2"""))
def f5(spark, sf):
    known = serving.factor_plays(T.corpus(spark, sf))
    w = R.decay_weights(R.decay_weights(known, "oldest", out="o"), "newest", out="n")
    totals = w.groupBy("case_id").agg(F.sum("o").alias("so"), F.sum("n").alias("sn"))
    per = w.groupBy("case_id", "item_id").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    return per.join(totals, "case_id").select("case_id", "item_id", F.round(F.col("o") / F.col("so"), 9).alias("w_oldest"),
                                              F.round(F.col("n") / F.col("sn"), 9).alias("w_newest"))


@query("F6_running_context", q("turns", """
WITH f AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS nu, sum(CASE WHEN role = 'music' THEN 1 ELSE 0 END) OVER w AS nm,
  last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w AS last_user
  FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, pos, trim(content) AS item_id, cast(nu AS bigint) AS n_user, cast(nm - 1 AS bigint) AS n_prior_music, last_user
FROM f WHERE role = 'music' AND nu > 0"""))
def f6(spark, sf):
    t = T.turns(spark, sf)
    said = S.stored_order(t, "user", "n_user", "last_user")
    return S.train_transitions(t).join(said, ["session_id", "n_user"]).select(
        "session_id", "pos", "item_id", "n_user", "n_prior_music", "last_user")


MARGIN = """m AS (SELECT case_id, coalesce(max(CASE WHEN r = 1 THEN s_base END) - max(CASE WHEN r = 2 THEN s_base END), 0.0) AS margin FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s_base DESC, pool_pos) AS r FROM scored) GROUP BY 1)"""
ROUTED = MARGIN + """, routed AS (SELECT s.*, margin, margin < 0.25 OR margin >= 1.5 AS used_large,
  CASE WHEN margin < 0.25 OR margin >= 1.5 THEN s_large ELSE s_base END AS s_routed FROM scored s JOIN m USING (case_id))"""
Z = ("CASE WHEN stddev_pop({0}) OVER (PARTITION BY case_id) > 1e-9 THEN ({0} - avg({0}) OVER (PARTITION BY case_id)) "
     "/ stddev_pop({0}) OVER (PARTITION BY case_id) ELSE 0.0 END")
NN = "(CASE WHEN isnan(s_second) THEN NULL ELSE s_second END)"
FINAL = ROUTED + f""", raw AS (SELECT *, {Z.format('s_routed')} + coalesce({Z.format(NN)}, 0.0) AS blend FROM routed),
blended AS (SELECT *, round(blend, 12) AS final FROM raw),
kept AS (SELECT * FROM blended b WHERE NOT EXISTS (SELECT 1 FROM returned r WHERE r.case_id = b.case_id AND r.item_id = b.item_id)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY final DESC, pool_pos) AS rank FROM kept)"""


@query("F7_margin", q("scored", f"WITH {MARGIN} SELECT case_id, round(margin, 6) AS margin FROM m"))
def f7(spark, sf):
    return RK.margins(T.scored(spark, sf)).select("case_id", F.round("margin", 6).alias("margin"))


@query("F8_selective_routing", q("scored", f"WITH {ROUTED} SELECT case_id, item_id, used_large, round(s_routed, 6) AS s_routed FROM routed"))
def f8(spark, sf):
    return RK.with_route(T.scored(spark, sf)).select("case_id", "item_id", "used_large", F.round("s_routed", 6).alias("s_routed"))


@query("F9_zscore", q("scored", f"SELECT case_id, item_id, round({Z.format('s_base')}, 6) AS z FROM scored"))
def f9(spark, sf):
    return T.scored(spark, sf).select("case_id", "item_id", F.round(RK.zscore(F.col("s_base")), 6).alias("z"))


@query("F10_zscore_nan", q("scored", f"SELECT case_id, item_id, round(coalesce({Z.format(NN)}, 0.0), 6) AS z FROM scored"))
def f10(spark, sf):
    return T.scored(spark, sf).select("case_id", "item_id", F.round(RK.zscore_nan(F.col("s_second")), 6).alias("z"))


@query("F11_blend", q("scored returned", f"WITH {FINAL} SELECT case_id, item_id, round(blend, 6) AS final FROM blended"))
def f11(spark, sf):
    # Rounded once, on either side.
    return RK.blended(RK.with_route(T.scored(spark, sf))).select("case_id", "item_id", F.round("final", 6).alias("final"))


@query("F12_score_route_full", q("scored returned", f"WITH {FINAL} SELECT case_id, item_id, rank FROM ordered"))
def f12(spark, sf):
    return RK.rank_full(T.scored(spark, sf), T.returned(spark, sf)).select("case_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("F13_top20", q("scored returned", f"WITH {FINAL} SELECT case_id, item_id, rank FROM ordered WHERE rank <= 20"))
def f13(spark, sf):
    return RK.rank_top(T.scored(spark, sf), T.returned(spark, sf)).select("case_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("F13_flagship_top20", q("plays vmeta returned", f"""
WITH near AS ({max_recent('vmeta', 3, 100)}),
pop AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS rank FROM (SELECT item_id, count(*) AS n FROM plays GROUP BY 1) QUALIFY rank <= 100),
fc AS (SELECT case_id, 'qwen_recent' AS source, 0 AS source_ord, rank, item_id FROM near
  UNION ALL SELECT DISTINCT p.case_id, 'struct_large', 8, pop.rank, pop.item_id FROM (SELECT DISTINCT case_id FROM plays) p CROSS JOIN pop),
pl AS ({rrf('fc', weights={'qwen_recent': 1.0, 'struct_large': 0.5})})
SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY pool_pos) AS rank FROM pl s
WHERE NOT EXISTS (SELECT 1 FROM plays r WHERE r.case_id = s.case_id AND r.item_id = s.item_id) QUALIFY rank <= 20"""))
def f13_flagship(spark, sf):
    c = T.corpus(spark, sf)
    near = R.max_recent(serving.recent(c, 3), c.spaces["metadata"], 3, 100)
    # Popular items form one shared list of 100, so giving it to every case is a bounded broadcast.
    pop = play_popularity(c.plays).orderBy(F.desc("plays"), "item_id").limit(100)
    pop = pop.agg(F.array_sort(F.collect_list(F.struct((-F.col("plays")).alias("o"), "item_id"))).alias("l")).scalar()
    every = c.plays.select("case_id").distinct().select("case_id", F.posexplode(pop).alias("p", "s")).select(
        "case_id", (F.col("p") + 1).alias("rank"), F.col("s.item_id").alias("item_id"), F.lit(None).cast("double").alias("score"))
    lists = R.union_sources({"qwen_recent": near, "struct_large": every})
    pool = weighted_rrf(lists, {"qwen_recent": 1.0, "struct_large": 0.5})
    left = RK.mask_played(pool, c.plays)
    return top_k(left, ["case_id"], [F.asc("pool_pos")], 20).select("case_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("F14_round_robin_folds", q("cust_folds", "SELECT session_id, fold FROM cust_folds"))
def f14(spark, sf):
    return session_folds(T.cases(spark, sf).select(F.col("case_id").alias("session_id")))


@query("F15_session_order", q("last_req", "SELECT session_id, turn_number FROM last_req ORDER BY session_id"))
def f15(spark, sf):
    return S.last_requests(T.turns(spark, sf)).select("session_id", "turn_number").orderBy("session_id")


@query("F16_list_reassembly", q("scored returned", f"WITH {FINAL} SELECT case_id, string_agg(item_id, ',' ORDER BY rank) AS ids FROM ordered WHERE rank <= 20 GROUP BY 1"))
def f16(spark, sf):
    top = RK.rank_top(T.scored(spark, sf), T.returned(spark, sf))
    return RK.recommendations(top).select("case_id", F.array_join("predicted_track_ids", ",").alias("ids"))
