"""B: projections, filters, session parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.functions.text import first
from refrain.operators import features as FE, pairs as P, responses as RS, sessions as S
from refrain.operators.folds import held_in, held_out, with_folds
from workload import tables as T
from workload.registry import query
from workload.sql import q


@query("B1_parse_last_turn", q("turns last_req", """
SELECT l.session_id, l.turn_number, l.user_query,
  (SELECT count(*) FROM turns t WHERE t.session_id = l.session_id AND t.turn_number < l.turn_number) AS n_history,
  coalesce((SELECT string_agg(role || ':' || content, chr(10) ORDER BY turn_number, pos) FROM turns t WHERE t.session_id = l.session_id AND t.turn_number < l.turn_number), '') AS history
FROM last_req l"""))
def b1(spark, sf):
    t = T.turns(spark, sf)
    cases = S.last_requests(t)
    nested = S.nest_history(S.history(t, cases))
    lines = F.transform("history", lambda h: F.concat_ws(":", h["role"], h["content"]))
    return cases.join(nested, "session_id", "left").select(
        "session_id", "turn_number", "user_query", F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("n_history"),
        F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("history"))


@query("B2_music_turns", q("turns last_req", """
SELECT t.session_id, trim(content) AS item_id, row_number() OVER (PARTITION BY t.session_id ORDER BY t.turn_number, t.pos) AS play_pos
FROM turns t JOIN last_req l ON l.session_id = t.session_id AND t.turn_number < l.turn_number WHERE role = 'music'"""))
def b2(spark, sf):
    t = T.turns(spark, sf)
    return S.plays_of(S.history(t, S.last_requests(t))).select("session_id", "item_id", "play_pos")


@query("B3_listener_goal", """
SELECT cast(c_custkey AS varchar) AS session_id, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS listener_goal FROM customer""")
def b3(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    goal = F.when(F.col("c_acctbal") >= 0, F.struct(F.col("c_mktsegment").alias("listener_goal")))
    c = c.withColumn("conversation_goal", goal)
    return c.select(T.text_id("c_custkey").alias("session_id"), S.listener_goal(F.col("conversation_goal")).alias("listener_goal"))


@query("B4_assess_map", """
SELECT session_id, string_agg(turn_number || '=' || assessment, ',' ORDER BY turn_number) AS assess FROM (
  SELECT cast(o_custkey AS varchar) AS session_id, cast(year(o_orderdate) AS int) AS turn_number, arg_max(o_orderstatus, o_orderkey) AS assessment
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2) GROUP BY 1""")
def b4(spark, sf):
    rows = T.table(spark, sf, "orders").select(
        T.text_id("o_custkey").alias("session_id"), F.year("o_orderdate").alias("turn_number"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("assessment"), F.col("o_orderkey").alias("pos"))
    maps = S.assessment_maps(rows)
    pairs = F.transform(F.array_sort(F.map_entries("assess")), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"]))
    return maps.select("session_id", F.array_join(pairs, ",").alias("assess"))


@query("B5_dev_cases", q("dev_cases", "SELECT case_id, session_id, user_id, turn_number, user_query, gt, n_prior_music, n_prior_user FROM dev_cases"))
def b5(spark, sf):
    return S.dev_cases(T.turns(spark, sf)).select(
        "case_id", "session_id", "user_id", "turn_number", "user_query", "gt", "n_prior_music", "n_prior_user")


@query("B6_ground_truth", q("turns", """
WITH m AS (SELECT *, trim(content) AS item FROM turns WHERE role = 'music'),
us AS (SELECT session_id, user_id, turn_number, arg_max(item, pos) AS gt FROM m WHERE user_id IS NOT NULL GROUP BY ALL),
ss AS (SELECT session_id, turn_number, arg_max(item, pos) AS gt FROM m GROUP BY ALL)
SELECT u.session_id, u.turn_number, coalesce(us.gt, ss.gt) AS gt FROM (SELECT * FROM turns WHERE role = 'user') u
LEFT JOIN us ON us.session_id = u.session_id AND us.user_id = u.user_id AND us.turn_number = u.turn_number
LEFT JOIN ss ON ss.session_id = u.session_id AND ss.turn_number = u.turn_number WHERE coalesce(us.gt, ss.gt) <> ''"""))
def b6(spark, sf):
    t = T.turns(spark, sf)
    users = t.where("role = 'user'").select("session_id", "user_id", "turn_number")
    return S.lookup_gold(users, t).select("session_id", "turn_number", "gt")


@query("B7_track_albums", q("items", "SELECT item_id, coalesce(album_id[1], album_name[1], '') AS album_key FROM items"))
def b7(spark, sf):
    return T.items(spark, sf).select("item_id", FE.album_key(F.col("album_id"), F.col("album_name")).alias("album_key"))


@query("B8_first_value", q("items", "SELECT item_id, coalesce(track_name[1], '') AS track_name, coalesce(album_id[1], '') AS album_id FROM items"))
def b8(spark, sf):
    return T.items(spark, sf).select("item_id", first(F.col("track_name")).alias("track_name"), first(F.col("album_id")).alias("album_id"))


@query("B9_smoke_limit", q("dev_cases", "SELECT case_id, gt FROM dev_cases ORDER BY case_id LIMIT 50"))
def b9(spark, sf):
    return T.dev_cases(spark, sf).select("case_id", "gt").orderBy("case_id").limit(50)


@query("B10_restricted_catalog", q("scored feats returned", """
SELECT item_id, artist_key, album_key FROM feats WHERE item_id IN (
  SELECT item_id FROM scored WHERE pool_pos <= 2 UNION SELECT item_id FROM returned)"""))
def b10(spark, sf):
    lists = T.scored(spark, sf).select("item_id", F.col("pool_pos").alias("rank"), F.lit("bm25_lastmusic").alias("source"))
    feats = FE.item_features(T.items(spark, sf))
    return FE.restrict_items(feats, lists, T.returned(spark, sf), {"bm25_lastmusic": 2}).select("item_id", "artist_key", "album_key")


@query("B11_in_catalog", q("plays vmeta", "SELECT case_id, pos, item_id FROM plays WHERE item_id IN (SELECT item_id FROM vmeta)"))
def b11(spark, sf):
    return P.known_items(T.plays(spark, sf), T.vectors(spark, sf, "metadata")).select("case_id", "pos", "item_id")


@query("B12_dev_exclusion", q("plays", """
WITH dev AS (SELECT DISTINCT cast(conv_id AS varchar) AS s FROM conversations)
SELECT case_id AS session_id, count(*) AS n_plays, (SELECT count(DISTINCT case_id) FROM plays WHERE case_id IN (SELECT s FROM dev)) AS n_overlap
FROM plays WHERE case_id NOT IN (SELECT s FROM dev) GROUP BY 1"""))
def b12(spark, sf):
    p = T.plays(spark, sf).select(F.col("case_id").alias("session_id"), "item_id")
    dev = T.table(spark, sf, "conversations").select(T.text_id("conv_id").alias("session_id"))
    kept = P.without_sessions(p, dev).groupBy("session_id").agg(F.count("*").alias("n_plays"))
    return kept.withColumn("n_overlap", P.overlap_count(p, dev).scalar())


@query("B13_fold_predicate", q("dev_cases sess_folds", """
SELECT case_id, fold, 'out' AS side FROM dev_cases JOIN sess_folds USING (session_id) WHERE fold = 2
UNION ALL SELECT case_id, fold, 'in' FROM dev_cases JOIN sess_folds USING (session_id) WHERE fold <> 2"""))
def b13(spark, sf):
    c = with_folds(T.dev_cases(spark, sf)).select("case_id", "fold")
    return held_out(c, 2).withColumn("side", F.lit("out")).unionByName(held_in(c, 2).withColumn("side", F.lit("in")))


@query("B14_empty_responses", "SELECT count(*) FILTER (trim(coalesce(nullif(role, 'system'), '')) = '') AS n_empty FROM conversations")
def b14(spark, sf):
    r = T.table(spark, sf, "conversations").select(
        F.when(F.col("role") == "system", F.lit("  ")).otherwise(F.col("role")).alias("predicted_response"))
    return RS.empty_responses(r)
