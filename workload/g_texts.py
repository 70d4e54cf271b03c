"""G: set operations and text-table construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.config import DEFAULTS
from refrain.operators import pairs as P, queries as Q, sessions as S
from refrain.operators.features import item_features
from workload import tables as T
from workload.registry import query
from workload.sql import ITEM_TEXT, SHORT_REF, inter, meta, q


@query("G1_id_union", q("scored plays", "SELECT item_id FROM scored WHERE pool_pos <= 1 UNION SELECT item_id FROM plays WHERE pos = 1"))
def g1(spark, sf):
    a = T.scored(spark, sf).where("pool_pos <= 1").select("item_id")
    return a.union(T.plays(spark, sf).where("pos = 1").select("item_id")).distinct()


@query("G2_query_parts", q("last_parts convo_parts", """
SELECT 'last' AS mode, query_id, text, cast(sum(times) AS bigint) AS times FROM last_parts WHERE text <> '' GROUP BY ALL
UNION ALL SELECT 'full', query_id, text, cast(sum(times) AS bigint) FROM convo_parts WHERE text <> '' GROUP BY ALL"""))
def g2(spark, sf):
    c = T.corpus(spark, sf)
    last = Q.last_item_parts(c.cases, c.plays, c.items).withColumn("mode", F.lit("last"))
    full = Q.conversation_parts(c.cases, c.said, c.plays, c.items).withColumn("mode", F.lit("full"))
    return last.where("text <> ''").unionByName(full).groupBy("mode", "query_id", "text").agg(F.sum("times").alias("times"))


@query("G3_set_sizes", q("feats", f"SELECT item_id, {inter('tags', 'meta_toks')} AS n_both, len(tags) + len(meta_toks) - {inter('tags', 'meta_toks')} AS n_any FROM feats"))
def g3(spark, sf):
    f = item_features(T.items(spark, sf))
    return f.select("item_id", F.size(F.array_intersect("tags", "meta_toks")).cast("long").alias("n_both"),
                    F.size(F.array_union("tags", "meta_toks")).cast("long").alias("n_any"))


@query("G4_last_albums", q("plays items", """
SELECT case_id, string_agg(DISTINCT album, ',' ORDER BY album) AS albums FROM (
  SELECT case_id, coalesce(album_id[1], '') AS album FROM plays JOIN items USING (item_id) WHERE pos > pos_total - 3) WHERE album <> '' GROUP BY 1"""))
def g4(spark, sf):
    albums = T.items(spark, sf).select("item_id", F.coalesce(F.try_element_at("album_id", F.lit(1)), F.lit("")).alias("album"))
    last = T.plays(spark, sf).where("pos > pos_total - 3").join(albums, "item_id")
    sets = last.groupBy("case_id").agg(F.array_sort(F.array_except(F.collect_set("album"), F.array(F.lit("")))).alias("a"))
    return sets.where(F.size("a") > 0).select("case_id", F.array_join("a", ",").alias("albums"))


@query("G5_query_text", q("dev_cases turns", """
SELECT case_id, string_agg(content, ' ' ORDER BY pos) AS text FROM (
  SELECT c.case_id, t.content, t.pos, row_number() OVER (PARTITION BY c.case_id ORDER BY t.pos DESC) AS r
  FROM dev_cases c JOIN turns t ON t.session_id = c.session_id AND t.role = 'user' AND t.pos <= c.pos) WHERE r <= 3 GROUP BY 1"""))
def g5(spark, sf):
    return Q.text_queries(T.dev_cases(spark, sf), S.utterances_of(T.turns(spark, sf)), DEFAULTS.text_query_turns).select("case_id", "text")


def structured_sql(cases: str, history: int) -> str:
    """``cases``: case_id, session_id, user_query, cut (utterances and plays before this position count)."""
    return f"""
SELECT c.case_id, '[QUERY] ' || user_query || coalesce(' [HISTORY] ' || (
    SELECT string_agg(content, ' ' ORDER BY pos) FROM (SELECT content, pos FROM turns t WHERE t.session_id = c.session_id AND role = 'user' AND t.pos < c.user_cut ORDER BY pos DESC LIMIT {history})), '')
  || coalesce(' [CONTEXT] ' || (SELECT string_agg({SHORT_REF}, '; ' ORDER BY pos) FROM (
    SELECT trim(content) AS item, pos FROM turns t WHERE t.session_id = c.session_id AND role = 'music' AND t.pos < c.cut ORDER BY pos DESC LIMIT 5) JOIN items ON item_id = item), '') AS query
FROM ({cases}) c"""


DEV_STRUCT = structured_sql("SELECT case_id, session_id, user_query, pos AS cut, pos AS user_cut FROM dev_cases", 3)


@query("G6_structured_query", q("dev_cases turns items", DEV_STRUCT))
def g6(spark, sf):
    t = T.turns(spark, sf)
    return P.structured_queries(T.dev_cases(spark, sf), S.utterances_of(t), S.plays_of(t), T.items(spark, sf)).select("case_id", "query")


TRAIN_CASES = """
SELECT session_id || ':' || pos AS case_id, session_id, trim(content) AS item_id, pos AS cut,
  (SELECT max(pos) FROM turns u WHERE u.session_id = t.session_id AND u.role = 'user' AND u.pos < t.pos) AS user_cut,
  (SELECT arg_max(content, pos) FROM turns u WHERE u.session_id = t.session_id AND u.role = 'user' AND u.pos < t.pos) AS user_query
FROM turns t WHERE role = 'music' AND trim(content) IN (SELECT item_id FROM items)"""


@query("G7_train_structured_query", q("turns items", "WITH tc AS (" + TRAIN_CASES + ") " + structured_sql("SELECT * FROM tc WHERE user_query IS NOT NULL", 2)))
def g7(spark, sf):
    return P.train_pairs(T.turns(spark, sf), T.items(spark, sf)).select("case_id", "query")


@query("G8_track_text", q("items", f"SELECT item_id, {ITEM_TEXT} AS item_text FROM items"))
def g8(spark, sf):
    return P.item_texts(T.items(spark, sf))


@query("G9_short_ref", q("items", f"SELECT item_id, {SHORT_REF} AS ref FROM items"))
def g9(spark, sf):
    return P.refs(T.items(spark, sf))


@query("G10_meta_text", q("items", f"SELECT item_id, {meta(True)} AS titled, {meta(False)} AS untitled FROM items"))
def g10(spark, sf):
    i = T.items(spark, sf)
    return Q.item_meta(i, True).withColumnRenamed("meta", "titled").join(Q.item_meta(i, False).withColumnRenamed("meta", "untitled"), "item_id")
