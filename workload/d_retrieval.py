"""D: retrieval operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from refrain.config import DEFAULTS
from refrain.lineage import cut
from refrain.operators import folds as FO, pairs as P, queries as Q, retrieval as R, sessions as S
from refrain.operators.joins import growing
from refrain.operators.topk import by_score
from refrain.plans import serving
from refrain.sources.candidates import nested
from workload import tables as T
from workload.registry import query
from workload.sql import DOC_TEXT, ITEM_TEXT, SOURCE_NEEDS, SOURCE_SQL, bm25, dot, encoded, ensemble, masked, max_recent, neighbours, q, session_vecs, words

PARTS_DOCS = f"SELECT item_id, {DOC_TEXT} AS text FROM items"
DOCS = "SELECT cast(doc_id AS varchar) AS item_id, text FROM documents"
ASKED = "SELECT cast(item_id AS varchar) AS query_id, text, 1 AS times FROM benchmark"


def documents(spark, sf):
    return T.table(spark, sf, "documents").select(T.text_id("doc_id").alias("item_id"), "text")


def asked(spark, sf):
    return T.table(spark, sf, "benchmark").select(T.text_id("item_id").alias("query_id"), "text", F.lit(1).alias("times"))


def out(ranked, key="case_id"):
    return ranked.select(key, "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("D1_bm25_index", q("items", f"""
WITH d AS MATERIALIZED (SELECT item_id, {words('text')} AS ws FROM ({PARTS_DOCS} UNION ALL {DOCS.replace("cast(doc_id AS varchar)", "'d' || doc_id")}) x),
w AS (SELECT item_id, len(ws) AS dl, unnest(ws) AS term FROM d)
SELECT term, count(DISTINCT item_id) AS df, count(*) AS cf, cast(sum(dl) AS bigint) AS dl_sum FROM w GROUP BY 1"""))
def d1(spark, sf):
    docs = documents(spark, sf).withColumn("item_id", F.concat(F.lit("d"), "item_id")).unionByName(serving.documents(T.items(spark, sf)))
    post = R.lexical_index(docs)
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.col("tf") * F.col("dl")).alias("dl_sum"))


@query("D2_bm25_retrieve", bm25(ASKED, DOCS, 10))
def d2(spark, sf):
    return out(R.bm25(R.terms_of(asked(spark, sf)), T.document_index(spark, sf), 10), "query_id")


TALK = "SELECT conv_id || ':' || turn AS query_id, text, 1 AS times FROM conversations WHERE role = 'user'"


@query("D3_bm25_batch", bm25(TALK, DOCS, 500))
def d3(spark, sf):
    talk = T.table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text", F.lit(1).alias("times"))
    return out(R.bm25(R.terms_of(talk), T.document_index(spark, sf), DEFAULTS.train_bm25_topk), "query_id")


@query("D4_src_bm25", q(SOURCE_NEEDS, f"""
SELECT 'bm25_lastmusic' AS source, case_id, item_id, score, rank FROM ({SOURCE_SQL['bm25_lastmusic']})
UNION ALL SELECT 'bm25_convo', case_id, item_id, score, rank FROM ({SOURCE_SQL['bm25_convo']})"""))
def d4(spark, sf):
    c = T.corpus(spark, sf)
    docs = T.catalog_index(spark, sf)
    last = R.bm25(R.terms_of(Q.last_item_parts(c.cases, c.plays, c.items)), docs, 100)
    talk = R.bm25(R.terms_of(Q.conversation_parts(c.cases, c.said, c.plays, c.items)), docs, 100)
    both = last.withColumn("source", F.lit("bm25_lastmusic")).unionByName(talk.withColumn("source", F.lit("bm25_convo")))
    return both.select("source", F.col("query_id").alias("case_id"), "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def recent(spark, sf, space, k, n):
    return out(R.max_recent(serving.recent(T.corpus(spark, sf), k), T.vectors(spark, sf, space), k, n))


@query("D5_max_recent", q("plays vmeta", max_recent("vmeta", 5, 200)))
def d5(spark, sf):
    return recent(spark, sf, "metadata", DEFAULTS.train_recent_k, DEFAULTS.train_topk)


@query("D6_metadata_recent", q("plays vmeta", max_recent("vmeta", 3, 100)))
def d6(spark, sf):
    return recent(spark, sf, "metadata", 3, 100)


@query("D7_collab_recent", q("plays vcollab", max_recent("vcollab", 3, 100)))
def d7(spark, sf):
    return recent(spark, sf, "collab", 3, 100)


@query("D8_audio_recent", q("plays vaudio", max_recent("vaudio", 3, 100)))
def d8(spark, sf):
    return recent(spark, sf, "audio", 3, 100)


@query("D9_item_neighbours", q("vcollab", f"""
SELECT a.item_id AS anchor_id, b.item_id, round({dot('a.vec', 'b.vec')}, 6) AS score,
  row_number() OVER (PARTITION BY a.item_id ORDER BY round({dot('a.vec', 'b.vec')}, 12) DESC, b.item_id) AS rank
FROM vcollab a CROSS JOIN vcollab b WHERE a.item_id <> b.item_id QUALIFY rank <= 100"""))
def d9(spark, sf):
    v = T.vectors(spark, sf, "collab")
    near = R.item_neighbours(v, 101).where("anchor_id <> item_id").drop("rank")
    return out(by_score(near, "anchor_id", 100), "anchor_id")


@query("D10_last_neighbours", q("plays vmeta", neighbours("vmeta", 100)))
def d10(spark, sf):
    return out(R.last_neighbours(serving.last_anchor(T.corpus(spark, sf)), T.vectors(spark, sf, "metadata"), 100))


@query("D11_src_als", q("plays factors svec", masked("svec", "factors", 200)))
def d11(spark, sf):
    c = T.corpus(spark, sf)
    return out(R.session_topk(serving.session_vectors(c), c.factors, c.plays, 200))


@query("D12_als_newest", q("plays factors", f"""
WITH nv AS ({session_vecs(True, False)}) {masked('nv', 'factors', 200)}"""))
def d12(spark, sf):
    c = T.corpus(spark, sf)
    return out(R.session_topk(serving.session_vectors(c, weighting="newest", normalize=False), c.factors, c.plays, 200))


def text_queries(spark, sf):
    """Last three utterances of each case."""
    return Q.text_queries(T.dev_cases(spark, sf), S.utterances_of(T.turns(spark, sf)), DEFAULTS.text_query_turns).select(
        "case_id", "session_id", "text")


def catalog_texts(spark, sf):
    return P.item_texts(T.items(spark, sf)).select("item_id", F.col("item_text").alias("text"))


def played_before(spark, sf):
    """What a case's session played before its turn; the retriever never lists it."""
    cases = T.dev_cases(spark, sf).select("case_id", "session_id", F.col("turn_number").alias("_upto"))
    return S.plays_of(T.turns(spark, sf)).join(growing(cases), "session_id").where("turn_number < _upto").select("case_id", "item_id").distinct()


QUERY_TEXTS = """SELECT case_id, session_id, string_agg(content, ' ' ORDER BY pos) AS text FROM (
  SELECT c.case_id, c.session_id, t.content, t.pos, row_number() OVER (PARTITION BY c.case_id ORDER BY t.pos DESC) AS r
  FROM dev_cases c JOIN turns t ON t.session_id = c.session_id AND t.role = 'user' AND t.pos <= c.pos) WHERE r <= 3 GROUP BY 1, 2"""
BEFORE = """SELECT DISTINCT d.case_id, trim(t.content) AS item_id FROM dev_cases d JOIN turns t ON t.session_id = d.session_id
  WHERE t.role = 'music' AND t.turn_number < d.turn_number"""


def text_list_sql(queries: str, items: str, k: int) -> str:
    """``queries`` and ``items``: encoded, as id, dim, x; every item is ranked, also those that share no term."""
    return f"""SELECT case_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT c.case_id, i.item_id, round(coalesce(s.x, 0.0), 12) AS score FROM cs c CROSS JOIN items i
  LEFT JOIN (SELECT a.id AS case_id, b.id AS item_id, sum(a.x * b.x) AS x FROM ({queries}) a JOIN ({items}) b USING (dim) GROUP BY 1, 2) s
    ON s.case_id = c.case_id AND s.item_id = i.item_id
  WHERE NOT EXISTS (SELECT 1 FROM bf WHERE bf.case_id = c.case_id AND bf.item_id = i.item_id))) WHERE rank <= {k}"""


CATALOG = f"SELECT item_id AS id, {ITEM_TEXT} AS text FROM items"
QT = "SELECT case_id AS id, text FROM qt"


@query("D13_text_retriever", q("dev_cases turns items", f"""
WITH qt AS ({QUERY_TEXTS}), cs AS (SELECT case_id FROM qt), bf AS ({BEFORE})
{text_list_sql(encoded(QT, CATALOG), encoded(CATALOG, CATALOG), 300)}"""))
def d13(spark, sf):
    items = catalog_texts(spark, sf)
    queries = R.hashed_encoder(text_queries(spark, sf).drop("session_id"), items)
    return out(R.masked_topk(queries, R.hashed_encoder(items, items), DEFAULTS.text_topk, played_before(spark, sf)))


@query("D14_stored_lists", q("plays vfold", f"""
SELECT 'struct_base' AS source, case_id, item_id, score, rank, rank <= 200 AS listed FROM ({ensemble(300, True)})
UNION ALL SELECT 'struct_large', case_id, item_id, score, rank, rank <= 200 FROM ({ensemble(300, False)})"""))
def d14(spark, sf):
    stored = T.stored_lists(spark, sf)
    table = R.union_sources({k: stored[k] for k in ("struct_base", "struct_large")})
    return table.select("source", "case_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), (F.col("rank") <= 200).alias("listed"))


def _fold_sql(k: int) -> str:
    seen = f"SELECT case_id AS id, text FROM qt JOIN sess_folds USING (session_id) WHERE fold <> {k}"
    asked = f"SELECT case_id AS id, text FROM qt JOIN sess_folds USING (session_id) WHERE fold = {k}"
    lists = text_list_sql(encoded(asked, seen), encoded(CATALOG, seen), 200).replace("FROM cs c", f"FROM (SELECT * FROM cs WHERE fold = {k}) c")
    return f"SELECT {k} AS fold, case_id, item_id, rank FROM ({lists})"


@query("D15_heldout_lists", q("dev_cases turns items sess_folds", f"""
WITH qt AS ({QUERY_TEXTS}), cs AS (SELECT case_id, fold FROM qt JOIN sess_folds USING (session_id)), bf AS ({BEFORE})
{' UNION ALL '.join(_fold_sql(k) for k in range(5))}"""))
def d15(spark, sf):
    """Each fold's encoder is fitted on the texts of the other folds and lists only the cases it has not seen."""
    cases = cut(FO.with_folds(text_queries(spark, sf)))
    played, lists = cut(played_before(spark, sf)), None
    weights = cut(R.held_out_weights(cases.select("fold", "text"), DEFAULTS.folds))
    asked = cut(R.held_out_encoder(cases.select("case_id", F.col("fold").cast("int").alias("fold"), "text"), weights))
    items = cut(R.held_out_encoder(catalog_texts(spark, sf), weights))
    for k in range(DEFAULTS.folds):
        of = lambda df: df.where(F.col("fold") == k).drop("fold")
        part = R.masked_topk(of(asked), of(items), DEFAULTS.train_topk, played).withColumn("fold", F.lit(k))
        lists = part if lists is None else lists.unionByName(part)
    return lists.select("fold", "case_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("D16_masked_with_score", q("plays lastvec vcollab", masked("lastvec", "vcollab", 300)))
def d16(spark, sf):
    return out(R.masked_topk(T.last_vectors(spark, sf), T.vectors(spark, sf, "collab"), 300, T.plays(spark, sf)))


@query("D17_unmasked_topk", q("plays lastvec vcollab", masked("lastvec", "vcollab", 300, mask=False)))
def d17(spark, sf):
    return out(R.masked_topk(T.last_vectors(spark, sf), T.vectors(spark, sf, "collab"), 300))


@query("D18_ensemble_masked", q("plays vfold", ensemble(300, True)))
def d18(spark, sf):
    return out(R.fold_ensemble(T.fold_queries(spark, sf), T.fold_vectors(spark, sf), 5, 300, T.plays(spark, sf)))


@query("D19_ensemble_unmasked", q("plays vfold", ensemble(300, False)))
def d19(spark, sf):
    return out(R.fold_ensemble(T.fold_queries(spark, sf), T.fold_vectors(spark, sf), 5, 300))


@query("D20_nested_record", q("cands", """
SELECT case_id, string_agg(source || '=' || ids, ';' ORDER BY source) AS lists FROM (
  SELECT case_id, source, string_agg(item_id, ',' ORDER BY rank) AS ids FROM cands GROUP BY 1, 2) GROUP BY 1"""))
def d20(spark, sf):
    lists = candidates(spark, sf)
    entry = F.transform(F.array_sort(F.map_entries("lists")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return nested(lists).select("case_id", F.array_join(entry, ";").alias("lists"))


@T.staged("candidates")
def candidates(spark, sf):
    return serving.retrieve(replace(T.corpus(spark, sf), lexical=T.catalog_index(spark, sf)), stored=T.stored_lists(spark, sf))


@query("D21_all_sources", q("cands", "SELECT case_id, source, source_ord, rank, item_id, score FROM cands"))
def d21(spark, sf):
    return serving.retrieve(replace(T.corpus(spark, sf), lexical=T.catalog_index(spark, sf)), stored=T.stored_lists(spark, sf)).select(
        "case_id", "source", "source_ord", "rank", "item_id", F.round("score", 6).alias("score"))
