"""I: candidate features over the fused pool of every customer."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from refrain.config import LIVE_SOURCES, POOL_SOURCES_8, POOL_SOURCES_9, TRAINING
from refrain.operators import boosting as B, features as FE
from refrain.plans import serving
from workload import tables as T
from workload.d_retrieval import candidates
from workload.e_aggregates import IN8, IN9, gold_cases, pool_of
from workload.registry import query
from workload.sql import CTES, NEEDS, SOURCE_NEEDS, TRAINING_SQL, cte, dot, inter, jaccard, q, rrf, session_vecs, tokens

# Items the catalog lacks keep empty attributes.
EMPTY = "coalesce(artist_key, '') AS artist_key, coalesce(album_key, '') AS album_key, coalesce(tags, []) AS tags"
cte("pf", f"""SELECT pool.case_id, pool.item_id, pool_pos, {EMPTY}, coalesce(title_toks, []) AS title_toks, coalesce(artist_toks, []) AS artist_toks,
  coalesce(meta_toks, []) AS meta_toks FROM pool LEFT JOIN feats USING (item_id)""", "pool feats")
cte("hist", f"SELECT p.case_id, p.item_id, pos, pos_total, {EMPTY} FROM plays p LEFT JOIN feats USING (item_id)", "plays feats")
cte("tagj", """
SELECT a.item_id AS ia, b.item_id AS ib, count(*) AS c, any_value(a.n) + any_value(b.n) AS n
FROM (SELECT item_id, len(tags) AS n, unnest(tags) AS tag FROM feats) a JOIN (SELECT item_id, len(tags) AS n, unnest(tags) AS tag FROM feats) b USING (tag) GROUP BY 1, 2""", "feats")
cte("said_toks", f"""
SELECT DISTINCT case_id, unnest({tokens('content')}) AS token FROM (
  SELECT case_id, content FROM said UNION ALL SELECT case_id, user_query FROM cases)""", "said cases")
cte("f_ctx", f"""
WITH lp AS (SELECT * FROM hist WHERE pos = pos_total), nowt AS (SELECT case_id, {tokens('user_query')} AS toks FROM cases),
hw AS (SELECT *, cast(round(1e12 / (pos_total - pos + 1)) AS bigint) AS w FROM hist),
ra AS (SELECT case_id, artist_key, sum(w) AS w FROM hw WHERE artist_key <> '' GROUP BY 1, 2),
rs AS (SELECT case_id, any_value(item_id) AS item_id, sum(w)::double AS w FROM hw WHERE len(tags) > 0 GROUP BY case_id, tags),
rt AS (SELECT f.case_id, f.item_id, sum(cast(round(h.w * c / (tagj.n - c)) AS bigint)) AS r
  FROM pf f JOIN rs h USING (case_id) JOIN tagj ON ia = f.item_id AND ib = h.item_id GROUP BY 1, 2),
rec AS (SELECT f.case_id, f.item_id, (coalesce(ra.w, 0) + coalesce(rt.r, 0))::double / 1e12 AS r FROM pf f
  LEFT JOIN ra ON ra.case_id = f.case_id AND ra.artist_key = f.artist_key LEFT JOIN rt ON rt.case_id = f.case_id AND rt.item_id = f.item_id),
mt AS (SELECT f.case_id, f.item_id, count(*)::double AS n FROM (SELECT case_id, item_id, unnest(meta_toks) AS token FROM pf) f JOIN said_toks USING (case_id, token) GROUP BY 1, 2),
pl AS (SELECT DISTINCT case_id, item_id FROM plays)
SELECT f.case_id, f.item_id, f.pool_pos, round(1.0 / f.pool_pos, 9) AS rrf_rank_inv,
  CASE WHEN f.artist_key <> '' AND f.artist_key = lp.artist_key THEN 1.0::double ELSE 0.0::double END AS last_artist_match,
  round({jaccard('f.tags', "coalesce(lp.tags, [])")}, 9) AS last_tag_jaccard,
  {inter('f.artist_toks', 'nowt.toks')}::double AS query_artist_tok_overlap, {inter('f.title_toks', 'nowt.toks')}::double AS query_title_tok_overlap,
  coalesce(mt.n, 0.0) AS query_meta_tok_overlap, CASE WHEN pl.item_id IS NULL THEN 0.0::double ELSE 1.0::double END AS is_played,
  coalesce(rec.r, 0.0) AS recency_score, coalesce(lp.pos_total, 0)::double AS n_history
FROM pf f LEFT JOIN lp ON lp.case_id = f.case_id LEFT JOIN nowt ON nowt.case_id = f.case_id LEFT JOIN rec ON rec.case_id = f.case_id AND rec.item_id = f.item_id
LEFT JOIN mt ON mt.case_id = f.case_id AND mt.item_id = f.item_id LEFT JOIN pl ON pl.case_id = f.case_id AND pl.item_id = f.item_id""",
    "pf hist tagj said_toks cases plays")
_PIVOT = ", ".join(f"min(CASE WHEN source = '{s}' THEN rank END) AS r_{c}" for c, s in {**LIVE_SOURCES, "text": "text_retriever"}.items())
_LIVE = list(LIVE_SOURCES)
cte("f_src", f"""
SELECT p.case_id, p.item_id, {', '.join(f"round(coalesce(1.0 / r_{c}, 0.0), 9) AS src_{c}_rank_inv, (r_{c} IS NOT NULL)::int::double AS src_{c}_pres" for c in _LIVE)},
  ({' + '.join(f"(r_{c} IS NOT NULL)::int" for c in _LIVE)})::double AS n_sources, ({' + '.join(f"(r_{c} IS NOT NULL)::int" for c in _LIVE)})::double AS source_count_v2,
  round(coalesce(1.0 / r_text, 0.0), 9) AS r21_rank_inv, (r_text IS NOT NULL)::int::double AS r21_presence
FROM pool p LEFT JOIN (SELECT case_id, item_id, {_PIVOT} FROM cands GROUP BY 1, 2) c ON c.case_id = p.case_id AND c.item_id = p.item_id""", "pool cands")
cte("f_glob", f"""
WITH pop AS (SELECT item_id, count(*) AS n FROM plays GROUP BY 1)
SELECT f.case_id, f.item_id, round(coalesce({dot('s.vec', 'a.vec')}, 0.0), 6) AS als_dot, round(coalesce(pop.n, 0) / (SELECT max(n)::double FROM pop), 9) AS popularity,
  CASE WHEN artist_key <> '' THEN (count(*) OVER (PARTITION BY f.case_id, artist_key))::double ELSE 0.0 END AS pool_artist_count,
  round(CASE WHEN artist_key <> '' THEN (count(*) OVER (PARTITION BY f.case_id, artist_key))::double / count(*) OVER (PARTITION BY f.case_id) ELSE 0.0 END, 9) AS pool_artist_frac
FROM pf f LEFT JOIN svec s ON s.case_id = f.case_id LEFT JOIN factors a ON a.item_id = f.item_id LEFT JOIN pop ON pop.item_id = f.item_id""", "pf svec factors plays")
cte("f_alb", """
WITH al AS (SELECT case_id, album_key, count(*) AS n, max(pos > pos_total - 3) AS l3, max(pos = pos_total) AS l1, max(pos_total) AS tot FROM hist WHERE album_key <> '' GROUP BY 1, 2)
SELECT f.case_id, f.item_id, coalesce(l1, false)::int::double AS same_album_last1, coalesce(l3, false)::int::double AS same_album_last3,
  (n IS NOT NULL)::int::double AS same_album_any, round(coalesce(n::double / tot, 0.0), 9) AS album_history_count,
  round(CASE WHEN f.album_key <> '' THEN (count(*) OVER (PARTITION BY f.case_id, f.album_key))::double / count(*) OVER (PARTITION BY f.case_id) ELSE 0.0 END, 9) AS pool_same_album_count
FROM pf f LEFT JOIN al ON al.case_id = f.case_id AND al.album_key = f.album_key""", "pf hist")
cte("f_trip", """
SELECT p.case_id, p.item_id, round(coalesce(1.0 / b.rank, 0.0), 9) AS r54_rank_inv, (b.rank IS NOT NULL)::int::double AS r54_presence, round(coalesce(b.score, 0.0), 6) AS r54_cosine,
  round(coalesce(l.rank, 0.0), 9) AS _unused, round(coalesce(1.0 / l.rank, 0.0), 9) AS r84_rank_inv, (l.rank IS NOT NULL)::int::double AS r84_presence, round(coalesce(l.score, 0.0), 6) AS r84_cosine
FROM pool p LEFT JOIN (SELECT * FROM cands WHERE source = 'struct_base') b ON b.case_id = p.case_id AND b.item_id = p.item_id
LEFT JOIN (SELECT * FROM cands WHERE source = 'struct_large') l ON l.case_id = p.case_id AND l.item_id = p.item_id""".replace("round(coalesce(l.rank, 0.0), 9) AS _unused, ", ""), "pool cands")

CTX = ["rrf_rank_inv", "last_artist_match", "last_tag_jaccard", "query_artist_tok_overlap", "query_title_tok_overlap",
       "query_meta_tok_overlap", "is_played", "recency_score", "n_history"]
SRC = [f"src_{c}_{x}" for c in _LIVE for x in ("rank_inv", "pres")] + ["n_sources", "source_count_v2", "r21_rank_inv", "r21_presence"]
GLOB = ["als_dot", "popularity", "pool_artist_count", "pool_artist_frac"]
ALB = FE.FEATURES[-5:]
SIX = {"als_dot", "r54_cosine", "r84_cosine"}


@T.staged("features")
def features(spark, sf):
    """The 40 columns over the nine-source and audio serving pool."""
    return serving.features(T.corpus(spark, sf), candidates(spark, sf))


def rounded(df, cols):
    # recency_score is a whole number of trillionths, alike on both sides; rounding would only make ties.
    return df.select("case_id", "item_id", *[c if c == "recency_score" else F.round(c, 6 if c in SIX else 9).alias(c) for c in cols])


def block(df_fn, cols, name):
    sql = q(name, f"SELECT case_id, item_id, {', '.join(cols)} FROM {name}")
    return sql, (lambda spark, sf: rounded(df_fn(spark, sf), cols))


def attributed(spark, sf):
    return FE.pool_counts(FE.with_attributes(pool_of(spark, sf), FE.item_features(T.items(spark, sf))))


def context(spark, sf):
    c = T.corpus(spark, sf)
    return FE.context_features(attributed(spark, sf), c.cases, c.plays, FE.item_features(c.items), serving.said_tokens(c))


def glob(spark, sf):
    c = T.corpus(spark, sf)
    return FE.global_features(attributed(spark, sf), serving.session_vectors(c), c.factors, FE.play_popularity(c.plays))


def albums(spark, sf):
    c = T.corpus(spark, sf)
    return FE.album_features(attributed(spark, sf), c.plays, FE.item_features(c.items))


for _name, _fn, _cols, _cte in (
        ("I1_context", context, CTX, "f_ctx"),
        ("I1_sources", lambda s, d: FE.source_features(pool_of(s, d)), SRC, "f_src"),
        ("I1_global", glob, GLOB, "f_glob"),
        ("I1_album", albums, ALB, "f_alb"),
        ("I1_triple", lambda s, d: FE.triple_features(pool_of(s, d)), FE.BASE_TRIPLE, "f_trip")):
    _sql, _run = block(_fn, _cols, _cte)
    query(_name, _sql)(_run)


@query("I2_variant_swap", q("f_trip", """
SELECT 'base' AS variant, case_id, item_id, r54_rank_inv AS rank_inv, r54_presence AS presence, r54_cosine AS cosine FROM f_trip
UNION ALL SELECT 'large', case_id, item_id, r84_rank_inv, r84_presence, r84_cosine FROM f_trip"""))
def i2(spark, sf):
    f = features(spark, sf)
    out = None
    for v in ("base", "large"):
        a, b, c = FE.variant(f, v)[-3:]
        part = f.select(F.lit(v).alias("variant"), "case_id", "item_id", F.round(a, 9).alias("rank_inv"),
                        F.col(b).alias("presence"), F.round(c, 6).alias("cosine"))
        out = part if out is None else out.unionByName(part)
    return out


ALL = FE.FEATURES + FE.BASE_TRIPLE + FE.LARGE_TRIPLE


@query("I3_combined_stack", q("f_ctx f_src f_glob f_alb f_trip", f"""
SELECT case_id, item_id, {', '.join(ALL)} FROM f_ctx JOIN f_src USING (case_id, item_id) JOIN f_glob USING (case_id, item_id)
JOIN f_alb USING (case_id, item_id) JOIN f_trip USING (case_id, item_id)"""))
def i3(spark, sf):
    return rounded(features(spark, sf), ALL)


@query("I4_support_maps", q("feats", """
SELECT item_id, artist_key, album_key, array_to_string(tags, '|') AS tags, array_to_string(title_toks, '|') AS title_toks,
  array_to_string(artist_toks, '|') AS artist_toks, array_to_string(meta_toks, '|') AS meta_toks FROM feats"""))
def i4(spark, sf):
    f = FE.item_features(T.items(spark, sf))
    flat = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    return f.select("item_id", "artist_key", "album_key", flat("tags"), flat("title_toks"), flat("artist_toks"), flat("meta_toks"))


# ---- the offline matrices: longer lists, newest-weighted session vectors, eight or nine sources, no audio ----

cte("nvec", session_vecs(True, False), "plays factors")
cte("tcands", TRAINING_SQL, SOURCE_NEEDS + " nvec")
for _n, _in in ((8, IN8), (9, IN9)):
    cte(f"tpool{_n}", rrf("tcands", extra=_in), "tcands")
    _names = {"pool": f"tpool{_n}", "cands": "tcands", "svec": "nvec", **{c: f"t{_n}_{c}" for c in ("pf", "f_ctx", "f_src", "f_glob", "f_alb", "f_trip")}}
    _swap = lambda text: re.sub(r"\b(" + "|".join(_names) + r")\b(?! *\()", lambda m: _names[m[0]], text)
    for _c in ("pf", "f_ctx", "f_src", "f_glob", "f_alb", "f_trip"):
        cte(_names[_c], _swap(CTES[_c]), _swap(" ".join(NEEDS[_c])))


@T.staged("training_candidates")
def training_candidates(spark, sf):
    c = T.corpus(spark, sf)
    lists = T.stored_lists(spark, sf)
    lists["text_retriever"] = lists["text_retriever"].where(F.col("rank") <= TRAINING.train_topk)
    return serving.retrieve(replace(c, lexical=T.catalog_index(spark, sf)), TRAINING, lists, training_vectors(c))


def training_vectors(c):
    return serving.session_vectors(c, TRAINING, weighting="newest", normalize=False)


def _matrix(sources):
    def build(spark, sf):
        c = T.corpus(spark, sf)
        rows = serving.features(c, training_candidates(spark, sf), TRAINING, training_vectors(c), sources)
        return FE.label_pool(rows, gold_cases(spark, sf))
    return build


MATRICES = {n: T.staged(f"training_matrix_{n}")(_matrix(s)) for n, s in ((8, POOL_SOURCES_8), (9, POOL_SOURCES_9))}


def _case_features(n):
    sql = q(f"t{n}_f_ctx t{n}_f_src t{n}_f_glob t{n}_f_alb t{n}_f_trip gold", f"""
SELECT case_id, item_id, f.pool_pos, coalesce(w.pool_pos, -1) AS gt_pos, {', '.join(ALL)} FROM t{n}_f_ctx f JOIN t{n}_f_src USING (case_id, item_id)
JOIN t{n}_f_glob USING (case_id, item_id) JOIN t{n}_f_alb USING (case_id, item_id) JOIN t{n}_f_trip USING (case_id, item_id)
LEFT JOIN (SELECT p.case_id, pool_pos FROM tpool{n} p JOIN gold g ON g.case_id = p.case_id AND g.item_id = p.item_id) w USING (case_id)""")

    def run(spark, sf):
        m = MATRICES[n](spark, sf)
        long = [F.col(c).cast("long").alias(c) for c in ("pool_pos", "gt_pos")]
        return m.select("case_id", "item_id", *long, *[c if c == "recency_score" else F.round(c, 6 if c in SIX else 9).alias(c) for c in ALL])
    return sql, run


for _name, _n in (("I5_case_features", 9), ("I5_eight_sources", 8)):
    _sql, _run = _case_features(_n)
    query(_name, _sql)(_run)


def customer_weights(spark, sf):
    from refrain.operators.weighting import mean_one
    c = T.table(spark, sf, "customer").select(T.text_id("c_custkey").alias("case_id"), (F.abs("c_acctbal") / 10000 + 0.01).alias("p"))
    return mean_one(c, "p", "w", 0.25)


@query("I6_ranking_dataset", q("tpool9 gold", """
WITH w AS (SELECT cast(c_custkey AS varchar) AS case_id, pow(abs(c_acctbal) / 10000 + 0.01, 0.25) AS x FROM customer)
SELECT p.case_id, p.item_id, p.pool_pos, CASE WHEN g.item_id IS NULL THEN 0.0::double ELSE 1.0::double END AS label, round(x / (SELECT avg(x) FROM w), 6) AS weight
FROM tpool9 p JOIN w USING (case_id) LEFT JOIN gold g ON g.case_id = p.case_id AND g.item_id = p.item_id"""))
def i6(spark, sf):
    rows = B.ranking_rows(MATRICES[9](spark, sf), FE.variant(None, "large"), customer_weights(spark, sf))
    return rows.select("case_id", "item_id", F.col("pool_pos").cast("long").alias("pool_pos"), "label", F.round("weight", 6).alias("weight"))
