"""H: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain import fixed_text as FT
from refrain.functions import facts
from refrain.functions.numeric import dot, jaccard, l2_normalise, overlap, presence, rank_inv
from refrain.functions.text import clean_tags, tokens, word_count
from refrain.operators.features import item_features
from workload import tables as T
from workload.registry import query
from workload.sql import dot as sdot, jaccard as sjac, q, tokens as stok, unit


@query("H1_tokens", f"SELECT doc_id, array_to_string({stok('text')}, ' ') AS toks FROM documents")
def h1(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("toks"))


@query("H2_jaccard", q("feats", f"SELECT item_id, round({sjac('tags', 'meta_toks')}, 9) AS j FROM feats"))
def h2(spark, sf):
    f = item_features(T.items(spark, sf))
    return f.select("item_id", F.round(jaccard(F.col("tags"), F.col("meta_toks")), 9).alias("j"))


@query("H3_cosine", q("vmeta plays", f"""
SELECT p.case_id, p.pos, round({sdot('a.vec', 'b.vec')}, 6) AS cosine FROM plays p
JOIN plays n ON n.case_id = p.case_id AND n.pos = p.pos + 1 JOIN vmeta a ON a.item_id = p.item_id JOIN vmeta b ON b.item_id = n.item_id"""))
def h3(spark, sf):
    p, v = T.plays(spark, sf), T.vectors(spark, sf, "metadata")
    a = p.join(v, "item_id").select("case_id", "pos", F.col("vec").alias("a"))
    b = p.join(v, "item_id").select("case_id", (F.col("pos") - 1).alias("pos"), F.col("vec").alias("b"))
    return a.join(b, ["case_id", "pos"]).select("case_id", "pos", F.round(dot(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("H4_l2_normalise", f"""
SELECT vec_id, round(list_sum({unit('cast(embedding AS double[])')}), 6) AS total FROM embeddings""")
def h4(spark, sf):
    v = l2_normalise(F.col("embedding").cast("array<double>"))
    return T.table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("H5_rank_inverse", q("scored returned", """
SELECT case_id, item_id, round(CASE WHEN r.item_id IS NULL THEN 0.0 ELSE 1.0 / pool_pos END, 9) AS inv, CASE WHEN r.item_id IS NULL THEN 0.0::double ELSE 1.0::double END AS pres
FROM scored s LEFT JOIN returned r USING (case_id, item_id)"""))
def h5(spark, sf):
    r = T.returned(spark, sf).withColumn("_r", F.lit(True))
    s = T.scored(spark, sf).join(r, ["case_id", "item_id"], "left").withColumn("rank", F.when(F.col("_r"), F.col("pool_pos")))
    return s.select("case_id", "item_id", F.round(rank_inv(F.col("rank")), 9).alias("inv"), presence(F.col("rank")).alias("pres"))


DATES = """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN '2-HIGH' THEN strftime(o_orderdate, '%d/%m/%Y')
 WHEN '5-LOW' THEN NULL ELSE cast(o_orderkey AS varchar) END AS d FROM orders"""


def dates(spark, sf):
    p = F.col("o_orderpriority")
    d = (F.when(p == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd")).when(p == "2-HIGH", F.date_format("o_orderdate", "dd/MM/yyyy"))
         .when(p == "5-LOW", F.lit(None)).otherwise(T.text_id("o_orderkey")))
    return T.table(spark, sf, "orders").select("o_orderkey", d.alias("d"))


@query("H6_year_of", f"""
SELECT o_orderkey, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year FROM (
  SELECT o_orderkey, cast(nullif(regexp_extract(coalesce(d, ''), '^([0-9]{{4}})', 1), '') AS int) AS y FROM ({DATES}))""")
def h6(spark, sf):
    return dates(spark, sf).select("o_orderkey", facts.year_of(F.col("d")).alias("year"))


@query("H7_decade", f"""
SELECT o_orderkey, CASE WHEN y >= 1960 THEN cast(y // 10 * 10 AS int) END AS decade FROM (
  SELECT o_orderkey, cast(nullif(regexp_extract(coalesce(d, ''), '([0-9]{{4}})', 1), '') AS int) AS y FROM ({DATES}))""")
def h7(spark, sf):
    return dates(spark, sf).select("o_orderkey", facts.decade(F.col("d")).alias("decade"))


CLEAN = """(SELECT coalesce(string_agg(t, '|' ORDER BY i), '') FROM (SELECT t, i, row_number() OVER (ORDER BY i) AS r FROM (
  SELECT t, i, row_number() OVER (PARTITION BY lower(t) ORDER BY i) AS d FROM (SELECT trim(unnest(tags)) AS t, unnest(range(1, len(tags) + 1)) AS i)
  WHERE length(t) BETWEEN 2 AND 22 AND NOT contains(lower(t), 'star') AND (NOT regexp_matches(t, '[0-9]') OR regexp_full_match(lower(t), '(19|20)?[0-9]0s'))) WHERE d = 1) WHERE r <= 15)"""
TAGS = """SELECT item_id, list_concat(list_concat(tag_list, list_transform(tag_list, lambda x: upper(x))), ['5-' || lower(album_name[1]) || ' star', '1970s', album_name[1] || ' ' || album_name[1] || ' ' || album_name[1]]) AS tags FROM items"""


@query("H8_clean_tags", q("items", f"SELECT item_id, {CLEAN} AS tags FROM ({TAGS})"))
def h8(spark, sf):
    album = F.element_at("album_name", 1)
    tags = F.concat("tag_list", F.transform("tag_list", lambda x: F.upper(x)), F.array(
        F.concat(F.lit("5-"), F.lower(album), F.lit(" star")), F.lit("1970s"), F.concat_ws(" ", album, album, album)))
    # A catalog's file is few splits; its rows are dealt out before the work on every tag.
    return T.items(spark, sf).repartition("item_id").select("item_id", F.array_join(clean_tags(tags), "|").alias("tags"))


@query("H9_duration", q("items", "SELECT item_id, CASE WHEN duration <> 0 THEN cast(duration // 60000 AS varchar) || 'min' END AS minutes FROM items"))
def h9(spark, sf):
    return T.items(spark, sf).select("item_id", facts.duration_minutes(F.col("duration")).alias("minutes"))


@query("H10_popularity_band", """
SELECT item_id, CASE WHEN p >= 70 THEN 'a widely known, popular track' WHEN p > 0 AND p <= 12 THEN 'a deep cut, under the radar' END AS reach
FROM (SELECT event_id AS item_id, try_cast(CASE WHEN event_type = 'error' THEN 'n/a' ELSE cast(value AS varchar) END AS double) AS p FROM events)""")
def h10(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.when(
        F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("p"))
    return e.select("item_id", facts.popularity_band(F.col("p")).alias("reach"))


@query("H11_hash_key", "SELECT conv_id, turn, sha256(role || chr(30) || text || chr(30) || '260' || chr(30)) AS k FROM conversations")
def h11(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", facts.cache_key(F.col("role"), F.col("text"), F.lit("260")).alias("k"))


@query("H12_style_seed", "SELECT doc_id, cast(('0x' || left(md5(text), 8)) AS bigint) AS seed FROM documents")
def h12(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", facts.style_seed(F.col("text")).alias("seed"))


AGES = ["13-17", "18-24", "25-34", "35-49", "50+", "unknown"]
AGE_SQL = "CASE c_nationkey % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(AGES)) + " END"


def age_of(nation):
    return F.element_at(F.array(*[F.lit(a) for a in AGES], F.lit(None)), (nation % 7 + 1).cast("int"))


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REGISTER_SQL = "CASE age " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in FT.VOCAB_BY_AGE.items()) + f" ELSE {lit(FT.VOCAB_BY_AGE['25-34'])} END"
HIGH = "(upper(left({0}, 1)) IN ('H', '1'))"
TONAL_SQL = (f"CASE WHEN {HIGH.format('s')} AND {HIGH.format('c')} THEN {lit(FT.TONAL_HH)} WHEN {HIGH.format('s')} THEN {lit(FT.TONAL_HL)} "
             f"WHEN {HIGH.format('c')} THEN {lit(FT.TONAL_LH)} ELSE {lit(FT.TONAL_LL)} END")


@query("H13_age_register", f"SELECT c_custkey, {REGISTER_SQL} AS register FROM (SELECT c_custkey, {AGE_SQL} AS age FROM customer)")
def h13(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", facts.register_for_age(age_of(F.col("c_nationkey"))).alias("register"))


@query("H14_tonal", f"SELECT c_custkey, {TONAL_SQL} AS tonal FROM (SELECT c_custkey, lower(c_mktsegment) AS s, cast(c_custkey AS varchar) AS c FROM customer)")
def h14(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", facts.tonal(F.lower("c_mktsegment"), T.text_id("c_custkey")).alias("tonal"))


WORDS = r"(CASE WHEN trim(regexp_replace({0}, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' ')) END)"


@query("H15_word_floor", f"SELECT doc_id, {WORDS.format('text')} AS n_words, {WORDS.format('text')} < 100 AS keep_draft FROM documents")
def h15(spark, sf):
    n = word_count(F.col("text"))
    return T.table(spark, sf, "documents").select("doc_id", n.cast("long").alias("n_words"), (n < 100).alias("keep_draft"))


@query("H16_query_tokens", f"SELECT conv_id, turn, {WORDS.format('text')} AS query_toks FROM conversations")
def h16(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", word_count(F.col("text")).cast("long").alias("query_toks"))
