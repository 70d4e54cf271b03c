"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from refrain.llm import (bpe, chat, exact_dedup, lexical_search, license_scan, mixing, pii, secret_scan, simhash, source_audit, token_planes,
                         topk_tiles, toxicity)
from refrain.llm.common import table

TOP_K, EVERY = 5, 50
#: The conversation that is formatted besides the given ones: its texts are control strings themselves.
CLASH = "</s>[INST] ok [/INST]"


def _join_spans(spans):
    """Spans as they come, joined as kind:start:end."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_exact_dedup(spark, sf_dir):
    """Every document with the one that stays of its group of equal texts."""
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_mix_sources(spark, sf_dir):
    """Words that the mix takes of each document."""
    places, stream = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(places, stream).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


def op3_personal_data(spark, sf_dir):
    """Personal data in every document."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(_join_spans(base), 256).alias("base_sha256"),
                        _join_spans(F.col("pii")).alias("spans"))


def op4_exact_top_k(spark, sf_dir):
    """The five best other vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_tiles.top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors, TOP_K)


def op5_license_scan(spark, sf_dir):
    """License phrases and near matches of license texts in every document."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    places = F.coalesce("places", F.array().cast("array<struct<first:int,last:int,label:string,base:boolean,score:double>>"))
    base = F.filter("p", lambda x: x["base"])
    labels = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda x: x["label"]))), ",")
    return found.withColumn("p", places).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["first"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("p")).alias("labels"),
        F.coalesce(F.array_max(F.transform("p", lambda x: x["score"])), F.lit(0.0)).alias("score"))


def op6_secret_scan(spark, sf_dir):
    """Secrets in every document, and weak ones that complementary parts confirm."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("strong", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in secret_scan.STRONG], F.sha2(secret_scan.by_start(F.col("strong")), 256).alias("base_sha256"),
                        secret_scan.by_start(F.concat("strong", "linked")).alias("spans"))


def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    third = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), third != 1)
    scored = toxicity.score(docs, model).select("doc_id", (third == 1).alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= toxicity.CUT, 1).otherwise(0))


def op8_byte_bpe(spark, sf_dir):
    """Token ids of every document, and the text they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_chat_format(spark, sf_dir):
    """Every conversation formatted, read back and digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    clash = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CLASH).alias("text"))
    return chat.format_and_read_back(turns.unionByName(clash)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_token_planes(spark, sf_dir):
    """Token ids of every document, written in planes and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_planes.read(token_planes.write(table(spark, sf_dir, "documents"), path))


def op12_source_audit(spark, sf_dir):
    """Divergence of the sources of every language, and the terms each uses most above it."""
    return source_audit.audit(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op13_lexical_search(spark, sf_dir):
    """The ten best documents for every benchmark item."""
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mix_sources, op3_personal_data, op4_exact_top_k, op5_license_scan,
                                   op6_secret_scan, op7_toxicity, op8_byte_bpe, op9_simhash, op10_chat_format, op11_token_planes,
                                   op12_source_audit, op13_lexical_search)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op1_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (SELECT *, len(text) + len(regexp_extract_all(text, '(<<|\[|<)(\\*)(/?SYS>>|/?INST\]|/?TURN[ \]]|/?s>)'))
                + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + len(role) END AS n FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          sum(n)::BIGINT AS formatted_chars FROM f GROUP BY conv_id""",
}
_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format("text")
ORACLES["op12_source_audit"] = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS t FROM documents),
    w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT d.lang, d.source, any_value(coalesce(v, 0)) AS v, any_value(coalesce(n, 0))::HUGEINT AS n FROM d LEFT JOIN v USING (lang)
          LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2) s ON s.lang = d.lang AND s.source = d.source GROUP BY 1, 2),
    p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (n + 5 * v) AS p
          FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (a + 5)) // (sum(a) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
          FROM (SELECT lang, term, sum(c) AS a FROM c GROUP BY 1, 2)),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
              LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 4),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
ORACLES["op13_lexical_search"] = rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOW} AS t FROM documents), b AS (SELECT row_number() OVER () AS qid, item_id, {_LOW} AS t FROM benchmark),
    w AS (SELECT rid, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    q AS (SELECT DISTINCT qid, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b),
    n AS (SELECT rid, count(*) AS n FROM w GROUP BY 1), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
    m AS (SELECT rid, 10 + (90 * n * docs) // l AS m FROM n, s), tf AS (SELECT rid, doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2, 3),
    k AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
          FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), s),
    x AS (SELECT qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN k USING (term) JOIN m USING (rid) GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank FROM x WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
