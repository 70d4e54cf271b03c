"""L: prompt, request and response tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain import fixed_text as FT
from refrain.functions import facts
from refrain.lineage import scratch_path
from refrain.operators import responses as RS, retrieval as R, sessions as S
from refrain.sources import artifacts
from workload import tables as T
from workload.a_sources import RECORDS, records
from workload.c_joins import TRANSCRIPT
from workload.e_aggregates import OVERUSED, e18
from workload.h_scalars import AGE_SQL, CLEAN, REGISTER_SQL, TONAL_SQL, WORDS, age_of, lit
from workload.registry import query
from workload.sql import encoded, q


def profiles(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    p = F.when(F.col("c_mktsegment") != "MACHINERY", F.struct(
        age_of(F.col("c_nationkey")).alias("age_group"), F.col("n_name").alias("country_name"), F.lit(None).cast("string").alias("gender")))
    return c.join(n, "c_nationkey", "left").select(T.text_id("c_custkey").alias("case_id"), p.alias("profile"))


PROFILE = f"""SELECT cast(c_custkey AS varchar) AS case_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE
  concat_ws(chr(10), 'age_group: ' || {AGE_SQL}, 'country_name: ' || n_name) END AS profile FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""


@query("L1_profile_text", PROFILE)
def l1(spark, sf):
    return profiles(spark, sf).select("case_id", RS.profile_text(F.col("profile")).alias("profile"))


def chats(spark, sf):
    t = T.turns(spark, sf)
    cases = S.last_requests(t)
    return RS.transcripts(RS.transcript_rows(S.history(t, cases), cases, T.items(spark, sf)))


@query("L2_chat_history", q("turns last_req items", f"""
SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY last, turn_number, pos) AS chat FROM ({TRANSCRIPT}) GROUP BY 1"""))
def l2(spark, sf):
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return chats(spark, sf).select("session_id", joined.alias("chat"))


PLAIN = """concat_ws(', ', 'track_id: ' || item_id, 'track_name: ' || track_name[1], 'artist_name: ' || artist_name[1], 'album_name: ' || album_name[1],
  'release_date: ' || release_date, 'genres: ' || array_to_string(tag_list[1:6], ', '))"""
RICH = f"""'track_name: ' || track_name[1] || ', artist_name: ' || artist_name[1] || ', album_name: ' || album_name[1]
  || coalesce(', year: ' || left(release_date, 4), '') || CASE WHEN duration <> 0 THEN ', duration: ' || (duration // 60000) || 'min' ELSE '' END
  || CASE WHEN popularity >= 70 THEN ', reach: a widely known, popular track' WHEN popularity > 0 AND popularity <= 12 THEN ', reach: a deep cut, under the radar' ELSE '' END
  || ', descriptors/tags: ' || replace({CLEAN}, '|', ', ')"""


@query("L3_recommend_item", q("items", f"SELECT item_id, {PLAIN} AS item_text FROM items"))
def l3(spark, sf):
    return T.items(spark, sf).select("item_id", RS.recommend_item().alias("item_text"))


TOP_TEXT = f"""SELECT l.case_id, l.item_id, coalesce(r.item_text, 'track_id: ' || l.item_id) AS item_text FROM (
  SELECT case_id, CASE WHEN pos_total > 60 THEN 'x' || item_id ELSE item_id END AS item_id FROM plays WHERE pos = pos_total) l
LEFT JOIN (SELECT item_id, {RICH} AS item_text FROM (SELECT *, tag_list AS tags FROM items)) r USING (item_id)"""


def top_texts(spark, sf):
    """Item text of each customer's last purchase; long histories get an id the catalog lacks."""
    last = T.plays(spark, sf).where("pos = pos_total").select("case_id", F.when(
        F.col("pos_total") > 60, F.concat(F.lit("x"), "item_id")).otherwise(F.col("item_id")).alias("item_id"))
    return RS.describe_top(last, T.items(spark, sf)).select("case_id", "item_id", "item_text")


@query("L4_rich_item", q("plays items", TOP_TEXT))
def l4(spark, sf):
    return top_texts(spark, sf)


DOC_IDS = "SELECT doc_id AS id, text FROM documents"


@query("L5_text_encoder", f"SELECT id AS doc_id, dim, round(x, 9) AS x FROM ({encoded(DOC_IDS, DOC_IDS)})")
def l5(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    dims = R.hashed_encoder(docs, docs).select("doc_id", F.posexplode("vec").alias("dim", "x")).where("x <> 0")
    return dims.select("doc_id", "dim", F.round("x", 9).alias("x"))


ROLE, GUIDE, PERSONAL = "You are a guide.\n", "Answer with one item.\n", "Mind the listener."
PROMPT = f"""SELECT p.case_id, {lit(ROLE + GUIDE)} || {lit(PERSONAL)} || CASE WHEN profile <> '' THEN chr(10) || profile ELSE '' END AS prompt FROM ({PROFILE}) p"""


def prompts(spark, sf):
    p = profiles(spark, sf)
    return p.select("case_id", RS.system_prompt(F.lit(ROLE), F.lit(GUIDE), F.lit(PERSONAL), RS.profile_text(F.col("profile"))).alias("prompt"))


@query("L6_system_prompt", PROMPT)
def l6(spark, sf):
    return prompts(spark, sf)


def bank(lines, salt):
    arr = "[" + ", ".join(lit(x) for x in lines) + "]"
    return f"{arr}[cast(cast('0x' || left(md5(seed || '|{salt}'), 8) AS bigint) % {len(lines)} AS int) + 1]"


PACKET = f"""SELECT case_id, concat_ws(chr(10), {bank(FT.OPENING_ANGLES, 0)}, {bank(FT.BODY_STRUCTURES, 1)}, {bank(FT.CLOSING_FORMATS, 2)}, {REGISTER_SQL},
  {lit(FT.TEMPORAL_PREFIX)} || CASE WHEN y >= 1960 THEN cast(y // 10 * 10 AS int) END || {lit(FT.TEMPORAL_SUFFIX)}, {TONAL_SQL}) AS packet FROM (
  SELECT t.case_id, cast('0x' || left(md5(t.item_text), 8) AS bigint) AS seed, {AGE_SQL} AS age, cast(left(i.release_date, 4) AS int) AS y, lower(c_mktsegment) AS s, t.case_id AS c
  FROM ({TOP_TEXT}) t JOIN customer ON cast(c_custkey AS varchar) = t.case_id LEFT JOIN items i USING (item_id))"""


def packets(spark, sf):
    t = top_texts(spark, sf).join(T.items(spark, sf).select("item_id", "release_date"), "item_id", "left")
    c = T.table(spark, sf, "customer").select(T.text_id("c_custkey").alias("case_id"), "c_nationkey", "c_mktsegment")
    packet = RS.style_packet(facts.style_seed(F.col("item_text")), age_of(F.col("c_nationkey")), F.col("release_date"),
                             F.lower("c_mktsegment"), F.col("case_id"))
    return t.join(c, "case_id").select("case_id", "item_text", packet.alias("packet"))


@query("L7_style_packet", q("plays items", PACKET))
def l7(spark, sf):
    return packets(spark, sf).select("case_id", "packet")


AUGMENTED = f"""SELECT p.case_id, p.prompt || {lit(FT.GROUNDING_DIRECTIVE)} || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), {lit(FT.PACKET_INTRO)}, k.packet, {lit(FT.MIN_WORDS.format(n=120))},
  {lit(FT.BEGIN_DIRECTLY)}, {lit(FT.TRACK_HEADER)} || t.item_text, {lit(FT.OVERUSED_PREFIX)} || (SELECT string_agg(bigram, ', ' ORDER BY n DESC, bigram) FROM ({OVERUSED})) || '.') AS prompt
FROM ({PROMPT}) p JOIN ({PACKET}) k USING (case_id) JOIN ({TOP_TEXT}) t USING (case_id)"""


@query("L8_augmented_prompt", q("plays items", AUGMENTED))
def l8(spark, sf):
    rows = prompts(spark, sf).join(packets(spark, sf), "case_id")
    listed = e18(spark, sf).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "bigram"))),
                                                         lambda s: s["bigram"]), ", ").alias("l")).scalar()
    return rows.select("case_id", RS.augmented_prompt(F.col("prompt"), F.col("item_text"), F.col("packet"), 120, listed, grounded=True).alias("prompt"))


MAPPED = "CASE WHEN role = 'user' THEN 'user' ELSE 'model' END || ': ' || content"


@query("L9_format_messages", q("turns last_req items", f"""
SELECT session_id, string_agg({MAPPED}, chr(10) ORDER BY last, turn_number, pos) || chr(10) || 'user: {FT.CLOSING_TURN}' AS augmented,
  string_agg({MAPPED}, chr(10) ORDER BY last, turn_number, pos) || chr(10) || 'model: Recommended track: ' || session_id || chr(10) || 'user: {FT.CLOSING_TURN}' AS plain
FROM ({TRANSCRIPT}) GROUP BY 1"""))
def l9(spark, sf):
    lines = lambda m: F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return chats(spark, sf).select("session_id", lines(RS.request_messages(F.col("messages"))).alias("augmented"),
                                   lines(RS.request_messages(F.col("messages"), F.col("session_id"))).alias("plain"))


@query("L10_cache_key", q("turns last_req items", f"""
SELECT session_id, sha256('model-a' || chr(30) || 'prompt' || chr(30) || '[' || string_agg('{{"role": ' || to_json(role)::varchar || ', "content": ' || to_json(content)::varchar || '}}', ', ' ORDER BY last, turn_number, pos) || ']'
  || chr(30) || session_id || chr(30) || '260' || chr(30) || '0.8' || chr(30) || '0.95' || chr(30)) AS cache_key
FROM ({TRANSCRIPT}) GROUP BY 1"""))
def l10(spark, sf):
    return chats(spark, sf).select("session_id", RS.request_key(
        F.lit("model-a"), F.lit("prompt"), RS.history_json(F.col("messages")), F.col("session_id"), 260, 0.8, 0.95).alias("cache_key"))


@query("L11_cache_append", """
SELECT sha256(role || chr(30) || text || chr(30)) AS cache_key, arg_max(CASE WHEN role = 'user' THEN text ELSE upper(role) END, conv_id * 1000 + turn) AS response
FROM conversations GROUP BY 1""")
def l11(spark, sf):
    """Two appends; a reader sees the newest entry of each key."""
    c = T.table(spark, sf, "conversations")
    rows = c.select(facts.cache_key(F.col("role"), F.col("text")).alias("cache_key"), F.lit("model-a").alias("model"), "role", "text",
                    (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("ts"))
    path = scratch_path(spark, "responses")
    RS.append_cache(path, rows.withColumn("response", F.col("text")).withColumn("ts", -F.col("ts") - 1))
    RS.append_cache(path, rows.withColumn("response", F.when(F.col("role") == "user", F.col("text")).otherwise(F.upper("role"))))
    cache = spark.read.parquet(path)
    hits, _ = RS.split_requests(rows.select("cache_key").distinct(), cache)
    return hits.select("cache_key", "response")


DRAFTS = "SELECT doc_id, text AS refined, CASE WHEN lang = 'en' THEN '' ELSE coalesce(lang, '') || ' draft' END AS draft FROM documents"


def drafts(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", F.col("text").alias("refined"), F.when(F.col("lang") == "en", F.lit("")).otherwise(
        F.concat(F.coalesce("lang", F.lit("")), F.lit(" draft"))).alias("draft"))


@query("L12_refined_or_draft", f"""
SELECT doc_id, CASE WHEN draft <> '' AND coalesce(refined, '') <> '' AND {WORDS.format('refined')} >= 100 THEN md5(refined) ELSE draft END AS response FROM ({DRAFTS})""")
def l12(spark, sf):
    chosen = RS.refined_or_draft(F.col("draft"), F.col("refined"))
    rows = drafts(spark, sf).select("doc_id", "draft", chosen.alias("r"))
    return rows.select("doc_id", F.when(F.col("r") == F.col("draft"), F.col("draft")).otherwise(F.md5(F.col("r").cast("binary"))).alias("response"))


@query("L13_critic_requests", f"""
SELECT conv_id, turn, sha256('model-b' || chr(30) || {lit(FT.EDITOR_PROMPT)} || chr(30) || '[{{"role": "user", "content": ' || to_json({lit(FT.CRITIC_PROMPT)} || chr(10) || chr(10) || 'ORIGINAL:' || chr(10) || text || chr(10) || chr(10) || 'REFINED:')::varchar || '}}]'
  || chr(30) || role || chr(30) || '2048' || chr(30) || '0.6' || chr(30) || '0.95' || chr(30)) AS cache_key FROM conversations WHERE text <> ''""")
def l13(spark, sf):
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("draft"), F.col("role").alias("item_text"))
    return RS.critic_requests(c, "model-b").select("conv_id", "turn", "cache_key")


@query("L14_final_records", q("scored", f"""
SELECT session_id, turn_number, array_to_string(predicted_track_ids, ',') AS ids, predicted_response FROM ({RECORDS})"""))
def l14(spark, sf):
    r = records(spark, sf)
    recs = r.select("session_id", "turn_number", "predicted_track_ids")
    replies = T.table(spark, sf, "customer").select(T.text_id("c_custkey").alias("session_id"), F.col("c_nationkey").alias("turn_number"),
                                                    F.col("c_mktsegment").alias("predicted_response"))
    return RS.final_records(recs, replies).select("session_id", "turn_number", F.array_join("predicted_track_ids", ",").alias("ids"), "predicted_response")
