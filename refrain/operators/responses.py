"""Prompt, request and cached-response tables. No model is called here.

A chat request holds its whole transcript by definition, so ``transcripts`` gathers one row per
session; everything else stays per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from refrain import fixed_text as T
from refrain.functions.facts import cache_key, decade, duration_minutes, pick, popularity_band, register_for_age, tonal
from refrain.functions.text import clean_tags, first, word_count
from refrain.operators.topk import top_k


def profile_text(profile: Column) -> Column:
    """``key: value`` lines in fixed order; missing and empty fields are skipped."""
    lines = [F.when(F.coalesce(profile[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), profile[k]))
             for k in ("age_group", "country_name", "gender")]
    return F.concat_ws("\n", *lines)


def transcript_rows(history: DataFrame, cases: DataFrame, items: DataFrame) -> DataFrame:
    """Ordered transcript rows: plays become ``(recommended: N by A)``, the request comes last."""
    names = items.select(F.col("item_id").alias("_id"), first(F.col("track_name")).alias("_n"),
                         first(F.col("artist_name")).alias("_a"))
    music = F.col("role") == "music"
    keyed = history.withColumn("_id", F.when(music, F.trim("content")))
    said = (keyed.join(names, "_id", "left")
            .select("session_id", "turn_number", "pos",
                    F.when(music, F.lit("assistant")).otherwise(F.col("role")).alias("role"),
                    F.when(music, F.concat(F.lit("(recommended: "), F.coalesce("_n", F.lit("")), F.lit(" by "),
                                           F.coalesce("_a", F.lit("")), F.lit(")"))).otherwise(F.col("content")).alias("content")))
    asked = cases.select("session_id", "turn_number", F.lit(None).cast("long").alias("pos"),
                         F.lit("user").alias("role"), F.col("user_query").alias("content"))
    return said.withColumn("last", F.lit(0)).unionByName(asked.withColumn("last", F.lit(1)))


def transcripts(rows: DataFrame) -> DataFrame:
    """One message array per session."""
    return (rows.groupBy("session_id")
            .agg(F.array_sort(F.collect_list(F.struct("last", "turn_number", "pos", "role", "content"))).alias("m"))
            .select("session_id", F.transform("m", lambda x: F.struct(
                x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))


def recommend_item() -> Column:
    """Compact item line: id, first values, up to six genres."""
    fields = [F.concat(F.lit("track_id: "), F.col("item_id"))]
    for k in ("track_name", "artist_name", "album_name"):
        v = first(F.col(k))
        fields.append(F.when(v != "", F.concat(F.lit(f"{k}: "), v)))
    date = F.coalesce("release_date", F.lit(""))
    fields.append(F.when(date != "", F.concat(F.lit("release_date: "), date)))
    fields.append(F.when(F.size(F.coalesce("tag_list", F.array())) > 0,
                         F.concat(F.lit("genres: "), F.array_join(F.slice("tag_list", 1, 6), ", "))))
    return F.concat_ws(", ", *fields)


def rich_item() -> Column:
    """Fact line of a catalog row: names, year, duration, reach, cleaned tags."""
    year = F.substring(F.coalesce("release_date", F.lit("")), 1, 4)
    minutes, reach = duration_minutes(F.col("duration")), popularity_band(F.col("popularity"))
    optional = lambda label, v: F.coalesce(F.concat(F.lit(label), v), F.lit(""))
    return F.concat(
        F.lit("track_name: "), first(F.col("track_name")), F.lit(", artist_name: "), first(F.col("artist_name")),
        F.lit(", album_name: "), first(F.col("album_name")), optional(", year: ", F.when(year != "", year)),
        optional(", duration: ", minutes), optional(", reach: ", reach),
        F.lit(", descriptors/tags: "), F.array_join(clean_tags(F.col("tag_list")), ", "))


def describe_top(top: DataFrame, items: DataFrame) -> DataFrame:
    """Rich facts of each case's first item, the compact line when the id is unknown."""
    facts = items.select("item_id", rich_item().alias("_rich"))
    return (top.join(facts, "item_id", "left")
            .withColumn("item_text", F.coalesce(F.col("_rich"), F.concat(F.lit("track_id: "), F.col("item_id"))))
            .drop("_rich"))


def system_prompt(roleplay: Column, guidelines: Column, personalization: Column | None = None,
                  profile: Column | None = None) -> Column:
    """Roleplay + guidelines, then personalization, then the profile on its own line."""
    out = F.concat(roleplay, guidelines)
    if personalization is None:
        return out
    tail = F.lit("")
    if profile is not None:
        tail = F.when(F.coalesce(profile, F.lit("")) != "", F.concat(F.lit("\n"), profile)).otherwise(F.lit(""))
    has = F.coalesce(personalization, F.lit("")) != ""
    return F.when(has, F.concat(out, personalization, tail)).otherwise(out)


def style_packet(seed: Column, age_group: Column, release_date: Column, specificity: Column, category: Column) -> Column:
    """Three hash-picked lines and three contextual ones; empty lines are dropped."""
    era = decade(release_date)
    return F.concat_ws(
        "\n", pick(T.OPENING_ANGLES, seed, 0), pick(T.BODY_STRUCTURES, seed, 1), pick(T.CLOSING_FORMATS, seed, 2),
        register_for_age(age_group),
        F.concat(F.lit(T.TEMPORAL_PREFIX), era.cast("string"), F.lit(T.TEMPORAL_SUFFIX)),
        tonal(specificity, category))


def augmented_prompt(prompt: Column, item_text: Column, packet: Column | None = None, min_words: int = 120,
                     overused: Column | None = None, grounded: bool = False) -> Column:
    """System prompt with the per-response directives, blocks parted by blank lines.

    ``grounded`` adds the directive that goes with rich item facts.
    """
    parts = [F.concat(prompt, F.lit(T.GROUNDING_DIRECTIVE)) if grounded else prompt]
    if packet is not None:
        parts += [F.lit(T.PACKET_INTRO), packet]
    if min_words > 0:
        parts.append(F.lit(T.MIN_WORDS.format(n=min_words)))
    parts += [F.lit(T.BEGIN_DIRECTLY), F.concat(F.lit(T.TRACK_HEADER), item_text)]
    if overused is not None:
        parts.append(F.when(F.coalesce(overused, F.lit("")) != "",
                            F.concat(F.lit(T.OVERUSED_PREFIX), overused, F.lit("."))))
    return F.concat_ws("\n\n", *parts)


def overused_bigrams(bigram_rows: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    """Most frequent bigrams seen at least ``least`` times."""
    counts = bigram_rows.groupBy("bigram").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "bigram").limit(top).where(F.col("n") >= least)


def request_messages(messages: Column, item_text: Column | None = None) -> Column:
    """Role map (user stays, all else is model), optional item turn, closing user turn."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    mapped = F.transform(messages, lambda m: turn(
        F.when(m["role"] == "user", F.lit("user")).otherwise(F.lit("model")), m["content"]))
    tail = [turn(F.lit("user"), F.lit(T.CLOSING_TURN))]
    if item_text is not None:
        tail.insert(0, turn(F.lit("model"), F.concat(F.lit("Recommended track: "), item_text)))
    return F.concat(mapped, F.array(*tail))


def history_json(messages: Column) -> Column:
    """Message list as JSON with the separators the stored cache keys were made with."""
    body = F.transform(messages, lambda m: F.concat(
        F.lit('{"role": '), _json_string(m["role"]), F.lit(', "content": '), _json_string(m["content"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(body, ", "), F.lit("]"))


def _json_string(text: Column) -> Column:
    """One JSON string literal: an array of one string, serialised, without its brackets."""
    packed = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substr(packed, F.lit(2), F.length(packed) - 2)


def request_key(model: Column, prompt: Column, history: Column, item_text: Column, max_tokens: int,
                temperature: float, top_p: float) -> Column:
    """Content address of a request; the reasoning budget is not part of it."""
    return cache_key(model, prompt, history, item_text, F.lit(str(max_tokens)), F.lit(str(temperature)), F.lit(str(top_p)))


def split_requests(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits with their stored response, and the misses that need generation."""
    stored = cache.groupBy("cache_key").agg(F.max_by("response", "ts").alias("response"))
    return requests.join(stored, "cache_key"), requests.join(stored.select("cache_key"), "cache_key", "left_anti")


def append_cache(path: str, responses: DataFrame) -> None:
    """Store new responses; readers keep the newest per key."""
    responses.select("cache_key", "response", "model", "ts").write.mode("append").parquet(path)


def refined_or_draft(draft: Column, refined: Column, floor: int = 100) -> Column:
    """Refined text unless it is missing or too short; an empty draft stays empty."""
    good = F.coalesce(refined, F.lit("")) != ""
    return F.when((F.coalesce(draft, F.lit("")) != "") & good & (word_count(refined) >= floor), refined).otherwise(draft)


def critic_message(draft: Column) -> Column:
    return F.concat(F.lit(T.CRITIC_PROMPT), F.lit("\n\nORIGINAL:\n"), draft, F.lit("\n\nREFINED:"))


def critic_requests(drafts: DataFrame, model: str, max_tokens: int = 2048, temperature: float = 0.6,
                    top_p: float = 0.95) -> DataFrame:
    """Second-pass requests for every non-empty draft, with their own key."""
    messages = F.array(F.struct(F.lit("user").alias("role"), critic_message(F.col("draft")).alias("content")))
    rows = drafts.where("draft <> ''").withColumn("messages", messages)
    return rows.withColumn("cache_key", request_key(
        F.lit(model), F.lit(T.EDITOR_PROMPT), history_json(F.col("messages")), F.col("item_text"),
        max_tokens, temperature, top_p))


def final_records(recs: DataFrame, responses: DataFrame) -> DataFrame:
    """Both halves side by side, fields in output order."""
    return recs.join(responses, ["session_id", "turn_number"]).select(
        "session_id", "turn_number", "predicted_track_ids", "predicted_response")


def empty_responses(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.trim("predicted_response") == "").alias("n_empty"))


def first_items(ranked: DataFrame) -> DataFrame:
    return top_k(ranked, ["case_id"], [F.asc("rank")], 1, "_r").drop("_r")
