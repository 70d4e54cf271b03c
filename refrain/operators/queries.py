"""Text queries for the lexical and text retrievers, as rows: repetition is a count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refrain.functions.text import meta_text
from refrain.operators.joins import growing
from refrain.operators.retrieval import terms_of
from refrain.operators.sessions import last_texts

FIELDS = ("track_name", "artist_name", "album_name", "tag_list")


def item_meta(items: DataFrame, titled: bool) -> DataFrame:
    return items.select("item_id", meta_text(*[F.col(c) for c in FIELDS], titled=titled).alias("meta"))


def last_item_parts(cases: DataFrame, plays: DataFrame, items: DataFrame) -> DataFrame:
    """Titled metadata of the last play; the request itself when that is empty."""
    last = (plays.where("pos = pos_total").join(growing(item_meta(items, True)), "item_id", "left").select("case_id", "meta"))
    text = F.coalesce(F.when(F.col("meta") != "", F.col("meta")), F.col("user_query"))
    return cases.join(growing(last), "case_id", "left").select(
        F.col("case_id").alias("query_id"), text.alias("text"), F.lit(1).alias("times"))


def conversation_parts(cases: DataFrame, said: DataFrame, plays: DataFrame, items: DataFrame) -> DataFrame:
    """Earlier user turns (the newest twice), the request three times, metadata of all plays.

    ``said(case_id, content, is_last)`` holds the earlier user turns.
    """
    earlier = said.select("case_id", F.col("content").alias("text"), F.when(F.col("is_last"), 2).otherwise(1).alias("times"))
    asked = cases.select("case_id", F.col("user_query").alias("text"), F.lit(3).alias("times"))
    heard = (plays.groupBy("case_id", "item_id").agg(F.count("*").cast("int").alias("times"))
             .join(growing(item_meta(items, False)), "item_id").select("case_id", F.col("meta").alias("text"), "times"))
    parts = earlier.unionByName(asked).unionByName(heard).where("text <> ''")
    return parts.select(F.col("case_id").alias("query_id"), "text", "times")


def lexical_queries(parts: DataFrame) -> DataFrame:
    return terms_of(parts)


def text_queries(cases: DataFrame, users: DataFrame, turns: int) -> DataFrame:
    """Last ``turns`` user utterances including the request, joined by spaces."""
    said = last_texts(cases, users, "n_prior_user", "user_pos", turns - 1, "content", "said")
    parts = F.concat(F.coalesce("said", F.array().cast("array<string>")), F.array("user_query"))
    return cases.join(growing(said), "case_id", "left").withColumn("text", F.array_join(parts, " ")).drop("said")
