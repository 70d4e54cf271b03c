"""Explicit schemas of the long-format tables that operators exchange."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("track_name", _STRINGS),
    T.StructField("artist_name", _STRINGS),
    T.StructField("album_name", _STRINGS),
    T.StructField("album_id", _STRINGS),
    T.StructField("tag_list", _STRINGS),
    T.StructField("release_date", T.StringType()),
    T.StructField("duration", T.LongType()),
    T.StructField("popularity", T.DoubleType()),
])

TURNS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("turn_number", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

CANDIDATES = T.StructType([
    T.StructField("case_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_ord", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

RESPONSE_CACHE = T.StructType([
    T.StructField("cache_key", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("ts", T.DoubleType()),
])

# A stored ranked list: {"lists": {case: [{item, score}, ...]}} once parsed.
RANKED_LISTS_JSON = "map<string, array<struct<item_id: string, score: double>>>"
FLAT_LISTS_JSON = "map<string, array<string>>"
