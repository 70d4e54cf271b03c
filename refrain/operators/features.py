"""The 37 candidate features, built from joins and bounded pool windows.

History-side inputs are aggregated per (case, artist), (case, album) or (case, tag) before they
meet the pool, so a session with very many plays never multiplies with its 300 candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from refrain.config import DEFAULTS, LIVE_SOURCES
from refrain.functions.numeric import dot, jaccard, overlap, presence, rank_inv
from refrain.functions.text import non_empty, spaced, tokens
from refrain.operators.joins import growing

# Feature names in model order.
FEATURES = [
    "rrf_rank_inv", "last_artist_match", "last_tag_jaccard",
    "query_artist_tok_overlap", "query_title_tok_overlap", "query_meta_tok_overlap",
    "is_played", "recency_score",
    "src_a_rank_inv", "src_b_rank_inv", "src_c_rank_inv", "src_d_rank_inv",
    "src_f_rank_inv", "src_als_rank_inv",
    "src_a_pres", "src_b_pres", "src_c_pres", "src_d_pres", "src_f_pres", "src_als_pres",
    "n_sources", "als_dot", "n_history",
    "popularity", "pool_artist_frac", "pool_artist_count", "source_count_v2",
    "r21_rank_inv", "r21_presence",
    "same_album_last1", "same_album_last3", "same_album_any",
    "album_history_count", "pool_same_album_count",
]
BASE_TRIPLE = ["r54_rank_inv", "r54_presence", "r54_cosine"]
LARGE_TRIPLE = ["r84_rank_inv", "r84_presence", "r84_cosine"]
MAX_META_TAGS = 12


def artist_key(artists):
    """Multi-artist items match only on the identical list."""
    return F.trim(F.lower(F.coalesce(F.concat_ws("\x1f", artists), F.lit(""))))


def album_key(album_id, album_name):
    return F.coalesce(F.try_element_at(album_id, F.lit(1)), F.try_element_at(album_name, F.lit(1)), F.lit(""))


def item_features(items: DataFrame) -> DataFrame:
    """Support columns of every catalog item."""
    tags = F.coalesce(F.col("tag_list"), F.array().cast("array<string>"))
    tag_set = F.array_sort(F.array_distinct(F.filter(
        F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    meta = F.concat_ws(" ", spaced(F.col("track_name")), spaced(F.col("artist_name")),
                       spaced(F.col("album_name")), spaced(F.slice(tags, 1, MAX_META_TAGS)))
    return items.select(
        "item_id", artist_key(F.col("artist_name")).alias("artist_key"), tag_set.alias("tags"),
        tokens(spaced(F.col("track_name"))).alias("title_toks"),
        tokens(spaced(F.col("artist_name"))).alias("artist_toks"),
        tokens(meta).alias("meta_toks"),
        album_key(F.col("album_id"), F.col("album_name")).alias("album_key"))


def restrict_items(items: DataFrame, candidates: DataFrame, plays: DataFrame,
                   heads: dict[str, int]) -> DataFrame:
    """Items reachable from list heads or plays only."""
    kept = None
    for source, n in heads.items():
        part = candidates.where((F.col("source") == source) & (F.col("rank") <= n)).select("item_id")
        kept = part if kept is None else kept.union(part)
    return items.join(kept.union(plays.select("item_id")).distinct(), "item_id", "left_semi")


def play_popularity(plays: DataFrame) -> DataFrame:
    return plays.groupBy("item_id").agg(F.count("*").alias("plays"))


def max_popularity(popularity: DataFrame):
    """Scalar normaliser, 1 for an empty table."""
    return popularity.agg(F.coalesce(F.max("plays"), F.lit(1)).alias("m")).scalar()


def with_attributes(pool: DataFrame, feats: DataFrame) -> DataFrame:
    """Item attributes with empty defaults for unknown items."""
    empty = F.array().cast("array<string>")
    out = pool.join(growing(feats), "item_id", "left")
    for c in ("artist_key", "album_key"):
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    for c in ("tags", "title_toks", "artist_toks", "meta_toks"):
        out = out.withColumn(c, F.coalesce(c, empty))
    return out


def recency_weights(plays: DataFrame) -> DataFrame:
    """1/(j+1) from the newest play, summed per (case, item) so repeats collapse early."""
    w = F.lit(1.0) / (F.col("pos_total") - F.col("pos") + 1)
    return plays.groupBy("case_id", "item_id").agg(F.sum(w).alias("w"))


def tag_key():
    """96 bits that stand for a tag set: fixed-width keys group far cheaper than arrays."""
    return F.xxhash64("tags"), F.hash("tags")


def with_tag_key(df: DataFrame, prefix: str) -> DataFrame:
    a, b = tag_key()
    return df.withColumn(f"{prefix}a", a).withColumn(f"{prefix}b", b)


SETS_IN_A_PACK = 64


def recency_parts(pool: DataFrame, plays: DataFrame, feats: DataFrame):
    """Recency weight per (case, artist) and weighted tag Jaccard per (case, tag set), both in whole trillionths.

    Tags are numbered. A case's distinct played sets go into packs of about ``SETS_IN_A_PACK`` and meet its pool's sets
    (at most a pool) inside a row, so no (pool set, played set) pair is ever shuffled; packs are summed afterwards.
    """
    # Whole trillionths: sums of integers come out alike in any order.
    age = F.col("pos_total") - F.col("pos") + 1
    weighted = plays.groupBy("case_id", "item_id").agg(F.sum(F.round(F.lit(1e12) / age).cast("long")).alias("w")).join(
        growing(feats.select("item_id", "artist_key", "tags")), "item_id")
    by_artist = (weighted.where("artist_key <> ''").groupBy("case_id", "artist_key")
                 .agg(F.sum("w").alias("artist_recency")))
    sets = (with_tag_key(weighted.where(F.size("tags") > 0), "_p").groupBy("case_id", "_pa", "_pb")
            .agg(F.sum("w").cast("double").alias("w"), F.first("tags").alias("tags")))
    n = sets.groupBy("case_id").agg(F.ceil(F.count("*") / SETS_IN_A_PACK).cast("int").alias("_packs"))
    hashed = lambda tags: F.transform(tags, lambda t: F.xxhash64(t))  # noqa: E731  numbers intersect faster than strings
    played = (sets.join(growing(n), "case_id").groupBy("case_id", F.pmod("_pb", F.col("_packs")).alias("_pack"))
              .agg(F.collect_list(F.struct("w", hashed(F.col("tags")).alias("tags"), F.size("tags").alias("n"))).alias("played")))
    pool_sets = with_tag_key(pool.select("case_id", "tags").where(F.size("tags") > 0), "_t").dropDuplicates(["case_id", "_ta", "_tb"])
    asked = pool_sets.groupBy("case_id").agg(
        F.collect_list(F.struct("_ta", "_tb", hashed(F.col("tags")).alias("tags"), F.size("tags").alias("n"))).alias("asked"))

    def shared(a, p):
        c = F.size(F.array_intersect(a["tags"], p["tags"]))
        return F.when(c > 0, F.round(p["w"] * c / (a["n"] + p["n"] - c)).cast("long")).otherwise(F.lit(0).cast("long"))

    score = lambda a: F.struct(a["_ta"].alias("_ta"), a["_tb"].alias("_tb"), F.aggregate(
        "played", F.lit(0).cast("long"), lambda t, p: t + shared(a, p)).alias("r"))
    met = asked.join(growing(played), "case_id").select("case_id", F.inline_outer(F.transform("asked", score)))  # outer: else a filter evaluates it twice
    by_tags = met.groupBy("case_id", "_ta", "_tb").agg(F.sum("r").alias("tag_recency"))
    return by_artist, by_tags


def context_features(pool: DataFrame, cases: DataFrame, plays: DataFrame, feats: DataFrame,
                     said: DataFrame) -> DataFrame:
    """Columns 0-7 and ``n_history``: ``pool`` carries item attributes, ``said(case_id, token)``."""
    last = (plays.where("pos = pos_total").join(growing(feats), "item_id", "left")
            .select("case_id", F.col("pos_total").cast("double").alias("_n_history"),
                    F.coalesce("artist_key", F.lit("")).alias("_last_artist"),
                    F.coalesce("tags", F.array().cast("array<string>")).alias("_last_tags"),
                    F.coalesce("album_key", F.lit("")).alias("_last_album")))
    now = cases.select("case_id", tokens(F.col("user_query")).alias("_now"))
    by_artist, by_tags = recency_parts(pool, plays, feats)
    seen = plays.select("case_id", "item_id").distinct().withColumn("_seen", F.lit(1.0))
    meta = (pool.select("case_id", "item_id", F.explode("meta_toks").alias("token"))
            .join(growing(said.select("case_id", "token").distinct()), ["case_id", "token"])
            .groupBy("case_id", "item_id").agg(F.count("*").cast("double").alias("_meta")))
    zero = F.lit(0.0)
    empty = F.array().cast("array<string>")
    known = F.col("artist_key") != ""
    # Everything that needs arrays comes first, so that they never travel through the later joins.
    out = (pool.join(growing(now), "case_id", "left").join(growing(last), "case_id", "left")
           .withColumn("rrf_rank_inv", F.lit(1.0) / F.col("pool_pos"))
           .withColumn("last_artist_match", F.when(known & (F.col("artist_key") == F.col("_last_artist")), 1.0).otherwise(0.0))
           .withColumn("last_tag_jaccard", jaccard(F.col("tags"), F.coalesce("_last_tags", empty)))
           .withColumn("query_artist_tok_overlap", overlap(F.col("artist_toks"), F.coalesce("_now", empty)))
           .withColumn("query_title_tok_overlap", overlap(F.col("title_toks"), F.coalesce("_now", empty)))
           .withColumn("n_history", F.coalesce("_n_history", zero)))
    out = with_tag_key(out, "_t").drop("_now", "_last_artist", "_last_tags", "_last_album", "_n_history",
                                       "tags", "title_toks", "artist_toks", "meta_toks")
    return (out.join(growing(seen), ["case_id", "item_id"], "left").join(growing(meta), ["case_id", "item_id"], "left")
            .join(growing(by_artist), ["case_id", "artist_key"], "left").join(growing(by_tags), ["case_id", "_ta", "_tb"], "left")
            .withColumn("query_meta_tok_overlap", F.coalesce("_meta", zero))
            .withColumn("is_played", F.coalesce("_seen", zero))
            .withColumn("recency_score", (F.coalesce("artist_recency", F.lit(0)) + F.coalesce("tag_recency", F.lit(0))).cast("double") / F.lit(1e12))
            .drop("_ta", "_tb", "_seen", "_meta", "artist_recency", "tag_recency"))


def pool_counts(pool: DataFrame, pool_k: int = DEFAULTS.pool_k) -> DataFrame:
    """Pool size, artist count and album count: three windows that share one exchange by case."""
    head = (F.col("artist_key") != "") & (F.col("pool_pos") <= pool_k)
    artist, album = W.partitionBy("case_id", "artist_key"), W.partitionBy("case_id", "album_key")
    return (pool.repartition("case_id")
            .withColumn("_pool_n", F.count("*").over(W.partitionBy("case_id")))
            .withColumn("_artist_n", F.when(F.col("artist_key") != "", F.count_if(head).over(artist)).otherwise(0))
            .withColumn("_album_n", F.when(F.col("album_key") != "", F.count("*").over(album)).otherwise(0)))


def source_features(pool: DataFrame) -> DataFrame:
    """Columns 8-20, 26-28: ranks and presence in the live sources and the text retriever."""
    out = pool
    n = F.lit(0.0)
    for code in LIVE_SOURCES:
        r = F.col(f"r_{code}")
        out = out.withColumn(f"src_{code}_rank_inv", rank_inv(r)).withColumn(f"src_{code}_pres", presence(r))
        n = n + presence(r)
    return (out.withColumn("n_sources", n).withColumn("source_count_v2", n)
            .withColumn("r21_rank_inv", rank_inv(F.col("r_text"))).withColumn("r21_presence", presence(F.col("r_text"))))


def global_features(pool: DataFrame, session_vecs: DataFrame, factors: DataFrame, popularity: DataFrame) -> DataFrame:
    """Columns 21, 23-25: factor dot product, popularity, artist share; needs ``pool_counts``."""
    out = (pool.join(growing(session_vecs.select("case_id", F.col("vec").alias("_sv"))), "case_id", "left")
           .join(growing(factors.select("item_id", F.col("vec").alias("_f"))), "item_id", "left")
           .withColumn("als_dot", F.coalesce(dot(F.col("_sv"), F.col("_f")), F.lit(0.0))).drop("_sv", "_f")
           .join(growing(popularity), "item_id", "left"))
    return (out.withColumn("popularity", F.coalesce("plays", F.lit(0)) / max_popularity(popularity))
            .withColumn("pool_artist_count", F.col("_artist_n").cast("double"))
            .withColumn("pool_artist_frac", F.col("_artist_n") / F.col("_pool_n")).drop("plays"))


def played_albums(plays: DataFrame, feats: DataFrame) -> DataFrame:
    """Per case and album: plays ``_hist``, whether among the last three or the last, and the case's plays ``_n``."""
    albums = plays.join(growing(feats.select("item_id", "album_key")), "item_id").where("album_key <> ''")
    return albums.groupBy("case_id", "album_key").agg(
        F.count("*").alias("_hist"), F.max(F.col("pos") > F.col("pos_total") - 3).alias("_last3"),
        F.max(F.col("pos") == F.col("pos_total")).alias("_last1"), F.max("pos_total").alias("_n"))


def album_features(pool: DataFrame, plays: DataFrame, feats: DataFrame) -> DataFrame:
    """Columns 29-33: album agreement with the history and inside the pool; needs ``pool_counts``."""
    counts = played_albums(plays, feats)

    def flag(c):
        return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return (pool.join(growing(counts), ["case_id", "album_key"], "left")
            .withColumn("same_album_last1", flag(F.col("_last1")))
            .withColumn("same_album_last3", flag(F.col("_last3")))
            .withColumn("same_album_any", flag(F.col("_hist") > 0))
            .withColumn("album_history_count", F.coalesce(F.col("_hist") / F.col("_n"), F.lit(0.0)))
            .withColumn("pool_same_album_count", F.col("_album_n") / F.col("_pool_n"))
            .drop("_hist", "_last3", "_last1", "_n"))


def triple_features(pool: DataFrame) -> DataFrame:
    """Columns 34-36 for both variants: rank, presence and cosine of the two fold retrievers."""
    out = pool
    for code, names in (("base", BASE_TRIPLE), ("large", LARGE_TRIPLE)):
        r = F.col(f"r_{code}")
        out = (out.withColumn(names[0], rank_inv(r)).withColumn(names[1], presence(r))
               .withColumn(names[2], F.coalesce(F.col(f"s_{code}"), F.lit(0.0))))
    return out


def featurize(pool: DataFrame, cases: DataFrame, plays: DataFrame, feats: DataFrame, said: DataFrame,
              session_vecs: DataFrame, factors: DataFrame, popularity: DataFrame) -> DataFrame:
    """All 40 columns (34 shared and both triples) per pool row."""
    # Arrays are used up by the context step; the rest of the plan moves narrow rows.
    out = pool_counts(with_attributes(pool, feats))
    out = source_features(context_features(out, cases, plays, feats, said))
    out = global_features(out, session_vecs, factors, popularity)
    out = triple_features(album_features(out, plays, feats))
    return out.select("case_id", "item_id", "pool_pos", *FEATURES, *BASE_TRIPLE, *LARGE_TRIPLE)


def variant(features: DataFrame, name: str) -> list[str]:
    """Column list of a ranker variant: only the last three columns differ."""
    return FEATURES + (BASE_TRIPLE if name == "base" else LARGE_TRIPLE)


def label_pool(features: DataFrame, cases: DataFrame) -> DataFrame:
    """Gold position (-1 when absent) and 0/1 label per pool row."""
    gold = cases.select("case_id", "gt")
    hit = (features.select("case_id", "item_id", "pool_pos").join(growing(gold), "case_id").where("item_id = gt")
           .select("case_id", F.col("pool_pos").alias("gt_pos")))
    return (features.join(growing(hit), "case_id", "left").withColumn("gt_pos", F.coalesce("gt_pos", F.lit(-1)))
            .withColumn("label", F.when(F.col("pool_pos") == F.col("gt_pos"), 1.0).otherwise(0.0)))


def case_gold_positions(pool: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per case: where its gold sits in the pool, or -1."""
    hits = pool.select("case_id", F.col("item_id").alias("gt"), "pool_pos")
    return cases.select("case_id", "gt").join(growing(hits), ["case_id", "gt"], "left").select(
        "case_id", "gt", F.coalesce("pool_pos", F.lit(-1)).alias("gt_pos"))
