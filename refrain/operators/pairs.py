"""Training pairs, samples, batches and negatives for the text retrievers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from refrain.config import DEFAULTS
from refrain.functions.text import item_text, short_ref, structured_query
from refrain.lineage import materialize, scratch_path
from refrain.operators.folds import hash_order, permutation
from refrain.operators.joins import growing
from refrain.operators.positions import ordinal_by_sample
from refrain.operators.sessions import last_texts, stored_order, train_transitions
from refrain.operators.topk import top_k


def known_items(rows: DataFrame, items: DataFrame, col: str = "item_id") -> DataFrame:
    """Keep rows whose item exists in the catalog."""
    return rows.join(growing(items.select(F.col("item_id").alias(col))), col, "left_semi")


def without_sessions(turns: DataFrame, excluded: DataFrame) -> DataFrame:
    return turns.join(growing(excluded.select("session_id").distinct()), "session_id", "left_anti")


def overlap_count(turns: DataFrame, excluded: DataFrame) -> DataFrame:
    """How many sessions the exclusion skips."""
    return (turns.select("session_id").distinct().join(growing(excluded.select("session_id").distinct()), "session_id", "left_semi")
            .agg(F.count("*").alias("n_overlap")))


def item_texts(items: DataFrame) -> DataFrame:
    fields = [F.col(c) for c in ("track_name", "artist_name", "album_name", "tag_list")]
    return items.select("item_id", item_text(*fields).alias("item_text"))


def refs(items: DataFrame) -> DataFrame:
    return items.select("item_id", short_ref(F.col("track_name"), F.col("artist_name")).alias("ref"))


def structured_queries(cases: DataFrame, users: DataFrame, plays: DataFrame, items: DataFrame,
                       history_turns: int = DEFAULTS.history_turns,
                       context_tracks: int = DEFAULTS.context_tracks) -> DataFrame:
    """Structured query per case.

    ``cases(case_id, session_id, user_query, n_prior_user, n_prior_music)``,
    ``users(session_id, user_pos, content)``, ``plays(session_id, play_pos, item_id)``. Plays are
    cut to the last few first; those missing from the catalog then drop out.
    """
    named = plays.join(growing(refs(items)), "item_id")
    said = last_texts(cases, users, "n_prior_user", "user_pos", history_turns, "content", "history")
    heard = last_texts(cases, named, "n_prior_music", "play_pos", context_tracks, "ref", "context")
    empty = F.array().cast("array<string>")
    return (cases.join(growing(said), "case_id", "left").join(growing(heard), "case_id", "left")
            .withColumn("query", structured_query(
                F.col("user_query"), F.coalesce("history", empty), F.coalesce("context", empty)))
            .drop("history", "context"))


def dev_pairs(cases: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Structured query with the text of the gold item; unknown gold drops out."""
    texts = item_texts(items).withColumnRenamed("item_id", "gt")
    return cases.select("case_id", "gt", "fold").join(growing(queries.select("case_id", "query")), "case_id").join(growing(texts), "gt")


def train_pairs(turns: DataFrame, items: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Every known play after a user message, uncapped, in stored order.

    The running utterance list holds the current message, so only two earlier ones remain.
    """
    if excluded is not None:
        turns = without_sessions(turns, excluded)
    users = stored_order(turns, "user", "user_pos", "content")
    plays = stored_order(turns, "music", "play_pos", "item_id")
    steps = known_items(train_transitions(turns), items)
    current = users.select("session_id", F.col("user_pos").alias("n_user"), F.col("content").alias("user_query"))
    cases = (steps.join(growing(current), ["session_id", "n_user"]).where("user_query <> ''")
             .withColumn("case_id", F.concat_ws(":", "session_id", "pos"))
             .withColumn("n_prior_user", F.col("n_user") - 1))
    queries = structured_queries(cases, users, plays, items, history_turns=DEFAULTS.history_turns - 1)
    return queries.join(growing(item_texts(items)), "item_id").select("case_id", "session_id", "item_id", "query", "item_text")


def capped_sample(pairs: DataFrame, per_session: int = DEFAULTS.pairs_per_session,
                  total: int = DEFAULTS.sampled_pairs, seed: int = DEFAULTS.fold_seed) -> DataFrame:
    """At most ``per_session`` pairs of a session, then ``total`` overall, both in hash order."""
    # Keys are chosen without their texts, by a hash cut-off that leaves few more than wanted; the texts of those follow.
    keys = pairs.select("session_id", "case_id", hash_order(seed, "case_id").alias("_h"))
    keys = materialize(top_k(keys, ["session_id"], [F.col("_h"), F.col("case_id")], per_session, "_r").select("case_id", "_h"),
                       scratch_path(pairs.sparkSession, "sample-keys"))
    wanted = min(total, keys.count())
    share = min(1.0, 1.2 * total / max(1, keys.count()) + 0.001)
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") / float(1 << 32)
    while share < 1.0 and keys.where(place < share).count() < wanted:
        share = min(1.0, 2 * share)
    few = (keys if share >= 1.0 else keys.where(place < share)).orderBy("_h", "case_id").limit(total)
    return pairs.join(F.broadcast(few.select("case_id")), "case_id", "left_semi")  # at most ``total`` keys


def batches(pairs: DataFrame, seed: int, size: int = DEFAULTS.batch_size, id_col: str = "case_id") -> DataFrame:
    """Seeded shuffle cut into consecutive batches; the last may be short."""
    return permutation(pairs, seed, id_col).withColumn(
        "batch_id", F.floor((F.col("perm") - 1) / size).cast("long"))


def random_negatives(batched: DataFrame, items: DataFrame, seed: int,
                     n: int = DEFAULTS.negatives_per_batch, tries: int = 4) -> DataFrame:
    """``n`` catalog draws per batch that repeat neither a positive text nor each other.

    Draws address items by number, so there is no batch-by-catalog product. A batch stops after
    ``n * tries`` rejections and may then hold fewer.
    """
    numbered = ordinal_by_sample(item_texts(items), "item_id", "item_no")
    size = items.agg(F.count("*").alias("n")).scalar()
    draws = n + n * tries
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("batch_id"), F.col("draw")).cast("binary"))
    drawn = (batched.select("batch_id").distinct()
             .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
             .withColumn("item_no", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size + 1)
             .join(growing(numbered), "item_no"))
    positives = batched.select("batch_id", "item_text").distinct().withColumn("_positive", F.lit(True))
    judged = drawn.join(growing(positives), ["batch_id", "item_text"], "left")
    again = F.row_number().over(W.partitionBy("batch_id", "item_text").orderBy("draw")) > 1
    judged = judged.withColumn("_bad", F.coalesce("_positive", F.lit(False)) | again)
    upto = W.partitionBy("batch_id").orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)
    judged = (judged.withColumn("_rejected", F.count_if("_bad").over(upto))
              .withColumn("neg_no", F.count_if(~F.col("_bad")).over(upto)))
    return (judged.where(~F.col("_bad") & (F.col("neg_no") <= n) & (F.col("_rejected") < n * tries))
            .select("batch_id", "neg_no", "item_id", "item_text"))
