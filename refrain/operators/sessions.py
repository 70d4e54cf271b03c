"""Parsing conversation sessions into cases, plays and histories, in long format."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refrain.operators.joins import growing
from refrain.operators.positions import lookback, positions, running_sums

CHUNK_TURNS = 64


def explode_turns(sessions: DataFrame) -> DataFrame:
    """Nested ``conversations`` arrays to ``(session_id, pos, turn_number, role, content)``."""
    return sessions.select("session_id", F.posexplode("conversations").alias("pos", "t")).select(
        "session_id", F.col("pos").cast("long").alias("pos"), "t.turn_number", "t.role", "t.content")


def _turn_chunk(col: str = "turn_number"):
    return F.floor(F.col(col) / CHUNK_TURNS)


def last_requests(turns: DataFrame) -> DataFrame:
    """The last user turn of each session: what has to be answered."""
    newest = F.max_by(F.struct("turn_number", "content"), F.struct("turn_number", "pos")).alias("u")
    return (turns.where("role = 'user'").groupBy("session_id").agg(newest)
            .select("session_id", F.col("u.turn_number").alias("turn_number"),
                    F.col("u.content").alias("user_query")))


def history(turns: DataFrame, cases: DataFrame) -> DataFrame:
    """Turns strictly before each session's request turn."""
    upto = cases.select("session_id", F.col("turn_number").alias("_upto"))
    return turns.join(growing(upto), "session_id").where("turn_number < _upto").drop("_upto")


def plays_of(turns: DataFrame) -> DataFrame:
    """Music turns as plays, trimmed ids, with a dense 1-based position in session order."""
    music = turns.where("role = 'music'").select(
        "session_id", "turn_number", "pos", F.trim("content").alias("item_id"))
    return positions(music, ["session_id"], ["turn_number", "pos"], _turn_chunk(), "play_pos")


def utterances_of(turns: DataFrame) -> DataFrame:
    """User turns with a dense 1-based position in session order."""
    said = turns.where("role = 'user'").select("session_id", "turn_number", "pos", "content")
    return positions(said, ["session_id"], ["turn_number", "pos"], _turn_chunk(), "user_pos")


def nest_history(rows: DataFrame) -> DataFrame:
    """One ordered array per session, for records that must carry their whole transcript."""
    return (rows.groupBy("session_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn_number", "pos", "role", "content"))).alias("h"))
            .select("session_id", F.transform("h", lambda t: F.struct(
                t["role"].alias("role"), t["content"].alias("content"),
                t["turn_number"].alias("turn_number"))).alias("history")))


def listener_goal(goal):
    return F.coalesce(goal["listener_goal"], F.lit(""))


def assessments(rows: DataFrame) -> DataFrame:
    """``(session, turn) -> assessment``: nulls dropped, the last row of a turn wins."""
    kept = rows.where("turn_number is not null and assessment is not null")
    return kept.groupBy("session_id", "turn_number").agg(F.max_by("assessment", "pos").alias("assessment"))


def assessment_maps(rows: DataFrame) -> DataFrame:
    """One map per session; turns are distinct after ``assessments``."""
    return (assessments(rows).groupBy("session_id")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn_number", "assessment"))))
                 .alias("assess")))


def gold_of(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Gold item of each turn: the last music turn carrying that turn number."""
    return (turns.where("role = 'music'").groupBy(*keys, "turn_number")
            .agg(F.max_by(F.trim("content"), F.col("pos")).alias("gt")))


def lookup_gold(users: DataFrame, turns: DataFrame) -> DataFrame:
    """Gold by (session, user, turn) first, then by (session, turn); no gold drops the row."""
    by_user = gold_of(turns.where("user_id is not null"), ["session_id", "user_id"])
    by_session = gold_of(turns, ["session_id"])
    return (users.join(growing(by_user.withColumnRenamed("gt", "_u")), ["session_id", "user_id", "turn_number"], "left")
            .join(growing(by_session.withColumnRenamed("gt", "_s")), ["session_id", "turn_number"], "left")
            .withColumn("gt", F.coalesce("_u", "_s")).drop("_u", "_s").where("gt <> ''"))


def prior_counts(turns: DataFrame) -> DataFrame:
    """Per (session, turn_number): plays and user turns strictly before that turn number."""
    per_turn = turns.groupBy("session_id", "turn_number").agg(
        F.count_if(F.col("role") == "music").alias("m"), F.count_if(F.col("role") == "user").alias("u"))
    run = running_sums(per_turn, ["session_id"], ["turn_number"], _turn_chunk(),
                       {"cm": F.col("m"), "cu": F.col("u")})
    return run.select("session_id", "turn_number", (F.col("cm") - F.col("m")).alias("n_prior_music"),
                      (F.col("cu") - F.col("u")).alias("n_prior_user"))


def dev_cases(turns: DataFrame, assess: DataFrame | None = None) -> DataFrame:
    """One case per user turn that has gold, with counts that address its history."""
    users = turns.where("role = 'user'").select(
        "session_id", "user_id", "turn_number", "pos", F.col("content").alias("user_query"))
    cases = (lookup_gold(users, turns).join(growing(prior_counts(turns)), ["session_id", "turn_number"])
             .withColumn("case_id", F.concat_ws(":", "session_id", "turn_number", "pos")))
    if assess is not None:
        cases = cases.join(growing(assess), ["session_id", "turn_number"], "left")
    return cases


def train_transitions(turns: DataFrame) -> DataFrame:
    """Each play preceded by a user message, in stored order, with counts before it."""
    flagged = running_sums(
        turns, ["session_id"], ["pos"], F.floor(F.col("pos") / CHUNK_TURNS),
        {"n_user": F.when(F.col("role") == "user", 1).otherwise(0),
         "n_play": F.when(F.col("role") == "music", 1).otherwise(0)})
    return (flagged.where("role = 'music' and n_user > 0")
            .select("session_id", "pos", "turn_number", F.trim("content").alias("item_id"), "n_user",
                    (F.col("n_play") - 1).alias("n_prior_music")))


def stored_order(turns: DataFrame, role: str, pos_name: str, value: str) -> DataFrame:
    """Rows of one role numbered by stored position (the training walk does not sort)."""
    rows = turns.where(F.col("role") == role).select("session_id", "pos", F.trim("content").alias(value))
    if role == "user":
        rows = turns.where("role = 'user'").select("session_id", "pos", F.col("content").alias(value))
    return positions(rows, ["session_id"], ["pos"], F.floor(F.col("pos") / CHUNK_TURNS), pos_name).drop("pos")


def last_texts(cases: DataFrame, events: DataFrame, seen: str, pos: str, k: int, value: str,
               out: str, keys: list[str] | None = None) -> DataFrame:
    """Per case, the last ``k`` event values as an array, oldest first (bounded by ``k``)."""
    keys = keys or ["session_id"]
    rows = lookback(cases.select("case_id", *keys, seen), events, seen, pos, k, keys)
    return (rows.groupBy("case_id")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), F.col(value).alias("v")))).alias("a"))
            .select("case_id", F.transform("a", lambda s: s["v"]).alias(out)))
