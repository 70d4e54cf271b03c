"""A: scans, sources, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.lineage import materialize, materialize_folds, scratch_path
from refrain.operators import features as FE, retrieval as R, sessions as S
from refrain.operators.folds import with_folds
from refrain.operators.topk import top_k
from refrain.sources import artifacts, candidates as CD, catalog, sessions as SS
from workload import tables as T
from workload.registry import query
from workload.sql import q


@query("A1_load_catalog", q("items", """
SELECT i.item_id, track_name[1] AS track_name, l.l_suppkey, l.l_quantity, len(tag_list) AS n_tags FROM items i JOIN (
  SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) = 1) l
ON i.item_id = cast(l.l_partkey AS varchar)"""))
def a1(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"), "l_suppkey", "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("row_order"))
    newest = catalog.last_wins(li, "item_id", "row_order").drop("row_order")
    raw = T.items(spark, sf).withColumnRenamed("item_id", "track_id")
    items = catalog.normalise(raw)
    return items.join(newest, "item_id").select(
        "item_id", catalog.first(F.col("track_name")).alias("track_name"), "l_suppkey", "l_quantity",
        F.size("tag_list").cast("long").alias("n_tags"))


@query("A2_load_split_sessions", q("last_req", """
SELECT c_mktsegment AS split, session_id, turn_number, user_query
FROM last_req JOIN customer ON cast(c_custkey AS varchar) = session_id"""))
def a2(spark, sf):
    splits = T.table(spark, sf, "customer").select(T.text_id("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("split"))
    return S.last_requests(T.turns(spark, sf)).join(splits, "session_id").select("split", "session_id", "turn_number", "user_query")


@query("A3_dev_split_scan", "SELECT cast(conv_id AS varchar) AS session_id, turn AS pos, role, text AS content FROM conversations")
def a3(spark, sf):
    return SS.newest_file_rows(spark, f"{sf}/conv*.parquet").select(
        T.text_id("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


@query("A4_train_split_turns", q("turns", "SELECT session_id, pos, turn_number, role, content FROM turns"))
def a4(spark, sf):
    return T.turns(spark, sf).select("session_id", "pos", "turn_number", "role", "content")


@query("A5_unit_vectors", q("vmeta vcollab vaudio", " UNION ALL ".join(
    f"SELECT '{s}' AS space, item_id, cast(unnest(range(1, len(vec) + 1)) AS int) AS dim, round(unnest(vec), 6) AS x FROM {c}"
    for s, c in (("metadata", "vmeta"), ("collab", "vcollab"), ("audio", "vaudio")))))
def a5(spark, sf):
    out = None
    for s in T.SPACES:
        v = T.vectors(spark, sf, s).select(F.lit(s).alias("space"), "item_id", F.posexplode("vec").alias("p", "v"))
        v = v.select("space", "item_id", (F.col("p") + 1).alias("dim"), F.round("v", 6).alias("x"))
        out = v if out is None else out.unionByName(v)
    return out


def bought(spark, sf):
    return T.scored(spark, sf).where("pool_pos <= 20").select(
        "case_id", "item_id", F.col("pool_pos").alias("rank"), F.col("s_base").alias("score"))


@query("A6_json_candidate_lists", q("scored", """
SELECT case_id, item_id, cast(pool_pos AS int) AS rank, s_base AS score, 'ranked' AS layout FROM scored WHERE pool_pos <= 20
UNION ALL SELECT case_id, item_id, cast(pool_pos AS int), NULL, 'flat' FROM scored WHERE pool_pos <= 20"""))
def a6(spark, sf):
    stored = CD.lists_json(bought(spark, sf))
    ranked = CD.parse_lists(stored, "value").withColumn("layout", F.lit("ranked"))
    ids = bought(spark, sf).groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("ids"))
    flat_json = ids.select(F.to_json(F.create_map("case_id", "ids")).alias("value"))
    flat = CD.parse_flat_lists(flat_json, "value").withColumn("layout", F.lit("flat"))
    return ranked.unionByName(flat).select("case_id", "item_id", F.col("rank").cast("int").alias("rank"), "score", "layout")


@query("A7_artifact_tables", q("plays feats", """
SELECT f.item_id, artist_key, album_key, array_to_string(tags, '|') AS tags, coalesce(p.n, 0) AS plays
FROM feats f LEFT JOIN (SELECT item_id, count(*) AS n FROM plays GROUP BY 1) p USING (item_id)"""))
def a7(spark, sf):
    support = materialize(FE.item_features(T.items(spark, sf)), scratch_path(spark, "support"))
    pop = materialize(FE.play_popularity(T.plays(spark, sf)), scratch_path(spark, "popularity"))
    return support.join(pop, "item_id", "left").select(
        "item_id", "artist_key", "album_key", F.array_join("tags", "|").alias("tags"),
        F.coalesce("plays", F.lit(0)).cast("long").alias("plays"))


def records(spark, sf):
    """Prediction records: best items per customer with the customer's segment as the reply."""
    ids = bought(spark, sf).groupBy("case_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("predicted_track_ids"))
    c = T.table(spark, sf, "customer").select(T.text_id("c_custkey").alias("case_id"), "c_nationkey", "c_mktsegment")
    return ids.join(c, "case_id").select(F.col("case_id").alias("session_id"), F.col("c_nationkey").alias("turn_number"),
                                         "predicted_track_ids", F.col("c_mktsegment").alias("predicted_response"))


RECORDS = """SELECT case_id AS session_id, c_nationkey AS turn_number, list(item_id ORDER BY pool_pos) AS predicted_track_ids,
  any_value(c_mktsegment) AS predicted_response
FROM scored JOIN customer ON cast(c_custkey AS varchar) = case_id WHERE pool_pos <= 20 GROUP BY 1, 2"""


@query("A8_prediction_sink", q("scored", f"""
SELECT session_id, cast(turn_number AS bigint) AS turn_number, array_to_string(predicted_track_ids, ',') AS ids, predicted_response
FROM ({RECORDS})"""))
def a8(spark, sf):
    path = scratch_path(spark, "predictions")
    artifacts.write_predictions(records(spark, sf), path)
    back = spark.read.schema("session_id string, turn_number long, predicted_track_ids array<string>, predicted_response string").json(path)
    return back.select("session_id", "turn_number", F.array_join("predicted_track_ids", ",").alias("ids"), "predicted_response")


@query("A9_payload_hash", q("scored", f"""
WITH h AS (SELECT sha256(to_json({{'session_id': session_id, 'turn_number': turn_number, 'predicted_track_ids': predicted_track_ids,
  'predicted_response': predicted_response}})::varchar) AS sha FROM ({RECORDS})),
b AS (SELECT left(sha, 3) AS bucket, sha256(string_agg(sha, '' ORDER BY sha)) AS d FROM h GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY bucket)) AS payload_sha FROM b"""))
def a9(spark, sf):
    return artifacts.payload_hash(records(spark, sf))


@query("A10_manifest_audit", """
SELECT url || '#' || page_id AS name, CASE WHEN NOT starts_with(url, 'https') THEN 'MISSING' WHEN contains(url, '?') THEN 'BAD' ELSE 'OK' END AS status FROM pages""")
def a10(spark, sf):
    """Pages as files: plain-http ones were never fetched, query-string ones have a stale manifest entry."""
    pages = T.table(spark, sf, "pages").select(F.concat_ws("#", "url", "page_id").alias("name"), "url", "html")
    folder = scratch_path(spark, "pages")
    artifacts.write_files(pages.where(F.startswith("url", F.lit("https"))).select("name", F.col("html").alias("content")), folder)
    fresh = artifacts.bytes_digest(F.coalesce("html", F.lit("")))
    manifest = pages.select(artifacts.file_name(F.col("name")).alias("name"), F.col("name").alias("page"),
                            F.when(F.contains("url", F.lit("?")), F.lit("stale")).otherwise(fresh).alias("sha256"))
    status = artifacts.audit(spark, folder, manifest, artifacts.CHUNK_BYTES)
    return manifest.select("name", "page").join(status, "name").select(F.col("page").alias("name"), "status")


POP = "SELECT item_id, count(*) AS plays FROM plays GROUP BY 1"


@query("A11_stage_materialize", q("plays", f"""
SELECT 'first' AS run, item_id, plays FROM ({POP}) UNION ALL SELECT 'kept', item_id, plays FROM ({POP})
UNION ALL SELECT 'forced', item_id, plays + 1 FROM ({POP})"""))
def a11(spark, sf):
    pop = FE.play_popularity(T.plays(spark, sf))
    more = pop.withColumn("plays", F.col("plays") + 1)
    path, forced = scratch_path(spark, "stage"), scratch_path(spark, "stage")
    first = materialize(pop, path)
    kept = materialize(more, path)                       # stands already: skipped
    materialize(pop, forced)
    again = materialize(more, forced, force=True)        # rebuilt
    tag = lambda df, run: df.select(F.lit(run).alias("run"), "item_id", "plays")
    return tag(first, "first").unionByName(tag(kept, "kept")).unionByName(tag(again, "forced"))


@query("A12_fold_resume", q("sess_folds dev_cases", """
SELECT fold, case_id, CASE WHEN fold < 2 THEN 'first' ELSE 'resumed' END AS run FROM dev_cases JOIN sess_folds USING (session_id)"""))
def a12(spark, sf):
    rows = with_folds(T.dev_cases(spark, sf)).select("fold", "case_id")
    path = scratch_path(spark, "folds")
    materialize_folds(rows.where("fold < 2").withColumn("run", F.lit("first")), path)
    return materialize_folds(rows.withColumn("run", F.lit("resumed")), path).select("fold", "case_id", "run")
