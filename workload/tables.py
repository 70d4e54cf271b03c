"""Logical tables of the library over the given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refrain.functions.numeric import l2_normalise
from refrain.lineage import fingerprint, materialize, scratch_path
from refrain.operators import retrieval as R, sessions as S
from refrain.operators.joins import growing
from refrain.operators.positions import positions, running_sums
from refrain.operators.topk import top_k
from refrain.plans.serving import Corpus, documents as catalog_documents


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_id(c: str):
    return F.col(c).cast("string")


_STAGED: dict = {}


def staged(name: str):
    """Build a table once per application, in the shared folder, and read it from there afterwards."""
    def wrap(build):
        def read(spark, sf) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf, name)
            if key not in _STAGED:
                path = scratch_path(spark, name)
                materialize(build(spark, sf), path)
                _STAGED[key] = path
            return spark.read.parquet(_STAGED[key])
        return read
    return wrap


def items(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    price = F.col("p_retailprice")
    return p.select(
        text_id("p_partkey").alias("item_id"), F.array("p_name").alias("track_name"), F.array("p_brand").alias("artist_name"),
        F.array("p_type").alias("album_name"),
        F.when(F.col("p_size") > 25, F.array(F.concat_ws("-", "p_type", size))).otherwise(F.array().cast("array<string>")).alias("album_id"),
        F.concat(F.split("p_name", " "), F.array(
            F.lower("p_type"), F.concat((F.col("p_size") % 10).cast("string"), F.lit("0s")), F.concat(F.lit("size "), size),
            F.concat(F.lit(" "), F.col("p_type")))).alias("tag_list"),
        F.when(F.col("p_size") != 17, F.concat((F.col("p_size") + 1950).cast("string"), F.lit("-06-01"))).alias("release_date"),
        F.floor(price * 200).cast("long").alias("duration"),
        F.round(price - F.floor(price / 100) * 100, 2).alias("popularity"))


def purchases(spark, sf, *extra: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cols = dict.fromkeys(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *extra])
    li = table(spark, sf, "lineitem").select(*cols)
    return (growing(o).join(li, o.o_orderkey == li.l_orderkey)
            .withColumn("case_id", text_id("o_custkey")).withColumn("item_id", text_id("l_partkey")))


@staged("all_plays")
def all_plays(spark, sf) -> DataFrame:
    order = ["o_orderdate", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    # Keys stay numbers while rows are shuffled and sorted; the ids become text afterwards.
    bought = purchases(spark, sf).select("o_custkey", *order)
    p = positions(bought, ["o_custkey"], order, F.unix_date(F.to_date("o_orderdate")), "pos", totals=True)
    return p.select(text_id("o_custkey").alias("case_id"), text_id("l_partkey").alias("item_id"), "pos", "pos_total")


def plays(spark, sf) -> DataFrame:
    """The history: what was played strictly before the gold play."""
    return all_plays(spark, sf).where("pos < pos_total").withColumn("pos_total", F.col("pos_total") - 1)


def gold(spark, sf) -> DataFrame:
    """The last play of each customer, which no history holds at its place."""
    return all_plays(spark, sf).where("pos = pos_total").select("case_id", F.col("item_id").alias("gt"))


def cases(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return c.join(growing(p), c.c_custkey == p.p_partkey, "left").select(
        text_id("c_custkey").alias("case_id"),
        F.coalesce(F.concat(F.lit("please give me "), "p_name", F.lit(" for "), "c_mktsegment"), F.col("c_mktsegment")).alias("user_query"))


def counted_turns(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    flag = lambda r: F.when(F.col("role") == r, 1).otherwise(0)
    return running_sums(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 64), {"tn": flag("user"), "na": flag("assistant")})


@staged("turns")
def turns(spark, sf) -> DataFrame:
    """Conversation turns; every assistant turn also plays one item (the customer's n-th purchase)."""
    b = counted_turns(spark, sf)
    user = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("u"), text_id("conv_id")))
    said = b.select(text_id("conv_id").alias("session_id"), user.alias("user_id"), (F.col("turn") * 2).alias("pos"),
                    F.col("tn").cast("int").alias("turn_number"), "role", F.col("text").alias("content"))
    p = plays(spark, sf).select("case_id", "item_id", F.col("pos").alias("na"))
    music = (b.where("role = 'assistant'").withColumn("case_id", text_id("conv_id")).join(growing(p), ["case_id", "na"])
             .select(F.col("case_id").alias("session_id"), user.alias("user_id"), (F.col("turn") * 2 + 1).alias("pos"),
                     F.col("tn").cast("int").alias("turn_number"), F.lit("music").alias("role"),
                     F.concat(F.lit(" "), "item_id", F.lit(" ")).alias("content")))
    return said.unionByName(music)


@staged("dev_cases")
def dev_cases(spark, sf) -> DataFrame:
    return S.dev_cases(turns(spark, sf))


def said(spark, sf) -> DataFrame:
    u = table(spark, sf, "conversations").where("role = 'user'")
    newest = u.groupBy("conv_id").agg(F.max("turn").alias("_m"))
    return u.join(growing(newest), "conv_id").select(text_id("conv_id").alias("case_id"), F.col("text").alias("content"),
                                            (F.col("turn") == F.col("_m")).alias("is_last"))


def raw_vectors(spark, sf, start: int = 1, width: int = 64) -> DataFrame:
    e = table(spark, sf, "embeddings").where(F.size("embedding") == 64)
    return e.select(text_id("vec_id").alias("item_id"), F.slice("embedding", start, width).cast("array<double>").alias("vec"))


SPACES = {"metadata": (1, 64), "collab": (1, 32), "audio": (33, 32)}


def vectors(spark, sf, space: str) -> DataFrame:
    start, width = SPACES[space]
    return R.unit_vectors(raw_vectors(spark, sf, start, width), width)


def factors(spark, sf) -> DataFrame:
    return raw_vectors(spark, sf)


def fold_vectors(spark, sf) -> DataFrame:
    # Five models of 16 dimensions each, 12 apart, read all 64.
    e = raw_vectors(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return e.withColumn("vec", l2_normalise(F.slice("vec", F.col("fold") * 12 + 1, F.lit(16))))


def last_plays(spark, sf) -> DataFrame:
    return plays(spark, sf).where("pos = pos_total").select("case_id", "item_id")


def fold_queries(spark, sf) -> DataFrame:
    return last_plays(spark, sf).join(growing(fold_vectors(spark, sf)), "item_id").select("case_id", "fold", "vec")


def last_vectors(spark, sf) -> DataFrame:
    return last_plays(spark, sf).join(growing(vectors(spark, sf, "collab")), "item_id").select("case_id", "vec")


def corpus(spark, sf) -> Corpus:
    c = cases(spark, sf)
    return Corpus(items=items(spark, sf), spaces={s: vectors(spark, sf, s) for s in SPACES}, factors=factors(spark, sf),
                  cases=c, plays=plays(spark, sf), said=said(spark, sf).join(growing(c.select("case_id")), "case_id", "left_semi"))


def catalog_index(spark, sf):
    """The lexical index of the catalog's texts, written once for these files and read by every search over them."""
    return R.build_lexical_index(catalog_documents(items(spark, sf)), f"catalog-{fingerprint(spark, [f'{sf}/part.parquet'])}")


def document_index(spark, sf):
    docs = table(spark, sf, "documents").select(text_id("doc_id").alias("item_id"), "text")
    return R.build_lexical_index(docs, f"documents-{fingerprint(spark, [f'{sf}/documents.parquet'])}")


def stored_lists(spark, sf) -> dict[str, DataFrame]:
    """Lists of the text and fold retrievers, with the last play standing in for the encoded query."""
    p = plays(spark, sf)
    return {
        "text_retriever": R.masked_topk(last_vectors(spark, sf), vectors(spark, sf, "collab"), 300, p),
        "struct_base": R.fold_ensemble(fold_queries(spark, sf), fold_vectors(spark, sf), 5, 300, p),
        "struct_large": R.fold_ensemble(fold_queries(spark, sf), fold_vectors(spark, sf), 5, 300),
    }


def scored(spark, sf) -> DataFrame:
    """Bounded pool with three scores per (customer, item), from purchase columns."""
    p = purchases(spark, sf, "l_quantity", "l_discount", "l_tax")
    best = p.groupBy("case_id", "item_id").agg(*[F.max(c).alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")])
    pool = top_k(best, ["case_id"], [F.desc("l_extendedprice"), F.asc("item_id")], 300, "pool_pos")
    nan = F.lit(float("nan"))
    return pool.select("case_id", "item_id", "pool_pos", F.round(F.col("l_extendedprice") / 5000, 6).alias("s_base"),
                       F.round(F.col("l_quantity") / 7, 6).alias("s_large"),
                       F.when(F.col("l_discount") > 0.08, nan).otherwise(
                           F.round(F.col("l_discount") * F.col("l_tax") * 100, 4)).alias("s_second"))


def returned(spark, sf) -> DataFrame:
    p = purchases(spark, sf, "l_returnflag").where("l_returnflag = 'R'")
    return p.select("case_id", "item_id").distinct()
