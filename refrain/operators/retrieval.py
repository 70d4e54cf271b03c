"""Retrieval sources: lexical, dense, collaborative. Each returns ranked candidate rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from refrain.config import DEFAULTS, SOURCE_ORDER
from refrain.functions.numeric import l2_normalise, norm
from refrain.functions.text import TOKEN_PATTERN, words
from refrain.lineage import materialize, scratch_path, stored
from refrain.operators.blocks import dense_topk, sparse_topk, term_counter, weighted_means
from refrain.operators.joins import growing
from refrain.operators.topk import by_score


# ---- lexical -------------------------------------------------------------------------

def lexical_index(docs: DataFrame) -> DataFrame:
    """``docs(item_id, text)`` to postings ``(item_id, term, tf, dl)``."""
    kind = docs.schema["item_id"].dataType.simpleString()
    lower = docs.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    counted = lower.mapInArrow(term_counter(TOKEN_PATTERN), f"item_id {kind}, dl int, term string, tf long")
    # Rows that share an id and a length are one document.
    return counted.groupBy("item_id", "dl", "term").agg(F.sum("tf").alias("tf"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class LexicalIndex:
    """A written index: ``postings(item_id, term, tf, dl)``, ``terms(term, df)``, and two numbers, documents and tokens."""

    postings: DataFrame
    terms: DataFrame
    n: int
    total: int


def build_lexical_index(docs: DataFrame, name: str | None = None) -> LexicalIndex:
    """Tokenise ``docs(item_id, text)`` once and write what every search reads.

    With a ``name``, which must tell one corpus from another, the tables stay in the shared folder and later calls read them there.
    """
    spark = docs.sparkSession

    def keep(part, build):
        return stored(spark, f"lexical-{name}-{part}", build) if name else materialize(build(), scratch_path(spark, f"lexical-{part}"))

    postings = keep("postings", lambda: lexical_index(docs))
    terms = keep("terms", lambda: document_frequency(postings))
    # A document without words has no posting but counts; its text is not read for that.
    size = keep("size", lambda: spark.createDataFrame(
        [(docs.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0])], "n long, total long")).first()
    return LexicalIndex(postings, terms, size["n"], size["total"])


def bm25(query_terms: DataFrame, docs: DataFrame | LexicalIndex, k: int, k1: float = DEFAULTS.bm25_k1,
         b: float = DEFAULTS.bm25_b, **blocks) -> DataFrame:
    """Top-k documents per query; ``query_terms(query_id, term, qtf)`` carries repetitions.

    ``docs`` is a written index, or ``(item_id, text)``, which is indexed first.
    """
    index = docs if isinstance(docs, LexicalIndex) else build_lexical_index(docs)
    n, total, postings = index.n, index.total, index.postings
    avgdl = total / n if n else 1.0
    tf, dl = F.col("tf"), F.col("dl")
    weighted = postings.select("item_id", "term", (
        tf / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.lit(avgdl or 1.0)))).alias("w"))
    df = F.col("df")
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    queries = (query_terms.join(index.terms, "term")
               .select("query_id", "term", (F.col("qtf") * idf).alias("w")))
    return sparse_topk(queries, weighted, n, total, k, **blocks)


def terms_of(parts: DataFrame) -> DataFrame:
    """``parts(query_id, text, times)`` to query terms; repetition is a weight, not a string."""
    return (parts.select("query_id", "times", F.explode(words(F.col("text"))).alias("term"))
            .groupBy("query_id", "term").agg(F.sum("times").alias("qtf")))


# ---- dense ---------------------------------------------------------------------------

def unit_vectors(raw: DataFrame, dim: int) -> DataFrame:
    """Well-formed vectors of one width, scaled to unit length."""
    return (raw.where(F.col("vec").isNotNull() & (F.size("vec") == dim))
            .withColumn("vec", l2_normalise(F.col("vec"))))


def item_neighbours(vectors: DataFrame, k: int, wanted: DataFrame | None = None) -> DataFrame:
    """Item-to-item lists, the item itself included; only of the items that ``wanted(item_id)`` names, if given."""
    asked = vectors if wanted is None else vectors.join(growing(wanted.distinct()), "item_id", "left_semi")
    return (dense_topk(asked.select(F.col("item_id").alias("query_id"), "vec"), vectors, k)
            .withColumnRenamed("query_id", "anchor_id"))


def max_recent(anchors: DataFrame, vectors: DataFrame, recent_k: int, topn: int) -> DataFrame:
    """Best match to any of the last plays: ``anchors(case_id, anchors)``, at most ``recent_k`` ids.

    An item in the top-n by its best anchor is within that anchor's own top (n + recent_k), so
    item-to-item lists of that length give the exact answer and the similarity work depends on
    the catalog, not on the number of sessions.
    """
    used = anchors.select(F.explode("anchors").alias("item_id"))
    near = (item_neighbours(vectors, topn + recent_k, used).groupBy("anchor_id")
            .agg(F.collect_list(F.struct("item_id", "score")).alias("near")))
    scored = (anchors.withColumn("anchor_id", F.explode(F.array_distinct("anchors"))).join(growing(near), "anchor_id")
              .select("case_id", "anchors", F.inline("near"))
              .where(~F.array_contains("anchors", F.col("item_id"))))
    # One shuffle, by case, serves both the maximum and the cut.
    best = scored.select("case_id", "item_id", "score").repartition("case_id").groupBy("case_id", "item_id").agg(F.max("score").alias("score"))
    return by_score(best, "case_id", topn)


def last_neighbours(anchors: DataFrame, vectors: DataFrame, topk: int) -> DataFrame:
    """Neighbours of the single last play, itself excluded: ``anchors(case_id, anchor_id)``."""
    near = item_neighbours(vectors, topk + 1, anchors.select(F.col("anchor_id").alias("item_id"))).where("anchor_id <> item_id")
    near = (by_score(near.drop("rank"), "anchor_id", topk).groupBy("anchor_id")
            .agg(F.collect_list(F.struct("item_id", "score", "rank")).alias("near")))
    return anchors.join(growing(near), "anchor_id").select("case_id", F.inline("near"))


def masked_topk(queries: DataFrame, vectors: DataFrame, k: int, played: DataFrame | None = None, **how) -> DataFrame:
    """Dense retrieval per case, played items excluded when given; keeps the score."""
    q = queries.select(F.col("case_id").alias("query_id"), "vec")
    ex = None if played is None else played.select(F.col("case_id").alias("query_id"), "item_id")
    return dense_topk(q, vectors, k, ex, **how).withColumnRenamed("query_id", "case_id")


def stack_folds(per_fold: DataFrame, key: str, n_folds: int, scale: float = 1.0) -> DataFrame:
    """Fold vectors side by side: one dot product then sums the fold cosines."""
    packed = per_fold.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("fold", "vec"))).alias("f"))
    # A row that lacks a fold must not drop out of the lists in silence.
    whole = F.when(F.size("f") == n_folds, F.col("f")).otherwise(F.raise_error(F.concat(
        F.lit(f"{key} "), F.col(key).cast("string"), F.lit(f" has not all {n_folds} folds"))).cast("array<struct<fold:int,vec:array<double>>>"))
    flat = F.flatten(F.transform(whole, lambda s: s["vec"]))
    return packed.select(key, F.transform(flat, lambda x: x * F.lit(scale)).alias("vec"))


def fold_ensemble(queries: DataFrame, items: DataFrame, n_folds: int, k: int,
                  played: DataFrame | None = None) -> DataFrame:
    """Mean cosine over fold models: ``queries(case_id, fold, vec)``, ``items(item_id, fold, vec)``."""
    return masked_topk(stack_folds(queries, "case_id", n_folds, 1.0 / n_folds),
                       stack_folds(items, "item_id", n_folds), k, played)


# ---- collaborative -------------------------------------------------------------------

def decay_weights(known_plays: DataFrame, weighting: str = "oldest", decay: float = DEFAULTS.als_decay, out: str = "w") -> DataFrame:
    """Add ``out``: ``oldest`` puts weight 1 on the first play of ``known_plays(pos, pos_total)``, ``newest`` on the last."""
    exponent = F.col("pos") - 1 if weighting == "oldest" else F.col("pos_total") - F.col("pos")
    return known_plays.withColumn(out, F.pow(F.lit(decay), exponent))


def session_vectors(known_plays: DataFrame, factors: DataFrame, weighting: str = "oldest",
                    decay: float = DEFAULTS.als_decay, normalize: bool = True) -> DataFrame:
    """Decayed mean of item factors per case, weighted as ``decay_weights`` says.

    ``known_plays(case_id, item_id, pos, pos_total)`` counts only plays that have a factor.
    """
    weighted = decay_weights(known_plays, weighting, decay).select(F.col("case_id").alias("query_id"), "item_id", "w")
    out = weighted_means(weighted, factors).withColumnRenamed("query_id", "case_id")
    if normalize:
        out = out.where(norm(F.col("vec")) >= 1e-8).withColumn("vec", l2_normalise(F.col("vec")))
    return out


def session_topk(vectors: DataFrame, factors: DataFrame, played: DataFrame, k: int) -> DataFrame:
    return masked_topk(vectors, factors, k, played)


# ---- candidate tables ----------------------------------------------------------------

def as_source(ranked: DataFrame, source: str) -> DataFrame:
    return ranked.select("case_id", F.lit(source).alias("source"),
                         F.lit(SOURCE_ORDER.index(source)).alias("source_ord"),
                         F.col("rank").cast("int").alias("rank"), "item_id",
                         F.col("score").cast("double").alias("score"))


def union_sources(ranked: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in SOURCE_ORDER:
        if name in ranked:
            part = as_source(ranked[name], name)
            out = part if out is None else out.unionByName(part)
    return out


# ---- text encoder --------------------------------------------------------------------

def term_bucket(term: Column, width: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")


def _buckets(width: int) -> Column:
    return F.transform(words(F.col("text")), lambda t: term_bucket(t, width))


def _bucket_counts(texts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(keys, b, tf)``; a text without terms has one row with neither."""
    return texts.select(*keys, F.explode_outer(_buckets(width)).alias("b")).groupBy(*keys, "b").agg(F.count("b").alias("tf"))


def _unit_rows(weighted: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(keys, b, w)`` to vectors of unit length."""
    packed = weighted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("b", "w")))).alias("f"))

    def dense(f):
        n = F.sqrt(F.aggregate(f, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        # Entries come in the order of their places: each brings the zeros before it, so a row costs its width and no search.
        gap = lambda i: F.when(i == 0, F.lit(-1)).otherwise(f[F.greatest(i - 1, F.lit(0))]["b"])
        filled = F.transform(F.array(n), lambda length: F.flatten(F.concat(
            F.transform(f, lambda x, i: F.concat(F.array_repeat(F.lit(0.0), x["b"] - gap(i) - 1), F.array(x["w"] / length))),
            F.array(F.array_repeat(F.lit(0.0), F.lit(width - 1) - f[F.size(f) - 1]["b"])))))[0]
        return F.when((F.size(f) > 0) & (n > 0), filled).otherwise(F.array_repeat(F.lit(0.0), width))

    # Bound as a variable, so that the list is made once a row.
    return packed.select(*keys, F.transform(F.array("f"), dense)[0].alias("vec"))


def hashed_encoder(texts: DataFrame, corpus: DataFrame, width: int = 256) -> DataFrame:
    """Default encoder: terms hashed to ``width`` buckets, TF-IDF with unit length, fitted on ``corpus(text)``.

    ``texts`` keeps its columns but ``text`` and gets ``vec``; a text without known weight gets zeros. Only built-in functions,
    so any engine can repeat it.
    """
    keys = [c for c in texts.columns if c != "text"]
    n = corpus.count()
    df = corpus.select(F.explode(F.array_distinct(_buckets(width))).alias("b")).groupBy("b").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(float(n)) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    counts = _bucket_counts(texts, keys, width)
    weighted = counts.join(F.broadcast(df), "b", "left").withColumn("w", F.col("tf") * idf)  # at most ``width`` rows are broadcast
    return _unit_rows(weighted, keys, width)


def held_out_weights(corpus: DataFrame, n_folds: int, width: int = 256) -> DataFrame:
    """``(fold, b, idf)`` for every fold and bucket: what the encoder fitted without that fold of ``corpus(fold, text)`` weighs.

    Texts are tokenised once; a fold's frequencies are the total less its own, and ``n_folds`` x ``width`` rows come out.
    """
    spark = corpus.sparkSession
    seen = corpus.select("fold", F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct(_buckets(width)))).alias("b"))  # -1 counts texts
    counts = seen.groupBy("fold", "b").agg(F.count("*").alias("c"))
    grid = spark.range(n_folds).select(F.col("id").cast("int").alias("fold"), F.explode(F.sequence(F.lit(-1), F.lit(width - 1))).alias("b"))
    total = counts.groupBy("b").agg(F.sum("c").alias("t"))
    out = (grid.join(F.broadcast(counts), ["fold", "b"], "left").join(F.broadcast(total), "b", "left")  # bounded by folds x width
           .select("fold", "b", (F.coalesce("t", F.lit(0)) - F.coalesce("c", F.lit(0))).alias("df")))
    texts = out.where("b = -1").select("fold", F.col("df").alias("n"))
    idf = F.log((F.col("n").cast("double") + 1.0) / (F.col("df") + 1.0))
    return out.where("b >= 0").join(F.broadcast(texts), "fold").select("fold", "b", idf.alias("idf"))


def held_out_encoder(texts: DataFrame, weights: DataFrame, width: int = 256) -> DataFrame:
    """``hashed_encoder`` by the weights of each row's ``fold``: ``texts(..., fold, text)``, or every fold for texts without one."""
    keys = [c for c in texts.columns if c != "text"]
    counts = _bucket_counts(texts, keys, width)
    if "fold" not in keys:
        folds = weights.select("fold").distinct().agg(F.array_sort(F.collect_list("fold"))).first()[0]
        counts, keys = counts.withColumn("fold", F.explode(F.array(*[F.lit(f) for f in folds]))), [*keys, "fold"]
    weighted = counts.join(F.broadcast(weights), ["fold", "b"], "left").withColumn("w", F.col("tf") * F.col("idf"))
    return _unit_rows(weighted, keys, width)


def encode(texts: DataFrame, encoder: Column) -> DataFrame:
    """Apply a user's encoder column (for instance a pandas UDF over ``text``)."""
    return texts.withColumn("vec", encoder).drop("text")
