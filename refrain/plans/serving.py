"""The serving plan: sessions in, ranked items out, one lazy job over all cases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from refrain.config import DEFAULTS, Settings
from refrain.lineage import materialize, scratch_path, side_by_side
from refrain.operators import queries as Q, retrieval as R
from refrain.operators.features import featurize, item_features, play_popularity
from refrain.operators.fusion import fused_pool
from refrain.operators.joins import growing
from refrain.operators.positions import positions
from refrain.operators.topk import last_k_array
from refrain.functions.text import document_text, tokens


@dataclass
class Corpus:
    """Inputs of a serving run.

    ``items``: catalog. ``spaces``: vectors per space (``metadata``, ``collab``, ``audio``).
    ``factors``: collaborative item factors. ``cases(case_id, user_query)``,
    ``plays(case_id, item_id, pos, pos_total)``, ``said(case_id, content, is_last)``.
    ``lexical``: written index of the catalog's texts; without one a run writes its own.
    """

    items: DataFrame
    spaces: dict[str, DataFrame]
    factors: DataFrame
    cases: DataFrame
    plays: DataFrame
    said: DataFrame
    lexical: R.LexicalIndex | None = None


def recent(corpus: Corpus, k: int) -> DataFrame:
    return last_k_array(corpus.plays, "case_id", [F.desc("pos")], k, "item_id", "anchors")


def last_anchor(corpus: Corpus) -> DataFrame:
    return corpus.plays.where("pos = pos_total").select("case_id", F.col("item_id").alias("anchor_id"))


def documents(items: DataFrame) -> DataFrame:
    return items.select("item_id", document_text(*[F.col(c) for c in Q.FIELDS]).alias("text"))


def factor_plays(corpus: Corpus) -> DataFrame:
    """Plays that have a factor, renumbered after the others drop out."""
    known = corpus.plays.select("case_id", "item_id", F.col("pos").alias("_p")).join(
        growing(corpus.factors.select("item_id")), "item_id", "left_semi")
    return positions(known, ["case_id"], ["_p"], F.floor(F.col("_p") / 1024), "pos", totals=True).drop("_p")


def session_vectors(corpus: Corpus, settings: Settings = DEFAULTS, weighting: str = "oldest",
                    normalize: bool = True) -> DataFrame:
    return R.session_vectors(factor_plays(corpus), corpus.factors, weighting, settings.als_decay, normalize)


def retrieve(corpus: Corpus, settings: Settings = DEFAULTS, stored: dict[str, DataFrame] | None = None,
             vectors: DataFrame | None = None) -> DataFrame:
    """Candidate rows of every source; disabled sources are not planned at all.

    ``stored`` adds lists computed elsewhere (text and fold retrievers).
    """
    n, spaces = settings.live_topk, corpus.spaces
    vectors = session_vectors(corpus, settings) if vectors is None else vectors
    docs = corpus.lexical or R.build_lexical_index(documents(corpus.items))

    def near(space):
        return R.max_recent(recent(corpus, settings.recent_k), spaces[space], settings.recent_k, n)

    def lexical(parts):
        return R.bm25(R.terms_of(parts), docs, settings.bm25_topk).withColumnRenamed("query_id", "case_id")

    makers = {
        "bm25_lastmusic": lambda: lexical(Q.last_item_parts(corpus.cases, corpus.plays, corpus.items)),
        "bm25_convo": lambda: lexical(Q.conversation_parts(corpus.cases, corpus.said, corpus.plays, corpus.items)),
        "als_session": lambda: R.session_topk(vectors, corpus.factors, corpus.plays, settings.als_topk),
    }
    if "metadata" in spaces:
        makers["qwen_recent"] = lambda: near("metadata")
        makers["qwen_neighbors"] = lambda: R.last_neighbours(last_anchor(corpus), spaces["metadata"], n)
    if "collab" in spaces:
        makers["cfbpr_recent"] = lambda: near("collab")
    if "audio" in spaces and settings.weights.get("clap_recent", 0) > 0:
        makers["clap_recent"] = lambda: near("audio")
    # Each search counts its inputs before it is planned; the sources do so side by side.
    out = dict(zip(makers, side_by_side(makers.values())))
    out.update(stored or {})
    return R.union_sources(out)


def said_tokens(corpus: Corpus) -> DataFrame:
    """Distinct tokens of all user turns of a case, the request included."""
    texts = corpus.said.select("case_id", "content").union(corpus.cases.select("case_id", "user_query"))
    return texts.select("case_id", F.explode(tokens(F.col("content"))).alias("token")).distinct()


def features(corpus: Corpus, candidates: DataFrame, settings: Settings = DEFAULTS,
             vectors: DataFrame | None = None, pool_sources: list[str] | None = None) -> DataFrame:
    """Fused pool with all feature columns."""
    pool = fused_pool(candidates, settings.weights, settings.pool_k, settings.rrf_k, pool_sources)
    # The pool feeds three branches of the feature plan: fuse once, read it back as a narrow table.
    spark = pool.sparkSession
    pool = materialize(pool, scratch_path(spark, "pool"))
    vectors = session_vectors(corpus, settings) if vectors is None else vectors
    return featurize(pool, corpus.cases, corpus.plays, item_features(corpus.items), said_tokens(corpus),
                     vectors, corpus.factors, play_popularity(corpus.plays))
