"""A corpus pipeline in five stages; each is written as Parquet and read again as the next one's documents.

Toxic documents go; of equal texts one document stays, of near duplicates too; sources are mixed to their weights (a
document may then come twice or not at all); the last stage encodes what is left as tokens. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from refrain.llm import bpe, exact_dedup, mixing, near_copies, toxicity
from refrain.llm.common import numbered, stage, table

#: A classifier and connected components are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the cut, learned from all labels of documents."""
    model = toxicity.fit(_rows(docs), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="_toxicity").where(F.col("_toxicity") < toxicity.CUT).drop("_toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the document with the largest id; of repeated rows the last one read.

    A null id counts as the smallest, a null text as empty; other columns keep their values, whatever their names.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = numbered(docs, row, "copies-rows", files=True)
    kept = exact_dedup.deduplicate(rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("doc_id"), "text")).where("kept")
    return rows.join(kept.select(F.col("doc_id")["row"].alias("_kept")), rows[row] == F.col("_kept"), "left_semi").drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies connect (0.8 of their five-word shingles), the one with the smallest id.

    SimHash fingerprints of words propose, shingles are compared exactly; nulls, repeated rows and ties as in near_copies.
    """
    return near_copies.drop(docs, files=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole copies."""
    return mixing.whole_copies(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, source, ids, n_tokens)`` of documents whose ids decode to their text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    checked = F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("token ids do not decode to the text")).cast("binary"))
    return both.select("doc_id", "source", checked.alias("ids"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies),
          ("mix", mix_sources), ("byte bpe", encode_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
