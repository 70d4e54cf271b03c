"""License scan by diagonal voting.

A text is lower-cased (A-Z) and cut into words; every window of ``K`` words is hashed and joined to the positions of the
same window in the license templates (the hash is the key, the words themselves must agree). A hit votes for its
diagonal: word position in the text less position in the template. Votes are summed per diagonal before anything
else; neighbouring diagonals of one template that lie together are merged, so a few inserted or missing words don't
break a span; a span is verified by the share of the template's windows that voted for it.

Phrases are short templates whose every window must vote on one diagonal, which is the phrase standing word for word.
Only DataFrame operations are used; the templates are a fixed, small table and are broadcast.

Defined results: a null text counts as empty; a text without words has no places, null first and last words, an empty
label list and score 0; repeated rows each get a result; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from refrain.llm.common import lower_ascii, stage, whole_text

K = 3
#: Phrases with their labels, each K words or more.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Well-known sentences of public licenses, with the labels a near match earns.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                 "with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mit", "this project is released under the mit license"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
)
#: Diagonals this near each other, and spans this near in the text, are one; this share of windows verifies a span.
NEAR, COVERED = 3, 0.5
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: maximal runs of 0-9, a-z and whatever is not ASCII, after lower-casing A-Z."""
    parts = F.split(lower_ascii(text), NOT_WORD)
    # A separator at either end leaves an empty part there and nowhere else.
    return F.filter(parts, lambda w: w != "")


def windows(ws: Column) -> Column:
    return F.when(F.size(ws) >= K, F.transform(F.sequence(F.lit(0), F.size(ws) - K),
                                               lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(K)]))).otherwise(
        F.array().cast("array<string>"))


def template_windows(spark: SparkSession) -> DataFrame:
    """``(gram, hash, template, label, base, of, tpos)`` and one row for the empty window that stands for a text."""
    every = [(p, label, True) for p, label in PHRASES] + [(t, label, False) for label, t in TEMPLATES]
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(t).alias("words"), F.lit(label).alias("label"), F.lit(b).alias("base"))
                     for i, (t, label, b) in enumerate(every)])
    one = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    grams = windows(words(F.col("words")))
    cut = one.select("template", "label", "base", F.size(grams).alias("of"), F.posexplode(grams).alias("tpos", "gram"))
    text = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("of"),
                                 F.lit(-1).alias("tpos"), F.lit("").alias("gram"))
    return cut.unionByName(text).withColumn("hash", F.xxhash64("gram"))


def votes(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts ``(doc_id, doc_key, n_words, copies)`` and votes per diagonal ``(…, template, diagonal, n, first, last)``.

    One pass: a leading empty window stands for the text itself, so texts without any hit stay.
    """
    cut = docs.select("doc_id", F.xxhash64(whole_text(text)).alias("doc_key"), words(whole_text(text)).alias("ws"))
    # The array of words ends here: exploding beside it would copy it into every row. No list is empty, and the outer form
    # keeps the optimizer from testing that on the texts, where it would cut them into words again for every window.
    cut = cut.select("doc_id", "doc_key", F.size("ws").alias("n_words"), F.concat(F.array(F.lit("")), windows(F.col("ws"))).alias("grams"))
    grams = cut.select("doc_id", "doc_key", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
    t = F.broadcast(template_windows(docs.sparkSession))
    g = grams.select("doc_id", "doc_key", "n_words", (F.col("at") - 1).alias("pos"), "gram", F.xxhash64("gram").alias("hash"))
    hits = g.join(t, (g["hash"] == t["hash"]) & (g["gram"] == t["gram"])).select(
        "doc_id", "doc_key", "n_words", "template", "label", "base", "of", "pos", "tpos")
    # Repeated rows vote alike, so each window counts once; the text's own row tells how many there are.
    return (hits.groupBy("doc_id", "doc_key", "n_words", "template", "label", "base", "of", (F.col("pos") - F.col("tpos")).alias("diagonal"))
            .agg(F.count_distinct("tpos").alias("n"), F.count("*").alias("copies"), F.min("pos").alias("first"), F.max("pos").alias("last")))


def spans(voted: DataFrame) -> DataFrame:
    """Verified spans of votes: ``(doc_id, doc_key, label, base, first, last, score)``, words from ``first`` to ``last``."""
    key = ["doc_id", "doc_key"]
    exact = voted.where("base and n = of").select(*key, "label", "base", F.col("diagonal").alias("first"),
                                                  (F.col("diagonal") + F.col("of") + F.lit(K - 2)).alias("last"), F.lit(1.0).alias("score"))
    line = W.partitionBy(*key, "template").orderBy("diagonal", "first")
    near = voted.where("not base and template >= 0").withColumn("_new", F.coalesce(
        ((F.col("diagonal") - F.lag("diagonal").over(line)) > NEAR) | ((F.col("first") - F.lag("last").over(line)) > K + NEAR), F.lit(True)).cast("int"))
    run = near.withColumn("_run", F.sum("_new").over(line))
    merged = run.groupBy(*key, "template", "label", "base", "of", "_run").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"))
    share = F.least(F.col("n") / F.col("of"), F.lit(1.0))
    return exact.unionByName(merged.withColumn("score", share).where(F.col("score") >= COVERED).select(*key, "label", "base", "first", "last", "score"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_words, places)``; places are ``(label, base, first, last, score)`` in order."""
    # Written once: spans and texts are read from it, and the texts themselves are passed over once.
    voted = stage(votes(docs, text), "license-votes")
    # Only texts and their few hits are left here.
    place = F.struct("first", "last", "label", "base", "score")
    found = spans(voted).groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_list(place)).alias("places"))
    texts = voted.where("template = -1").select("doc_id", "doc_key", "n_words", "copies")
    f = found.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), "places")
    out = texts.join(f, texts["doc_id"].eqNullSafe(f["_id"]) & (texts["doc_key"] == f["_key"]), "left")
    return (out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "places"))
