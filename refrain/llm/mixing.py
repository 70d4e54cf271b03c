"""Mixing sources to target weights along a low-discrepancy schedule.

Every source's documents, shuffled by a hash, lie end to end on a line of words, which is cut into equal blocks. The
schedule has one slot a block: slot ``i`` sits at the fractional part of ``i`` times the golden ratio, and the source
whose stretch of the cumulative weights holds that point gets the slot. Slots are ranked per source, and the ``r``-th
slot of a source takes its ``r``-th block; past the end of the line a source begins again. So any run of slots holds
each source close to its weight. A source leaves the schedule when it has its target; the schedule runs on for those that
lack a few slots, at most to twice the number of blocks (no gap between ``2n`` golden-ratio points is as wide as ``1/n``).
So every block's slot is a point of the sequence, and every source gets its target to within one word.

The slots are the mix's order: a document's first slot and number of pieces are returned, and whole documents come in the
order of their slots, one partition a stretch of the schedule.

Targets share ``budget`` x all words by weight; a target stops at ``max_epochs`` x its source's words and what is above
is shared again by weight.

Sources are ordered by code point, a null source last. Ranks and offsets are counted in bounded chunks, so a source
that holds most rows is never in one task. Per-source totals go through the driver: the list of sources is the mix's
configuration, one row a source.

Defined results: a null text has no words; a document without words is taken 0 words; repeated rows are documents of
their own; an empty table gives an empty table; extra columns are kept, those that bear an output's name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from refrain.llm.common import stage, whole_text
from refrain.operators.positions import running_sums

#: The golden ratio's fractional part, and the weights that repeat over the ordered sources.
GOLDEN = (math.sqrt(5) - 1) / 2
#: Points are whole multiples of 2**-52, so they are exact for any slot below 2**36.
POINT_BITS, HALF_BITS = 52, 26
WEIGHTS = (3, 1, 2)
BUDGET, MAX_EPOCHS = 1.5, 2
#: Block size: about this many slots, within these bounds of words.
SLOTS, LEAST_BLOCK, MOST_BLOCK = 1 << 19, 16, 4096
#: Up to so many sources their list is broadcast; a longer one is shuffled.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def share_out(sizes: list[int], weights: list[float], total: float, most: list[float]) -> list[float]:
    """Share ``total`` by weight; whoever reaches its ``most`` stops there and the rest is shared again."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / weight > most[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(most[i])
            open_.discard(i)
        left = max(0.0, total - sum(t for i, t in enumerate(targets) if i not in open_))
    return targets


def source_targets(sized: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS,
                   weights: tuple = WEIGHTS) -> list[dict]:
    """Words, weight and target of each source, in order."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in rows]
    w = [float(weights[i % len(weights)]) for i in range(len(rows))]
    targets = share_out(sizes, w, budget * sum(sizes), [max_epochs * s for s in sizes])
    return [{"k": i, "source": r["source"], "source_size": r["size"], "weight": x, "target": t}
            for i, (r, x, t) in enumerate(zip(rows, w, targets))]


def _sources(spark, targets: list[dict], block: int) -> DataFrame:
    """Sources with the stretch of the unit interval each owns, in slots."""
    slots = [math.ceil(round(t["target"]) / block) for t in targets]
    total, edge, rows = sum(slots), 0, []
    for t, n in zip(targets, slots):
        rows.append((t["k"], t["source"], t["source_size"], t["target"], round(t["target"]), n, edge / max(total, 1), (edge + n) / max(total, 1)))
        edge += n
    return spark.createDataFrame(rows, "k int, source string, source_size long, target double, words long, slots long, lo double, hi double")


def _row_hash(text: str = "text") -> Column:
    """Rows that agree in id, source and text are alike to the mix."""
    return F.xxhash64(whole_text(text), F.col("source").cast("string"))


def _small(df: DataFrame, n_sources: int) -> DataFrame:
    return F.broadcast(df) if n_sources <= BROADCAST_SOURCES else df


def point(slot: Column) -> Column:
    """Fractional part of ``slot`` times the golden ratio, in whole numbers until the end."""
    high, low = divmod(round(GOLDEN * (1 << POINT_BITS)), 1 << HALF_BITS)
    top = (slot * F.lit(high)).bitwiseAND(F.lit((1 << HALF_BITS) - 1)) * F.lit(1 << HALF_BITS)
    return (top + slot * F.lit(low)).bitwiseAND(F.lit((1 << POINT_BITS) - 1)) / F.lit(float(1 << POINT_BITS))


def schedule(sources: DataFrame, n_sources: int, n_slots: int, cells: int = 4096) -> DataFrame:
    """Slots with their source and their rank in it: ``(slot, k, block)``, every rank below the source's slots once."""
    spark, length = sources.sparkSession, 2 * n_slots + 2
    slots = spark.range(length).select(F.col("id").alias("slot")).withColumn("at", point(F.col("slot"))).withColumn(
        "cell", F.least(F.floor(F.col("at") * cells), F.lit(cells - 1)))
    stretches = sources.where("slots > 0").select("k", "slots", "lo", "hi").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    dealt = slots.join(_small(stretches, n_sources), "cell").where("at >= lo and at < hi").select("slot", "k", "slots")
    ranked = running_sums(dealt, ["k"], ["slot"], F.floor(F.col("slot") / max(1, math.ceil(4 * math.sqrt(length)))), {"rank": F.lit(1)})
    return ranked.withColumn("block", F.col("rank") - 1).where("block < slots").select("slot", "k", "block")


def block_words(total_words: float) -> int:
    return int(min(MOST_BLOCK, max(LEAST_BLOCK, total_words // SLOTS)))


def lines(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Documents ``(k, size, order columns…)`` laid end to end per source: adds ``start`` and ``nth``."""
    n = docs.count()
    chunks = max(1, math.ceil(math.sqrt(n) / 4))  # both levels of counting grow with the root of the rows
    placed = docs.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "_text_hash"))
    # Unsigned hash order cut into equal chunks; the chunk never falls along the order.
    top = F.shiftrightunsigned(F.col("_hash").bitwiseXOR(F.lit(-(1 << 63))), 32)
    chunk = F.floor(top * F.lit(chunks) / F.lit(float(1 << 32)))
    laid = running_sums(placed, ["k"], ["_hash", "doc_id", "_text_hash"], chunk, {"_end": F.col("size"), "nth": F.lit(1)})
    return laid.withColumn("start", F.col("_end") - F.col("size")).drop("_end", "_hash")


def mix(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: tuple = WEIGHTS,
        text: str = "text", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs(doc_id, source, text)``.

    Returns the documents' places ``(doc_id, k, size, source_size, target, words, start, nth)`` and the mixed stream:
    ``(slot, doc_id, k, nth, epoch, first_word, n_words, _text_hash)``, in which slot after slot a document gives a run of words.
    """
    spark = docs.sparkSession
    sized = stage(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"),
                              _row_hash(text).alias("_text_hash")), "mix-sizes")
    targets = source_targets(sized, budget, max_epochs, weights)
    words = sum(round(t["target"]) for t in targets)
    block = block_words(words)
    sources = _sources(spark, targets, block)
    keyed = sized.join(_small(sources.select("k", F.col("source").alias("_s"), "source_size", "target", "words"), len(targets)),
                       F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    places = stage(lines(keyed, seed), "mix-places")
    n_slots = sum(math.ceil(round(t["target"]) / block) for t in targets)
    return places, _stream(places, schedule(sources, len(targets), n_slots), block, max_epochs)


def _stream(places: DataFrame, slots: DataFrame, block: int, max_epochs: int) -> DataFrame:
    # The line of a source repeats: epoch e begins at e x its words, and the mix takes what lies before its target.
    runs = (places.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
            .withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where("at < words")
            .withColumn("to", F.least(F.col("at") + F.col("size"), F.col("words"))))
    pieces = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("to") - 1) / block))))
    first = F.greatest(F.col("at"), F.col("block") * block)
    last = F.least(F.col("to"), (F.col("block") + 1) * block)
    return (pieces.join(slots, ["k", "block"])
            .select("slot", "doc_id", "k", "nth", "epoch", (first - F.col("at")).alias("first_word"), (last - first).alias("n_words"), "_text_hash"))


def taken_words(places: DataFrame, stream: DataFrame) -> DataFrame:
    """``places`` with the words the mix takes of each document, repeats counted, and where: ``taken, first_slot, n_pieces``.

    A document that isn't taken has 0 words, 0 pieces and no first slot.
    """
    taken = stream.groupBy("k", "nth").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return places.join(taken, ["k", "nth"], "left").select(*places.columns, count("taken"), "first_slot", count("n_pieces"))


def whole_copies(docs: DataFrame, **settings) -> DataFrame:
    """The mix in whole documents: each comes as often as the words taken of it, to the nearest whole copy.

    Copies come in the order of the schedule: one stands at the first slot of its round over the source's line. At most
    one document a source is taken in part. A document without words gives the mix nothing and doesn't come. Rows
    alike in id, source and text share one count.
    """
    places, stream = mix(docs, **settings)
    alike = ["doc_id", "_text_hash"]
    rounds = stream.groupBy(*alike, "epoch").agg(F.sum("n_words").alias("words"), F.min("slot").alias("slot"))
    taken = rounds.groupBy(*alike).agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("epoch", "slot"))).alias("at"))
    sizes = places.where("size > 0").groupBy(*alike).agg(F.sum("size").alias("size"))
    same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t._text_hash") == F.col("s._text_hash"))
    copies = F.floor(F.col("words") / F.col("size") + 0.5).cast("int")
    times = stage(taken.alias("t").join(sizes.alias("s"), same)
                  .select(F.col("t.doc_id").alias("_id"), F.col("t._text_hash").alias("_th"), F.slice("at.slot", F.lit(1), copies).alias("_slots")), "mix-copies")
    end = times.agg(F.max(F.array_max("_slots")).alias("end")).first()["end"] or 0
    mixed = docs.join(times, docs["doc_id"].eqNullSafe(times["_id"]) & (_row_hash() == times["_th"]))
    # The list of copies is exploded behind the join, so a text is carried there once.
    placed = mixed.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.explode(times["_slots"]).alias("slot"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    ordered = placed.repartitionById(parts, F.floor(F.col("slot") * parts / F.lit(end + 1)).cast("int")).sortWithinPartitions("slot")
    return ordered.select("row.*")
