"""Exact deduplication with an extendible-hash index on shared files.

1. One pass over the texts writes the log: each row's 64-bit key (xxHash of the normalised text), SHA-256 and size.
2. The directory doubles until no bucket holds more than ``capacity`` distinct keys: a bucket that is overfull at its
   depth is split by the next bit of its keys, others stay. Copies share a key and so never overfill a bucket.
3. At the deepest bucket's depth the directory has one slot for every value of that many bits; a shallower bucket fills
   several. A key's slot names its bucket, which is the key's only address: keys are filed and rows look up by it.
4. The index files hold the keys with their number of rows, in the order of their buckets; every owner task
   writes a range of buckets.
5. Keys with more than one row are chained in their bucket: the rows' bytes are grouped under their key, so equal bytes
   meet and texts that only share a key become links of one chain. Copies are merged before they are shuffled.
6. Rows go to their bucket and look their key up there. A chain of one link answers at once; a longer one is searched by
   bytes. A row without an address stops the job.

Only DataFrame operations are used. Texts are equal when they are identical after lower-casing A-Z.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, of several
rows with that doc_id all carry ``kept``; a null doc_id is smaller than any other and stays only when alone; an empty
table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from refrain.llm.common import lower_ascii, stage, whole_text

CAPACITY = 1 << 17
SPARE_BITS = 6
KEY_BITS = 64
BROADCAST_BYTES = 32 << 20


def _key(norm: Column, bits: int) -> Column:
    """The top ``bits`` of the hash, as an unsigned number's order (fewer bits only serve to test collisions)."""
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def _prefix(key: Column, depth: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, bits - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int, bits: int = KEY_BITS) -> DataFrame:
    """Buckets ``(depth, prefix, n)``: each holds at most ``capacity`` keys (or cannot be split further)."""
    # The keys are counted once, in cells far finer than the buckets; doubling then works on the cells.
    finest = min(bits, max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))) + SPARE_BITS)
    cells = stage(keys.groupBy(_prefix(F.col("key"), finest, bits).alias("cell")).agg(F.count("*").alias("n")), "dedup-cells")
    depth, done, open_ = 0, None, None
    while True:
        at = cells.groupBy((F.shiftrightunsigned("cell", finest - depth) if depth else F.lit(0).cast("long")).alias("prefix")).agg(F.sum("n").alias("n"))
        if open_ is not None:  # only the halves of buckets that were overfull one level up
            at = at.join(open_.select(F.col("prefix").alias("_p")), F.shiftrightunsigned("prefix", 1) == F.col("_p"), "left_semi")
        at = stage(at.select(F.lit(depth).alias("depth"), "prefix", "n"), f"dedup-directory-{depth}")
        fits = at if depth == finest else at.where(F.col("n") <= capacity)
        done = fits if done is None else done.unionByName(fits)
        open_ = at.where(F.col("n") > capacity)
        if depth == finest or not open_.limit(1).count():
            return done
        depth += 1


def slots(buckets: DataFrame, bits: int = KEY_BITS) -> tuple[DataFrame, int]:
    """The directory unrolled, ``(slot, bucket, depth)``, and its depth; a bucket's address is the first key it can hold."""
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {depth} - depth)")
    unrolled = buckets.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {depth} - depth)") - 1)).alias("slot"),
                              first.alias("_first"), "depth")
    address = F.shiftleft("_first", bits - depth) if depth else F.lit(0).cast("long")
    return unrolled.select("slot", address.alias("bucket"), "depth"), depth


def addressed(rows: DataFrame, book: tuple[DataFrame, int], bits: int = KEY_BITS) -> DataFrame:
    """``rows`` with a ``key``, and the ``bucket`` and ``depth`` that the directory names for it."""
    named, depth = book
    named = named.select(F.col("slot").alias("_slot"), "bucket", "depth")
    found = rows.withColumn("_slot", _prefix(F.col("key"), depth, bits)).join(F.broadcast(named) if 24 << depth <= BROADCAST_BYTES else named, "_slot", "left")
    lost = F.raise_error(F.concat(F.lit("no bucket for key "), F.hex("key"))).cast("long")
    return found.withColumn("bucket", F.coalesce("bucket", lost)).drop("_slot")


def build_index(log: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame]:
    """The directory and the index files ``(bucket, depth, key, n)`` of a log, written in bucket order."""
    keys = stage(log.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    buckets = directory(keys, capacity, bits)
    placed = addressed(keys, slots(buckets, bits), bits).select("bucket", "depth", "key", "n")
    order = F.col("bucket").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned addresses in signed order
    return buckets, stage(placed.repartitionByRange(order, F.col("key")).sortWithinPartitions(order, "key"), "dedup-index")


def look_up(rows: DataFrame, index: DataFrame, book: tuple[DataFrame, int], bits: int = KEY_BITS) -> DataFrame:
    """``rows`` with the ``bucket`` their key lies in and its number of rows ``n``; a key is sought in its bucket only."""
    return addressed(rows, book, bits).drop("depth").join(index.select("bucket", "key", "n"), ["bucket", "key"])


def deduplicate(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, keep_id, group_size, kept, text_sha256, key, bucket, chain)``, one row a row."""
    norm = docs.select("doc_id", lower_ascii(whole_text(text)).alias("norm")).withColumn("key", _key(F.col("norm"), key_bits))
    log = stage(norm.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-log")
    buckets, index = build_index(log, capacity, key_bits)
    book = slots(buckets, key_bits)
    place = ["bucket", "key"]
    shared = index.where("n > 1")
    few = shared.count() * 24 <= BROADCAST_BYTES
    wanted = F.broadcast(shared.select(*place)) if few else shared.select(*place)
    filed = addressed(norm, book, key_bits).drop("depth")
    # Grouping by place and bytes compares bytes; partial counts merge copies before the shuffle.
    links = filed.join(wanted, place, "left_semi").groupBy(*place, "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    links = stage(links.select(*place, "keep_id", "group_size", "norm"), "dedup-chains")
    chains = links.groupBy(*place).agg(F.count("*").alias("chain"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    found = look_up(log, index, book, key_bits)
    result = ["doc_id", "keep_id", "group_size", "text_sha256", "key", "bucket", "chain"]
    unique = found.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                         "text_sha256", *reversed(place), F.lit(1).cast("long").alias("chain"))
    out = unique.unionByName(found.where("n > 1").join(chains, place).where("chain = 1").select(*result))
    # Keys that different texts share: their rows are compared with the chain's texts byte by byte.
    longer = chains.where("chain > 1").select(*place, "chain")
    if longer.limit(1).count():
        clashing = filed.join(F.broadcast(longer) if few else longer, place)
        out = out.unionByName(clashing.join(links, [*place, "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).select(*result))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
