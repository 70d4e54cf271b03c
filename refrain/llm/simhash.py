"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in over half the hashes of a text's word shingles (repeats included). Fingerprints
link when they differ in at most ``radius`` bits.

Every bit position gets a vector of ``radius + 1`` bits; the mask of a non-zero vector v keeps the positions whose
vector has an odd product with v. For any ``radius`` positions some v is orthogonal to all their vectors, so that
v's mask hides every difference: each pair within the radius has equal keys in at least one of the
``2 ** (radius + 1) - 1`` tables. Only distinct fingerprints enter the tables.

Within a bucket no pairs are emitted: its fingerprints are compared in bounded blocks, and of a block (or of two blocks,
for a bucket that has several) only a spanning forest of its links goes on. Forests connect what the links connect, so
components come out whole, and a bucket of m fingerprints yields under m rows a pair of blocks. The forests of many tables
say the same of a group many times over, so edges are first contracted in chunks of bounded size: a chunk goes on as stars,
one edge a node at most. Components are found by alternating star steps whose lineage is cut by tables in the shared folder.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like any other; a
text of fewer words than a shingle is one shingle; equal texts share a fingerprint; repeated rows each get a result; a
null doc_id never names a component unless it is alone there; an empty table gives an empty table; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refrain.llm.common import ship, stage, whole_text

WORDS, RADIUS, SEED = 4, 4, 42
BLOCK = 1024
BROADCAST_BYTES = 24 << 20
#: Fingerprints a task spreads over the covering tables.
KEYED_ROWS = 1 << 14
#: Edges a task contracts at a time.
CHUNK = 1 << 19
PART = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash, signed, over XXH64 (seed 42) of the text's shingles, repeats included; bytes split at ASCII white space."""
    import numpy as np
    from xxhash import xxh64_intdigest
    tokens = text.encode().lower().split()
    n = max(0, len(tokens) - words + 1) if len(tokens) >= words else min(1, len(tokens))
    if not n:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.append(0, ends[:-1] + 1)
    last = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    spans = zip(starts.tolist(), last.tolist())
    return majority(np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in spans), dtype="<u8", count=n))


def majority(hashes) -> int:
    """The bits that over half of 64-bit ``hashes`` have set, as a signed number."""
    import numpy as np
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), PART):
        set_bits += np.unpackbits(hashes[at:at + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text", out: str = "fp") -> DataFrame:
    """Add ``out``: the whole text's fingerprint as a long."""
    @F.arrow_udf("long")
    def prints(texts):
        import pyarrow as pa
        return pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())

    return docs.withColumn(out, prints(whole_text(text)))


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Signed masks of the covering tables."""
    half = 2 ** radius  # vectors with the top bit set while they last, so that every mask keeps many positions
    vectors = [half + i % half if bits <= half else 1 + i % (2 * half - 1) for i in range(bits)]
    unsigned = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def forest_of(a, b, radius: int):
    """Spanning forest of the links among fingerprints ``a`` (``b`` None), or between ``a`` and ``b``."""
    import numpy as np
    nodes = a if b is None else np.unique(np.concatenate([a, b]))
    u = nodes.astype(np.uint64)
    label = np.arange(len(u), dtype=np.int32)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    while True:
        lower = np.where(near, label[None, :], np.int32(len(u))).min(axis=1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    at = np.flatnonzero(label != np.arange(len(u)))
    return nodes[at], nodes[label[at]]


def _forests(radius: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            left, right = [], []
            for r in range(batch.num_rows):
                a = np.asarray(batch.column("a")[r].values)
                other = batch.column("b")[r]
                x, y = forest_of(a, np.asarray(other.values) if other.is_valid else None, radius)
                left.append(x)
                right.append(y)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), pa.int64()), pa.array(np.concatenate(right), pa.int64())],
                                                 names=["u", "v"])
    return run


def linked(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``(u, v)``: edges that connect the distinct fingerprints ``fps(fp)`` as their links do; u > v.

    With a column ``space`` only fingerprints of one space meet.
    """
    space = [F.col("space")] if "space" in fps.columns else []
    # One number stands for a table's bucket; should two buckets share it, their fingerprints are compared all the same.
    tables = F.array(*[F.xxhash64(F.lit(t), *space, F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius))])
    # Tables multiply the rows, so a task takes a bounded number of fingerprints, however few files they lie in.
    tasks = max(1, -(-fps.count() // KEYED_ROWS))
    keyed = fps.repartition(tasks, "fp").select("fp", F.explode(tables).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    sizes = stage(sizes, "simhash-buckets")
    # Two fingerprints of a bucket are its least and its greatest; only larger buckets need their members.
    pairs = sizes.where("n = 2").select(F.col("high").alias("u"), F.col("low").alias("v")).where(
        F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    large = sizes.where("n > 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if large.count() * 24 <= BROADCAST_BYTES:  # else both sides are shuffled
        large = F.broadcast(large)
    packs = (keyed.join(large, "key")
             .groupBy("key", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("part"))
             .agg(F.collect_list("fp").alias("fps")))
    alone = packs.where("blocks = 1").select(F.col("fps").alias("a"), F.lit(None).cast("array<long>").alias("b"))
    several = packs.where("blocks > 1")
    # A block goes to each of its partners, so a bucket's pairs of blocks spread over as many tasks as it has blocks.
    first = several.select("key", "part", F.col("fps").alias("a"), F.explode(F.sequence(F.col("part").cast("int"), F.col("blocks") - 1)).alias("part_b"))
    second = several.select("key", F.col("part").cast("int").alias("part_b"), F.col("fps").alias("b"))
    crossed = first.join(second, ["key", "part_b"]).select("a", F.when(F.col("part") < F.col("part_b"), F.col("b")).alias("b"))
    forests = alone.unionByName(crossed).mapInArrow(_forests(radius), "u long, v long")
    up = forests.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return pairs.unionByName(up).distinct()


def stars(u, v):
    """Edges from each node of the edges ``u``, ``v`` to the least node they connect it with; least nodes have none."""
    import numpy as np
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            lower = label[label]
            if (lower == label).all():
                break
            label = lower
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[at], nodes[label[at]]


def _stars(chunk: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def out(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        us, vs, held = [], [], 0
        for batch in batches:
            us.append(batch.column("u").to_numpy(zero_copy_only=False))
            vs.append(batch.column("v").to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= 2 * chunk:
                u, v = stars(np.concatenate(us), np.concatenate(vs))
                us, vs, held = [u], [v], len(u)
                if held > chunk:
                    yield out(u, v)
                    us, vs, held = [], [], 0
        if held:
            yield out(*stars(np.concatenate(us), np.concatenate(vs)))
    return run


def contracted(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges that connect what the written table ``edges(u, v)`` does: each chunk of them as stars."""
    tasks = max(1, -(-edges.count() // chunk))
    return edges.coalesce(tasks).mapInArrow(_stars(chunk), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node that an edge ``(u, v)`` names: the least node it is connected with.

    Large-star steps hang every greater neighbour on a node's least neighbour; small-star steps do so with the lesser
    ones. Only least neighbours are aggregated; a node of any degree is joined, never gathered.
    """
    now, seen = stage(contracted(stage(edges, "simhash-edges")), "simhash-chunks"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = large.where("u > v").distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(least, "u")
        now = stage(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "simhash-stars")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        if state == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, component_id)``: the least doc_id each row is connected with."""
    known = stage(fingerprints(docs.select("doc_id", F.col(text).alias("text")), words).select("doc_id", "fp"), "simhash-prints")
    least = stage(known.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(linked(least.select("fp"), radius, block))
    placed = stage(least.join(roots, least.fp == roots.u, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    named = join_heavy(placed, names, "root").select("fp", F.col("n").alias("_n"), "component_id")
    return join_heavy(known, named, "fp").select("doc_id", "fp", "component_id")


def join_heavy(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``keys`` and in ``_n`` how many rows have it.

    Keys that hold a thousandth of all rows or more, a thousand at most, are looked up where the rows lie; only the
    others are shuffled.
    """
    total = table.agg(F.sum("_n")).first()[0] or 0
    heavy = table.where(F.col("_n") * 1000 >= total)
    light = rows.join(F.broadcast(heavy.select(*keys)), list(keys), "left_anti").join(table.drop("_n"), list(keys))
    return rows.join(F.broadcast(heavy.drop("_n")), list(keys)).unionByName(light)


ship(__name__)
