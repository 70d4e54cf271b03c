"""Near copies: documents that share enough of their word shingles.

Proposing: a text gets ``PRINTS`` SimHash fingerprints of its distinct words, which differ by how the words' hashes are
mixed, and covering locality-sensitive hashing links those within ``BITS`` bits, exactly. One edited word in fifty breaks
a tenth of the five-word shingles, but moves a fingerprint of words by few bits; what one fingerprint misses another finds.

Checking: rows that links connect are compared by the exact Jaccard similarity of their distinct five-word shingles (as
64-bit hashes), and those at ``SHARE`` or more link. A proposed component is cut into blocks of bounded bytes. Each block
meets a few of the component's rows, its pivots, and itself; the heaviest group that this connects is settled. Only the
other rows then meet each other and that group, block by block, so a large group of copies costs about its size, and no
link is lost. Spanning forests of the links go on, so links connect what they should and nothing else. Quadratic is only
what no pivot reached.

Defined results: a null text counts as empty; texts without words are alike; a text of fewer words than a shingle is one
shingle; of connected rows that with the least doc_id stays (null last, then the first read), so of repeated rows one
stays; an empty table gives an empty table; columns keep their values and order, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from refrain.llm import simhash
from refrain.llm.common import numbered, ship, stage, whole_text
from refrain.operators.topk import top_k

#: Similarity as a fraction, so that comparing is exact.
WORDS, SHARE = 5, (4, 5)
#: Fingerprints a text has, and the bits within which two of them link.
PRINTS, BITS = 4, 4
BROADCAST_BYTES = 24 << 20
#: A component takes up to 16 blocks of the small size, so that it spreads over tasks, then as many of the large one.
SMALL_BLOCK, LARGE_BLOCK, SPREAD = 1 << 18, 4 << 20, 16
#: Rows of a large component that all its rows are compared with first.
PIVOTS = 4


def shingles(text: str, words: int = WORDS) -> list[int]:
    """Distinct hashes, signed, of the text's word shingles; words as in fingerprints."""
    from xxhash import xxh64_intdigest
    tokens = text.encode().lower().split()
    found = {xxh64_intdigest(b" ".join(tokens[i:i + words]), simhash.SEED) for i in range(max(1, len(tokens) - words + 1))}
    return [h - (1 << 64) if h >> 63 else h for h in found]


def prints(text: str, n: int = PRINTS) -> list[int]:
    """``n`` SimHash fingerprints, signed, of the text's distinct words (A-Z lower-cased, split at ASCII white space)."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = set(text.encode().lower().split())
    if not words:
        return [0] * n
    h = np.fromiter((xxh64_intdigest(w, simhash.SEED) for w in words), dtype="<u8", count=len(words))
    out = [simhash.majority(h)]
    for k in range(1, n):
        z = h * np.uint64(2 * k + 1) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(simhash.majority(z ^ (z >> np.uint64(31))))
    return out


def forest_of(rows, sets, share: tuple[int, int] = SHARE):
    """Spanning forest of the links among ``rows``, whose shingles are ``sets`` (none is empty)."""
    import numpy as np
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(size)])
    mine, left, links = np.zeros(codes.max() + 1, dtype=bool), np.arange(len(rows)), []
    # What is still to be reached is held apart and cut down as it halves, so a group around one text costs little more than its size.
    pool, others, start = left, codes, at[:-1]
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            if 2 * len(left) <= len(pool):
                pool, others = left, np.concatenate([codes[at[x]:at[x + 1]] for x in left])
                start = np.concatenate([[0], np.cumsum(size[left])[:-1]])
            x = reached.pop()
            own = codes[at[x]:at[x + 1]]
            mine[own] = True
            both = np.add.reduceat(mine[others], start, dtype=np.int64)[np.searchsorted(pool, left)]
            mine[own] = False
            near = share[1] * both >= share[0] * (size[x] + size[left] - both)
            links += [(rows[x], rows[y]) for y in left[near]]
            reached += left[near].tolist()
            left = left[~near]
    return links


def _forests(batches):
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        for r in range(batch.num_rows):
            rows, sets = [], []
            for side in ("a", "b"):
                block = batch.column(side)[r]
                if block.is_valid:
                    rows += block.values.field("row").to_pylist()
                    sets += [np.asarray(s.values) for s in block.values.field("shingles")]
            links = forest_of(rows, sets)
            yield pa.RecordBatch.from_arrays([pa.array([max(x) for x in links], pa.int64()), pa.array([min(x) for x in links], pa.int64())], names=["u", "v"])


def _blocks(octets):
    """How many blocks that many bytes of shingles are cut into."""
    return F.greatest(F.least(F.ceil(octets / SMALL_BLOCK), F.lit(SPREAD)), F.ceil(octets / LARGE_BLOCK)).cast("int")


def _packs(sets: DataFrame, out: str, *keys: str) -> DataFrame:
    return sets.groupBy(*keys).agg(F.collect_list(F.struct("row", "shingles")).alias(out))


def _linked(packs: DataFrame) -> DataFrame:
    """``packs(a, b)`` to the edges, u > v, of each pack's forest; b may be null."""
    return packs.mapInArrow(_forests, "u long, v long").where("u > v").distinct()


def links(sets: DataFrame) -> DataFrame:
    """``sets(row, part_of, shingles)`` to edges ``(u, v)``, u > v, that connect the rows of a ``part_of`` as their links do."""
    octets = F.size("shingles") * 8 + 64
    # A component of several blocks has 256 KB or more, so the list of them is short.
    large = stage(sets.groupBy("part_of").agg(_blocks(F.sum(octets)).alias("blocks")).where("blocks > 1"), "near-large")
    known = large.count()
    if not known:
        return _linked(_packs(sets, "a", "part_of").select("a", F.lit(None).cast("array<struct<row:long,shingles:array<long>>>").alias("b")))
    short = F.broadcast if known * 64 <= BROADCAST_BYTES else (lambda df: df)
    alone = _packs(sets.join(short(large), "part_of", "left_anti"), "a", "part_of")
    none = F.lit(None).cast(alone.schema["a"].dataType)
    several = sets.join(short(large), "part_of").withColumn("part", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    own = stage(_linked(_beside_pivots(several, octets)), "near-own")
    cells = stage(several.join(_main_rows(several.select("part_of", "row", octets.alias("octets")), own, short), "row", "left"), "near-cells")
    rest = cells.where("main is null")
    cut = rest.groupBy("part_of").agg(_blocks(F.sum(octets)).alias("n"))
    packs = _packs(rest.join(short(cut), "part_of").withColumn("q", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")), "a", "part_of", "blocks", "n", "q")
    # The main group is connected already: only what it lacks meets it, and itself.
    mains = packs.select("part_of", "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part")).join(
        _packs(cells.where("main"), "b", "part_of", "part"), ["part_of", "part"]).select("a", "b")
    first = packs.select("part_of", "a", "q", F.explode(F.sequence("q", F.col("n") - 1)).alias("p"))
    second = packs.select("part_of", F.col("q").alias("p"), F.col("a").alias("b"))
    # A block without rows has no pack, and each pack meets itself by an empty second side.
    met = first.where("q < p").join(second, ["part_of", "p"]).select("a", "b")
    met = met.unionByName(packs.select("a", none.alias("b")))
    return own.unionByName(_linked(alone.select("a", none.alias("b")).unionByName(mains).unionByName(met))).distinct()


def _beside_pivots(several: DataFrame, octets) -> DataFrame:
    """Each block of ``several`` beside its component's pivots, ``PIVOTS`` of its rows under a small block's size."""
    light = several.where(octets <= SMALL_BLOCK).select("part_of", "row", F.xxhash64("row", F.lit(1)).alias("order"))
    chosen = top_k(light, ["part_of"], [F.asc("order"), F.asc("row")], PIVOTS, "n").select("row")
    pivots = _packs(several.join(chosen, "row", "left_semi"), "a", "part_of", "blocks")
    pivots = pivots.select("part_of", "a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    return _packs(several, "b", "part_of", "part").join(pivots, ["part_of", "part"], "left").select("a", "b")


def _main_rows(weights: DataFrame, edges: DataFrame, short) -> DataFrame:
    """``(row, main)`` of the rows of the heaviest group that ``edges`` connect in each component of ``weights(part_of, row, octets)``."""
    placed = simhash.components(edges)
    placed = stage(placed.unionByName(placed.select(F.col("root").alias("u"), "root")).distinct(), "near-groups")
    heavy = weights.join(placed.withColumnRenamed("u", "row"), "row").groupBy("part_of", "root").agg(F.sum("octets").alias("octets"))
    main = heavy.groupBy("part_of").agg(F.max(F.struct("octets", "root"))["root"].alias("root")).select("root")
    return placed.join(short(main), "root", "left_semi").select(F.col("u").alias("row"), F.lit(True).alias("main"))


def proposed(rows: DataFrame) -> DataFrame:
    """``rows(row, text)`` to ``(row, part_of)`` of the rows that some fingerprint connects with others."""
    @F.arrow_udf("array<long>")
    def printed(texts):
        import pyarrow as pa
        return pa.array([prints(t.as_py()) for t in texts], pa.list_(pa.int64()))

    known = stage(rows.select("row", F.posexplode(printed(whole_text("text"))).alias("space", "fp")), "near-prints")
    # Rows of one fingerprint hang on the first of them, and firsts on each other as their fingerprints link.
    first = stage(known.groupBy("space", "fp").agg(F.min("row").alias("first"), F.count("*").alias("_n")), "near-firsts")
    alike = simhash.join_heavy(known, first.where("_n > 1"), "space", "fp").where("row > first").select(F.col("row").alias("u"), F.col("first").alias("v"))
    near = simhash.linked(first.select("space", "fp"), BITS)
    # A value that stands in two spaces proposes a pair too many at worst; the texts decide.
    name = lambda c, out: first.select(F.col("fp").alias(c), F.col("first").alias(out))
    met = near.join(name("u", "a"), "u").join(name("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = alike.unionByName(met.where("u > v")).distinct()
    return simhash.components(links).select(F.col("u").alias("row"), F.col("root").alias("part_of"))


def drop(docs: DataFrame, text: str = "text", files: bool = False) -> DataFrame:
    """Rows of ``docs`` without near copies: of connected ones that with the least doc_id (null last) stays.

    ``files``: the table stands as it is in Parquet files, so its rows need no copy to be numbered.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = numbered(docs, row, "near-rows", files)
    others = stage(proposed(rows.select(F.col(row).alias("row"), F.col(text).alias("text"))), "near-proposed").where("row <> part_of")
    firsts = others.select("part_of").distinct().select(F.col("part_of").alias("row"), "part_of")

    @F.arrow_udf("array<long>")
    def sets_of(texts):
        import pyarrow as pa
        return pa.array([shingles(t.as_py()) for t in texts], pa.list_(pa.int64()))

    found = rows.select(F.col(row).alias("row"), F.col(text).alias("_text")).join(others.unionByName(firsts), "row")
    sets = stage(found.select("row", "part_of", sets_of(whole_text("_text")).alias("shingles")), "near-shingles")
    placed = simhash.components(links(sets))
    placed = placed.unionByName(placed.select(F.col("root").alias("u"), "root")).distinct()  # a root is named by the others alone
    ids = rows.select(F.col(row).alias("u"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u"))["u"]
    stay = placed.join(ids, "u").groupBy("root").agg(first.alias("u")).select("u")
    gone = placed.select("u").join(stay, "u", "left_anti")
    return rows.join(gone, rows[row] == gone["u"], "left_anti").drop(row)


ship(__name__)
