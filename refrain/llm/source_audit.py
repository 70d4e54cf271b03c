"""How far the sources of a language diverge in their words, counted through minimal acyclic transducers.

1. Terms in at least ``least_docs`` documents of a language are kept. Documents are counted once a term in partial tables.
2. The kept terms of a language, sorted by their bytes, are cut into shards of bounded size. A task builds of each shard
   the minimal acyclic automaton (equal suffixes share their states) and lays its transitions into one double array.
   Transitions carry outputs whose sum along a term is its ordinal in the sorted list, so the table maps terms to
   numbers and back without holding a term.
3. Texts are streamed through the transducers again: all tokens of a batch take a step at a time along the arrays, those
   that end in a final state are counted under (language, source, ordinal). Transducers go to the workers in groups of
   bounded bytes; a vocabulary beyond the bound takes as many passes as it has groups.
4. Shares p of the counts are compared: for every two sources of a language over all kept terms (a zero count has a share
   too), in tiles of sources times ranges of ordinals, whose sums are added; and for every source against its
   language, where ties go to the smaller ordinal, which is the smaller term.

All shares are whole numbers found by long division in 64 bits; nothing is rounded.

Defined results: null text, language and source are the empty string; a group without kept terms has all counts zero; a
language without kept terms has divergence 0 between all its sources and no terms; repeated rows are documents of their
own; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refrain.llm.common import ship, stage, stretches, whole_text

#: Fixed values of the share: scale, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 5
LEAST_DOCS, TOP = 30, 50
#: Bytes that are part of a term, A-Z lower-cased; all others part terms.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms a shard, bytes of transducers sent at once, partial entries held by a task.
SHARD_TERMS, SENT_BYTES, HELD = 100_000, 64 << 20, 1_000_000
#: Bytes of text walked at once.
SLAB = 4 << 20
#: A tile compares so many sources with as many others over so many ordinals.
TILE_SOURCES, TILE_TERMS = 128, 4096
BROADCAST_BYTES = 32 << 20


# ---- the transducer --------------------------------------------------------------------

class Transducer:
    """Sorted byte strings to their ordinals and back.

    State 0 is the start. The transition of state s by byte b lies in slot ``base[s] + b`` if ``check`` there is s.
    """

    FIELDS = ("base", "check", "target", "out", "final")

    def __init__(self, base, check, target, out, final):
        self.base, self.check, self.target, self.out, self.final = base, check, target, out, final

    @classmethod
    def build(cls, terms: list) -> Transducer:
        """Of sorted distinct byte strings: states that no further term can change are merged with equal ones."""
        known, nodes, path, before = {}, [], [[{}, False]], b""

        def settle(to: int) -> None:
            while len(path) > to:
                edges, final = path.pop()
                same = (final, *edges.items())
                if same not in known:
                    known[same] = len(nodes)
                    nodes.append((edges, final))
                path[-1][0][before[len(path) - 1]] = known[same]

        for term in terms:
            common, stop = 0, min(len(term), len(before))
            while common < stop and term[common] == before[common]:
                common += 1
            settle(common + 1)
            path += [[{}, False] for _ in range(len(term) - common)]
            path[-1][1] = True
            before = term
        settle(1)
        nodes.append(tuple(path[0]))
        return cls._laid_out(nodes[::-1])  # children were settled first: reversed, the start is 0 and every edge points onwards

    @classmethod
    def _laid_out(cls, nodes: list) -> Transducer:
        import numpy as np
        n, last = len(nodes), len(nodes) - 1
        below = [0] * n  # terms that begin at a state
        for s in range(n - 1, -1, -1):
            below[s] = nodes[s][1] + sum(below[last - t] for t in nodes[s][0].values())
        base, slots, first_free = np.zeros(n, dtype=np.int32), {}, 0
        for s, (edges, final) in enumerate(nodes):
            if not edges:
                continue
            marks = sorted(edges)
            at, tries = first_free - marks[0], 0
            while any(at + b in slots for b in marks):
                at, tries = at + 1, tries + 1
            if tries > 64:  # crowded slots are not searched again
                first_free = max(first_free, at + marks[0] - 32)
            base[s], number = at, int(final)
            for b in marks:
                to = last - edges[b]
                slots[at + b] = (s, to, number)
                number += below[to]
        size, shift = max(slots, default=0) + 257, -min([0, *base.tolist()])
        check, target, out = np.full(size + shift, -1, np.int32), np.zeros(size + shift, np.int32), np.zeros(size + shift, np.int32)
        if slots:
            at = np.fromiter(slots, dtype=np.int64, count=len(slots)) + shift
            check[at], target[at], out[at] = np.array(list(slots.values())).T
        return cls(base + np.int32(shift), check, target, out, np.array([f for _, f in nodes], dtype=bool))

    def packed(self) -> dict:
        return {f: getattr(self, f).tobytes() for f in self.FIELDS}

    @classmethod
    def unpacked(cls, row) -> Transducer:
        import numpy as np
        kinds = dict.fromkeys(cls.FIELDS, np.int32) | {"final": bool}
        return cls(*(np.frombuffer(row[f], dtype=kinds[f]) for f in cls.FIELDS))

    def ordinals(self, octets, at):
        """``(which, ordinal)`` of the known ones among the tokens that start at ``at`` and end at the next blank."""
        import numpy as np
        which, state = np.arange(len(at)), np.zeros(len(at), dtype=np.int32)
        number, found, numbers = np.zeros(len(at), dtype=np.int32), [], []
        at = at.copy()
        while len(at):
            b = octets[at]
            ended = b == 32
            if ended.any():
                last = np.flatnonzero(ended)
                last = last[self.final[state[last]]]
                found.append(which[last])
                numbers.append(number[last])
            slot = self.base[state] + b
            on = np.flatnonzero((self.check[slot] == state) & ~ended)
            slot = slot[on]
            state, number, which, at = self.target[slot], number[on] + self.out[slot], which[on], at[on] + 1
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *found]), np.concatenate([empty, *numbers])

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        import numpy as np
        state, out = 0, bytearray()
        while True:
            if self.final[state]:
                if ordinal == 0:
                    return bytes(out)
                # the term that ends here is counted in the outputs below
            lo = int(self.base[state])
            marks = np.flatnonzero(self.check[lo:lo + 256] == state)
            outs = self.out[lo + marks]
            k = int(np.searchsorted(outs, ordinal, side="right")) - 1
            ordinal -= int(outs[k])
            out.append(int(marks[k]))
            state = int(self.target[lo + marks[k]])


# ---- kept terms and their shards -------------------------------------------------------

def _documents_of_terms(held: int):
    def run(batches):
        import pyarrow as pa
        seen: dict = {}
        size = 0

        def flush():
            for lang, terms in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(list(terms), pa.binary()),
                                                  pa.array(list(terms.values()), pa.int64())], names=["lang", "term", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                mine = seen.setdefault(lang, {})
                before = len(mine)
                for t in set().union(*map(bytes.split, stretches(text.as_py().translate(LETTERS)))):
                    mine[t] = mine.get(t, 0) + 1
                size += len(mine) - before
                if size >= held:
                    yield from flush()
                    seen, size = {}, 0
        yield from flush()
    return run


def kept_terms(docs: DataFrame, least_docs: int, held: int = HELD) -> DataFrame:
    """``(lang, term)`` of ``docs(lang, source, text)``, terms as bytes."""
    partial = docs.select("lang", "text").mapInArrow(_documents_of_terms(held), "lang string, term binary, n long")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def _builder(most: int):
    def run(batches):
        import pyarrow as pa
        lang, terms = None, []

        def shard():
            made = Transducer.build(terms)
            return pa.RecordBatch.from_pylist([{"lang": lang, "first": terms[0], "n": len(terms), **made.packed()}], schema=schema)

        schema = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("n", pa.int64()), *[(f, pa.binary()) for f in Transducer.FIELDS]])
        for batch in batches:
            for x, term in zip(batch.column("lang").to_pylist(), batch.column("term")):
                if terms and (x != lang or len(terms) == most):
                    yield shard()
                    terms = []
                lang = x
                terms.append(term.as_py())
        if terms:
            yield shard()
    return run


_SHARDS = "lang string, first binary, n long, " + ", ".join(f"{f} binary" for f in Transducer.FIELDS)


def shards(kept: DataFrame, most: int = SHARD_TERMS) -> DataFrame:
    """Transducers over ranges of the sorted terms: ``(shard, lang, first, n, ord0, bytes, arrays…)``; ``ord0`` numbers the first term."""
    order = ["lang", "term"]
    built = stage(kept.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_builder(most), _SHARDS), "audit-shards")
    # One row a hundred thousand terms (and a task): short, and numbered without the arrays.
    before = W.partitionBy("lang").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
    size = sum((F.octet_length(f) for f in Transducer.FIELDS), F.lit(0)).cast("long")
    narrow = built.select("lang", "first", "n", size.alias("bytes"))
    numbered = narrow.select("lang", "first", "bytes", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ord0"))
    numbered = numbered.withColumn("shard", F.row_number().over(W.orderBy("lang", "first")))
    return stage(built.join(F.broadcast(numbered), ["lang", "first"]), "audit-transducers")


# ---- counting --------------------------------------------------------------------------

def _counter(sent, held: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        tables: dict = {}
        for row in sent.value:
            tables.setdefault(row["lang"], []).append((row["ord0"], Transducer.unpacked(row)))
        names, parts, size = {}, [], 0

        def merged():
            keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[first], np.add.reduceat(n, first)

        def flush():
            if not parts:
                return
            keys, n = merged()
            listed = list(names)
            of = keys >> 40
            for g in range(0, len(keys), 1 << 18):
                at = slice(g, g + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([listed[i][0] for i in of[at].tolist()], pa.string()), pa.array([listed[i][1] for i in of[at].tolist()], pa.string()),
                     pa.array(keys[at] & ((1 << 40) - 1), pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "source", "ord", "n"])

        def count(lang, pieces, groups):
            nonlocal size
            ends = np.cumsum([len(p) + 1 for p in pieces])
            octets = np.frombuffer(b" ".join([*pieces, b""]), dtype=np.uint8)
            blank = octets == 32
            starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
            group = np.array(groups, dtype=np.int64)[np.searchsorted(ends, starts, side="right")]
            for ord0, table in tables[lang]:
                which, number = table.ordinals(octets, starts)
                if len(which):
                    parts.append(np.unique((group[which] << 40) + (number.astype(np.int64) + ord0), return_counts=True))
                    size += len(parts[-1][0])

        for batch in batches:
            waiting = {lang: ([], [], 0) for lang in tables}
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                if lang not in tables:
                    continue
                group = names.setdefault((lang, source), len(names))
                for piece in stretches(text.as_py().translate(LETTERS)):
                    pieces, groups, octets = waiting[lang]
                    pieces.append(piece)
                    groups.append(group)
                    waiting[lang] = pieces, groups, octets + len(piece)
                    if octets + len(piece) >= SLAB:
                        count(lang, pieces, groups)
                        waiting[lang] = [], [], 0
            for lang, (pieces, groups, _) in waiting.items():
                if pieces:
                    count(lang, pieces, groups)
            if size >= 4 * held:
                parts = [merged()]
                size = len(parts[0][0])
                if size >= held:
                    yield from flush()
                    names, parts, size = {}, [], 0
        yield from flush()
    return run


def counts(docs: DataFrame, transducers: DataFrame, sent_bytes: int = SENT_BYTES, held: int = HELD) -> DataFrame:
    """``(lang, source, ord, n)``: occurrences of the kept terms, zero counts left out.

    Transducers are sent in groups of ``sent_bytes`` (a single one is bounded by its terms); every group is a pass over the texts.
    """
    spark, out = docs.sparkSession, None
    sizes = [(r["shard"], r["bytes"]) for r in transducers.select("shard", "bytes").orderBy("shard").collect()]  # two numbers a shard
    while sizes:
        group, total = [sizes.pop(0)[0]], 0
        while sizes and total + sizes[0][1] <= sent_bytes:
            total += sizes[0][1]
            group.append(sizes.pop(0)[0])
        rows = transducers.where(F.col("shard").between(group[0], group[-1])).select("lang", "ord0", *Transducer.FIELDS).collect()
        sent = spark.sparkContext.broadcast([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in rows])
        part = docs.mapInArrow(_counter(sent, held), "lang string, source string, ord long, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, ord long, n long")
    return stage(out.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "audit-counts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms))``, exactly."""
    wide = lambda c: c.cast("decimal(27,0)")
    over, under = wide(count + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + ADDED * terms)
    return F.lit(1) + F.call_function("div", over, under)


def shares(n, total: int, terms: int):
    """The same over an array: long division by three digits at a time, so that nothing passes 64 bits."""
    import numpy as np
    under, left = total + ADDED * terms, n.astype(np.int64) + ADDED
    out = np.zeros(len(left), dtype=np.int64)
    if under >= 1 << 53:
        return np.array([1 + SCALE * int(x) // under for x in left], dtype=np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // under
        left %= under
    return out + 1


# ---- comparing -------------------------------------------------------------------------

def _tiles(batches):
    import numpy as np
    import pyarrow as pa

    def matrix(rows, cells, wide: int, at: int, terms: int):
        names = [r["source"] for r in rows]
        m = np.zeros((len(rows), wide), dtype=np.int64)
        row_of = {s: i for i, s in enumerate(names)}
        if cells.is_valid:
            c = cells.values
            m[[row_of[s] for s in c.field("source").to_pylist()], c.field("ord").to_numpy(zero_copy_only=False) - at] = \
                c.field("n").to_numpy(zero_copy_only=False)
        for i, r in enumerate(rows):
            m[i] = shares(m[i], r["total"], terms) if wide else 0
        return names, m

    for batch in batches:
        for r in range(batch.num_rows):
            v = {c: batch.column(c)[r] for c in batch.schema.names}
            terms, at = v["terms"].as_py(), v["tile"].as_py() * TILE_TERMS
            wide = max(0, min(TILE_TERMS, terms - at))
            a_names, a = matrix(v["a_rows"].as_py(), v["a_cells"], wide, at, terms)
            same = v["a"].as_py() == v["b"].as_py()
            b_names, b = (a_names, a) if same else matrix(v["b_rows"].as_py(), v["b_cells"], wide, at, terms)
            left, right, value = [], [], []
            for i, name in enumerate(a_names):
                j = i + 1 if same else 0
                apart = np.abs(b[j:] - a[i]).sum(axis=1)
                left += [name] * len(apart)
                right += b_names[j:]
                value += apart.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([v["lang"].as_py()] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()),
                 pa.array(value, pa.int64())], names=["lang", "x", "y", "value"])


def pair_divergence(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, x, y, value)`` for every two sources, each pair once; ``groups(lang, source, total, terms)`` are all groups."""
    several = groups.withColumn("in_lang", F.count("*").over(W.partitionBy("lang")))
    blocks = F.ceil(F.col("in_lang") / TILE_SOURCES).cast("int")
    placed = stage(several.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).drop("in_lang"),
                   "audit-sources")
    rows = placed.groupBy("lang", "blocks", "block", "terms").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("rows"))
    rows = rows.withColumn("tile", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("terms") / TILE_TERMS) - 1, F.lit(0)).cast("int"))))
    # A tile's cells are bounded: so many sources (about) times so many ordinals.
    cells = (counted.join(placed.select("lang", "source", "block"), ["lang", "source"])
             .groupBy("lang", "block", F.floor(F.col("ord") / TILE_TERMS).cast("int").alias("tile"))
             .agg(F.collect_list(F.struct("source", "ord", "n")).alias("cells")))
    packs = stage(rows.join(cells, ["lang", "block", "tile"], "left"), "audit-tiles")
    side = lambda n: packs.select("lang", "tile", F.col("block").alias(n), F.col("rows").alias(f"{n}_rows"), F.col("cells").alias(f"{n}_cells"))
    first = (packs.select("lang", "tile", "terms", F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b"),
                          F.col("rows").alias("a_rows"), F.col("cells").alias("a_cells")))
    met = first.join(side("b"), ["lang", "tile", "b"]).select("lang", "tile", "terms", "a", "b", "a_rows", "a_cells", "b_rows", "b_cells")
    parts = met.mapInArrow(_tiles, "lang string, x string, y string, value long")
    # Which of a pair's blocks came first is alike in all tiles, so its parts have one order.
    return parts.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def term_excess(counted: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``(lang, source, ord, value, rank)``: terms whose share in the source is most above that in its language."""
    whole = counted.groupBy("lang", "ord").agg(F.sum("n").alias("all_n"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"))
    small = groups.join(langs, "lang")
    n_groups = groups.count()
    rows = counted.join(F.broadcast(small) if n_groups * 128 <= BROADCAST_BYTES else small, ["lang", "source"]).join(whole, ["lang", "ord"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    above = rows.select("lang", "source", "ord", (p - q).alias("value")).where("value > 0")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def names_of(numbers: DataFrame, transducers: DataFrame) -> DataFrame:
    """``(lang, ord, term)`` of the distinct ``numbers(lang, ord)``, read back from the transducers."""
    ranges = transducers.select(F.col("lang").alias("_lang"), "shard", "ord0", F.col("n").alias("_n"))  # five numbers a shard
    inside = (F.col("lang") == F.col("_lang")) & (F.col("ord") >= F.col("ord0")) & (F.col("ord") < F.col("ord0") + F.col("_n"))
    wanted = (numbers.select("lang", "ord").distinct().join(F.broadcast(ranges), inside)
              .groupBy("shard").agg(F.collect_list("ord").alias("ords")))  # a shard's terms at most

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for r in range(batch.num_rows):
                table = Transducer.unpacked({f: batch.column(f)[r].as_py() for f in Transducer.FIELDS})
                lang, ord0, ords = batch.column("lang")[r].as_py(), batch.column("ord0")[r].as_py(), batch.column("ords")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ords), pa.string()), pa.array(ords, pa.int64()),
                                                  pa.array([table.term(o - ord0).decode() for o in ords], pa.string())], names=["lang", "ord", "term"])

    return (transducers.join(wanted, "shard").select("lang", "ord0", "ords", *Transducer.FIELDS)
            .mapInArrow(run, "lang string, ord long, term string"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", shard_terms: int = SHARD_TERMS,
          sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``docs(text, lang, source)`` to ``(lang, source, part, item, value, rank)``.

    Part ``pair`` has each other source of the language with the summed difference of shares, part ``term`` the ``top``
    terms that the source uses more than its language.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), whole_text(text).cast("binary").alias("text"))
    kept = stage(kept_terms(read, least_docs), "audit-kept")
    tables = shards(kept, shard_terms)
    counted = counts(read, tables, sent_bytes)
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = stage(read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
                   .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "audit-groups")
    pairs = pair_divergence(counted, groups)
    pairs = pairs.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("y").alias("source"), F.col("x").alias("item"), "value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    best = stage(term_excess(counted, groups, top), "audit-terms")
    named = best.join(names_of(best, tables), ["lang", "ord"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(named)


ship(__name__)
