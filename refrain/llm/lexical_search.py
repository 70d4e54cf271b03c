"""Ranked lexical search by best positions.

Terms of the queries are looked up in every document, whose numbers of terms and occurrences are written once. From the
totals every occurrence gets its impact, and every query term its weight.

Documents are cut into blocks of bounded postings, each inside a task. A block holds, for every query term, its documents
in the order of falling impact, and again by document with their place in that order, so any document's impact can be
accessed directly. A query reads its lists in turns of growing depth; every document met is scored at once by direct
access to all lists, and each access marks its place. The best position of a list is the end of its marked places that
follow without a gap from the top; as direct accesses mark places too, it lies at or beyond what was read. No
unmet document can have more than the sum of the weighted impacts right below the best positions, and a query stops as
soon as that sum is strictly below its k-th best score, so ties are never cut off. The k best carry over from block to
block of a task as a bar. Lists of the tasks meet in one ranking per query.

A term in every document spreads over all blocks; nothing is joined on terms. Queries whose terms come to more than
``sent_bytes`` are dealt into groups, each a pass of its own, so what is sent to the workers stays bounded.

Defined results: a null text has no terms; a query without terms, or whose terms occur nowhere, has no rows; queries are
answered row by row, so repeated items repeat their rows; repeated documents each have a rank, equal scores go by ascending
doc_id, null first; an empty table on either side gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from refrain.llm.common import ship, stage, stretches, whole_text

TOP = 10
#: Fixed values of the score: ``SCALE * tf div (1000 * tf + 8 * m)`` with ``m = 100 - 90 + (90 * n * N) div L``.
SCALE, TF, LENGTH = 1_000_000_000, 1000, 8
FLOOR, SLOPE = 100 - 90, 90
#: Bytes that are part of a term, A-Z lower-cased; all others part terms.
MARKS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Postings a block, first depth of reading, bytes of query terms sent at once.
BLOCK, DEPTH, SENT_BYTES = 1_500_000, 32, 32 << 20
ROWS = 512

_ENTRY = "doc_id long, n long, terms array<int>, tfs array<int>"
_HIT = "query long, doc_id long, score long"


def _terms(batches):
    import pyarrow as pa
    for batch in batches:
        for query, item, text in zip(batch.column("query"), batch.column("item_id"), batch.column("text")):
            found = sorted(set().union(*map(bytes.split, stretches(text.as_py().translate(MARKS)))))
            yield pa.RecordBatch.from_arrays([pa.array([query.as_py()] * len(found), pa.int64()), pa.array([item.as_py()] * len(found), pa.int64()),
                                              pa.array(found, pa.binary())], names=["query", "item_id", "term"])


def query_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """``(query, item_id, term)``: distinct terms of every row of ``items(item_id, text)``, terms as bytes."""
    rows = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"),
                        whole_text(text).cast("binary").alias("text"))
    return rows.mapInArrow(_terms, "query long, item_id long, term binary")


def _finder(numbers):
    def run(batches):
        import pyarrow as pa
        known = {t: i for i, t in enumerate(numbers.value)}
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                n, counts = 0, {}
                for piece in stretches(text.as_py().translate(MARKS)):
                    words = piece.split()
                    n += len(words)
                    for i in map(known.get, words):
                        if i is not None:
                            counts[i] = counts.get(i, 0) + 1
                if n:
                    ids.append(doc_id)
                    ns.append(n)
                    terms.append(list(counts))
                    tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])
    return run


class Block:
    """Impact lists of some documents: per term, places in falling impact, and documents with their places."""

    def __init__(self, lens, terms, tfs, m):
        import numpy as np
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        impact = SCALE * tfs // (TF * tfs + LENGTH * m[doc])
        order = np.lexsort((-impact, terms))
        self.known, self.first = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.first[1:], len(order))
        self.doc_at, self.impact_at = doc[order], impact[order]
        # The same postings by term and document; postings come in document order, so a stable sort by term is enough.
        back = np.argsort(terms, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.docs, self.place_of = doc[back], place[back]

    def best(self, terms, weights, bar: int, k: int, depth: int = DEPTH):
        """Documents of the block that may be among the k best of a query whose k-th score so far is ``bar`` (-1: none yet).

        Returns ``(document, score)`` arrays and the number of documents scored.
        """
        import numpy as np
        at = np.searchsorted(self.known, terms)
        hit = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == terms) & (weights > 0) if len(self.known) else np.zeros(len(terms), bool)
        spans = [(int(self.first[a]), int(self.ends[a]), int(w)) for a, w in zip(at[hit], weights[hit])]
        seen = [np.zeros(hi - lo + 1, dtype=bool) for lo, hi, _ in spans]  # one more, never marked: the end
        best_at = [0] * len(spans)
        done, docs, scores = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        scored = 0
        while spans:
            met = []
            for (lo, hi, _), marks, p in zip(spans, seen, best_at):
                met.append(self.doc_at[lo + p:min(hi, lo + p + depth)])
                marks[p:min(hi - lo, p + depth)] = True
            new = np.setdiff1d(np.concatenate(met), done)
            total = np.zeros(len(new), dtype=np.int64)
            for (lo, hi, w), marks in zip(spans, seen):
                mine = self.docs[lo:hi]
                i = np.searchsorted(mine, new)
                there = np.flatnonzero(i < hi - lo)
                there = there[mine[i[there]] == new[there]]
                place = self.place_of[lo + i[there]]
                total[there] += w * self.impact_at[place]
                marks[place - lo] = True
            done, scored = np.union1d(done, new), scored + len(new)
            docs, scores = np.append(docs, new), np.append(scores, total)
            kth = bar
            if len(scores) >= k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                kth = max(kth, int(cut))
                docs, scores = docs[scores >= kth], scores[scores >= kth]  # what ties with the k-th stays
            most = 0
            for j, ((lo, hi, w), marks) in enumerate(zip(spans, seen)):
                best_at[j] += int(np.argmin(marks[best_at[j]:]))
                if lo + best_at[j] < hi:
                    most += w * int(self.impact_at[lo + best_at[j]])
            if most < kth or most == 0:
                break
            depth *= 2
        return docs, scores, scored


def _searcher(sent, k: int, block: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        edges, terms, weights, queries = (np.frombuffer(b, dtype=np.int64) for b in sent.value)
        tops = [[] for _ in queries]  # the k best so far: (-score, whether it has an id, doc_id)
        held, size = [], 0

        def search():
            nonlocal held, size
            lens = np.concatenate([h[1] for h in held])
            made = Block(lens, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]))
            ids = [x for h in held for x in h[0]]
            held, size = [], 0
            for q in range(len(queries)):
                top = tops[q]
                at = slice(edges[q], edges[q + 1])
                docs, scores, _ = made.best(terms[at], weights[at], -top[-1][0] if len(top) == k else -1, k)
                if len(docs):
                    ties = [(-s, ids[d] is not None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist()) if s > 0]
                    tops[q] = sorted(top + ties)[:k]

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists, tfs = part.column("terms"), part.column("tfs")
                held.append((part.column("doc_id").to_pylist(), np.diff(np.asarray(lists.offsets)), np.asarray(lists.flatten()).astype(np.int64),
                             np.asarray(tfs.flatten()).astype(np.int64), np.asarray(part.column("m"))))
                size += len(held[-1][2])
                if size >= block:
                    search()
        if held:
            search()
        hits = [(int(queries[q]), i if there else None, -s) for q, top in enumerate(tops) for s, there, i in top]
        if hits:
            q, i, s = zip(*hits)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query", "doc_id", "score"])
    return run


def _search(docs: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """Best documents of ``asked(query, item_id, term)``, whose distinct terms the workers can hold."""
    import numpy as np
    spark = docs.sparkSession
    vocabulary = sorted(bytes(r[0]) for r in asked.select("term").distinct().collect())  # bounded by the caller
    entries = docs.mapInArrow(_finder(spark.sparkContext.broadcast(vocabulary)), _ENTRY)
    entries = stage(entries, "lexical-documents")
    totals = entries.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = totals["N"], totals["L"]
    if not n_docs or not vocabulary:
        return spark.createDataFrame([], _HIT)
    # One row a query term, of which there are as many as were sent.
    df = entries.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = {r["t"]: r["w"] for r in df.select("t", weight.alias("w")).collect()}
    number = {t: i for i, t in enumerate(vocabulary)}
    lists: dict = {}
    for r in asked.select("query", "term").collect():
        i = number[bytes(r["term"])]
        if i in weights:
            lists.setdefault(r["query"], []).append(i)
    queries = sorted(lists)
    flat = [i for q in queries for i in sorted(lists[q])]
    arrays = [np.cumsum([0, *(len(lists[q]) for q in queries)]), flat, [weights[i] for i in flat], queries]
    sent = spark.sparkContext.broadcast([np.array(a, dtype=np.int64).tobytes() for a in arrays])
    wide = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("decimal(19,0)")
    m = F.lit(FLOOR) + F.call_function("div", (F.col("n") * SLOPE).cast("decimal(19,0)") * wide(n_docs), wide(n_terms))
    best = entries.where(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "tfs")
    return best.mapInArrow(_searcher(sent, k, block), _HIT)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", block: int = BLOCK, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The k best documents of ``docs(doc_id, text)`` for every row of ``items(item_id, text)``: ``(query, item_id, rank, doc_id, score)``."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"))
    asked = stage(query_terms(items, text), "lexical-queries")
    # A row counts with its term and some bytes for the numbers that go with it, on the driver and in a worker.
    size = asked.agg(F.sum(F.octet_length("term") + F.lit(96))).first()[0] or 0
    groups = max(1, math.ceil(size / sent_bytes))
    dealt = asked.withColumn("_group", F.pmod(F.xxhash64("query"), F.lit(groups)))
    hits = None
    for g in range(groups):  # one pass, but for question sets of hundreds of thousands of terms
        part = _search(read, dealt.where(F.col("_group") == g), k, block)
        hits = part if hits is None else hits.unionByName(part)
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id").distinct(), "query").select("query", "item_id", "rank", "doc_id", "score")


ship(__name__)
