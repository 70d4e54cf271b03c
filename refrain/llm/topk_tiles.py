"""Exact top-k inner products by tiles.

Vectors become integers. Candidates are hashed into shards and queries into tiles, both bounded by bytes; a task
multiplies one tile with one shard, a bounded number of products at a time, and keeps each query's best k of that shard. The lists are merged in a tree: first
over groups of shards, then over the groups. No pair is shuffled beyond k rows a query and shard.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; only vectors of the same
length meet; rows that share a vec_id are one candidate with its best score, and none of its own queries; equal scores
go to the smaller vec_id; a null vec_id takes no part; an empty table gives an empty table; extra columns are not carried.
Scores are exact: products of 8-byte floats where every sum stays under 2^53, Python integers otherwise, held within a
long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refrain.llm.common import ship

SHARD_BYTES, TILE_BYTES = 16 << 20, 4 << 20
LEAST_SHARD_ROWS = 1024
SCALE = 256
_OUT = "query_id long, vec_id long, score long, shard int"


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """``(id, vec)`` of the vectors that take part."""
    v = F.col(vec).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", odd)))


def _packs(df: DataFrame, part: Column, name: str) -> DataFrame:
    """Rows of one length and part in one row; equal rows are merged before they are shuffled."""
    return (df.groupBy(F.size("vec").alias("dim"), part.alias(name))
            .agg(F.collect_set(F.struct("id", "vec")).alias(f"{name}_rows")))


def _integers(rows, dim: int):
    """Ids and floored, scaled components, sorted by id."""
    import numpy as np
    ids = np.asarray(rows.field("id"))
    raw = np.floor(SCALE * np.asarray(rows.field("vec").flatten(), dtype=np.float64).reshape(len(ids), dim))
    order = np.argsort(ids, kind="stable")
    return ids[order], raw[order]


def products(a, b):
    """Integer inner products, exact."""
    import numpy as np
    top = lambda x: float(np.abs(x).max()) if x.size else 0.0
    if max(1, a.shape[1]) * top(a) * top(b) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in b]
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([[min(high, max(low, sum(x * y for x, y in zip(q, w)))) for w in whole]
                     for q in ([int(v) for v in row] for row in a)], dtype=np.int64).reshape(len(a), len(b))


def best_of_tile(q_ids, ids, scores, k: int):
    """(query row, candidate column) of each query's k best; columns are in id order, so ties go to the smaller id."""
    import numpy as np
    m = len(ids)
    own = q_ids[:, None] == ids[None, :]
    if len(np.unique(ids)) < m or m <= 2 * k + 2 or not len(q_ids):
        rows, cols = [], []
        for r in range(len(q_ids)):
            seen = set()
            for c in np.argsort(-scores[r].astype(object), kind="stable"):
                if not own[r, c] and int(ids[c]) not in seen:
                    seen.add(int(ids[c]))
                    rows.append(r)
                    cols.append(int(c))
                    if len(seen) == k:
                        break
        return np.array(rows, dtype=int), np.array(cols, dtype=int)
    # One value a candidate holds score and order, so selection needs no second look at ties.
    spread = int(scores.max()) - int(scores.min()) + 1
    if spread * m < 1 << 62:
        key = (scores - scores.min()) * m + (m - 1 - np.arange(m))
        key[own] = -1
        cols = np.argpartition(-key, k, axis=1)[:, :k]
    else:
        cols = np.array([[c for c in np.argsort(-s.astype(object), kind="stable") if not o[c]][:k] for s, o in zip(scores, own)])
    rows = np.repeat(np.arange(len(q_ids)), cols.shape[1])
    return rows, cols.ravel()


def best_of_pair(q_ids, q, ids, v, k: int, products_at_once: int = 1 << 22):
    """``(query id, candidate id, score)`` of each query's k best in a shard, a bounded number of products at a time."""
    import numpy as np
    high = max(1, min(len(q_ids), 512))
    wide = max(1, products_at_once // high)
    found = []
    for top in range(0, len(q_ids), high):
        for left in range(0, len(ids), wide):
            some, them = slice(top, top + high), slice(left, left + wide)
            scores = products(q[some], v[them])
            rows, cols = best_of_tile(q_ids[some], ids[them], scores, k)
            found.append((q_ids[some][rows], ids[them][cols], scores[rows, cols]))
    of, to, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    # Ids may be repeated over pieces: a candidate counts once, with its best score, then the k best stay.
    for best_only in (True, False):
        order = np.lexsort((to, [-int(x) for x in score] if len(score) and score.min() == -(1 << 63) else -score, of))
        if best_only:
            order = order[np.lexsort((np.arange(len(order)), to[order], of[order]))]
            fresh = np.append(True, (of[order][1:] != of[order][:-1]) | (to[order][1:] != to[order][:-1]))[:len(order)]
            order = order[fresh]
        of, to, score = of[order], to[order], score[order]
    kept = np.arange(len(of)) - np.searchsorted(of, of, side="left") < k
    return of[kept], to[kept], score[kept]


def _scorer(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                q_ids, q = _integers(batch.column("tile_rows")[r].values, dim)
                ids, v = _integers(batch.column("shard_rows")[r].values, dim)
                of, to, score = best_of_pair(q_ids, q, ids, v, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of, pa.int64()), pa.array(to, pa.int64()), pa.array(score, pa.int64()),
                     pa.array(np.full(len(of), batch.column("shard")[r].as_py()), pa.int32())], names=["query_id", "vec_id", "score", "shard"])
    return run


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, vec: str = "embedding",
          shard_bytes: int = SHARD_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Each query's k best candidates other than itself: ``(query_id, rank, vec_id, score)``."""
    spark = vectors.sparkSession
    candidates, asked = usable(vectors, vec), usable(queries, vec)
    size = candidates.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, width = size["n"], max(1, size["d"] or 1) * 8
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    shards = max(1, math.ceil(n * width / shard_bytes), min(tasks, math.ceil(n / LEAST_SHARD_ROWS)))
    tiles = max(1, math.ceil(asked.count() * width / tile_bytes))
    part = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    shard_packs = _packs(candidates, part(shards), "shard")
    tile_packs = _packs(asked, part(tiles), "tile").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # A tile counts as its vectors, but comes once a shard: to Spark it looks small enough to be gathered on the driver, so the join is a merge.
    pairs = tile_packs.hint("merge").join(shard_packs, ["dim", "shard"]).select("dim", "shard", "tile_rows", "shard_rows")
    partial = pairs.mapInArrow(_scorer(k), _OUT)
    group = max(2, math.isqrt(shards))
    twigs = _merge(partial.withColumn("branch", F.floor(F.col("shard") / group)), ["query_id", "branch"], k).drop("rank", "branch")
    return _merge(twigs, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ship(__name__)
