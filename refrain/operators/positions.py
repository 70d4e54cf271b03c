"""Running sums and positions inside groups that may be too big for one task.

A plain window over a hot session (or over the whole table) sorts that group in a single
task. Here each group is cut into chunks along its own order: chunk totals are aggregated
map-side, their prefix sums become offsets, and only a chunk is ever sorted at once.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from refrain.operators.joins import growing


def running_sums(df: DataFrame, keys: list[str], order: list, chunk: Column,
                 sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """Add inclusive running sums of ``sums`` per key group.

    ``chunk`` must never decrease along ``order`` inside a group and must not be null.
    With ``totals`` each sum ``x`` also gets its group total as ``x_total``.
    """
    chunked = df.withColumn("_chunk", chunk)
    group = keys or ["_all"]
    if not keys:
        chunked = chunked.withColumn("_all", F.lit(0))
    per_chunk = chunked.groupBy(*group, "_chunk").agg(
        *[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_chunk.select(
        *group, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *([F.sum(f"_t_{n}").over(W.partitionBy(*group)).alias(f"{n}_total") for n in sums]
          if totals else []),
    )
    inside = (W.partitionBy(*group, "_chunk").orderBy(*order)
               .rowsBetween(W.unboundedPreceding, W.currentRow))
    out = chunked.select("*", *[F.sum(e).over(inside).alias(f"_r_{n}") for n, e in sums.items()])
    # Rows lie and are sorted by group and chunk already, so only the offsets are shuffled.
    out = out.join(growing(offsets), [*group, "_chunk"])
    for n in sums:
        out = out.withColumn(n, F.col(f"_r_{n}") + F.col(f"_o_{n}"))
    drop = ["_chunk"] + ([] if keys else ["_all"])
    return out.drop(*drop, *[f"_r_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def positions(df: DataFrame, keys: list[str], order: list, chunk: Column,
              name: str = "pos", totals: bool = False) -> DataFrame:
    """1-based position of each row in its group; ``order`` must be total."""
    return running_sums(df, keys, order, chunk, {name: F.lit(1)}, totals)


def ordinal(df: DataFrame, key: Column, name: str = "ordinal", width: int = 3) -> DataFrame:
    """Global 1-based position by a string key (unique per row), chunked by its prefix."""
    return (positions(df.withColumn("_key", key), [], [F.col("_key")],
                      F.substring("_key", 1, width), name).drop("_key"))


def ordinal_by_sample(df: DataFrame, col: str, name: str = "ordinal", chunks: int = 128, sample: int = 8192) -> DataFrame:
    """Global 1-based position by a column of unique strings of any shape.

    Chunks end at keys of a sample (rows whose hash falls on one residue), so ids that share a long prefix spread like
    any others. The driver sees about ``sample`` keys and keeps ``chunks`` of them.
    """
    every = max(1, df.count() // sample)
    keys = [r[0] for r in df.where(F.pmod(F.xxhash64(col), F.lit(every)) == 0).select(col).collect() if r[0] is not None]
    keys.sort(key=lambda k: k.encode())
    ends = keys[len(keys) // chunks::max(1, len(keys) // chunks)][:chunks]
    below = reduce(operator.add, [F.when(F.col(col) >= e, 1).otherwise(0) for e in ends], F.lit(0))
    return positions(df, [], [F.col(col)], below, name)


def lookback(cases: DataFrame, events: DataFrame, seen: str, pos: str, k: int,
             keys: list[str]) -> DataFrame:
    """The last ``k`` events before each case, as rows with ``back`` = 1 (newest) … k.

    ``cases.seen`` is how many events of the session precede the case and ``events.pos`` is
    dense, so this is an equi-join on (session, position): no window over the session.
    """
    wanted = (cases.where(F.col(seen) > 0)
              .withColumn("back", F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col(seen).cast("int")))))
              .withColumn(pos, F.col(seen) - F.col("back") + 1))
    return wanted.join(growing(events), [*keys, pos])
