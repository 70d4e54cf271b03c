"""Secret scan with multipart credential linking.

A credential comes in parts: an access identifier, a secret and an endpoint. Strong parts (an assignment to a secret-like
name, an AWS-style access identifier, a long hexadecimal string) are reported wherever they stand. Weak candidates
(a bare token, an assigned user or client identifier, a URL, each of any length) say little alone: an interval
join looks for the other parts within ``SCOPE`` code points, and a weak candidate is reported only when an identifier
or a secret that complements it co-occurs there.

Positions are code points, end exclusive, found by cutting a text at the matches of a pattern: the gaps' lengths and the
matches' lengths add up to the places. Only DataFrame operations are used. The interval join meets parts of one text in
cells as wide as the scope: a partner that begins behind a weak span by its start, one that ends before it by its end, so
a span's length doesn't matter. Parts don't overlap within a kind, so a cell holds a bounded number of starts and ends.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each get a result; an empty table
gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from refrain.llm.common import stage, whole_text

#: Patterns of the strong kinds, in order.
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
STRONG = ("assign", "access", "hex")
#: Weak kinds, their part of a credential, and their patterns.
WEAK = {
    "user": ("identifier", r"(?i)(?:user(?:name)?|client_?id|access_?key_?id|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}"),
    "bare": ("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_]{32,}={0,2}(?![A-Za-z0-9+/_=-])"),
    "endpoint": ("endpoint", r"(?i)(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20\"'<>]{4,}"),
}
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: p for k, (p, _) in WEAK.items()}
ORDER = {k: i for i, k in enumerate((*STRONG, *WEAK))}
SCOPE = 512
RUN = 64
SPAN = "array<struct<start:int,end:int,kind:string>>"


def _kinds() -> list[tuple[str, str, str, int]]:
    """Kind, pattern, a cheaper hint that a text has a match, and the group whose length must reach the least.

    A run of hexadecimal digits is maximal on both sides, so asking for 24 at once finds the spans that the rule keeps.
    """
    return [("assign", ASSIGN, ASSIGN, 2), ("access", ACCESS, "AKIA", 0), ("hex", HEX.replace("+", "{%d,}" % LEAST["hex"]), "[0-9a-f]{24}", 0),
            *[(k, p, p, 0) for k, (_, p) in WEAK.items()]]


def parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, doc_key, strong, weak)``: spans of either sort in the whole text."""
    t, longs = F.col("t"), "array<int>"
    one = docs.select("doc_id", whole_text(text).alias("t"))
    lengths = lambda strings, hint: F.when(t.rlike(hint), F.transform(strings, lambda s: F.length(s))).otherwise(F.array().cast(longs))
    # Each step is a projection of its own: inlined into a lambda, a step would be taken again for every match.
    cut = one.select("doc_id", F.xxhash64("t").alias("doc_key"), *[c for k, p, hint, g in _kinds() for c in (
        lengths(F.split(t, p, -1), hint).alias(f"gap_{k}"), lengths(F.regexp_extract_all(t, F.lit(p), F.lit(0)), hint).alias(f"hit_{k}"),
        lengths(F.regexp_extract_all(t, F.lit(p), F.lit(g)), hint).alias(f"key_{k}"))])
    names = [k for k, *_ in _kinds()]
    steps = cut.select("doc_id", "doc_key", *[F.arrays_zip(
        F.slice(f"gap_{k}", 1, F.size(f"hit_{k}")).alias("gap"), F.col(f"hit_{k}").alias("hit"), F.col(f"key_{k}").alias("key")).alias(k) for k in names])
    # Growing an array copies it, so places are added up in runs of RUN matches, and before that the runs' own lengths.
    in_runs = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / RUN).cast("int")), lambda c: F.slice(a, c * RUN + 1, RUN))
    runs = steps.select("doc_id", "doc_key", *[in_runs(F.col(k)).alias(k) for k in names])
    total = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["hit"])
    starts = runs.select("doc_id", "doc_key", *[c for k in names for c in (F.col(k), F.aggregate(
        k, F.array(F.lit(0)), lambda out, run: F.concat(out, F.array(F.element_at(out, -1) + total(run)))).alias(f"at_{k}"))])
    none = F.array().cast("array<struct<start:int,end:int,key:int>>")

    def step(acc, x):
        a = acc["at"] + x["gap"]
        b = a + x["hit"]
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["key"].alias("key")))).alias("out"))

    def spans(k):
        placed = F.flatten(F.zip_with(F.col(k), F.slice(f"at_{k}", 1, F.size(k)), lambda run, at: F.aggregate(
            run, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))
        kept = F.filter(placed, lambda s: s["key"] >= LEAST.get(k, 0))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))

    return starts.select("doc_id", "doc_key", F.concat(*[spans(k) for k in STRONG]).alias("strong"), F.concat(*[spans(k) for k in WEAK]).alias("weak"))


def _rows(found: DataFrame, col: str, *more) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in PARTS.items() for x in pair])
    return (found.select("doc_id", "doc_key", F.explode(col).alias("s")).select("doc_id", "doc_key", "s.*", *more)
            .withColumn("part", kinds[F.col("kind")]).distinct())


def linked_weak(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak spans with a complementary part in scope: ``(doc_id, doc_key, start, end, kind)``.

    A secret needs an identifier, an identifier a secret, an endpoint either; the partner may be strong or weak, but
    one of the two must be strong or the pair must be an identifier with a secret.
    """
    having = found.where(F.size("weak") > 0)
    weak = _rows(having, "weak")
    every = _rows(having.select("doc_id", "doc_key", F.concat("strong", "weak").alias("both")), "both")
    cell = lambda at: F.floor(at / scope)
    meets = lambda *at: F.explode(F.array(*[F.struct(F.lit(side).alias("side"), cell(c).alias("cell")) for side, c in at]))
    start, end = F.col("start"), F.col("end")
    left = weak.withColumn("at", meets(("start", end), ("start", end + scope), ("end", start - scope), ("end", start)))
    right = every.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), start.alias("_start"), end.alias("_end"),
                         F.col("part").alias("_part"), meets(("start", start), ("end", end)).alias("_at"))
    fits = (((F.col("part") == "secret") & (F.col("_part") == "identifier")) | ((F.col("part") == "identifier") & (F.col("_part") == "secret"))
            | ((F.col("part") == "endpoint") & F.col("_part").isin("identifier", "secret")))
    apart = F.greatest(F.col("_start") - F.col("end"), F.col("start") - F.col("_end"))
    on = (left["doc_id"].eqNullSafe(right["_id"]) & (F.col("doc_key") == F.col("_key")) & (F.col("at") == F.col("_at"))
          & fits & (apart >= 0) & (apart <= scope))
    return left.join(right, on, "left_semi").select("doc_id", "doc_key", "start", "end", "kind").distinct()


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, strong, linked)``: strong spans, and weak ones that other parts confirm."""
    found = stage(parts(docs, text), "secret-parts")
    weak = linked_weak(found, scope).groupBy(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("linked"))
    out = found.join(weak, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("doc_key") == F.col("_key")), "left")
    return out.select("doc_id", "strong", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def by_start(spans: Column) -> Column:
    """Spans by start, then kind as listed, joined as ``kind:start:end``."""
    rank = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
