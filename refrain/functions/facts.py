"""Date, duration, popularity and hashing expressions behind the response tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from refrain import fixed_text


def year_of(date: Column) -> Column:
    """Leading four-digit year between 1900 and 2100, else null."""
    digits = F.regexp_extract(F.coalesce(date, F.lit("")), r"^([0-9]{4})", 1)
    year = F.when(digits != "", digits).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def decade(date: Column) -> Column:
    """Decade of the first four-digit run, null before 1960."""
    digits = F.regexp_extract(F.coalesce(date, F.lit("")), r"([0-9]{4})", 1)
    year = F.when(digits != "", digits).try_cast("int")
    return F.when(year >= 1960, (F.floor(year / 10) * 10).cast("int"))


def duration_minutes(ms: Column) -> Column:
    """``3min``-style text; null for a missing or zero duration."""
    return F.when(ms != 0, F.concat(F.floor(ms / 60000).cast("string"), F.lit("min")))


def popularity_band(popularity: Column) -> Column:
    """Reach note for the extremes only."""
    p = popularity.try_cast("double")
    return (F.when(p >= 70, F.lit("a widely known, popular track"))
             .when((p > 0) & (p <= 12), F.lit("a deep cut, under the radar")))


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by a record separator."""
    pieces = []
    for p in parts:
        pieces += [F.coalesce(p, F.lit("")), F.lit("\x1e")]
    return F.sha2(F.concat(*pieces).cast("binary"), 256)


def style_seed(text: Column) -> Column:
    """First four MD5 bytes as an unsigned integer."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def register_for_age(age_group: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed_text.VOCAB_BY_AGE.items() for x in kv])
    return F.coalesce(
        F.try_element_at(table, F.trim(F.coalesce(age_group, F.lit("")))),
        F.lit(fixed_text.VOCAB_BY_AGE["25-34"]),
    )


def tonal(specificity: Column, category: Column) -> Column:
    def high(c: Column) -> Column:
        return F.upper(F.substring(F.coalesce(c, F.lit("M")), 1, 1)).isin("H", "1")
    s, c = high(specificity), high(category)
    return (F.when(s & c, F.lit(fixed_text.TONAL_HH))
             .when(s, F.lit(fixed_text.TONAL_HL))
             .when(c, F.lit(fixed_text.TONAL_LH))
             .otherwise(F.lit(fixed_text.TONAL_LL)))


def pick(lines: list[str], seed: Column, salt: int) -> Column:
    """One line of a bank, chosen by hash so any engine can repeat the choice."""
    digest = F.md5(F.concat_ws("|", seed.cast("string"), F.lit(str(salt))).cast("binary"))
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % len(lines)).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in lines]), slot + 1)
