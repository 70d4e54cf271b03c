"""String and token-set expressions. All are plain Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that never count as query tokens.
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "you", "your",
    "song", "songs", "track", "tracks", "music", "artist", "artists",
    "band", "bands", "more", "another", "please", "some", "have",
    "like", "want", "really", "something", "can", "could", "would",
    "from", "about", "into", "give", "play", "just", "any",
]
# The token pattern and the shortest token kept.
TOKEN_PATTERN = "[a-z0-9']+"
MIN_TOKEN_LENGTH = 3


def words(text: Column) -> Column:
    """Every lower-case token of a text, repeats kept (lexical index and queries)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens(text: Column) -> Column:
    """Token set used by the overlap features: no short words, no stopwords."""
    keep = F.filter(
        words(text),
        lambda t: (F.length(t) >= MIN_TOKEN_LENGTH) & ~t.isin(STOPWORDS),
    )
    return F.array_distinct(keep)


def first(values: Column) -> Column:
    """First element of a multi-valued field, or an empty string."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def spaced(values: Column) -> Column:
    return F.coalesce(F.array_join(values, " "), F.lit(""))


def non_empty(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, " ")))


def meta_text(track: Column, artist: Column, album: Column, tags: Column,
              titled: bool, max_tags: int = 8) -> Column:
    """Searchable blob of one item: optional title, artist, album, up to eight tags."""
    head = [spaced(artist), spaced(album)]
    if titled:
        head.insert(0, spaced(track))
    parts = F.concat(F.array(*head), F.slice(F.coalesce(tags, F.array()), 1, max_tags))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def document_text(track: Column, artist: Column, album: Column, tags: Column) -> Column:
    """What the lexical index sees of an item: every field, all tags."""
    return F.concat_ws(" ", spaced(track), spaced(artist), spaced(album), spaced(tags))


def item_text(track: Column, artist: Column, album: Column, tags: Column) -> Column:
    """Catalog side of the text retrievers."""
    return F.concat(
        first(track), F.lit(" by "), F.coalesce(F.array_join(artist, ", "), F.lit("")),
        F.lit(". Album: "), first(album),
        F.lit(". Tags: "), F.coalesce(F.array_join(F.slice(tags, 1, 10), ", "), F.lit("")),
    )


def short_ref(track: Column, artist: Column) -> Column:
    return F.concat(first(track), F.lit(" by "), first(artist))


def structured_query(query: Column, history: Column, context: Column) -> Column:
    """``[QUERY] … [HISTORY] … [CONTEXT] …`` with empty blocks left out."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("[QUERY] "), query),
        F.when(F.size(history) > 0, F.concat(F.lit("[HISTORY] "), F.array_join(history, " "))),
        F.when(F.size(context) > 0, F.concat(F.lit("[CONTEXT] "), F.array_join(context, "; "))),
    )


def clean_tags(tags: Column, n: int = 15) -> Column:
    """Readable descriptor tags: trimmed, 2-22 characters, no ratings, no numbers but decades.

    Case-insensitive duplicates keep their first spelling.
    """
    trimmed = F.transform(F.coalesce(tags, F.array()), lambda t: F.trim(t))
    usable = F.filter(
        trimmed,
        lambda t: F.length(t).between(2, 22)
        & ~F.contains(F.lower(t), F.lit("star"))
        & (~t.rlike(r"[0-9]") | F.lower(t).rlike(r"^(19|20)?[0-9]0s$")),
    )
    # Bound as variables, so that both lists are made once a row and not again for every tag.
    pairs = F.transform(F.array(usable), lambda u: F.struct(u.alias("tag"), F.transform(u, lambda t: F.lower(t)).alias("low")))
    firsts = F.transform(pairs, lambda p: F.filter(p["tag"], lambda t, i: F.array_position(p["low"], F.lower(t)) == i + 1))[0]
    return F.slice(firsts, 1, n)


def bigrams(text: Column) -> Column:
    """Adjacent lower-case word pairs of a text."""
    w = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), " ")
    # Two shifted slices meet, so the text is split a fixed number of times, not once a word.
    n = F.size(w) - 1
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
