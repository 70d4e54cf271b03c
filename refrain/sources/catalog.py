"""Reading the item catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from refrain.functions.text import first  # noqa: F401  (re-exported: scalar view of a list field)

LIST_FIELDS = ("track_name", "artist_name", "album_name", "album_id", "tag_list")


def as_list(df: DataFrame, field: str):
    """Scalar-or-list field as an array; null becomes an empty array."""
    empty = F.array().cast("array<string>")
    if field not in df.columns:
        return empty
    if isinstance(df.schema[field].dataType, T.ArrayType):
        return F.coalesce(F.col(field).cast("array<string>"), empty)
    return F.when(F.col(field).isNull(), empty).otherwise(F.array(F.col(field).cast("string")))


def normalise(raw: DataFrame, key: str = "track_id") -> DataFrame:
    """Catalog rows with string ids and array-typed multi-valued fields."""
    date = F.col("release_date") if "release_date" in raw.columns else F.lit(None).cast("string")
    if "release_date" in raw.columns and isinstance(raw.schema["release_date"].dataType, T.ArrayType):
        date = F.try_element_at(date, F.lit(1))
    scalar = lambda c, t: (F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c)
    return raw.select(F.col(key).cast("string").alias("item_id"), *[as_list(raw, f).alias(f) for f in LIST_FIELDS],
                      date.cast("string").alias("release_date"), scalar("duration", "long"), scalar("popularity", "double"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per id: the last in file order (aggregated map-side, no window)."""
    rest = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*"))


def read_catalog(spark: SparkSession, path: str, key: str = "track_id", order: str | None = None) -> DataFrame:
    raw = spark.read.parquet(path)
    if order:
        raw = last_wins(raw, key, order)
    return normalise(raw, key)
