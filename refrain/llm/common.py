"""Small helpers the corpus operators share."""

from __future__ import annotations

import string
import sys
import types

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refrain.lineage import scratch_path

#: A-Z only: other capitals, such as accented ones, keep their form.
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def worker_cache(key: str, build):
    """Build an object once per Python worker process, whichever task asks first."""
    import sys as s
    shelf = s.modules.setdefault("_refrain_worker_cache", types.ModuleType("_refrain_worker_cache"))
    if not hasattr(shelf, key):
        setattr(shelf, key, build())
    return getattr(shelf, key)


def stretches(octets: bytes, size: int = 1 << 22):
    """A text of tokens between blanks in pieces of about ``size`` bytes, cut at blanks."""
    at = 0
    while at < len(octets):
        cut = len(octets) if at + size >= len(octets) else octets.find(b" ", at + size)
        cut = len(octets) if cut < 0 else cut
        yield octets[at:cut] if at or cut < len(octets) else octets
        at = cut


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



def numbered(docs: DataFrame, row: str, name: str, files: bool = False) -> DataFrame:
    """``docs`` with a number ``row`` a row, which stays the same whenever the table is read.

    With ``files``, ``docs`` is a table as Parquet files give it: a row's number is its file's, in the order of paths, and its
    place there, and nothing is copied. Any other table is written out with its numbers.
    """
    try:
        if not files or "_metadata" in docs.columns:
            raise AnalysisException("not a table of files")
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{row}file"), F.col("_metadata.row_index").alias(f"{row}at"))
    except AnalysisException:
        return stage(docs.withColumn(row, F.monotonically_increasing_id()), name)
    paths = placed.select(f"{row}file").distinct().coalesce(1).sortWithinPartitions(f"{row}file")  # one row a file
    paths = stage(paths.withColumn(f"{row}no", F.monotonically_increasing_id()), f"{name}-files")
    number = F.shiftleft(f"{row}no", 40).bitwiseOR(F.col(f"{row}at"))
    return placed.join(F.broadcast(paths), f"{row}file").select(*[placed[c] for c in docs.columns], number.alias(row))


ship(__name__)
