"""Reading conversation sessions; the split is a column, never a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from refrain.operators.sessions import explode_turns


def read_sessions(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All sessions below ``path`` (a folder or glob), optionally one split of them."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def read_turns(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    return explode_turns(read_sessions(spark, path, split))


def newest_file_rows(spark: SparkSession, glob: str) -> DataFrame:
    """Rows of the lexicographically last table a glob matches: one file, or a folder with all its part files."""
    # Only names are listed here; the one table is read afterwards.
    pattern = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    if not found:
        raise FileNotFoundError(glob)
    return spark.read.parquet(max((f.getPath().toString() for f in found), key=lambda p: p.encode()))
