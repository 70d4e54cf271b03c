"""How joins treat tables that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join that is sorted and merged where it lies.

    Spark broadcasts a side whose files look small, and a broadcast is gathered and built on the driver; packed files hold
    many times their size in rows, so a table that grows with the input says that it is none to broadcast.
    """
    return df.hint("merge")
