"""Checks that a side is small enough before anything is broadcast."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def measure(df: DataFrame, row_bytes: Column, max_rows: int) -> tuple[int, int]:
    """(rows, bytes) of ``df``, reading no further than ``max_rows + 1`` rows."""
    row = (
        df.select(row_bytes.cast("long").alias("b"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
        .first()
    )
    return row["n"], row["b"]


def small_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` for a join with a far larger table: broadcast after a check of its size, so that the
    large table is not shuffled. ``df`` should be stored, as the check reads it."""
    return F.broadcast(df) if is_small(df, row_bytes) else df


def is_small(df: DataFrame, row_bytes: Column, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    n, size = measure(df, row_bytes, max_rows)
    return n <= max_rows and size <= max_bytes
