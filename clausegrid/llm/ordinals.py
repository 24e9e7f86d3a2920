"""Rows in a stated order, numbered without putting a whole key into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.llm.storage import stored

PART_BITS = 33  # a number is its part, then the row's place within the part


def in_order(df: DataFrame, order: list[str], name: str, table: str) -> DataFrame:
    """``df`` stored with a unique number ``name`` that increases with ``order`` (nulls first).

    Rows are dealt out by ranges, so a key with a third of all rows spans many parts; equal
    rows follow each other in the order of their input, wherever the ranges are cut.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return stored(placed.withColumn(name, F.monotonically_increasing_id()), table)


def part(name: str):
    return F.shiftright(F.col(name), PART_BITS)


def starts(df: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, _part, _first, _before, _all)``: the first number of a key in each part, its
    rows in earlier parts and in all of them. A few rows per key."""
    heads = df.groupBy(key, part(name).alias("_part")).agg(F.min(name).alias("_first"), F.count("*").alias("_rows"))
    of_key = Window.partitionBy(key)
    before = of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return heads.select(key, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(of_key).alias("_all"))
