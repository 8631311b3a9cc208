"""Rows of conversations in order, whatever the size of one conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.staging import stage

# Characters that are no part of a word: blank and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def in_order(rows: DataFrame, keys: list[Column], label: str, name: str = "pos") -> DataFrame:
    """``rows`` as a staged table with ``name``: longs that grow with ``keys``, with gaps.

    Rows are range-partitioned by the keys and sorted inside partitions, so a key of any size is
    spread over many tasks.  A random last key splits rows that are equal in all keys.
    """
    by = [c.alias(f"__k{i}") for i, c in enumerate([*keys, F.rand(17)])]
    names = [f"__k{i}" for i in range(len(by))]
    order = [F.col(n).asc_nulls_first() for n in names]
    sorted_rows = rows.select("*", *by).repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(sorted_rows.withColumn(name, F.monotonically_increasing_id()).drop(*names), label)


def plain(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of a table that may have other columns and integer types."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )


def order_keys() -> list[Column]:
    """Order of the rows of conversations: by turn, null first; ties by role, then by a hash of the text."""
    return [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")]
