"""Positions over a whole table without a window that holds the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.staging import stage

BLOCK = 65_536


def with_global_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based position in ``order``, which should have no ties (they fall arbitrarily).

    Rows are range-partitioned and written once; a row's place inside its partition is a window
    over that partition, and the sizes of the partitions (one number each) give the offsets.
    """
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    names = [f"_k{i}" for i in range(len(order))]
    parts = df.select("*", *keys).repartitionByRange(*names).withColumn("_part", F.spark_partition_id())
    staged = stage(parts, "ranked")
    counts = {r["_part"]: r["n"] for r in staged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, pairs = 0, []
    for part in sorted(counts):
        pairs += [F.lit(part), F.lit(offset).cast("bigint")]
        offset += counts[part]
    if not pairs:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return staged.select(*df.columns, (inside + F.create_map(*pairs)[F.col("_part")]).alias(name))


def with_slot(df: DataFrame, key: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Add the 0-based place of ``order`` (distinct non-negative longs) inside each ``key``.

    Rows are numbered in blocks of consecutive ``order``; a key of any size is many blocks.
    """
    rows = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order)) - 1
    numbered = rows.withColumn("_inside", inside).join(starts, [key, "_block"])
    return numbered.select(*df.columns, (F.col("_inside") + F.col("_start")).alias(name))
