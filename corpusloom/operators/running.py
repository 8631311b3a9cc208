"""Ordered running totals without putting a whole key into one task.

``order`` is an integer column, unique within ``key``.  Rows are cut into blocks of
``block_rows`` consecutive order values, so a (key, block) group holds at most that many rows
however hot the key is.  Totals per block are a table ``block_rows`` times smaller; only it is
ordered per key.  Rows and block totals are partitioned alike, so rows shuffle once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
_BLOCK = "_block"


def block_of(order: str, block_rows: int) -> Column:
    return F.expr(f"`{order}` div {int(block_rows)}")


def with_running(
    df: DataFrame,
    key: list[str],
    order: str,
    *,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add inclusive running sums and minima; NULL inputs leave the running value unchanged."""
    sums, mins = sums or {}, mins or {}
    values = [c.alias(f"_v_{n}") for n, c in {**sums, **mins}.items()]
    rows = df.select("*", block_of(order, block_rows).alias(_BLOCK), *values)

    upto_here = Window.partitionBy(*key, _BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)

    totals = rows.groupBy(*key, _BLOCK).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.min(f"_v_{n}").alias(f"_t_{n}") for n in mins],
    )
    carries = totals.select(
        *key,
        _BLOCK,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins],
    )
    local = rows.select(
        *df.columns,
        _BLOCK,
        *[F.sum(f"_v_{n}").over(upto_here).alias(f"_l_{n}") for n in sums],
        *[F.min(f"_v_{n}").over(upto_here).alias(f"_l_{n}") for n in mins],
    )

    def add(name: str) -> Column:
        carry, inner = F.col(f"_c_{name}"), F.col(f"_l_{name}")
        return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(carry + inner).alias(name)

    def least(name: str) -> Column:
        return F.least(f"_c_{name}", f"_l_{name}").alias(name)

    return local.join(carries, [*key, _BLOCK], "left").select(
        *df.columns, *[add(n) for n in sums], *[least(n) for n in mins]
    )


def with_position(
    df: DataFrame, key: list[str], order: str, name: str = "ord", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the 0-based rank of ``order`` within ``key``."""
    counted = with_running(df, key, order, sums={name: F.lit(1).cast("bigint")}, block_rows=block_rows)
    return counted.withColumn(name, F.col(name) - 1)


# A block of a decayed sum ends where its first value weighs about this much.
_LEAST_WEIGHT = 1e-150


def decayed_sum(
    df: DataFrame, key: list[str], position: str, value: str, decay: float, name: str
) -> DataFrame:
    """Add ``sum(decay ** (t - i) * value_i for i <= t)`` with ``t`` the 0-based ``position``.

    Within a block the sum is one window over values weighted relative to the block's end, so
    large values cannot overflow.  A block passes its last sum on to the next ones: by the same
    recurrence with decay ``decay ** block`` over a table that is a block length smaller or, once that
    decay is tiny, from the three blocks before, beyond which a weight has no digit left.  NaN and
    infinities never fade: what has been met so far travels as bits beside the finite sums.
    """
    block, carry, seen, met = f"_block_of_{position}", f"_carry_of_{name}", f"_seen_of_{name}", f"_met_of_{name}"
    m = max(2, min(BLOCK_ROWS, int(math.log(_LEAST_WEIGHT) / math.log(decay)))) if 0.0 < decay < 1.0 else BLOCK_ROWS
    step = F.expr(f"`{position}` % {m}").cast("double")
    x = F.col(value).cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    bits = F.when(F.isnan(x), 1).when(x == float("inf"), 2).when(x == float("-inf"), 4).otherwise(0)
    rows = df.select("*", block_of(position, m).alias(block), step.alias("_j"), F.when(odd, 0.0).otherwise(x).alias("_x"), bits.alias("_bits"))
    upto_here = Window.partitionBy(*key, block).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.pow(F.lit(decay), F.lit(m - 1) - F.col("_j"))
    rows = rows.withColumns({name: F.sum(F.col("_x") * weight).over(upto_here) / weight, seen: F.bit_or("_bits").over(upto_here)})

    ends = rows.filter(F.col("_j") == m - 1).select(*key, block, F.col(name).alias("_end"), F.col(seen).alias("_ended"))
    in_order = Window.partitionBy(*key).orderBy(block)
    block_decay = decay**m
    if block_decay > 1e-100:
        ends = decayed_sum(ends, key, block, "_end", block_decay, carry)
    else:
        before = lambda n: F.coalesce(F.lag("_end", n).over(in_order), F.lit(0.0))
        ends = ends.withColumn(carry, F.col("_end") + before(1) * block_decay + before(2) * block_decay**2)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    carries = ends.select(*key, (F.col(block) + 1).alias(block), carry, F.bit_or("_ended").over(so_far).alias(met))
    total = F.col(name) + F.coalesce(F.col(carry) * F.pow(F.lit(decay), F.col("_j") + 1), F.lit(0.0))
    flags = F.col(seen).bitwiseOR(F.coalesce(F.col(met), F.lit(0)))
    spoiled = F.when(flags.bitwiseAND(F.lit(1)).cast("boolean") | (flags.bitwiseAND(F.lit(6)) == 6), float("nan"))
    spoiled = spoiled.when(flags == 2, float("inf")).when(flags == 4, float("-inf"))
    return rows.join(carries, [*key, block], "left").select(*df.columns, spoiled.otherwise(total).alias(name))
