"""A bit filter of hashes: rows that it passes by need no join, the others are joined exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK_BITS = 1 << 17


def filter_bits(hashes: DataFrame, n_bits: int) -> bytes:
    """Bits set at the low bits of every hash in ``hashes.h``; ``n_bits`` is a power of two, 2^17 at least."""
    bit = F.col("h").bitwiseAND(F.lit(n_bits - 1).cast("bigint"))
    chunked = hashes.select(F.shiftright(bit, 17).cast("int").alias("chunk"), F.pmod(bit, F.lit(_CHUNK_BITS)).cast("int").alias("bit"))

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(_CHUNK_BITS, np.uint8)
        flags[table.column("bit").to_numpy()] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(n_bits // 8, np.uint8)
    for r in chunked.distinct().groupBy("chunk").applyInArrow(pack, "chunk int, bits binary").toLocalIterator():
        at = r["chunk"] * (_CHUNK_BITS // 8)
        out[at : at + _CHUNK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def in_filter(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each unsigned hash is set in ``bits``, the bytes of a filter."""
    bit = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return ((bits[bit >> 3] >> (bit & 7)) & 1).astype(bool)


def may_hold(bits: Broadcast, hashes: Column) -> Column:
    """Whether the bit of each hash, a long, is set in a broadcast filter."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            yield pa.array(in_filter(batch.to_numpy().view(np.uint64), held))

    return of(hashes)
