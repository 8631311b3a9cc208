"""NumPy helpers for Arrow functions: code points, hashes, words of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A slice of an Arrow batch handed to NumPy at once holds about this many bytes of text.
SLICE_BYTES = 4 << 20


def code_points(text: str) -> np.ndarray:
    """Code points of a text; lone surrogates pass through."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices_by_bytes(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of a string array, each of about ``limit`` bytes and at least one row."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a slice without nulls, and each text's word bounds."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(filled)])
    return words.filter(pa.array(filled)), before[offsets]


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each span ``bounds[i]:bounds[i + 1]``; empty spans give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of the bytes of each word of a string array without nulls."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    raw = words.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1) if data else np.zeros(0, np.uint64)
    lengths = np.diff(ends)
    place = np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)
    # Positions 64 apart share a power but not the scrambled value.
    mixed = mix64(values + (place.astype(np.uint64) << np.uint64(8))) * _POWERS[place & 63]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    return mix64((total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]) ^ lengths.astype(np.uint64))
