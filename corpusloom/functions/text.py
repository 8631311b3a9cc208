"""Pre-tokens and bytes as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.fixed_values import SPLIT_PATTERN


def pretokens(text: Column, pattern: str = SPLIT_PATTERN) -> Column:
    """All pieces of ``text`` in order; nothing is dropped between them.

    ``(?U)`` makes the JVM's white-space and letter classes Unicode-aware.
    """
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def byte_chars(text: Column) -> Column:
    """UTF-8 bytes of ``text`` as a string with one character (U+0000..U+00FF) per byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


# Bytes of text, or pieces, that a task turns into ids at a time: an Arrow batch holds up to 64 MB, and its ids are several times as large.
SLICE_BYTES, SLICE_PIECES = 2 << 20, 1 << 18


def slices(array: pa.Array, most: int) -> Iterator[pa.Array]:
    """Consecutive slices of an array of texts or lists with up to ``most`` bytes or items each; a single larger row is one slice."""
    if not len(array):
        yield array
        return
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_list(array.type) else np.int32
    ends = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]
    at = 0
    while at < len(array):
        stop = max(int(np.searchsorted(ends, int(ends[at]) + most, side="right")) - 1, at + 1)
        yield array.slice(at, stop - at)
        at = stop


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        for part in slices(column, SLICE_BYTES):
            raw = part.cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = raw.buffers()[2]
            values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            values = values[offsets[0] : offsets[-1]].astype(np.int32)
            ends = pa.array((offsets - offsets[0]).astype(np.int32))
            yield pa.ListArray.from_arrays(ends, pa.array(values), mask=raw.is_null())


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes of ``text`` as token ids 0..255 (buffers are reused, nothing per row)."""
    return _byte_ids(text)


def joined(ids: Column, separator: str = " ") -> Column:
    """An id array as text, for output that must compare across engines."""
    return F.array_join(ids.cast("array<string>"), separator)
