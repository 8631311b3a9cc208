"""Whole rows carried through an operator without clashes of column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def nested(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (a struct of all columns), ``key_a, key_b`` (128 bits of hashes of them), and ``columns``.

    No name of ``docs`` stands beside them, so columns may have any names.  Equal rows have equal keys.
    """
    parts = [quoted(f.name) if _hashable(f.dataType) else quoted(f.name).cast("string") for f in docs.schema.fields]
    return docs.select(
        F.struct(*map(quoted, docs.columns)).alias("row"), F.xxhash64(*parts).alias("key_a"),
        F.xxhash64(F.lit(1), *parts).alias("key_b"), *[c.alias(n) for n, c in columns.items()],
    )
