"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer when the smallest hash among its inner s-mers lies at
its first or last place.  The choice looks at the k-mer alone, so an edit elsewhere in the text
never changes it.  A fingerprint keeps the ``anchors`` smallest distinct syncmer hashes over the
whole text, written in the order of their positions.  Likeness takes the smallest hashes of both
fingerprints together, keeps those that both have in the same order (the longest increasing run of
positions), and divides by how many there are: an estimate of the shared part that demands
collinear positions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import code_points, mix64
from corpusloom.staging import fresh_path

K, S, ANCHORS = 16, 8, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _windows_hash(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` values."""
    n = len(points) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= _MULTIPLIER
        out += points[i : i + n]
    return mix64(out)


def syncmer_anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of all closed syncmers; a text shorter than k is one anchor."""
    points = code_points(text).astype(np.uint64)
    if len(points) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(points) < k:
        return (_windows_hash(points, len(points)) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    inner = _windows_hash(points, s)
    n, span = len(points) - k + 1, k - s + 1
    least = inner[:n].copy()
    for i in range(1, span):
        np.minimum(least, inner[i : i + n], out=least)
    at = np.flatnonzero((inner[:n] == least) | (inner[span - 1 : span - 1 + n] == least))
    # The k-mer's hash, only where it is an anchor.
    value = np.zeros(len(at), np.uint64)
    for i in range(k):
        value *= _MULTIPLIER
        value += points[at + i]
    return (mix64(value) >> np.uint64(32)).astype(np.uint32), at


def fingerprint(text: str, k: int = K, s: int = S, anchors: int = ANCHORS) -> np.ndarray:
    """The smallest distinct anchor hashes in order of first position."""
    hashes, at = syncmer_anchors(text, k, s)
    if len(hashes) == 0:
        return hashes
    values, first = np.unique(hashes, return_index=True)
    values, first = values[:anchors], first[:anchors]
    return values[np.argsort(at[first], kind="stable")]


def likeness(a: np.ndarray, b: np.ndarray, anchors: int = ANCHORS) -> float:
    """Collinear share of the smallest anchors of two fingerprints: 1 if equal, 0 if disjoint."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:anchors]
    top = union[-1]
    place = {h: i for i, h in enumerate(b.tolist())}
    runs: list[int] = []
    for h in a[a <= top].tolist():
        p = place.get(h)
        if p is not None:
            i = bisect_left(runs, p)
            runs[i : i + 1] = [p]
    return len(runs) / len(union)


def _text_of(fp: np.ndarray) -> str:
    return fp.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fingerprint)`` of every row: eight hex digits per anchor, in text order.

    Null and empty texts give the empty fingerprint; texts shorter than k one anchor.  Equal texts
    have equal fingerprints.  Other columns are ignored.
    """

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_text_of(fingerprint(t.as_py() or "")) for t in texts], pa.string())

    return docs.select(id_col, of(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))


_RESULT = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compare(text: str, fp: np.ndarray, following: str, next_fp: np.ndarray) -> tuple:
    n = len(text)
    cut = n // 3
    edited = text[: n - cut] + following[:cut]
    edited_fp = fp if edited == text else fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return n, digest, _text_of(fp), _text_of(edited_fp), likeness(fp, edited_fp), likeness(fp, next_fp)


def compare_with_following(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    Documents stand in descending ``doc_id`` order; the one after the last is the first.  The last
    third (in code points, rounded down) of the edited text is replaced by as much of the next
    document.  Returns ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``.

    Null texts are empty texts.  Rows with equal ids stand in order of a hash of their text, then
    the text; null ids come last.  Repeated rows give one row each; an empty table gives none; a
    single row follows itself.  Other columns are ignored.

    Texts are range-partitioned once, and neighbours meet inside a partition.  Only the first and
    last document of each partition travel again, to the partition before and after.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_tie"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "_text").drop("_tie")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {_RESULT}, part int, place string, body string"
    arrow_id = {"int": pa.int32(), "string": pa.string()}.get(id_type, pa.int64())
    fields = [("doc_id", arrow_id), ("n_chars", pa.int64())]
    fields += [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    fields += [("near_edited", pa.float64()), ("near_next", pa.float64())]
    fields += [("part", pa.int32()), ("place", pa.string()), ("body", pa.string())]
    target = pa.schema(fields)
    empty = (None,) * 6

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(fields)
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=target)

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            out = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                fp = fingerprint(body)
                if held is None:
                    out.append((doc_id, *empty, part, "head", body))
                else:
                    out.append((held[0], *_compare(held[1], held[2], body, fp), part, "done", None))
                held = (doc_id, body, fp)
            yield batch_of(out)
        if held is not None:
            yield batch_of([(held[0], *empty, part, "tail", held[1])])

    target_path = fresh_path(docs.sparkSession, "fingerprints")
    placed.mapInArrow(in_order, schema).write.option("compression", "zstd").parquet(target_path)
    staged = docs.sparkSession.read.schema(schema).parquet(target_path)
    heads = staged.where("place = 'head'").select("part", F.col("body").alias("following"))
    # One number per partition, not per document.
    parts = sorted(r["part"] for r in staged.where("place = 'head'").select("part").collect())
    after = dict(zip(parts, parts[1:] + parts[:1]))
    spark = docs.sparkSession
    links = spark.createDataFrame(list(after.items()), "part int, next_part int")
    tails = staged.where("place = 'tail'").select("doc_id", "part", "body").join(links, "part")
    pairs = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "body", "following")

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, body, following in zip(*(c.to_pylist() for c in batch.columns)):
                result = _compare(body, fingerprint(body), following, fingerprint(following))
                out.append((doc_id, *result, 0, "done", None))
            yield batch_of(out)

    columns = [n for n, _ in fields[:7]]
    edges = pairs.mapInArrow(at_edges, schema).select(columns)
    return staged.where("place = 'done'").select(columns).unionByName(edges)
