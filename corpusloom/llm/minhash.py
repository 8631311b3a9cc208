"""Near-duplicates by exact Jaccard similarity of shingle sets, with MinHash bands for candidates.

A text is its set of ``SHINGLE``-word shingles.  ``BANDS * ROWS`` smallest hashes of the set are folded
into ``BANDS`` keys, and texts with a key in common are candidates: two texts at a similarity of s meet
with probability ``1 - (1 - s^ROWS)^BANDS``, which is 0.9999 at 0.8 and more above.  No candidate is
linked unchecked: the whole sets are fetched and compared, so every link is at 0.8 or more.

Texts of one key are first compared with the smallest of them.  Those that are still in different components
after that are joined by their rarest shingles (``prefix_pairs``), so that many texts which share much, but less
than 0.8, are not compared pair by pair.  Copies of one text are one node, known by 128 bits of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.arrays import mix64
from corpusloom.llm.components import components
from corpusloom.staging import stage

SHINGLE, LEAST_JACCARD = 5, 0.8
BANDS, ROWS, SEED = 50, 8, 11
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.iinfo(np.uint64).max
_draws = np.random.default_rng(SEED)
_TIMES = _draws.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draws.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def normal(text: str) -> tuple[bytes, list[int]]:
    """The lower-cased words (A-Z, ASCII white space) joined with blanks, and the length of each."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return b" ".join(words), [len(w) for w in words]


def shingle_set(line: bytes, lengths: list[int], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle are one, no words none."""
    if not lengths:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.array(lengths) + 1)
    starts = ([0, *ends.tolist()])[: max(1, len(lengths) - shingle + 1)]
    stops = (ends - 1).tolist()[min(shingle, len(lengths)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 0) for a, b in zip(starts, stops)], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set of hashes; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_TIMES), _TOP, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, (hashes[i : i + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    least = least.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * _STEP + least[:, r])
    return keys.view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two stored sets; two empty ones are alike."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if min(len(x), len(y)) < LEAST_JACCARD * max(len(x), len(y)):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def marks(text: Column) -> Column:
    """Node (128-bit hash of the word sequence) and band keys of each text."""

    @F.arrow_udf("struct<node:binary,keys:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            nodes, keys = [], []
            for t in texts:
                line, lengths = normal(t.as_py() or "")
                nodes.append(xxhash.xxh3_128_digest(line))
                keys.append(band_keys(shingle_set(line, lengths)))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.StructArray.from_arrays(
                [pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "keys"]
            )

    return of(text)


def sets_of(text: Column) -> Column:
    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingle_set(*normal(t.as_py() or "")).tobytes() for t in texts], pa.binary())

    return of(text)


def alike(a: Column, b: Column) -> Column:
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([jaccard(i.as_py(), j.as_py()) >= LEAST_JACCARD for i, j in zip(x, y)], pa.bool_())

    return of(a, b)


def candidates(nodes: DataFrame) -> DataFrame:
    """``(key, node, head, n)`` of the keys that several nodes have; ``nodes`` has ``node`` and ``keys``, one row a node."""
    placed = nodes.select("node", F.explode("keys").alias("key"))
    heads = placed.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return stage(placed.join(stage(heads, "heads"), "key"), "candidates")


def _checked(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """Pairs ``(a, b)`` that are alike; each set travels once for each pair it is in."""
    pairs = stage(pairs.distinct(), f"{label}_pairs")
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    return stage(pairs.join(right, "b").join(left, "a").where(alike(F.col("set_a"), F.col("set_b"))).select("a", "b"), label)


def _rooted(nodes: DataFrame, root: DataFrame, column: str) -> DataFrame:
    """``nodes`` with the root of ``column`` as ``root_<column>``."""
    of = root.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return nodes.join(of, column, "left").withColumn(f"root_{column}", F.coalesce("_root", column)).drop("_root")


def _mixed(rooted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys with nodes of several components, each with its last node, and their rows ``(key, node, root_node)``."""
    rooted = stage(rooted, "rooted")
    found = rooted.groupBy("key").agg(F.min("root_node").alias("lo"), F.max("root_node").alias("hi"), F.max("node").alias("last"))
    mixed = stage(found.where("lo < hi").select("key", "last"), "mixed")
    return mixed, rooted.join(mixed, "key", "left_semi")


def alike_components(met: DataFrame, sets: DataFrame) -> DataFrame:
    """``(node, root)`` as ``components`` gives them, of all candidate pairs in ``met`` that are alike.

    ``sets`` has ``node`` and ``set`` for every node in ``met``.  Each node is compared with the head of its
    largest key, then with the heads of its other keys as far as they are in other components, then with the last
    nodes of its keys.  Nodes of a key that are still apart go through ``prefix_pairs``, where nodes that only share what is common do not meet.
    """
    towards = met.where("node <> head")
    largest = towards.groupBy("node").agg(F.max_by("head", F.struct("n", "key")).alias("b"))
    links = _checked(largest.select(F.col("node").alias("a"), "b"), sets, "near_first")
    root = components(links)
    rest = _rooted(_rooted(towards.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), root, "a"), root, "b")
    links = stage(links.union(_checked(rest.where("root_a <> root_b").select("a", "b"), sets, "near_head")), "near")
    root = components(links)
    placed = met.where("n > 2").select("key", "node")
    # Nodes of a key that are still apart are compared with its last node, too: fewer of them are left to meet below.
    last, keyed = _mixed(_rooted(placed, root, "node"))
    towards = _rooted(keyed.join(last, "key").select(F.col("node").alias("a"), "root_node", F.col("last").alias("b")), root, "b")
    links = stage(links.union(_checked(towards.where("root_node <> root_b").select("a", "b"), sets, "near_last")), "near")
    _, keyed = _mixed(_rooted(placed, components(links), "node"))
    apart = keyed.select("node", F.col("root_node").alias("root")).distinct()
    pairs = prefix_pairs(stage(apart, "apart"), sets)
    return components(links.union(_checked(pairs, sets, "near_rest")))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for node, root, held in zip(*(column.to_pylist() for column in batch.columns)):
            hashes = np.frombuffer(held, np.int64)
            for i in range(0, len(hashes), 65_536):
                part = hashes[i : i + 65_536]
                kind = batch.column(0).type
                same = [pa.array([v] * len(part), k) for v, k in ((node, kind), (root, kind), (len(hashes), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part)], ["node", "root", "size", "hash"])


def prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes (node, root)`` in different components that can be alike; none that is alike is left out.

    Every set is ordered by how many of these nodes have a shingle, the rarest first.  Two sets of sizes
    m <= n with a similarity of 4/5 or more share 8/9 m and 4/5 n shingles at least, so they have one in common among the
    first m - ceil(8/9 m) + 1 of the smaller and the first n - ceil(4/5 n) + 1 of the larger.  At the first that they
    share, what follows it in both sets must leave room for 4/9 (m + n) in common.  Shingles of one node take places
    in the order but meet nothing.
    """
    held = nodes.join(sets, "node").select("node", "root", "set")
    kind = held.schema["node"].dataType.simpleString()
    every = stage(held.mapInArrow(_shingles, f"node {kind}, root {kind}, size bigint, hash bigint"), "shingles")
    often = stage(every.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    # A node is one text, so the window holds the shingles of a text.
    order = Window.partitionBy("node").orderBy("n", "hash")
    shared = every.join(often, "hash").withColumns(
        {"place": F.row_number().over(order), "shared": F.count(F.lit(1)).over(Window.partitionBy("node"))}
    )
    placed = shared.withColumn("place", F.expr("place + size - shared"))
    first = stage(placed.where("place <= size - (4 * size + 4) div 5 + 1").select("hash", "node", "root", "size", "place"), "prefixes")
    small = first.where("place <= size - (8 * size + 8) div 9 + 1")

    def by_root(placed: DataFrame, x: str) -> DataFrame:
        held = placed.groupBy("hash", "root").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("place").alias("place"))
        return held.select("hash", *[F.col(c).alias(f"{c}_{x}") for c in ("root", "lo", "hi", "place")])

    # Components meet first, so nodes of one component are never paired; a meeting whose sizes or whose
    # places in the order leave too few shingles to share is none.
    met = by_root(small, "a").join(by_root(first, "b"), "hash").where(
        "root_a <> root_b and lo_a <= hi_b and 4 * lo_b <= 5 * hi_a"
        " and 1 + least(hi_a - place_a, hi_b - place_b) >= (4 * (lo_a + lo_b) + 8) div 9"
    )
    met = stage(met.select("hash", "root_a", "root_b"), "meetings")
    a, b = (t.select("hash", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "size", "place")]) for t, x in ((small, "a"), (first, "b")))
    fits = "(size_a < size_b or (size_a = size_b and node_a < node_b)) and 4 * size_b <= 5 * size_a"
    leaves = "1 + least(size_a - place_a, size_b - place_b) >= (4 * (size_a + size_b) + 8) div 9"
    pairs = met.join(a, ["hash", "root_a"]).join(b, ["hash", "root_b"]).where(f"{fits} and {leaves}")
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
