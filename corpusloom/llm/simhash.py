"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 bits.  Two within ``radius`` bits agree on at least one of ``radius + 1`` equal
slices of the bits, so fingerprints that share a slice meet in a tile, and none within the radius
is missed.  A tile with more than ``TILE`` fingerprints is split by population count and hash; the
pairs of its tiles whose population counts differ beyond the radius are skipped.  A pair of tiles
is compared with NumPy's exclusive-or and bit counts, and reports a spanning forest of its links, so a
group of n fingerprints yields at most n rows however many pairs it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import minhash, rows
from corpusloom.llm.bit_filter import filter_bits, may_hold
from corpusloom.llm.components import components
from corpusloom.staging import stage

SHINGLE, RADIUS, TILE = 3, 2, 1024
# Size of the filters of row keys.  It is fixed: with more keys more rows pass, and the join that follows is exact either way.
FILTER_BITS = 1 << 26
_SEED = 42


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint of one text: a bit is set if it is in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ([0, *ends.tolist()])[: max(1, len(words) - shingle + 1)]
    stops = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], _SEED) for a, b in zip(starts, stops)], "<u8")
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist()))


def simhash_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long; null texts are empty."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.array([simhash(t.as_py() or "", shingle) for t in texts], np.uint64)
            yield pa.array(found.view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked number below ``n`` that is not the smallest of its component, with that smallest one."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label[a], label[b])
        np.minimum.at(new, label[b], label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def tile_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one pair of tiles (its distinct fingerprints in one array)."""
    values = np.unique(values.astype(np.uint64))
    counts = np.bitwise_count(values).astype(np.int16)
    order = np.argsort(counts, kind="stable")
    values, counts = values[order], counts[order]
    left, right = [], []
    step = 512
    for i in range(0, len(values), step):
        for j in range(i, len(values), step):
            if counts[j] - counts[min(i + step, len(values)) - 1] > radius:
                break  # the counts are sorted: later tiles differ even more
            x, y = np.nonzero(np.bitwise_count(values[i : i + step, None] ^ values[None, j : j + step]) <= radius)
            x, y = x + i, y + j
            apart = x != y
            # A tile gives its own forest, so what is kept stays small.
            a, b = _forest(len(values), x[apart], y[apart])
            left.append(a)
            right.append(b)
    a, b = _forest(len(values), np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
    return values[a], values[b]


def in_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Groups of equal leading columns of a sorted stream, each whole and in one table."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None and len(held):
            table = pa.concat_tables([held, table])
        if len(table) == 0:
            continue
        table = table.combine_chunks()
        change = np.zeros(len(table) - 1, bool)
        for c in range(n_keys):
            x = table.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(bounds, bounds[1:]):
            yield table.slice(a, b - a)
        held = table.slice(bounds[-1])
    if held is not None and len(held):
        yield held


def near_links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(a, b)`` links whose components are those of all pairs within ``radius`` bits.

    ``fingerprints`` has a column ``fp`` (long) of distinct values.
    """
    bands = radius + 1
    cuts = [64 * i // bands for i in range(bands + 1)]

    def slice_of(i: int) -> Column:
        width = cuts[i + 1] - cuts[i]
        mask = (1 << width) - 1
        return F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("bigint"))

    keyed = fingerprints.select(
        "fp",
        F.bit_count("fp").cast("int").alias("pop"),
        F.posexplode(F.array(*[slice_of(i) for i in range(bands)])).alias("band", "slice"),
    )
    sizes = keyed.groupBy("band", "slice").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(keyed.join(sizes, ["band", "slice"]), "tiles")

    # Small groups are one tile.  Larger ones are split by population count, then by hash.
    small = met.where(F.col("n") <= tile).select(
        "band", "slice", F.lit(0).alias("p1"), F.lit(0).alias("s1"), F.lit(0).alias("p2"), F.lit(0).alias("s2"), "fp"
    )
    large = met.where(F.col("n") > tile)
    counts = large.groupBy("band", "slice", "pop").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    placed = large.join(counts, ["band", "slice", "pop"]).withColumn("sub", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    listed = counts.select("band", "slice", "pop", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("sub"))
    left = listed.select("band", "slice", F.col("pop").alias("p1"), F.col("sub").alias("s1"))
    right = listed.select("band", "slice", F.col("pop").alias("p2"), F.col("sub").alias("s2"))
    pairs = left.join(right, ["band", "slice"]).where(
        f"p2 - p1 between 0 and {radius} and (p2 > p1 or s2 >= s1)"
    )
    key = ["band", "slice", "p1", "s1", "p2", "s2"]
    first = placed.withColumnsRenamed({"pop": "p1", "sub": "s1"}).join(pairs, ["band", "slice", "p1", "s1"])
    apart = pairs.where("p1 <> p2 or s1 <> s2")  # a tile beside itself came with ``first``
    second = placed.withColumnsRenamed({"pop": "p2", "sub": "s2"}).join(apart, ["band", "slice", "p2", "s2"])
    rows = small.unionByName(first.select(*key, "fp")).unionByName(second.select(*key, "fp"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for group in in_groups(batches, len(key)):
            x, y = tile_links(group.column("fp").to_numpy().view(np.uint64), radius)
            a.append(x)
            b.append(y)
            held += len(x)
            if held > 65536:
                yield pa.record_batch([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], ["a", "b"])
                a, b, held = [], [], 0
        if a:
            yield pa.record_batch([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], ["a", "b"])

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row: 16 hex digits and the smallest id reachable.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text of fewer words than
    a shingle is one shingle, one without words has fingerprint zero, which links like any other.
    Null texts are empty.  Rows with equal fingerprints are linked; null ids take part in links but are never
    the smallest unless all ids of the component are null.  Repeated rows give one row each, an
    empty table none; other columns are ignored.
    """
    marked = stage(docs.select(F.col(id_col).alias("_id"), simhash_of(F.col(text), shingle).alias("fp")), "simhash")
    smallest = stage(marked.groupBy("fp").agg(F.min("_id").alias("least")), "fingerprints")
    root = components(near_links(smallest.select("fp"), radius))
    grouped = smallest.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = grouped.join(ids, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _may_be_in(asked: DataFrame) -> Column:
    """Whether the row with this ``key_a`` may be one of ``asked``."""
    bits = asked.sparkSession.sparkContext.broadcast(filter_bits(asked.select(F.col("key_a").alias("h")), FILTER_BITS))
    return may_hold(bits, F.col("key_a"))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Groups are the components of documents whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more.  Candidates are texts whose fingerprints are linked, directly or through others, within ``RADIUS``
    bits, and texts that share a MinHash key; ``minhash`` checks them on the whole sets.  Texts with equal words are one
    node.  Null texts are empty, and empty texts are one group.  A null id stays only if its group has no other; of
    equal rows one stays.  All columns are kept.
    """
    keyed = rows.nested(docs, id=F.col("doc_id"), body=F.coalesce(F.col(text), F.lit("")))
    keys = ["key_a", "key_b"]
    who = F.struct(F.col("id").isNull().alias("none"), "id", *keys)
    marked = keyed.select(who.alias("who"), minhash.marks(F.col("body")).alias("m"), simhash_of(F.col("body")).alias("fp"))
    # Equal digests have equal keys and fingerprints.  A node goes by a number from here on, which moves in fewer bytes.
    nodes = marked.groupBy("m.node").agg(F.min("who").alias("least"), F.min("m.keys").alias("keys"), F.min("fp").alias("fp"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Linked fingerprints have one root, which is one more key.
    near = components(near_links(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    smallest = nodes.join(near, "fp", "left").withColumn("near", F.xxhash64(F.coalesce("root", "fp")))
    met = minhash.candidates(smallest.select("node", F.concat("keys", F.array("near")).alias("keys")))
    asked = nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "least.key_a", "least.key_b")
    asked = stage(asked, "asked")
    # Only texts that may be asked for are moved to the join.
    texts = keyed.select(*keys, "body").where(_may_be_in(asked)).join(asked, keys).dropDuplicates(keys)
    sets = stage(texts.select("node", minhash.sets_of(F.col("body")).alias("set")), "sets")
    root = minhash.alike_components(met, sets)
    grouped = nodes.select("node", "least").join(root, "node", "left")
    kept = grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("who"))
    kept = stage(kept.select("who.key_a", "who.key_b"), "kept")
    # Rows that stay and have no equal are told by the filter alone; equal rows have equal keys and meet in the join.
    counted = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    others = stage(counted.join(kept.withColumn("stays", F.lit(True)), keys, "left").where("stays is null or n > 1").select(*keys), "others")
    moved = keyed.select("row", *keys)
    other = _may_be_in(others)
    one = moved.where(other).join(kept, keys, "left_semi").dropDuplicates(keys)
    return moved.where(~other).select("row").union(one.select("row")).select("row.*")
