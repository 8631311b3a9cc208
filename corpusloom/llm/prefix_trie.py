"""The trie of conversation prefixes, peeled from its deepest turns to the root.

A prefix is known by two sums over its turns of 64-bit hashes that hold the turn's depth, so a
conversation of any length gets its prefixes from running sums over blocks of turns and stripping
the last turn is a subtraction.

*Truncation peeling* starts at the greatest depth at which two different conversations still agree.
A round joins the nodes that survive from the depth below with the conversations that enter at this depth, groups them
by prefix, adds up what a node needs (members, children, leaves, saved tokens), writes the level,
and strips the last turn.  Turns that a conversation shares with no other form a chain under the depth where
it enters: the chain's nodes have the same members, so their figures follow from running sums and no
round is spent on them.  Copies of a conversation count as one with a number.  There are as many rounds as the deepest shared prefix has
turns, each on the rows alive at its depth only; grouping combines before the shuffle, so a prefix
that a third of all conversations start with costs no more than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.turns import in_order, order_keys, plain
from corpusloom.operators.running import with_position, with_running
from corpusloom.staging import fresh_path, stage

NODE = "decimal(30,0)"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
# Ids that one row of the id lists holds; a longer list is many rows, hashed one after the other.
IDS_A_ROW = 8192


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, ord, a, b, n_bytes``: turns by number from 0, texts replaced by two hashes and their bytes.

    Null roles and texts are empty ones; rows without ``conv_id`` belong to no conversation and
    are left out.  Rows with equal turns stand in the order of role and text hash.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = plain(conversations).where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    narrow = rows.select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("text"),
        F.xxhash64("role", "text").alias("a"), F.xxhash64("text", "role").alias("b"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )
    placed = in_order(narrow, order_keys(), "turns").drop("turn", "role", "text")
    return with_position(placed, ["conv_id"], "pos", "ord").drop("pos")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of the first one of their family of ids.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all if it has fewer,
    none if it is absent), h = crc32(c) % ``heads``, and then its own turns after its first h.
    Returns ``(turns by depth from 1, all conv_ids)``; a conversation may be left without turns.
    """
    sizes = stage(turns.groupBy("conv_id").agg((F.max("ord") + 1).alias("n_turns")), "sizes")
    c = F.col("conv_id")
    wishes = sizes.select(
        "conv_id", "n_turns", (F.crc32(c.cast("string")) % heads).alias("h"), (c - c % family).alias("base"),
    )
    bases = sizes.select(c.alias("base"), F.col("n_turns").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = stage(wishes.join(bases, "base", "left").withColumn("head", head), "plan")
    first = turns.where(F.col("ord") < heads - 1).select(c.alias("base"), (F.col("ord") + 1).alias("depth"), "a", "b", "n_bytes")
    taken = plan.where("head > 0").select("conv_id", "base", F.explode(F.sequence(F.lit(1).cast("bigint"), "head")).alias("depth"))
    taken = taken.join(first, ["base", "depth"]).select("conv_id", "depth", "a", "b", "n_bytes")
    own = turns.join(plan.select("conv_id", "h", "head"), "conv_id").where("ord >= h")
    own = own.select("conv_id", F.expr("ord - h + head + 1").alias("depth"), "a", "b", "n_bytes")
    return taken.unionByName(own), plan.select("conv_id")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, p, q, conv_id`` to rows that hold up to IDS_A_ROW ids of one node, comma-joined."""
    node, ids, first = None, [], None

    def row() -> pa.RecordBatch:
        depth, p, q = node
        arrays = [pa.array([depth], pa.int64()), pa.array([p], pa.decimal128(30, 0)), pa.array([q], pa.decimal128(30, 0))]
        return pa.record_batch([*arrays, pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["depth", "p", "q", "first", "ids"])

    for batch in batches:
        for depth, p, q, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (depth, p, q) != node or len(ids) == IDS_A_ROW:
                if ids:
                    yield row()
                node, ids, first = (depth, p, q), [], conv
            ids.append(str(conv))
    if ids:
        yield row()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted id lists to one SHA-256 a node; a list of any length passes through one hash state."""
    node, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        depth, p, q, digest = zip(*out)
        arrays = [pa.array(depth, pa.int64()), pa.array(p, pa.decimal128(30, 0)), pa.array(q, pa.decimal128(30, 0)), pa.array(digest)]
        return pa.record_batch(arrays, ["depth", "p", "q", "ends_sha256"])

    for batch in batches:
        for depth, p, q, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if (depth, p, q) == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, p, q), hashlib.sha256()
            state.update(ids.encode())
        if len(out) >= 10_000:
            yield rows()
            out.clear()
    if node:
        out.append((*node, state.hexdigest()))
        yield rows()


def _ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids of conversations that end at the same node, for nodes with several."""
    keys = ["depth", "p", "q"]
    ids = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    lists = ids.mapInArrow(_lists, f"depth bigint, p {NODE}, q {NODE}, first bigint, ids string")
    lists = lists.repartition(*keys).sortWithinPartitions(*keys, "first")
    return lists.mapInArrow(_digests, f"depth bigint, p {NODE}, q {NODE}, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of ``turns (conv_id, depth, a, b, n_bytes)``, the root included.

    ``conversations`` has every ``conv_id`` once, also those without turns, which are members of the
    root alone.  ``a`` and ``b`` are two hashes of a turn.  Returns ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``; without conversations there are no rows.  Equal conversations are members of
    the same nodes.
    """
    term = {"p": F.xxhash64("depth", "a", "b"), "q": F.xxhash64("b", "a", "depth")}
    terms = turns.select("conv_id", "depth", "n_bytes", *[t.cast("decimal(20,0)").alias(f"{n}_term") for n, t in term.items()])
    sums = {"p": F.col("p_term"), "q": F.col("q_term"), "bytes_sum": F.col("n_bytes")}
    summed = with_running(terms, ["conv_id"], "depth", sums=sums)
    paths = stage(summed.withColumns({n: F.col(n).cast(NODE) for n in term}), "paths")

    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("depth", "p", "q", "bytes_sum"), "depth").alias("end"))
    zero, none = F.lit(0).cast("bigint"), F.lit(0).cast(NODE)
    ends = stage(
        conversations.join(last, "conv_id", "left").select(
            "conv_id", F.coalesce("end.depth", zero).alias("depth"), F.coalesce("end.p", none).alias("p"),
            F.coalesce("end.q", none).alias("q"), F.coalesce("end.bytes_sum", zero).alias("total"),
        ),
        "ends",
    )
    copies = ends.groupBy("depth", "p", "q").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total")
    )
    copies = stage(copies, "classes")
    several = _ends_digests(ends.join(copies.where("n > 1").select("depth", "p", "q"), ["depth", "p", "q"], "left_semi"))
    alone = F.sha2(F.col("conv_id").cast("string"), 256)
    classes = stage(
        copies.join(several, ["depth", "p", "q"], "left").select(
            "conv_id", F.col("depth").alias("length"), "n", "total", F.coalesce("ends_sha256", alone).alias("ends_sha256")
        ),
        "classes",
    )

    # How deep each class agrees with another one; below that its turns are a chain of its own.
    reps = paths.join(classes.select("conv_id"), "conv_id", "left_semi")
    shared = reps.groupBy("depth", "p", "q").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    meets = reps.join(shared, ["depth", "p", "q"], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("meets"))
    known = stage(classes.join(meets, "conv_id", "left").withColumn("meets", F.coalesce("meets", zero)), "known")

    rows = paths.join(known, "conv_id").withColumns({"up_p": F.expr("p - p_term"), "up_q": F.expr("q - q_term")})
    chain = stage(
        rows.where("depth > meets").select(
            "conv_id", "depth", F.when(F.col("depth") > F.col("meets") + 1, F.col("conv_id")).alias("parent_conv_id"),
            F.col("up_p").cast(NODE).alias("up_p"), F.col("up_q").cast(NODE).alias("up_q"), F.col("n").alias("n_convs"),
            (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
            F.expr("(n - 1) * (total - bytes_sum + n_bytes)").alias("saved_tokens"),
            F.when(F.col("depth") == F.col("length"), F.col("ends_sha256")).otherwise(EMPTY_SHA).alias("ends_sha256"),
        ),
        "chains",
    )
    at_meeting = rows.where("depth = meets").select("conv_id", "p", "q", "bytes_sum")
    enter = known.join(at_meeting, "conv_id", "left").select(
        F.col("meets").alias("depth"), F.coalesce("p", none).alias("p"), F.coalesce("q", none).alias("q"), "conv_id",
        F.col("n").alias("n_convs"), (F.col("length") > F.col("meets")).cast("bigint").alias("n_children"),
        (F.col("length") > F.col("meets")).cast("bigint").alias("n_leaves"),
        (F.expr("n - 1") * (F.col("total") - F.coalesce("bytes_sum", zero))).alias("saved_tokens"),
        F.when(F.col("length") == F.col("meets"), F.col("ends_sha256")).alias("ends_sha256"),
    )
    enter = stage(enter.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"), "entering")
    steps = rows.where("depth <= meets").select("conv_id", "depth", "n_bytes", "up_p", "up_q")
    steps = stage(steps.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth"), "steps")

    spark = turns.sparkSession
    levels = fresh_path(spark, "levels")
    deepest = enter.agg(F.max("depth")).first()[0]
    survivors = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        survivors = _level(enter, steps, survivors, depth, f"{levels}/level={depth}")
    if deepest is None:
        return chain.drop("up_p", "up_q")
    fields = [f for f in survivors.schema.fields if f.name != "level"]
    nodes = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in fields)}, level int").parquet(levels).drop("level")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("_parent"))
    below = nodes.select(*[c for c in chain.columns if c != "parent_conv_id"]).unionByName(chain.where("parent_conv_id is null").drop("parent_conv_id"))
    linked = below.where("depth > 0").join(parents, ["depth", "up_p", "up_q"]).withColumnRenamed("_parent", "parent_conv_id")
    root = below.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return linked.select(*out).unionByName(root.select(*out)).unionByName(chain.where("parent_conv_id is not null").select(*out))


def _level(enter: DataFrame, steps: DataFrame, survivors: DataFrame | None, depth: int, path: str) -> DataFrame:
    """One round: strip the survivors' last turn, join those that enter at ``depth``, group by prefix."""
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    live = enter.where(F.col("depth") == depth).select("p", "q", "conv_id", *figures)
    if survivors is not None:
        stripped = survivors.select(
            F.col("up_p").alias("p"), F.col("up_q").alias("q"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("n_children"),
            "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"),
        )
        live = live.unionByName(stripped)
    merged = live.groupBy("p", "q").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
    if depth:
        merged = merged.join(steps.where(F.col("depth") == depth).drop("depth"), "conv_id")
    else:
        merged = merged.withColumns({"n_bytes": F.lit(0), "up_p": F.lit(None), "up_q": F.lit(None)})
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    nodes = merged.select(
        "conv_id", F.lit(depth).cast("bigint").alias("depth"), F.col("p").cast(NODE).alias("p"), F.col("q").cast(NODE).alias("q"),
        F.col("up_p").cast(NODE).alias("up_p"), F.col("up_q").cast(NODE).alias("up_q"), "n_convs", "n_children", leaves.cast("bigint").alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    return stage(nodes, "level", path)
