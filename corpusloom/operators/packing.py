"""BOS-aligned packing of documents into rows of ``seq_len + 1`` tokens.

A row takes documents from its start until it is full; the last one is cut and its rest is lost;
the next row starts at the next document.  Rows of a shard depend on each other, but only through
the document a row starts at.  So a shard is cut into blocks of consecutive documents and

1. each block tells, for every document a row may enter it at, where the chain of rows leaves it
   and how many rows start inside (few entries: only the first ``seq_len + 1`` tokens qualify);
2. these small maps are composed in groups of ``fan_in`` blocks until one map per shard is left;
3. going back down, each block learns its one true entry and row number, and lists its rows.

No step puts a whole shard into one task, and all of them move ``(ord, n)`` pairs, never tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.running import with_position
from corpusloom.operators.sequences import ordered_concat, shift, token_offsets
from corpusloom.staging import stage

_MAP = "shard string, node long, entry long, leave long, n_rows long"
_ENTRY = "shard string, node long, entry long, first_row long"


def _row_chain(pos: np.ndarray, n: np.ndarray, shard_tokens: int, length: int) -> np.ndarray:
    """For a row that starts at document i: index of the first document after it, -1 if not full."""
    starts = np.append(pos, pos[-1] + n[-1])
    after = np.searchsorted(starts, pos + length, side="left")
    return np.where(pos + length <= shard_tokens, after, -1)


def _block_docs(pdf: pd.DataFrame, node: int) -> tuple[pd.DataFrame, int]:
    """A block's documents followed by its look-ahead, in order; and how many are its own."""
    pdf = pdf.sort_values("ord", ignore_index=True)
    return pdf, int((pdf["home"] == node).sum())


def _summarise(length: int):
    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, node = key
        pdf, own = _block_docs(pdf, node)
        pos, ords = pdf["shard_pos"].to_numpy(), pdf["ord"].to_numpy()
        after = _row_chain(pos, pdf["n"].to_numpy(), int(pdf["shard_tokens"].iloc[0]), length).tolist()
        leave, rows = [-1] * own, [0] * own
        for i in range(own - 1, -1, -1):
            j = after[i]
            if j < 0:
                continue  # the row is not full: the chain ends here
            if j < own:
                leave[i], rows[i] = leave[j], rows[j] + 1
            else:
                leave[i], rows[i] = (int(ords[j]) if j < len(ords) else -1), 1
        # A row of the block before ends within length tokens, or one document later.
        reach = 1 if node == 0 else min(own, int(np.searchsorted(pos[:own], pos[0] + length)) + 1)
        return pd.DataFrame(
            {"shard": shard, "node": node, "entry": ords[:reach], "leave": leave[:reach], "n_rows": rows[:reach]}
        )

    return summarise


def _chain(pdf: pd.DataFrame) -> dict[int, dict[int, tuple[int, int]]]:
    maps: dict[int, dict[int, tuple[int, int]]] = {}
    for node, entry, leave, n in zip(pdf["node"], pdf["entry"], pdf["leave"], pdf["n_rows"]):
        maps.setdefault(node, {})[entry] = (leave, n)
    return maps


def _compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    shard, parent = key
    maps = _chain(pdf)
    order = sorted(maps)
    out = []
    for entry in sorted(maps[order[0]]):
        at, rows = entry, 0
        for node in order:
            if at < 0 or at not in maps[node]:
                break
            at, n = maps[node][at]
            rows += n
        out.append((shard, parent, entry, at, rows))
    return pd.DataFrame(out, columns=["shard", "node", "entry", "leave", "n_rows"])


def _descend(key: tuple, parents: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(parents):
        maps = _chain(children)
        at, row = int(parents["entry"].iloc[0]), int(parents["first_row"].iloc[0])
        for node in sorted(maps):
            if at < 0 or at not in maps[node]:
                break
            out.append((key[0], node, at, row))
            at, n = maps[node][at]
            row += n
    return pd.DataFrame(out, columns=["shard", "node", "entry", "first_row"])


def _list_rows(length: int):
    def list_rows(key: tuple, entries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        shard, node = key
        cols = ["shard", "row_no", "seg_no", "ord", "start", "end"]
        if not len(entries) or not len(docs):
            return pd.DataFrame([], columns=cols, dtype=object)
        docs, own = _block_docs(docs, node)
        pos, ords, n = (docs[c].to_numpy() for c in ("shard_pos", "ord", "n"))
        after = _row_chain(pos, n, int(docs["shard_tokens"].iloc[0]), length).tolist()
        heads, i = [], int(entries["entry"].iloc[0] - ords[0])
        while i < own and after[i] >= 0:
            heads.append(i)
            i = after[i]
        heads = np.array(heads, np.int64)
        if not len(heads):
            return pd.DataFrame([], columns=cols, dtype=object)
        size = np.array([after[h] for h in heads], np.int64) - heads
        row = np.repeat(np.arange(len(heads)), size)
        seg = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        doc = heads[row] + seg
        end = np.minimum(pos[doc] + n[doc], pos[heads][row] + length)
        return pd.DataFrame(
            {
                "shard": shard,
                "row_no": int(entries["first_row"].iloc[0]) + row,
                "seg_no": seg,
                "ord": ords[doc],
                "start": pos[doc],
                "end": end,
            }
        )

    return list_rows


def pack_plan(
    offsets: DataFrame,
    batch_rows: int,
    seq_len: int,
    *,
    block_docs: int | None = None,
    fan_in: int = 1024,
) -> DataFrame:
    """``(shard, batch_id, row_in_batch, seg_no, ord, start, end)`` for all full batches.

    ``offsets`` is the output of ``token_offsets``; ``start`` and ``end`` are token positions in
    the shard.  Each shard is packed alone and its last batch is left out unless full.

    The lengths and each level of maps are staged: they are small, used more than once, and
    computing them again would read the corpus again.
    """
    length = int(seq_len) + 1
    offsets = stage(offsets.select("shard", "ord", "n", "shard_pos"), "lengths")
    named = None
    if not offsets.filter("n <= 0").isEmpty():
        # Documents without tokens take no place in a row; the others are numbered anew meanwhile.
        filled = with_position(offsets.filter("n > 0"), ["shard"], "ord", "_dense")
        filled = stage(filled, "lengths")
        named = filled.select("shard", F.col("_dense").alias("ord"), F.col("ord").alias("_named"))
        offsets = filled.select("shard", F.col("_dense").alias("ord"), "n", "shard_pos")
    block = max(block_docs or 16 * length, length)  # a row then never reaches past the next block
    shard_tokens = offsets.groupBy("shard").agg(
        F.sum("n").alias("shard_tokens"), F.max("ord").alias("_last_ord")
    )
    docs = offsets.select("shard", "ord", "n", "shard_pos").join(shard_tokens, "shard").select(
        "shard", "ord", "n", "shard_pos", "shard_tokens", F.expr(f"ord div {block}").alias("home")
    )
    # A document near the start of a block is also look-ahead of the block before.
    here = F.col("home")
    near_start = (F.expr(f"ord % {block}") < length) & (here > 0)
    nodes = F.when(near_start, F.array(here, here - 1)).otherwise(F.array(here))
    placed = docs.withColumn("node", F.explode(nodes))
    maps = stage(placed.groupBy("shard", "node").applyInPandas(_summarise(length), _MAP), "maps")

    deepest = shard_tokens.agg(F.max(F.expr(f"_last_ord div {block}"))).first()[0] or 0
    levels = [maps]
    while deepest > 0:
        deepest //= fan_in
        lower = levels[-1].withColumn("parent", F.expr(f"node div {fan_in}"))
        levels.append(stage(lower.groupBy("shard", "parent").applyInPandas(_compose, _MAP), "maps"))

    shard_rows = levels[-1].filter((F.col("node") == 0) & (F.col("entry") == 0)).select("shard", "n_rows")
    entries = shard_rows.select(
        "shard",
        F.lit(0).cast("bigint").alias("node"),
        F.lit(0).cast("bigint").alias("entry"),
        F.lit(0).cast("bigint").alias("first_row"),
    )
    for lower in reversed(levels[:-1]):
        children = lower.withColumn("parent", F.expr(f"node div {fan_in}"))
        entries = (
            entries.groupBy("shard", "node")
            .cogroup(children.groupBy("shard", "parent"))
            .applyInPandas(_descend, _ENTRY)
        )
    rows = (
        entries.groupBy("shard", "node")
        .cogroup(placed.groupBy("shard", "node"))
        .applyInPandas(
            _list_rows(length), "shard string, row_no long, seg_no int, ord long, start long, end long"
        )
    )
    B = int(batch_rows)
    if named is not None:
        rows = rows.join(named, ["shard", "ord"]).withColumn("ord", F.col("_named")).drop("_named")
    return (
        rows.join(shard_rows, "shard")
        .filter(F.expr(f"row_no div {B} < n_rows div {B}"))
        .select(
            "shard",
            F.expr(f"row_no div {B}").alias("batch_id"),
            F.expr(f"cast(row_no % {B} as int)").alias("row_in_batch"),
            "seg_no",
            "ord",
            "start",
            "end",
        )
    )


def batch_count(plan: DataFrame) -> DataFrame:
    """Number of full batches of each shard that has one."""
    return plan.groupBy("shard").agg((F.max("batch_id") + 1).alias("n_batches"))


def packed_rows(plan: DataFrame, docs: DataFrame, seq_len: int) -> DataFrame:
    """Training rows of a plan: ``(shard, batch_id, row_in_batch, inputs, targets)``.

    ``docs`` has ``(shard, ord, ids)``.  A document gives a prefix to at most one row, so no more
    than one row's length of it is shuffled.
    """
    T = int(seq_len)
    heads = docs.select("shard", "ord", F.slice("ids", 1, T + 1).alias("ids"))
    taken = plan.join(heads, ["shard", "ord"]).select(
        "shard",
        "batch_id",
        "row_in_batch",
        "seg_no",
        F.slice("ids", F.lit(1), (F.col("end") - F.col("start")).cast("int")).alias("ids"),
    )
    rows = taken.groupBy("shard", "batch_id", "row_in_batch").agg(
        ordered_concat(F.col("seg_no"), F.col("ids")).alias("buf")
    )
    inputs, targets = shift(F.col("buf"), T)
    return rows.select("shard", "batch_id", "row_in_batch", inputs.alias("inputs"), targets.alias("targets"))


def packed(encoded: DataFrame, batch_rows: int, seq_len: int) -> DataFrame:
    """Plan and rows of a table of encoded documents ``(shard, row_index, ids, n)``.

    Positions and plan are made from lengths alone; ids move with the join and the grouping of ``packed_rows`` only.
    """
    places = stage(token_offsets(encoded.select("shard", "row_index", "n")), "positions")
    plan = pack_plan(places, batch_rows, seq_len).join(places.select("shard", "ord", "row_index"), ["shard", "ord"])
    plan = stage(plan.drop("ord").withColumnRenamed("row_index", "ord"), "plan")
    return packed_rows(plan, encoded.select("shard", F.col("row_index").alias("ord"), "ids"), seq_len)


def packing_audit(offsets: DataFrame, plan: DataFrame) -> DataFrame:
    """Per shard: documents, tokens, and what became of the tokens."""
    whole = offsets.groupBy("shard").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n").cast("bigint").alias("tokens")
    )
    used = (
        plan.join(offsets.select("shard", "ord", "n"), ["shard", "ord"])
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.sum(F.col("end") - F.col("start")).alias("kept"),
            F.sum(F.col("n") - (F.col("end") - F.col("start"))).alias("cut"),
            F.count_if(F.col("seg_no") == 0).alias("full_rows"),
        )
    )
    zero = F.lit(0).cast("bigint")
    filled = whole.join(used, "shard", "left")
    columns = {c: F.coalesce(F.col(c), zero) for c in ("segments", "kept", "cut", "full_rows")}
    return filled.select(
        "shard",
        "docs",
        "tokens",
        *[v.alias(c) for c, v in columns.items()],
        (F.col("tokens") - columns["kept"] - columns["cut"]).alias("dropped"),
    )
