"""Token offsets, stream cutting and shifted training rows.

Documents are ``(shard, row_index, ..., n)`` with ``n`` tokens each, BOS included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.running import block_of

# Documents per (shard, block) group of the offset scan.
BLOCK_DOCS = 8192


def token_offsets(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Add ``ord`` (rank in shard), ``shard_pos`` and ``start_pos`` (tokens before the document).

    ``docs`` is read twice, so pass a staged table when ``n`` is costly to compute.

    ``shard_pos`` counts from the start of the shard, ``start_pos`` from the start of the corpus.
    Three levels of sums: documents inside a block, blocks inside a shard, shards.  The last one
    is a window without partitioning over one row per file.
    """
    rows = docs.withColumn("_block", block_of("row_index", block_docs))
    totals = rows.groupBy("shard", "_block").agg(
        F.sum("n").alias("_tokens"), F.count(F.lit(1)).alias("_docs")
    )
    earlier_blocks = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    in_shard = totals.select(
        "shard",
        "_block",
        F.coalesce(F.sum("_tokens").over(earlier_blocks), zero).alias("_tokens_before"),
        F.coalesce(F.sum("_docs").over(earlier_blocks), zero).alias("_docs_before"),
    )
    shards = totals.groupBy("shard").agg(F.sum("_tokens").alias("_tokens"))
    bases = shards.select("shard", F.coalesce(F.sum("_tokens").over(earlier_shards), zero).alias("_base"))
    starts = in_shard.join(bases, "shard")
    here = Window.partitionBy("shard", "_block").orderBy("row_index")
    upto_here = here.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_before", F.sum("n").over(upto_here) - F.col("n"))
        .withColumn("_nth", F.row_number().over(here) - 1)
        .join(starts, ["shard", "_block"])
        .select(
            *docs.columns,
            (F.col("_docs_before") + F.col("_nth")).alias("ord"),
            (F.col("_tokens_before") + F.col("_before")).alias("shard_pos"),
            (F.col("_base") + F.col("_tokens_before") + F.col("_before")).alias("start_pos"),
        )
    )


def total_tokens(docs: DataFrame) -> Column:
    """Number of tokens of the corpus, as a scalar subquery."""
    return docs.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).scalar()


def repeat_epochs(offsets: DataFrame, epochs: int) -> DataFrame:
    """The corpus read ``epochs`` times as one seamless stream."""
    total = total_tokens(offsets)
    each = offsets.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("start_pos", F.col("start_pos") + F.col("epoch").cast("bigint") * total)


def shift(row: Column, length: int | Column) -> tuple[Column, Column]:
    """Inputs (all but the last of ``length + 1`` tokens) and targets (all but the first)."""
    return F.slice(row, 1, length), F.slice(row, 2, length).cast("array<bigint>")


def shift_long(tokens: DataFrame, row_key: list[str]) -> DataFrame:
    """Long form of ``shift``: each token of a row beside the next one; the last token drops."""
    # Rows are at most one sequence long, so the window group is bounded.
    follow = Window.partitionBy(*row_key).orderBy("pos")
    return tokens.withColumn("target", F.lead("token").over(follow)).filter(F.col("target").isNotNull())


def stream_batches(
    docs: DataFrame, batch_rows: int, seq_len: int, *, first_batch: int = 0, total: Column | None = None
) -> DataFrame:
    """Cut the token stream into training rows ``(batch_id, row_in_batch, inputs, targets)``.

    ``docs`` has ``start_pos`` and ``ids``; ``total`` may give its number of tokens.  A batch takes ``batch_rows * seq_len + 1`` tokens and
    batches do not overlap; neighbouring rows of a batch share one token.  Each document is sliced
    into the rows it touches and tokens shuffle once, straight to groups of one row.  A last batch
    that is not full is left out.
    """
    B, T = int(batch_rows), int(seq_len)
    span = B * T + 1
    total = docs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("bigint")).scalar() if total is None else total
    end = F.expr("start_pos + size(ids)")
    # The first row that holds position s and the last one that holds position e - 1.
    first = F.expr(f"(start_pos div {span}) * {B} + greatest(start_pos % {span} - 1, 0) div {T}")
    last = F.expr(
        f"((start_pos + size(ids) - 1) div {span}) * {B}"
        f" + least((start_pos + size(ids) - 1) % {span} div {T}, {B - 1})"
    )
    touched = docs.filter(F.size("ids") > 0).select(
        "start_pos", "ids", end.alias("_end"), F.explode(F.sequence(first, last)).alias("_row")
    )
    row_start = F.expr(f"(_row div {B}) * {span} + (_row % {B}) * {T}")
    parts = (
        touched.filter(F.expr(f"_row div {B}") < F.call_function("div", total, F.lit(span)))
        .withColumn("_from", F.greatest(row_start, F.col("start_pos")))
        .withColumn("_to", F.least(row_start + T + 1, F.col("_end")))
        .select(
            "_row",
            "_from",
            F.slice(
                "ids",
                (F.col("_from") - F.col("start_pos") + 1).cast("int"),
                (F.col("_to") - F.col("_from")).cast("int"),
            ).alias("_ids"),
        )
    )
    rows = parts.groupBy("_row").agg(ordered_concat(F.col("_from"), F.col("_ids")).alias("buf"))
    inputs, targets = shift(F.col("buf"), T)
    return rows.select(
        (F.expr(f"_row div {B}") + first_batch).alias("batch_id"),
        F.expr(f"cast(_row % {B} as int)").alias("row_in_batch"),
        inputs.alias("inputs"),
        targets.alias("targets"),
    )


def ordered_concat(order: Column, ids: Column) -> Column:
    """Aggregate: id arrays of a group put together in ``order`` (unique in the group)."""
    sorted_parts = F.array_sort(F.collect_list(F.struct(order.alias("at"), ids.alias("ids"))))
    return F.flatten(F.transform(sorted_parts, lambda p: p["ids"]))


def bos_positions(offsets: DataFrame) -> DataFrame:
    """Where BOS stands in each shard: every document starts with it."""
    return offsets.select("shard", F.col("shard_pos").alias("pos"))


def bos_index(tokens: DataFrame, bos_id: int) -> DataFrame:
    """BOS positions of token-shard rows ``(path, pos, token)``."""
    return tokens.filter(F.col("token") == bos_id).select("path", "pos")
