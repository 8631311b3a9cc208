"""Training rows cut where the documents lie.

A *run* is a stretch of the token stream that one task holds in order: a range partition of the
corpus, or consecutive row groups.  A run's place in the stream is the number of tokens before it, one number
per run.  Each task cuts the rows that lie inside its stretch; only the fragments at its two ends, each
shorter than a row, are exchanged and put together.  Token arrays cross no shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.sequences import ordered_concat, shift
from corpusloom.staging import stage

CUT = "row bigint, at bigint, whole boolean, ids array<int>"
# Tokens of an Arrow batch of cut rows.
BATCH_TOKENS = 1 << 20


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``run_pos``, the number of tokens before a document in the task; the task is one run, named by its first row."""
    before, run = 0, None
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        ends = before + np.cumsum(n)
        place = batch.schema.get_field_index("run")
        run = batch.column(place)[0].as_py() if run is None and len(n) else run
        columns = [*batch.columns, pa.array(ends - n)]
        columns[place] = pa.array(np.full(len(n), run or 0), pa.int64())
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "run_pos"])
        before = int(ends[-1]) if len(ends) else before


def in_runs(texts: DataFrame, encode: Callable[[Column], Column], *keep: str) -> DataFrame:
    """Encoded documents ``(run, run_pos, n, ids, *keep)`` as a table in the order of the stream.

    ``texts`` is ``(shard, row_index, text, ...)``.  It is range-partitioned before it is encoded, so text and no
    ids is shuffled; with a ``run`` column, as row groups are read, its rows are taken to be in order, runs that one task
    holds become one, and nothing is shuffled.
    """
    if "run" not in texts.columns:
        ordered = texts.repartitionByRange("shard", "row_index").sortWithinPartitions("shard", "row_index")
        texts = ordered.withColumn("run", F.spark_partition_id().cast("bigint"))
    encoded = texts.select("run", encode(F.col("text")).alias("ids"), *keep)
    counted = encoded.withColumn("n", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint"))
    schema = T.StructType([*counted.schema.fields, T.StructField("run_pos", T.LongType())])
    return stage(counted.mapInArrow(_place, schema), "runs")


def run_starts(placed: DataFrame) -> DataFrame:
    """``(run, run_start, run_tokens)``: one row per run, so the window over all of them is small."""
    tokens = placed.groupBy("run").agg(F.sum("n").alias("run_tokens"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("run_tokens").over(before), F.lit(0).cast("bigint"))
    return stage(tokens.select("run", start.alias("run_start"), "run_tokens"), "run_starts")


class _Stretch:
    """Tokens of consecutive documents, and the rows cut from them.

    A row that lies inside the stretch is whole; of others the stretch gives what it has.
    """

    def __init__(self, batch_rows: int, seq_len: int, begin: int):
        self.B, self.T, self.span = batch_rows, seq_len, batch_rows * seq_len + 1
        self.begin = self.at = self.end = begin
        self.held: list[np.ndarray] = []
        self.row = begin // self.span * batch_rows + max(begin % self.span - 1, 0) // seq_len

    def start_of(self, row: int) -> int:
        return row // self.B * self.span + row % self.B * self.T

    def add(self, ids: np.ndarray) -> Iterator[tuple[int, int, bool, np.ndarray]]:
        self.held.append(ids)
        self.end += len(ids)
        if self.start_of(self.row) + self.T + 1 > self.end:
            return
        tokens = np.concatenate(self.held)
        while (stop := self.start_of(self.row) + self.T + 1) <= self.end:
            start = max(self.start_of(self.row), self.begin)
            yield self.row, start, stop - start > self.T, tokens[start - self.at : stop - self.at]
            self.row += 1
        keep = min(max(self.start_of(self.row), self.at), self.end)
        self.held, self.at = [tokens[keep - self.at :]], keep

    def rest(self) -> Iterator[tuple[int, int, bool, np.ndarray]]:
        tokens = np.concatenate(self.held) if self.held else np.zeros(0, np.int32)
        while (start := max(self.start_of(self.row), self.begin)) < self.end:
            yield self.row, start, False, tokens[start - self.at :]
            self.row += 1


def _pieces(batches: Iterator[pa.RecordBatch], batch_rows: int, seq_len: int) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    stretch = None
    for batch in batches:
        starts, ids = batch.column(0).to_numpy(), batch.column(1)
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        offsets = ids.offsets.to_numpy()
        tokens = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        # Documents of a batch that follow each other are one slice of its tokens.
        breaks = np.flatnonzero(starts[1:] != starts[:-1] + np.diff(ends)[:-1]) + 1
        for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(starts)]):
            if a == b:
                continue
            if stretch is None or int(starts[a]) != stretch.end:
                if stretch is not None:
                    yield from stretch.rest()
                stretch = _Stretch(batch_rows, seq_len, int(starts[a]))
            yield from stretch.add(tokens[ends[a] : ends[b]])
    if stretch is not None:
        yield from stretch.rest()


def _cut(batch_rows: int, seq_len: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch_of(found: list[tuple[int, int, bool, np.ndarray]]) -> pa.RecordBatch:
        row, at, whole, ids = zip(*found)
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(whole, pa.bool_()), lists], ["row", "at", "whole", "ids"]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, weight = [], 0
        for piece in _pieces(batches, batch_rows, seq_len):
            found.append(piece)
            weight += len(piece[3])
            if weight >= BATCH_TOKENS:
                yield batch_of(found)
                found, weight = [], 0
        if found:
            yield batch_of(found)

    return cut


def positions(placed: DataFrame) -> DataFrame:
    """``(start_pos, n, ids)`` of the documents that have tokens; nothing is shuffled."""
    return _located(placed, run_starts(placed))


def _located(placed: DataFrame, starts: DataFrame) -> DataFrame:
    # One row per run: the planner sees the table's size and sends it to the tasks while it is small.
    return placed.where("n > 0").join(starts, "run").select((F.col("run_start") + F.col("run_pos")).alias("start_pos"), "n", "ids")


def cut_runs(
    placed: DataFrame, batch_rows: int, seq_len: int, *, first_batch: int = 0, starts: DataFrame | None = None
) -> DataFrame:
    """Training rows ``(batch_id, row_in_batch, inputs, targets)`` of a table of runs, as ``stream_batches`` cuts them.

    Documents without tokens take no place; a last batch that is not full is left out.  ``starts`` may
    give the runs' places, as ``run_starts`` does.
    """
    starts = run_starts(placed) if starts is None else starts
    return rows_of(stage(cut_pieces(placed, starts, batch_rows, seq_len, first_batch=first_batch), "cut"))


PIECES = "batch_id bigint, row_in_batch int, at bigint, whole boolean, ids array<int>"


def cut_pieces(placed: DataFrame, starts: DataFrame, batch_rows: int, seq_len: int, *, first_batch: int = 0) -> DataFrame:
    """Rows of full batches as ``PIECES``: a row inside a run is whole, others are what each run has of them from place ``at``."""
    full_rows = full_batches(starts, batch_rows, seq_len) * batch_rows
    located = _located(placed, starts).select("start_pos", "ids")
    return located.mapInArrow(_cut(batch_rows, seq_len), CUT).where(F.col("row") < full_rows).select(
        (F.expr(f"row div {batch_rows}") + first_batch).alias("batch_id"), F.expr(f"cast(row % {batch_rows} as int)").alias("row_in_batch"),
        "at", "whole", "ids",
    )


def rows_of(pieces: DataFrame) -> DataFrame:
    """``(batch_id, row_in_batch, inputs, targets)`` of a table of ``PIECES``, which is read twice."""
    key = ["batch_id", "row_in_batch"]
    inside = pieces.where("whole").select(*key, F.col("ids").alias("buf"))
    ends = pieces.where("not whole").groupBy(*key).agg(ordered_concat(F.col("at"), F.col("ids")).alias("buf"))
    inputs, targets = shift(F.col("buf"), F.size("buf") - 1)
    return inside.unionByName(ends).select(*key, inputs.alias("inputs"), targets.alias("targets"))


def full_batches(starts: DataFrame, batch_rows: int, seq_len: int) -> int:
    total = starts.agg(F.coalesce(F.sum("run_tokens"), F.lit(0)).cast("bigint")).first()[0]
    return total // (batch_rows * seq_len + 1)


def left_over(placed: DataFrame, starts: DataFrame, batch_rows: int, seq_len: int) -> DataFrame:
    """One row ``ids``: the tokens behind the last full batch, less than a batch."""
    used = full_batches(starts, batch_rows, seq_len) * (batch_rows * seq_len + 1)
    rest = _located(placed, starts).where(F.col("start_pos") + F.col("n") > used).select(
        "start_pos", F.expr(f"slice(ids, cast(greatest({used} - start_pos, 0) as int) + 1, size(ids))").alias("ids")
    )
    return rest.agg(ordered_concat(F.col("start_pos"), F.col("ids")).alias("ids"))
