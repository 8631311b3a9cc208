"""Token-shard files: a header of 256 int32 values, then unsigned 16-bit token ids.

``format("token_shard")`` reads chunks ``(path, start, ids)`` in parallel byte ranges of a file.
With ``view=bos`` a chunk gives the positions of the token ``bosId`` instead of its ids, with
``view=headers`` a file gives one row that says why it cannot be read, if so.  Writing takes
``(file_no, file_tokens, pos, ids)`` rows, ordered within each file, and publishes the finished
files on commit, so a repeated task leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from corpusloom.functions.fixed_values import (
    MAX_TOKEN_IDS,
    SHARD_HEADER_INTS,
    SHARD_MAGIC,
    SHARD_VERSION,
)
from corpusloom.operators.sequences import ordered_concat, shift
from corpusloom.staging import filesystem, fresh_path, qualified, stage

FORMAT = "token_shard"
HEADER_BYTES = SHARD_HEADER_INTS * 4
CHUNK_TOKENS = 65_536
READ_SCHEMA = "path string, start bigint, ids array<int>"
BOS_SCHEMA = "path string, start bigint, n_tokens bigint, bos array<bigint>"
HEADER_SCHEMA = "path string, magic int, version int, n_tokens bigint, n_bytes bigint, reason string"
FILE_NAME = "tokens_%06d.bin"


@dataclass
class _Range:
    path: str
    size: int
    first: int
    last: int
    # Tokens up to here may follow a chunk as its look-ahead.
    end: int


@dataclass
class _Ranges(InputPartition):
    ranges: list


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _header(file) -> np.ndarray:
    raw = file.read(HEADER_BYTES)
    return np.frombuffer(raw[: len(raw) // 4 * 4], "<i4")


def _fault(header: np.ndarray, size: int) -> str | None:
    if len(header) < SHARD_HEADER_INTS:
        return "short_header"
    if header[0] != SHARD_MAGIC:
        return "bad_magic"
    if header[1] != SHARD_VERSION:
        return "bad_version"
    if size < HEADER_BYTES + 2 * int(header[2]):
        return "missing_tokens"
    return None


class TokenShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        views = {"headers": HEADER_SCHEMA, "bos": BOS_SCHEMA}
        return views.get(self.options.get("view"), READ_SCHEMA)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.view = options.get("view", "ids")
        self.ranges = options.get("ranges")
        self.bos_id = int(options.get("bosid", -1))
        self.beyond = int(options.get("beyond", 0))
        self.strict = str(options.get("strict", "true")).lower() == "true"
        # A task reads between these numbers of tokens: long files are cut, short ones share a task.
        self.most = max(int(options.get("tokenspertask", 32 << 20)) // CHUNK_TOKENS, 1) * CHUNK_TOKENS
        self.least = self.most // 16

    def partitions(self):
        """Byte ranges from the file listing alone, or from a list of ranges; no file is opened on the driver."""
        if self.ranges:
            system, root = filesystem(self.ranges)
            listed = ds.dataset(root, filesystem=system, format="parquet").to_table().to_pylist()
            system, _ = filesystem(self.path)
            sizes = {f.path: f.size for f in system.get_file_info(sorted({r["path"] for r in listed}))} if listed else {}
            whole = sorted((r["path"], r["first"], r["last"]) for r in listed)
            cut = [(p, at, min(at + self.most, b), b) for p, a, b in whole for at in range(a, b, self.most)]
            return [_Ranges([_Range(p, sizes[p], a, b, end)]) for p, a, b, end in cut] or [_Ranges([])]
        system, root = filesystem(self.path)
        if system.get_file_info(root).type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(root, recursive=True))
        else:
            found = [system.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".bin"))
        tasks, held = [_Ranges([])], 0
        for path, size in files:
            tokens = max((size - HEADER_BYTES) // 2, 1)
            step = tokens if self.view == "headers" else self.most
            for first in range(0, tokens, step):
                last = min(first + step, tokens)
                tasks[-1].ranges.append(_Range(path, size, first, last, tokens))
                held += 1 if self.view == "headers" else last - first
                if held >= (256 if self.view == "headers" else self.least):
                    tasks.append(_Ranges([]))
                    held = 0
        return tasks

    def read(self, task: _Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        for part in task.ranges:
            with system.open_input_file(part.path) as file:
                yield from self._read_range(file, part)

    def _read_range(self, file, part: _Range) -> Iterator[pa.RecordBatch]:
        header = _header(file)
        reason = _fault(header, part.size)
        if self.view == "headers":
            values = [int(v) for v in header[:3]] + [None] * (3 - len(header[:3]))
            row = [[part.path], values[:1], values[1:2], values[2:3], [part.size], [reason]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            names = ["path", "magic", "version", "n_tokens", "n_bytes", "reason"]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds)], names=names)
            return
        if reason is not None:
            if self.strict:
                raise ValueError(f"{part.path}: {reason}")
            return
        last = min(part.last, int(header[2]))
        # Chunks end at multiples of their size, wherever the range begins.
        bounds = [part.first, *range((part.first // CHUNK_TOKENS + 1) * CHUNK_TOKENS, last, CHUNK_TOKENS), last]
        for at, stop in zip(bounds, bounds[1:]):
            if at >= stop:
                continue
            file.seek(HEADER_BYTES + 2 * at)
            upto = max(stop, min(stop + self.beyond, part.end, int(header[2])))
            ids = np.frombuffer(file.read(2 * (upto - at)), "<u2")
            columns = {"path": pa.array([part.path]), "start": pa.array([at], pa.int64())}
            if self.view == "bos":
                spots = np.flatnonzero(ids == self.bos_id) + at
                columns["n_tokens"] = pa.array([len(ids)], pa.int64())
                columns["bos"] = _one_list(spots.astype(np.int64))
            else:
                columns["ids"] = _one_list(ids.astype(np.int32))
            yield pa.RecordBatch.from_pydict(columns)


def _one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, root = filesystem(self.path)
        system.create_dir(root, recursive=True)
        attempt, files, out = uuid.uuid4().hex, [], None
        at = expected = 0

        def close():
            if out is not None:
                out.close()
                if at != expected:
                    raise ValueError(f"file {files[-1][1]}: {at} tokens instead of {expected}")

        for batch in batches:
            rows = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                number, ids = rows["file_no"][i].as_py(), rows["ids"][i].values.to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= MAX_TOKEN_IDS):
                    raise ValueError("token ids must fit in 16 bits")
                name = FILE_NAME % number
                if not files or files[-1][1] != name:
                    close()
                    at, expected = 0, rows["file_tokens"][i].as_py()
                    files.append((f"{root}/_{name}.{self.job}.{attempt}", name))
                    out = system.open_output_stream(files[-1][0])
                    header = np.zeros(SHARD_HEADER_INTS, "<i4")
                    header[:3] = SHARD_MAGIC, SHARD_VERSION, expected
                    out.write(header.tobytes())
                out.write(ids.astype("<u2").tobytes())
                at += len(ids)
        close()
        return _Written(files)

    def commit(self, messages) -> None:
        system, root = filesystem(self.path)
        for message in messages:
            for temporary, name in message.files if message else []:
                system.move(temporary, f"{root}/{name}")

    def abort(self, messages) -> None:
        system, _ = filesystem(self.path)
        for message in messages:
            for temporary, _name in message.files if message else []:
                system.delete_file(temporary)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShardSource)


def read_token_shards(spark: SparkSession, path: str, strict: bool = True, beyond: int = 0) -> DataFrame:
    """Chunks ``(path, start, ids)``; ``start`` is a multiple of ``CHUNK_TOKENS``.

    A chunk goes on for ``beyond`` tokens of the next ones, as far as the file has them.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("strict", str(strict).lower()).option("beyond", beyond)
    return reader.load(qualified(spark, path))


def shard_headers(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("view", "headers").load(qualified(spark, path))


def shard_rejects(spark: SparkSession, path: str) -> DataFrame:
    return shard_headers(spark, path).filter(F.col("reason").isNotNull())


def shard_tokens(chunks: DataFrame) -> DataFrame:
    """One row per token: ``(path, pos, token)``."""
    each = chunks.select("path", "start", F.posexplode("ids").alias("_i", "token"))
    return each.select("path", (F.col("start") + F.col("_i")).alias("pos"), "token")


def write_token_shards(stream: DataFrame, path: str, tokens_per_file: int = 100_000_000) -> str:
    """Write a token stream ``(start_pos, ids)`` as numbered files of ``tokens_per_file`` tokens.

    Documents are cut at file borders, so no task writes more than its files' fixed size.  The
    folder must be new or empty.
    """
    register(stream.sparkSession)
    system, root = filesystem(qualified(stream.sparkSession, path))
    if system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        raise FileExistsError(f"{path} is not empty: files of an earlier write would be replaced")
    size = int(tokens_per_file)
    total = stream.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("bigint")).scalar()
    files = F.sequence(F.expr(f"start_pos div {size}"), F.expr(f"(start_pos + size(ids) - 1) div {size}"))
    cut = stream.filter(F.size("ids") > 0).select("start_pos", "ids", F.explode(files).alias("file_no"))
    low = F.greatest(F.col("file_no") * size, F.col("start_pos"))
    high = F.least((F.col("file_no") + 1) * size, F.col("start_pos") + F.size("ids"))
    pieces = cut.select(
        "file_no",
        F.least(F.lit(size).cast("bigint"), total - F.col("file_no") * size).alias("file_tokens"),
        low.alias("pos"),
        F.slice("ids", (low - F.col("start_pos") + 1).cast("int"), (high - low).cast("int")).alias("ids"),
    )
    placed = pieces.repartition("file_no").sortWithinPartitions("file_no", "pos")
    placed.write.format(FORMAT).mode("append").save(qualified(stream.sparkSession, path))
    return path


def read_bos_index(spark: SparkSession, path: str, bos_id: int, strict: bool = True) -> DataFrame:
    """``(path, start, n_tokens, bos)`` per chunk: where BOS stands, without shipping the tokens."""
    register(spark)
    reader = spark.read.format(FORMAT).option("view", "bos").option("bosId", bos_id)
    return reader.option("strict", str(strict).lower()).load(qualified(spark, path))


def shard_documents(index: DataFrame, block_tokens: int = 1 << 23) -> DataFrame:
    """Documents ``(shard, row_index, n)`` of token shards: from each BOS to the next.

    ``index`` is a BOS index, read three times: stage it.  ``row_index`` is the token position of
    the BOS; tokens before the first one belong to none.  The next BOS is found inside a block of
    positions, or is the first one of a later block.
    """
    starts = index.select(F.col("path").alias("shard"), F.explode("bos").alias("pos")).withColumn(
        "_block", F.expr(f"pos div {block_tokens}")
    )
    sizes = index.groupBy(F.col("path").alias("shard")).agg(F.max(F.col("start") + F.col("n_tokens")).alias("_size"))
    firsts = starts.groupBy("shard", "_block").agg(F.min("pos").alias("_first"))
    later = firsts.select(
        "shard", "_block", F.lead("_first").over(Window.partitionBy("shard").orderBy("_block")).alias("_later")
    ).join(sizes, "shard")
    inside = F.lead("pos").over(Window.partitionBy("shard", "_block").orderBy("pos"))
    return (
        starts.withColumn("_next", inside)
        .join(later, ["shard", "_block"])
        .select(
            "shard",
            F.col("pos").alias("row_index"),
            (F.coalesce("_next", "_later", "_size") - F.col("pos")).alias("n"),
        )
    )


def read_token_ranges(spark: SparkSession, path: str, ranges: DataFrame, strict: bool = True, beyond: int = 0) -> DataFrame:
    """Chunks ``(path, start, ids)`` of token ranges ``(path, first, last)``, a task for each; nothing else is read.

    ``ranges`` is a list the planner holds, one row for a stretch of a file.  A chunk goes on for ``beyond`` tokens
    of the next ones, as far as its range has them.
    """
    register(spark)
    listed = fresh_path(spark, "ranges")
    ranges.select("path", "first", "last").coalesce(1).write.parquet(listed)
    reader = spark.read.format(FORMAT).option("ranges", qualified(spark, listed)).option("strict", str(strict).lower())
    return reader.option("beyond", beyond).load(qualified(spark, path))


def skip_list(spark: SparkSession, path: str, bos_id: int) -> DataFrame:
    """The BOS index of the files under ``path``, kept beside them and read from there from then on.

    ``(path, start, n_tokens, bos)`` as ``read_bos_index`` gives it; the list is some bytes per document, where
    the files have two per token.  It is written once and not refreshed: files are taken to be final.
    """
    kept = f"{path.rstrip('/')}/_bos_{bos_id}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path):
        stage(read_bos_index(spark, path, bos_id), "bos", kept)
    return spark.read.schema(BOS_SCHEMA).parquet(kept)


def batch_rows_of(
    spark: SparkSession, path: str, plan: DataFrame, docs: DataFrame, seq_len: int, first_batch: int, last_batch: int
) -> DataFrame:
    """Training rows of the batches ``first_batch`` to ``last_batch`` of each shard, seeking to their bytes.

    ``plan`` and ``docs`` come from the skip list.  A shard's batches lie side by side, so one stretch per shard is read.
    """
    wanted = stage(plan.where(F.col("batch_id").between(first_batch, last_batch)), "wanted")
    at = docs.select("shard", "ord", F.col("row_index").alias("at"))
    spans = wanted.join(at, ["shard", "ord"]).groupBy(F.col("shard").alias("path")).agg(
        F.min("at").alias("first"), F.max(F.col("at") + F.col("end") - F.col("start")).alias("last")
    )
    return rows_in_chunks(wanted, docs, read_token_ranges(spark, path, spans, beyond=seq_len), seq_len)


def rows_in_chunks(plan: DataFrame, docs: DataFrame, chunks: DataFrame, seq_len: int) -> DataFrame:
    """Training rows of a packing plan over token shards, each sliced from the one chunk it begins in.

    A row's documents lie side by side in its file, so its first token places all of it.  ``chunks`` go on for ``seq_len``
    tokens beyond their end, so a chunk holds every row that begins in it and tokens move once, to the join.
    ``docs`` is ``token_offsets(shard_documents(...))``.
    """
    T = int(seq_len)
    starts = docs.select("shard", "ord", F.col("row_index").alias("low"))
    low = plan.join(starts, ["shard", "ord"]).groupBy("shard", "batch_id", "row_in_batch").agg(F.min("low").alias("low"))
    numbered = chunks.select(
        F.col("path").alias("shard"), F.expr(f"start div {CHUNK_TOKENS}").alias("_chunk"), "start", "ids"
    )
    # A range may begin inside a chunk, so two chunks can have one number; only one holds all of the row.
    found = low.withColumn("_chunk", F.expr(f"low div {CHUNK_TOKENS}")).join(numbered, ["shard", "_chunk"]).where(
        f"low >= start and low + {T + 1} <= start + size(ids)"
    )
    buf = F.slice("ids", (F.col("low") - F.col("start") + 1).cast("int"), T + 1)
    inputs, targets = shift(F.col("buf"), T)
    rows = found.select("shard", "batch_id", "row_in_batch", buf.alias("buf"))
    return rows.select("shard", "batch_id", "row_in_batch", inputs.alias("inputs"), targets.alias("targets"))


def packed_shard_rows(plan: DataFrame, docs: DataFrame, chunks: DataFrame, seq_len: int) -> DataFrame:
    """Training rows of a packing plan over token shards, sliced from the chunks they touch.

    ``docs`` is ``token_offsets(shard_documents(...))``.
    """
    T = int(seq_len)
    starts = docs.select("shard", "ord", F.col("row_index").alias("_at"))
    length = F.col("end") - F.col("start")
    segments = plan.join(starts, ["shard", "ord"]).select(
        "shard", "batch_id", "row_in_batch", F.col("_at").alias("low"), (F.col("_at") + length).alias("high")
    )
    touched = segments.withColumn(
        "_chunk", F.explode(F.expr(f"sequence(low div {CHUNK_TOKENS}, (high - 1) div {CHUNK_TOKENS})"))
    )
    numbered = chunks.select(
        F.col("path").alias("shard"), F.expr(f"start div {CHUNK_TOKENS}").alias("_chunk"), "start", "ids"
    )
    low = F.greatest("low", "start")
    high = F.least(F.col("high"), F.col("start") + F.size("ids"))
    pieces = touched.join(numbered, ["shard", "_chunk"]).select(
        "shard",
        "batch_id",
        "row_in_batch",
        low.alias("low"),
        F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("ids"),
    )
    rows = pieces.groupBy("shard", "batch_id", "row_in_batch").agg(
        ordered_concat(F.col("low"), F.col("ids")).alias("buf")
    )
    inputs, targets = shift(F.col("buf"), T)
    return rows.select("shard", "batch_id", "row_in_batch", inputs.alias("inputs"), targets.alias("targets"))
