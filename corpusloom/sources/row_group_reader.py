"""A Parquet reader whose unit is the row group, in the order of the stream.

An input partition holds consecutive row groups: one, or as many small ones as make up a task's share, so that the
number of tasks follows the bytes and not the number of groups.  ``read_rank_groups`` opens only the row groups that are dealt to a rank.  Spark's own reader splits
files by bytes and cannot be told which groups to leave out.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.sources.corpus import row_groups
from corpusloom.staging import filesystem, fresh_path, qualified

FORMAT = "corpus_row_groups"
# Rows of an Arrow batch.
BATCH_ROWS = 2048
# Bytes of row groups that a task reads at most, as long as they are several.
TASK_BYTES = 32 << 20


@dataclass
class Group:
    """One row group; ``run`` is its place among all groups that are read."""

    run: int
    file: str
    row_group: int
    first_row: int
    n_bytes: int


@dataclass
class Groups(InputPartition):
    """Consecutive row groups, the share of a task."""

    held: list[Group]


def _shares(groups: list[Group], tasks: int) -> list[Groups]:
    """Consecutive groups put together: not over ``TASK_BYTES`` a task, and still ``tasks`` of them if there are as many groups."""
    most = min(TASK_BYTES, sum(g.n_bytes for g in groups) // max(tasks, 1))
    out, held = [], 0
    for group in groups:
        if not out or held + group.n_bytes > most:
            out.append(Groups([]))
            held = 0
        out[-1].held.append(group)
        held += group.n_bytes
    return out


class RowGroupSource(DataSource):
    """Rows of listed row groups.

    Options: ``groups``, a Parquet table ``(run, file, row_group, first_row, n_bytes)``, ``columns``, the Parquet columns as
    a schema, and ``tasks``, over how many tasks small groups are spread at least.  Rows are ``run, file, row_group, row_index`` and these columns.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"run bigint, file string, row_group bigint, row_index bigint, {self.options['columns']}"

    def reader(self, schema: StructType) -> RowGroupReader:
        return RowGroupReader(self.options["groups"], schema.names[4:], int(self.options["tasks"]))

    def streamReader(self, schema: StructType) -> RowGroupStream:
        epochs, catch_up = int(self.options.get("epochs", 0)), int(self.options.get("catch_up", 0))
        reader = self.reader(schema)
        return RowGroupStream(reader, int(self.options["per_trigger"]), epochs, self.options["progress"], catch_up)


class RowGroupReader(DataSourceReader):
    def __init__(self, groups: str, columns: list[str], tasks: int):
        self.groups, self.columns, self.tasks = groups, columns, tasks

    def listed(self) -> list[Group]:
        system, root = filesystem(self.groups)
        table = ds.dataset(root, filesystem=system, format="parquet").to_table()
        fields = ["run", "file", "row_group", "first_row", "n_bytes"]
        return [Group(*row) for row in sorted(zip(*(table[f].to_pylist() for f in fields)))]

    def partitions(self) -> list[Groups]:
        return _shares(self.listed(), self.tasks)

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        for file, held in groupby(partition.held, key=lambda g: g.file):
            system, root = filesystem(file)
            with system.open_input_file(root) as opened:
                parquet = pq.ParquetFile(opened)
                # A stream may come to a file again in its next epoch, and to a group that it has read in this one.
                for stretch in _rising(held):
                    yield from self._rows(parquet, file, stretch)

    def _rows(self, parquet: pq.ParquetFile, file: str, held: list[Group]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([parquet.metadata.row_group(g.row_group).num_rows for g in held], np.int64)
        group = np.repeat(np.arange(len(held)), sizes)
        row = np.array([g.first_row for g in held], np.int64)[group] + np.arange(len(group)) - (np.cumsum(sizes) - sizes)[group]
        run, number = (np.array([getattr(g, f) for g in held], np.int64) for f in ("run", "row_group"))
        at = 0
        for batch in parquet.iter_batches(BATCH_ROWS, row_groups=[g.row_group for g in held], columns=self.columns):
            n = batch.num_rows
            which = group[at : at + n]
            same = [pa.array(run[which]), pa.array([file] * n, pa.string()), pa.array(number[which]), pa.array(row[at : at + n])]
            names = ["run", "file", "row_group", "row_index", *self.columns]
            yield pa.RecordBatch.from_arrays([*same, *(batch.column(c) for c in self.columns)], names)
            at += n


def _rising(groups: Iterator[Group]) -> Iterator[list[Group]]:
    """Stretches of a file's groups that follow each other in the file."""
    held: list[Group] = []
    for group in groups:
        if held and group.row_group <= held[-1].row_group:
            yield held
            held = []
        held.append(group)
    if held:
        yield held


class RowGroupStream(DataSourceStreamReader):
    """The listed row groups read over and over, or ``epochs`` times.

    An offset counts row groups since the start, so it names epoch, file and row group at once, and one epoch follows
    the other without a seam.  A micro-batch takes up to ``per_trigger`` groups.  With ``catch_up`` it grows while there is
    more to read: it takes as many groups as have been read so far, up to that many bytes.  So the number of micro-batches
    follows the bytes, however small the groups are.  The ``progress`` file tells a restarted stream how far it had come.
    """

    def __init__(self, reader: RowGroupReader, per_trigger: int, epochs: int, progress: str, catch_up: int):
        self.batch = reader
        self.groups = reader.listed()
        # Bytes before each group of an epoch, and those of the epoch.
        self.bytes = list(accumulate((g.n_bytes for g in self.groups), initial=0))
        self.per_trigger, self.epochs, self.progress, self.catch_up = per_trigger, epochs, progress, catch_up
        system, path = filesystem(progress)
        if system.get_file_info(path).is_file:
            with system.open_input_stream(path) as file:
                self.at = json.loads(file.read())["at"]
        else:
            self.at = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _before(self, at: int) -> int:
        """Bytes of the first ``at`` groups."""
        epoch, i = divmod(at, len(self.groups))
        return epoch * self.bytes[-1] + self.bytes[i]

    def latestOffset(self) -> dict:
        if not self.groups:
            return {"at": 0}
        ahead = self.at + self.per_trigger
        if self.catch_up:
            room = self._before(self.at) + self.catch_up
            wider = range(ahead, max(ahead, 2 * self.at) + 1)
            ahead = wider[max(bisect_right(wider, room, key=self._before) - 1, 0)]
        return {"at": min(ahead, self.epochs * len(self.groups)) if self.epochs else ahead}

    def partitions(self, start: dict, end: dict) -> list[Groups]:
        self.at = max(self.at, end["at"])
        at = range(start["at"], end["at"])
        return _shares([replace(self.groups[g % len(self.groups)], run=g) for g in at], self.batch.tasks)

    def commit(self, end: dict) -> None:
        system, path = filesystem(self.progress)
        system.create_dir(path.rsplit("/", 1)[0])
        with system.open_output_stream(path) as file:
            file.write(json.dumps(end).encode())

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)


def _listed(groups: DataFrame) -> str:
    """Path of the list of groups, numbered in the order of file and row group."""
    # One row per row group of the corpus: the list a planner holds anyway.
    listed = groups.select("file", "row_group", "first_row", "n_bytes").coalesce(1).sortWithinPartitions("file", "row_group")
    path = fresh_path(groups.sparkSession, "groups")
    listed.withColumn("run", F.monotonically_increasing_id()).write.parquet(path)
    groups.sparkSession.dataSource.register(RowGroupSource)
    return qualified(groups.sparkSession, path)


def _tasks(groups: DataFrame) -> int:
    """Two tasks for every core, if there are as many groups."""
    return 2 * groups.sparkSession.sparkContext.defaultParallelism


def stream_groups(
    groups: DataFrame, progress: str, per_trigger: int, *, epochs: int | None = None, columns: str = "text string", catch_up: int = 0
) -> DataFrame:
    """A stream of the listed row groups, ``per_trigger`` a micro-batch, without end or ``epochs`` times over.

    ``progress`` is a file that belongs to the stream's checkpoint.  With ``catch_up`` micro-batches grow, up to that many bytes.
    """
    path = _listed(groups)
    reader = groups.sparkSession.readStream.format(FORMAT).option("groups", path).option("columns", columns)
    reader = reader.option("per_trigger", per_trigger).option("progress", qualified(groups.sparkSession, progress))
    return reader.option("epochs", epochs or 0).option("catch_up", catch_up).option("tasks", _tasks(groups)).load()


def read_groups(groups: DataFrame, columns: str = "text string") -> DataFrame:
    """Rows of the listed row groups ``(file, row_group, first_row, n_bytes)``.

    Partitions, and ``run``, follow the order of file and row group; a partition holds one group or
    several small ones.  The list is one small row per group; it is written to the shared folder and read where
    the partitions are planned.
    """
    path = _listed(groups)
    reader = groups.sparkSession.read.format(FORMAT).option("groups", path).option("columns", columns)
    return reader.option("tasks", _tasks(groups)).load()


def rank_groups(spark: SparkSession, path: str, rank: int, world: int) -> DataFrame:
    """``(file, row_group, first_row, n_rows, n_bytes)`` of every file under ``path`` that rank ``rank`` of ``world`` reads:
    the groups whose ordinal in their file leaves the remainder ``rank``."""
    if not 0 <= rank < world:
        raise ValueError(f"rank must be at least 0 and below {world}, not {rank}")
    return row_groups(spark, path).where((F.col("row_group") % world == rank) & (F.col("n_rows") > 0))


def read_rank_groups(spark: SparkSession, path: str, rank: int, world: int, columns: str = "text string") -> DataFrame:
    """``(run, file, row_group, row_index, ...)`` of the row groups that belong to a rank.

    Footers of all files are read, and of their contents only these groups.  A rank beyond the
    number of groups reads nothing.
    """
    return read_groups(rank_groups(spark, path, rank, world), columns)
