"""Training batches from a folder that keeps receiving corpus files.

Each micro-batch is cut where its documents lie, as ``operators/runs.py`` does.  What is left over (less than one
batch of tokens) is one row of a state table; the next micro-batch puts it in front.  Rows and
state of a micro-batch are written under its number, so repeating it after a failure replaces
them and no token is lost or used twice.  Rows keep each token once; inputs and targets are made when they are read.
Tables that a micro-batch stages go when it has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.operators.codec import with_ends
from corpusloom.operators.runs import PIECES, cut_pieces, full_batches, in_runs, left_over, rows_of, run_starts
from corpusloom.sources.corpus import row_group
from corpusloom.staging import recorded, release

STATE_SCHEMA = "next_batch bigint, ids array<int>"


def read_corpus_stream(
    spark: SparkSession, path: str, *, files_per_trigger: int | None = None, name_filter: str = "*.parquet"
) -> DataFrame:
    """Streaming ``(shard, row_index, text)``; files arrive in the order they were written.

    ``path`` is a folder of corpus files, or one file: Spark streams folders only, so of a file's folder it alone is read.
    """
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(hadoop_path) and system.getFileStatus(hadoop_path).isFile():
        path, name_filter = hadoop_path.getParent().toString(), hadoop_path.getName()
    reader = spark.readStream.schema("text string").option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).select(
        F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"), "text"
    )


def rank_lane(corpus: DataFrame, rank: int, world: int, rows_per_group: int) -> DataFrame:
    """The row groups one rank of ``world`` reads."""
    return corpus.filter(F.pmod(row_group(rows_per_group), F.lit(world)) == rank)


def _cutter(sink: str, encode: Callable[[Column], Column], bos_id: int, batch_rows: int, seq_len: int) -> Callable[[DataFrame, int], None]:
    """What a stream does with each micro-batch: rows and state are written under its number."""

    def cut(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with recorded() as paths:
            texts = batch.filter(F.col("text").isNotNull())
            placed = in_runs(texts, lambda text: with_ends(encode(text), prepend=bos_id)).select("run", "run_pos", "n", "ids")
            next_batch = 0
            if epoch > 0:
                before = spark.read.schema(STATE_SCHEMA).parquet(f"{sink}/state/epoch={epoch - 1}")
                next_batch = before.first()["next_batch"]
                none = F.lit(0).cast("bigint")
                carried = before.select((none - 1).alias("run"), none.alias("run_pos"), F.size("ids").cast("bigint").alias("n"), "ids")
                placed = carried.unionByName(placed)
            starts = run_starts(placed)
            pieces = cut_pieces(placed, starts, batch_rows, seq_len, first_batch=next_batch)
            pieces.write.mode("overwrite").parquet(f"{sink}/rows/epoch={epoch}")
            done = F.lit(next_batch + full_batches(starts, batch_rows, seq_len)).cast("bigint").alias("next_batch")
            rest = left_over(placed, starts, batch_rows, seq_len)
            rest.select(done, "ids").write.mode("overwrite").parquet(f"{sink}/state/epoch={epoch}")
        release(spark, paths)

    return cut


def cut_stream(
    corpus: DataFrame,
    sink: str,
    encode: Callable[[Column], Column],
    bos_id: int,
    batch_rows: int,
    seq_len: int,
) -> StreamingQuery:
    """Start the job and let it use up what is there; rows land in ``<sink>/rows/epoch=N``.

    Inside a micro-batch the order is ``(shard, row_index)``; micro-batches follow each other in
    order of arrival.  Text is what a micro-batch shuffles, once, before it is encoded.
    """
    return (
        corpus.writeStream.foreachBatch(_cutter(sink, encode, bos_id, batch_rows, seq_len))
        .option("checkpointLocation", f"{sink}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def cut_lane(
    lane: DataFrame, sink: str, encode: Callable[[Column], Column], bos_id: int, batch_rows: int, seq_len: int
) -> StreamingQuery:
    """Cut a lane's row groups, as ``stream_groups`` gives them, into training rows until the query is stopped.

    A micro-batch is cut where its row groups are read.  Tokens behind its last full batch, the number of
    batches so far and the rows are written under the micro-batch's number, so a restart repeats or goes on and
    the rows are those of one uninterrupted cut.
    """
    cut = _cutter(sink, encode, bos_id, batch_rows, seq_len)
    return lane.writeStream.foreachBatch(cut).option("checkpointLocation", f"{sink}/checkpoint").start()


def cut_rows(spark: SparkSession, sink: str) -> DataFrame:
    """Training rows written so far."""
    return rows_of(spark.read.schema(PIECES).parquet(f"{sink}/rows/epoch=*"))
