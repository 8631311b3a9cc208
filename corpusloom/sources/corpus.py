"""The text corpus: scan, split, rank stride, micro-batches, shard manifest, size profile.

A corpus row is ``(shard STRING, row_index BIGINT, text STRING)``; file name order, then row
order, is the order of the token stream, so both columns travel with every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import MAX_SHARD, SHARD_NAME_FORMAT
from corpusloom.staging import filesystem

SPLITS = ("train", "val")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Scan every ``*.parquet`` file under ``path``; only the ``text`` column is read."""
    return (
        spark.read.option("pathGlobFilter", "*.parquet")
        .parquet(path)
        .select(
            F.col("_metadata.file_name").alias("shard"),
            F.col("_metadata.row_index").alias("row_index"),
            "text",
        )
    )


def reject_null_text(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be encoded, and ``(shard, row_index, reason)`` of the rest."""
    rejects = corpus.filter(F.col("text").isNull()).select("shard", "row_index", F.lit("null_text").alias("reason"))
    return corpus.filter(F.col("text").isNotNull()), rejects


def with_split(corpus: DataFrame, shards: DataFrame | None = None) -> DataFrame:
    """Mark the last shard by name ``val`` and all others ``train``.

    ``shards`` (any table with the shard column) may replace the corpus as the source of names,
    so that a file listing answers without reading rows.
    """
    last = (corpus if shards is None else shards).select(F.max("shard")).scalar()
    return corpus.withColumn("split", F.when(F.col("shard") == last, "val").otherwise("train"))


def scan_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split of the files under ``path``; the file listing tells first and last shard."""
    return read_split(read_corpus(spark, path), split, list_shards(spark, path))


def read_split(corpus: DataFrame, split: str, shards: DataFrame | None = None) -> DataFrame:
    """Rows of one split.  A one-shard corpus has no training rows, which is an error here.

    The last shard's name is looked up first, in ``shards`` if given (any table with the shard column), and compared
    as a literal, so a scan with ``_metadata`` columns opens only the files of the split.
    """
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}, not {split!r}")
    ends = (corpus if shards is None else shards).agg(F.min("shard").alias("first"), F.max("shard").alias("last")).first()
    if split == "train" and ends["first"] == ends["last"]:
        raise ValueError("the corpus has a single shard: no training split")
    is_last = F.col("shard") == F.lit(ends["last"])
    return corpus.filter(is_last if split == "val" else ~is_last)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Row groups of every Parquet file under ``path``: ``(file, row_group, first_row, n_rows, n_bytes)``.

    ``n_bytes`` is the size of all columns before compression.
    The driver lists the files; tasks read the footers and nothing else.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "_metadata.file_path")
    )

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for location, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, root = filesystem(location)
                with system.open_input_file(root) as opened:
                    footer = pq.read_metadata(opened)
                groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
                rows = np.array([g.num_rows for g in groups], np.int64)
                yield pa.record_batch(
                    [
                        pa.array([file] * len(rows)), np.arange(len(rows)), np.cumsum(rows) - rows, rows,
                        np.array([g.total_byte_size for g in groups], np.int64),
                    ],
                    ["file", "row_group", "first_row", "n_rows", "n_bytes"],
                )

    return files.mapInArrow(footers, "file string, row_group bigint, first_row bigint, n_rows bigint, n_bytes bigint")


def with_row_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add the real ``row_group`` of rows ``(file, row_index)``.

    A file is one row of the joined side, with the first rows of its groups in order.
    """
    starts = groups.where("n_rows > 0").groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("first_row", "row_group"))).alias("_starts")
    )
    passed = F.filter("_starts", lambda g: g["first_row"] <= F.col("row_index"))
    return rows.join(starts, "file").withColumn("row_group", F.element_at(passed, -1)["row_group"]).drop("_starts")


def row_group(rows_per_group: int) -> Column:
    """Ordinal of the row group in its file, for groups of a fixed number of rows."""
    return F.expr(f"row_index div {int(rows_per_group)}")


def with_rank(corpus: DataFrame, world: int, rows_per_group: int) -> DataFrame:
    """Row groups dealt to ranks; the ordinal restarts in each file."""
    return corpus.withColumn("row_group", row_group(rows_per_group)).withColumn(
        "rank", F.expr(f"pmod(row_group, {int(world)})")
    )


def read_rank(corpus: DataFrame, rank: int, world: int, rows_per_group: int) -> DataFrame:
    return with_rank(corpus, world, rows_per_group).filter(F.col("rank") == rank).drop("rank", "row_group")


def with_doc_batch(corpus: DataFrame, rows_per_group: int, batch_rows: int = 128) -> DataFrame:
    """Number the slices of ``batch_rows`` documents inside each row group."""
    return corpus.withColumn("row_group", row_group(rows_per_group)).withColumn(
        "doc_batch", F.expr(f"(row_index % {int(rows_per_group)}) div {int(batch_rows)}")
    )


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """Names of the corpus files present; file listing only, no content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("shard"))
    )


def shard_manifest(
    present: DataFrame, wanted: int = MAX_SHARD + 1, name_format: str = SHARD_NAME_FORMAT
) -> DataFrame:
    """Which of the ``wanted`` shard names are present: ``(shard_no, shard, present)``."""
    spark = present.sparkSession
    names = spark.range(wanted).select(
        F.col("id").alias("shard_no"), F.format_string(name_format, "id").alias("shard")
    )
    found = present.select("shard").distinct().withColumn("found", F.lit(True))
    return names.join(found, "shard", "left").select(
        "shard_no", "shard", F.coalesce("found", F.lit(False)).alias("present")
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count_if("present").alias("successful"), F.count(F.lit(1)).alias("total")
    )


def size_profile(corpus: DataFrame, *by: str) -> DataFrame:
    """Characters, lines, files and approximate tokens (four characters each)."""
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    totals = corpus.groupBy(*by).agg(
        F.sum(F.length("text")).cast("bigint").alias("characters"),
        F.sum(lines).cast("bigint").alias("lines"),
        F.count(F.lit(1)).alias("files"),
    )
    return totals.withColumn("approx_tokens", F.expr("characters div 4"))
