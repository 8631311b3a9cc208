"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import bpe
from corpusloom.operators.running import with_position
from corpusloom.operators.sequences import token_offsets
from corpusloom.sources.vocab_store import load_tokenizer, save_tokenizer
from corpusloom.staging import fresh_path, spread, stage

# Vocabulary of the trained-tokenizer queries: bytes, specials and this many merges.
MERGES = 64
VOCAB_SIZE = 256 + 9 + MERGES
# Ids of the byte vocabulary.
BOS = 256

_tokenizers: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows: the source plays the shard, the document id the row number."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("shard"), F.col("doc_id").alias("row_index"), "text")


def numbered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows (without text) numbered 0, 1, 2, ... inside each shard."""
    ids = documents(spark, sf_dir).select("shard", F.col("row_index").alias("doc_id"))
    return with_position(ids, ["shard"], "doc_id", "row_index")


def byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of each document in the byte vocabulary, BOS included."""
    return documents(spark, sf_dir).select(
        "shard", "row_index", (F.octet_length("text") + 1).cast("bigint").alias("n")
    )


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of all documents; the text is read once, for its lengths."""
    return token_offsets(stage(byte_lengths(spark, sf_dir), "lengths"))


def tokenizer(spark: SparkSession, sf_dir: str, layout: str = "rank") -> tuple[DataFrame, DataFrame]:
    """Vocabulary and merges learned from ``documents``; trained once per session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key not in _tokenizers:
        vocab, merges = bpe.train(documents(spark, sf_dir), VOCAB_SIZE, layout)
        _tokenizers[key] = save_tokenizer(vocab, merges, fresh_path(spark, "tokenizer"), layout)
    return load_tokenizer(spark, _tokenizers[key])[:2]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir), "row_index")
