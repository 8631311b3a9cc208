"""Corpus pipeline: language, near-duplicates, benchmark leaks, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents.  All stages but the last return the columns of
``documents``, whatever their names and types.  Language ID, the MinHash candidates, the latent search and the
pivotal draws are outside SQL, so there is no ORACLE_SQL; tests hold the stages against brute force.

A stage begins by deleting what the stage before it staged, unless its ``docs`` still reads it: a
result that has been written needs its scratch no more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import hyperdim, latent, mixing, rows, shards, simhash
from corpusloom.staging import recorded, release, stage

_scratch: dict[str, list[str]] = {}


def tidy(function: Callable) -> Callable:
    """A stage that releases the scratch of the one before it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        left = release(spark, _scratch.get(app, []), docs)
        with recorded() as paths:
            out = function(spark, docs, sf_dir)
        _scratch[app] = left + paths
        return out

    return run_stage


# A text whose cosine with the nearest language prototype is below this is no text of these languages.
LEAST_LANGUAGE = 0.05


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: null texts, texts without letters and texts unlike every language go.

    Prototypes are learned from all documents with a label; without any label nothing can be told
    apart and every document with a letter stays.  Repeated rows are judged alike.
    """
    labelled = docs.where("lang is not null and text is not null")
    names, matrix = hyperdim.prototypes(hyperdim.gram_counts(labelled, "lang", "text"))
    if not names:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = hyperdim.predict(rows.nested(docs, text=F.col("text")).select("row", "text"), names, matrix)
    return judged.where((F.col("lang_pred") != hyperdim.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Documents are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8, which is checked
    on the whole sets; MinHash keys that find the candidates miss one pair in 10,000 at 0.8 and fewer above.
    Of repeated rows with the smallest id one stays; null and empty texts are one group.
    """
    return simhash.one_of_each(docs)


@tidy
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage go.

    Whether a row leaks depends on its text alone, so rows are told apart by a digest of it: ids may
    be null or repeated.
    """
    keyed = rows.nested(docs, digest=F.sha2(F.coalesce(F.col("text"), F.lit("")), 256), text=F.col("text"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = latent.contaminated(keyed.select("digest", "text"), benchmark, id_col="digest")
    hit = stage(leaks.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    return keyed.select("row", "digest").join(hit, F.col("digest") == F.col("leak"), "left_anti").select("row.*")


@tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows with no copy go, others are repeated.

    Sizes and draws carry two hashes of the row instead of the row; whole rows join once, at the end.  Rows with a
    null or empty text have no size and go; repeated rows are drawn apart and their copies added up; a null source
    is a source.
    """
    keyed = rows.nested(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    keys = ["key_a", "key_b"]
    mixed = mixing.mix(keyed.select("doc_id", "source", "text", *keys), keep=keys)
    taken = stage(mixed.groupBy(*keys).agg(F.sum("copies").alias("copies")).where("copies > 0"), "copies")
    one = keyed.select("row", *keys).join(taken, keys).dropDuplicates(keys)
    return one.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")


@tidy
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix; null texts count 16 bytes, repeated rows stay together as far as a shard has room."""
    return shards.assign_shards(docs).drop("pos")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
