"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.codec import encode_corpus
from corpusloom.operators.packing import packed
from corpusloom.plans import conversations, corpus, evaluation, reports, runlog, sequences, tokens

from corpusloom.plans.tables import spread_documents, tokenizer
from corpusloom.staging import stage

FLAGSHIP_LENGTH = 512

_FAMILIES = [corpus, tokens, sequences, conversations, evaluation, runlog, reports]

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE = {name: sql for family in _FAMILIES for name, sql in family.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train a vocabulary on the corpus, encode it with BOS, and pack it into training rows."""
    vocab, _merges = tokenizer(spark, sf_dir)
    encoded = encode_corpus(spread_documents(spark, sf_dir), vocab, prepend="<|bos|>")
    docs = stage(
        encoded.select("shard", "row_index", "ids", F.size("ids").cast("bigint").alias("n")), "encoded"
    )
    return packed(docs, sequences.B, FLAGSHIP_LENGTH)
