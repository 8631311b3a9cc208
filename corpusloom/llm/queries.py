"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    attention, chaining, chat_log, feistel, hyperdim, latent, mixing, prefix_trie, repair, shards, simhash, syncmers,
    token_counts, turns,
)

# Key of the registered query; real users pass a secret of their own.
PSEUDONYM_KEY = "registered query"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _fold(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.pseudonymise(_documents(spark, sf_dir), PSEUDONYM_KEY)


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_following(_documents(spark, sf_dir))


def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperdim.identify(_documents(spark, sf_dir), _fold(4) == 2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return attention.score_texts(_documents(spark, sf_dir), _fold(5) == 1, path, public_tokenizers.PATTERN)


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(_documents(spark, sf_dir)).drop("pos")


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("copies")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = prefix_trie.numbered_turns(_conversations(spark, sf_dir))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(numbered))


def op12_event_sourced_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations and one with control strings, written as event logs, folded, rendered and read back."""
    chats = turns.plain(_conversations(spark, sf_dir)).unionByName(chat_log.sample_injection(spark))
    messages = chat_log.fold_events(chat_log.log_of(chats))
    return chat_log.read_back(chat_log.render(messages))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(_conversations(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_pseudonyms,
        op2_syncmer_fingerprints,
        op3_hyperdimensional_language,
        op4_token_counts,
        op5_attention_scores,
        op6_simhash_near_duplicates,
        op7_balanced_shards,
        op8_latent_decontamination,
        op9_pivotal_mixing,
        op10_repeated_passages,
        op11_prefix_trie,
        op12_event_sourced_chats,
        op13_structure_repair,
    )
}
ORACLE: dict[str, str] = {}
