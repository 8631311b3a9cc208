"""Closed-form model sizes and token budgets over tables of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _big(name: str) -> Column:
    return F.col(name).cast("bigint")


def scaling_counts(configs: DataFrame) -> DataFrame:
    """Add parameter counts per group and FLOPs per token.

    Needs ``sequence_len, vocab_size, n_layer, n_head, n_kv_head, n_embd``.  ``valid`` says
    whether heads divide the width and key/value heads divide heads.
    """
    width, heads, kv, layers = _big("n_embd"), _big("n_head"), _big("n_kv_head"), _big("n_layer")
    head_dim = F.expr("cast(n_embd as bigint) div n_head")
    block = 2 * width * heads * head_dim + 2 * width * kv * head_dim + 8 * width * width
    counted = configs.select(
        "*",
        (_big("vocab_size") * width).alias("wte"),
        (_big("vocab_size") * width).alias("lm_head"),
        (layers * block).alias("transformer_matrices"),
        ((width % heads == 0) & (kv <= heads) & (heads % kv == 0)).alias("valid"),
    )
    total = F.col("wte") + F.col("lm_head") + F.col("transformer_matrices")
    attention = 12 * layers * heads * head_dim * _big("sequence_len")
    return counted.withColumn("total", total).withColumn(
        "flops_per_token", 6 * (F.col("total") - F.col("wte")) + attention
    )


def shape_from_depth(depths: DataFrame, vocab_size: int, sequence_len: int) -> DataFrame:
    """Model configuration of each ``depth``: width 64 per layer, heads of about 128."""
    width = F.col("depth") * 64
    heads = F.greatest(F.lit(1), F.expr("(depth * 64 + 127) div 128"))
    return depths.select(
        "*",
        F.lit(sequence_len).alias("sequence_len"),
        F.lit(vocab_size).alias("vocab_size"),
        F.col("depth").alias("n_layer"),
        heads.alias("n_head"),
        heads.alias("n_kv_head"),
        width.alias("n_embd"),
    )


def token_budget(
    sized: DataFrame, total_batch: int, device_batch: int, sequence_len: int
) -> DataFrame:
    """Steps, tokens and passes over the corpus for ``ratio`` tokens per parameter.

    ``sized`` has ``total`` parameters, ``ratio`` and ``corpus_tokens``.
    """
    micro = device_batch * sequence_len
    if total_batch % micro:
        raise ValueError(f"total batch {total_batch} is not a multiple of {micro} tokens")
    iterations = F.floor(F.col("ratio") * F.col("total") / total_batch).cast("bigint")
    planned = sized.withColumn("n_iterations", iterations).withColumn("accumulation_steps", F.lit(total_batch // micro))
    planned = planned.withColumn("total_tokens", F.col("n_iterations") * total_batch)
    return planned.select(
        "*",
        (F.col("total_tokens") / F.col("total")).alias("tokens_per_param"),
        F.when(F.col("corpus_tokens") > 0, F.col("total_tokens") / F.col("corpus_tokens")).alias("epochs_needed"),
    )
