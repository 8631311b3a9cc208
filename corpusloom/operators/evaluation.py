"""Losses over per-token rows ``(nats, target)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scores import token_nll


def with_nats(rows: DataFrame, logits: str = "logits", target: str = "target", ignore: int | None = None) -> DataFrame:
    """Add ``nats``; it is NULL for a target outside the vocabulary.

    With ``ignore``, only that target is left out: other negative ones count from the end of the
    vocabulary, as positions do.
    """
    at = F.col(target)
    if ignore is not None:
        at = F.when(at != ignore, F.when(at < 0, at + F.size(logits)).otherwise(at))
    return rows.withColumn("nats", token_nll(F.col(logits), at))


def bits_per_byte(rows: DataFrame, token_bytes: DataFrame, *by: str) -> DataFrame:
    """``(total_nats, total_bytes, bpb)`` over rows ``(nats, target)``.

    ``token_bytes`` is ``(token_id, n_bytes)``, one row per id.  Negative and unknown targets,
    rows without nats and tokens of 0 bytes count for nothing; without a countable byte the result
    is NULL.  Rows are added up by target before the join, so a frequent target is one row there.
    """
    scored = F.col("nats").isNotNull()
    per_target = rows.groupBy(*by, "target").agg(F.sum("nats").alias("_nats"), F.count_if(scored).alias("_rows"))
    sized = per_target.join(token_bytes, per_target["target"] == token_bytes["token_id"], "left")
    counted = (F.col("target") >= 0) & (F.col("n_bytes") > 0)
    totals = sized.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(counted, F.col("_nats"))), F.lit(0.0)).alias("total_nats"),
        F.coalesce(F.sum(F.when(counted, F.col("_rows") * F.col("n_bytes"))), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
    bytes_or_null = F.when(F.col("total_bytes") > 0, F.col("total_bytes"))
    return totals.withColumn("bpb", F.col("total_nats") / (math.log(2) * bytes_or_null))


def masked_mean_loss(rows: DataFrame, *by: str, ignore: int = -1) -> DataFrame:
    """Mean of ``nats`` over rows whose target is not ``ignore``; 0 when all are ignored.

    Unlike in ``bits_per_byte`` only the one sentinel is masked, so ``nats`` should come from
    ``with_nats(..., ignore=ignore)``.  A target that is no token is counted and has no nats: the
    loss is then NULL.
    """
    used = F.col("target") != ignore
    totals = rows.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(used, F.col("nats"))), F.lit(0.0)).alias("_nats"),
        F.count_if(used).alias("n_tokens"),
        F.count_if(used & F.col("nats").isNull()).alias("_unknown"),
    )
    loss = F.when(F.col("_unknown") == 0, F.col("_nats") / F.greatest("n_tokens", F.lit(1)))
    return totals.select(*by, "n_tokens", loss.alias("loss"))


def first_batches(rows: DataFrame, eval_tokens: int, batch_rows: int, seq_len: int) -> DataFrame:
    """Rows of the first ``eval_tokens // (batch_rows * seq_len)`` batches."""
    return rows.filter(F.col("batch_id") < eval_tokens // (batch_rows * seq_len))


def batch_of(position: Column, batch_rows: int, seq_len: int) -> Column:
    return F.call_function("div", position, F.lit(batch_rows * seq_len))
