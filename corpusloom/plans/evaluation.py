"""Loss and score queries: embeddings play the logits, their label the target."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.operators import evaluation
from corpusloom.plans.tables import table

B, T = 2, 16
EVAL_TOKENS = 8 * B * T
TOP_K, TEMPERATURE, SEED = 10, 0.8, 42


def _scored(spark, sf_dir):
    """``(row_id, logits, target)``; some targets are ignored (-1), some otherwise negative (-2)."""
    target = (
        F.when(F.col("vec_id") % 7 == 0, -1).when(F.col("vec_id") % 11 == 0, -2).otherwise(F.col("label"))
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").alias("logits"),
        target.alias("target"),
        evaluation.batch_of(F.col("vec_id"), B, T).alias("batch_id"),
    )


def _token_bytes(spark, sf_dir):
    """Bytes per token id, taken from the labels present; every fourth one is special (0 bytes)."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("token_id")).distinct()
    return labels.withColumn("n_bytes", F.col("token_id") % 4)


def _long(rows, column, kind="double"):
    """Scores one per row: ``(row_id, index, score)``."""
    each = rows.select("row_id", F.posexplode(column).alias("index", "score"))
    return each.withColumn("score", F.round("score", 6))


def token_nll(spark, sf_dir):
    rows = evaluation.with_nats(_scored(spark, sf_dir))
    return rows.select("row_id", "target", F.round("nats", 6).alias("nats"))


def bits_per_byte(spark, sf_dir):
    rows = evaluation.with_nats(_scored(spark, sf_dir))
    return _rounded(evaluation.bits_per_byte(rows, _token_bytes(spark, sf_dir)), "total_nats", "bpb")


def bits_per_byte_by_batch(spark, sf_dir):
    rows = evaluation.with_nats(_scored(spark, sf_dir))
    return _rounded(evaluation.bits_per_byte(rows, _token_bytes(spark, sf_dir), "batch_id"), "total_nats", "bpb")


def bpb_first_n(spark, sf_dir):
    rows = evaluation.first_batches(evaluation.with_nats(_scored(spark, sf_dir)), EVAL_TOKENS, B, T)
    return _rounded(evaluation.bits_per_byte(rows, _token_bytes(spark, sf_dir)), "total_nats", "bpb")


def masked_loss(spark, sf_dir):
    # A target other than the sentinel must be a token id: -2 reads as the last but one.
    rows = evaluation.with_nats(_scored(spark, sf_dir), ignore=-1)
    return _rounded(evaluation.masked_mean_loss(rows, "batch_id"), "loss")


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def logit_softcap(spark, sf_dir):
    return _long(_scored(spark, sf_dir), scores.softcap(F.col("logits")))


def topk_mask(spark, sf_dir):
    # Two decimals make ties at the threshold common.
    coarse = F.transform(scores.doubles(F.col("logits")), lambda x: F.floor(x * 100) / 100)
    masked = _scored(spark, sf_dir).select("row_id", scores.top_k_mask(coarse, TOP_K).alias("masked"))
    each = masked.select("row_id", F.posexplode("masked").alias("index", "score"))
    kept = F.col("score") > F.lit(scores.NEG_INF)
    return each.select("row_id", "index", kept.alias("kept"), F.when(kept, F.round("score", 6)).alias("score"))


def temperature_softmax(spark, sf_dir):
    return _long(_scored(spark, sf_dir), scores.softmax(scores.tempered(F.col("logits"), TEMPERATURE)))


def greedy_token(spark, sf_dir):
    return _scored(spark, sf_dir).select("row_id", scores.greedy(F.col("logits")).alias("token"))


def sample_token(spark, sf_dir):
    drawn = scores.sample(F.col("logits"), F.col("row_id"), TEMPERATURE, SEED, TOP_K)
    return _scored(spark, sf_dir).select("row_id", drawn.alias("token"))


def rms_normalize(spark, sf_dir):
    return _long(_scored(spark, sf_dir), scores.rms_normalize(F.col("logits")))


QUERIES = {
    f.__name__: f
    for f in (
        token_nll,
        bits_per_byte,
        bits_per_byte_by_batch,
        bpb_first_n,
        masked_loss,
        logit_softcap,
        topk_mask,
        temperature_softmax,
        greedy_token,
        sample_token,
        rms_normalize,
    )
}

_SCORED = f"""
scored as (
  select vec_id as row_id, list_transform(embedding, lambda x: x::double) as logits, label,
    (case when vec_id % 7 = 0 then -1 when vec_id % 11 = 0 then -2 else label end)::int as target,
    vec_id // {B * T} as batch_id
  from embeddings),
nats as (
  select *, case when target >= 0 then
    ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) + list_max(logits) - logits[target + 1]
    end as nats
  from scored),
sized as (
  select *, case when target >= 0 then target % 4 else 0 end as n_bytes from nats)"""


def _bpb(where: str, by: str = "") -> str:
    group = f"group by {by}" if by else ""
    return f"""
with {_SCORED}
select {by + ", " if by else ""}round(coalesce(sum(nats) filter (n_bytes > 0), 0), 6) as total_nats,
  sum(n_bytes)::bigint as total_bytes,
  round(sum(nats) filter (n_bytes > 0) / (ln(2) * nullif(sum(n_bytes), 0)), 6) as bpb
from sized where {where} {group}"""


def _each(value: str) -> str:
    return f"""
with {_SCORED}
select row_id, (unnest(range(len(logits))))::int as index, round(unnest({value}), 6) as score from scored"""


ORACLE = {
    "token_nll": f"with {_SCORED} select row_id, target, round(nats, 6) as nats from nats",
    "bits_per_byte": _bpb("true"),
    "bits_per_byte_by_batch": _bpb("true", "batch_id"),
    "bpb_first_n": _bpb(f"batch_id < {EVAL_TOKENS} // {B * T}"),
    "masked_loss": f"""
with {_SCORED},
used as (
  select batch_id, target, ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) + list_max(logits)
    - logits[case when target = -2 then len(logits) - 1 else target + 1 end] as nats
  from scored)
select batch_id, count(*) filter (target <> -1) as n_tokens,
  round(coalesce(sum(nats) filter (target <> -1), 0) / greatest(count(*) filter (target <> -1), 1), 6) as loss
from used group by batch_id""",
    "logit_softcap": _each("list_transform(logits, lambda x: 15 * tanh(x / 15))"),
    "topk_mask": f"""
with {_SCORED},
coarse as (select row_id, list_transform(logits, lambda x: floor(x * 100) / 100) as c from scored),
cut as (select *, list_reverse_sort(c)[{TOP_K}] as kth from coarse),
each as (select row_id, kth, (unnest(range(len(c))))::int as index, unnest(c) as x from cut)
select row_id, index, x >= kth as kept, case when x >= kth then round(x, 6) end as score from each""",
    "temperature_softmax": f"""
with {_SCORED},
hot as (select row_id, list_transform(logits, lambda x: x / {TEMPERATURE}) as l from scored),
norm as (select row_id, l, ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) + list_max(l) as z from hot)
select row_id, (unnest(range(len(l))))::int as index, round(unnest(list_transform(l, lambda x: exp(x - z))), 6) as score
from norm""",
    "greedy_token": f"""
with {_SCORED} select row_id, (list_position(logits, list_max(logits)) - 1)::int as token from scored""",
    "sample_token": f"""
with {_SCORED},
hot as (select row_id, list_transform(logits, lambda x: case when x < list_reverse_sort(logits)[{TOP_K}] then null else x / {TEMPERATURE} end) as l
  from scored),
parts as (select row_id, list_transform(l, lambda x: coalesce(exp(x - list_max(l)), 0)) as e from hot),
shares as (select row_id, list_transform(e, lambda x: x / list_sum(e)) as p,
  (('0x' || substr(md5(row_id || ':{SEED}'), 1, 13))::bigint + 0.5) / {float(1 << 52)} as u from parts)
select row_id, len(list_filter(range(1, len(p) + 1), lambda i: list_sum(p[1:i]) <= u))::int as token from shares""",
    "rms_normalize": _each(
        "list_transform(logits, lambda x: x / sqrt(list_sum(list_transform(logits, lambda y: y * y)) / len(logits) + 1e-6))"
    ),
}
