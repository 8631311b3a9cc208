"""Training-log metrics: smoothing, throughput, cadence, schedules, and parsing of log lines.

Log rows are ``(run, step, ...)`` with one row per step of a run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import LOG_AMOUNT_PATTERN, LOG_SHARD_PATTERN
from corpusloom.operators.running import decayed_sum, with_running

WARM_UP_STEPS = 10
_RUN = ["run"]


def debiased_ema(log: DataFrame, value: str = "loss", beta: float = 0.9) -> DataFrame:
    """Add ``debiased``: the exponential mean from 0, divided by ``1 - beta ** (step + 1)``.

    ``step`` counts 0, 1, 2, ... within a run.
    """
    summed = decayed_sum(log, _RUN, "step", value, beta, "_decayed")
    norm = F.lit(1.0) - F.pow(F.lit(float(beta)), F.col("step") + 1)
    return summed.select(*log.columns, ((1 - beta) * F.col("_decayed") / norm).alias("debiased"))


def running_best(log: DataFrame, value: str = "val_bpb") -> DataFrame:
    """Add ``best``: the least value so far.  NaN never wins; before any value it is NULL."""
    usable = F.when(~F.isnan(value), F.col(value))
    return with_running(log, _RUN, "step", mins={"best": usable})


def throughput(log: DataFrame, tokens_per_step: int, flops_per_token: Column | int) -> DataFrame:
    """Add progress in percent, whole tokens per second and FLOPs per second (0 without time)."""
    dt = F.col("dt")
    flops = flops_per_token if isinstance(flops_per_token, Column) else F.lit(flops_per_token)
    return log.select(
        "*",
        (F.lit(100.0) * F.col("step") / F.col("n_steps")).alias("pct_done"),
        F.when(dt > 0, (tokens_per_step / dt).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("tok_per_sec"),
        F.when(dt > 0, flops.cast("double") * tokens_per_step / dt).otherwise(0.0).alias("flops_per_sec"),
    )


def training_time(log: DataFrame) -> DataFrame:
    """Add ``total_time``: the sum of ``dt`` so far, without the first steps."""
    return with_running(
        log, _RUN, "step", sums={"total_time": F.when(F.col("step") > WARM_UP_STEPS, F.col("dt")).otherwise(0.0)}
    )


def cadence(log: DataFrame, eval_every: int, sample_every: int) -> DataFrame:
    """Add ``evaluates`` and ``samples``: what happens at each step of a run of ``n_steps``."""
    step, last = F.col("step"), F.col("step") == F.col("n_steps")
    return log.select(
        "*",
        (last | (step % eval_every == 0)).alias("evaluates"),
        (last | ((step > 0) & (step % sample_every == 0))).alias("samples"),
    )


def learning_rate(step: Column, n_steps: Column, peak: float, warm_up: float = 0.01, floor: float = 0.01) -> Column:
    """Linear from 0 to ``peak``, then cosine down to ``floor * peak`` at ``n_steps``."""
    warm = F.greatest(F.lit(1.0), F.bround(warm_up * n_steps.cast("double")))
    left = n_steps - warm
    gone = F.when(left > 0, F.least(step - warm, left) / left).otherwise(1.0)
    cosine = 0.5 * (1 + F.cos(F.lit(math.pi) * gone))
    return F.when(step < warm, peak * step / warm).otherwise(peak * ((1 - floor) * cosine + floor))


def lr_audit(log: DataFrame, peak: float) -> DataFrame:
    """Add the scheduled rate and whether the logged ``lr`` agrees at its printed precision."""
    expected = learning_rate(F.col("step"), F.col("n_steps"), peak)
    return log.withColumn("lr_expected", expected).withColumn(
        "lr_agrees", F.abs(F.col("lr") - F.col("lr_expected")) <= 0.005 * F.abs("lr_expected") + 1e-12
    )


_STEP_LINE = (
    r"^step (\d+)/(\d+) \((-?[\d.]+|nan)%\) \| loss: (\S+) \| lr: (\S+) \| dt: (\d+)ms \| tok/s: ([\d,]+) \| time: ([\d.]+)m$"
)
_BPB_LINE = r"^Step (\d+) \| Validation bpb: (\S+)$"


def parse_step_lines(lines: DataFrame) -> DataFrame:
    """Typed fields of step lines; ``parsed`` is false for every other line, which stays too."""

    def field(n: int, kind: str) -> Column:
        return F.regexp_extract("line", _STEP_LINE, n).try_cast(kind)

    whole = F.regexp_extract("line", _STEP_LINE, 7)
    return lines.select(
        "*",
        F.regexp_like("line", F.lit(_STEP_LINE)).alias("parsed"),
        field(1, "bigint").alias("step"),
        field(2, "bigint").alias("n_steps"),
        field(3, "double").alias("pct_done"),
        field(4, "double").alias("loss"),
        field(5, "double").alias("lr"),
        field(6, "bigint").alias("dt_ms"),
        F.replace(whole, F.lit(","), F.lit("")).try_cast("bigint").alias("tok_per_sec"),
        field(8, "double").alias("time_m"),
    )


def parse_validation_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.regexp_like("line", F.lit(_BPB_LINE))).select(
        "*",
        F.regexp_extract("line", _BPB_LINE, 1).try_cast("bigint").alias("step"),
        F.regexp_extract("line", _BPB_LINE, 2).try_cast("double").alias("val_bpb"),
    )


def log_facts(lines: DataFrame) -> DataFrame:
    """Sizes, percentages, document counts and shard numbers named in free text, one per row."""
    sizes = F.transform(
        F.regexp_extract_all("line", F.lit(LOG_AMOUNT_PATTERN), F.lit(1)),
        lambda m: F.struct(
            F.regexp_extract(m, r"^(\d+\.?\d*)", 1).cast("double").alias("value"),
            F.regexp_extract(m, r"(GB|MB|%|docs)$", 1).alias("unit"),
        ),
    )
    shards = F.transform(
        F.regexp_extract_all("line", F.lit(LOG_SHARD_PATTERN), F.lit(1)),
        lambda m: F.struct(m.cast("double").alias("value"), F.lit("shard").alias("unit")),
    )
    facts = lines.select("*", F.posexplode(F.concat(sizes, shards)).alias("fact_no", "_fact"))
    return facts.select(*lines.columns, "fact_no", "_fact.value", "_fact.unit")
