"""Checkpoint catalog: which steps are saved, kept and known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def save_gate(steps: DataFrame, interval: int, forced: Column | None = None) -> DataFrame:
    """Steps at which a checkpoint is written."""
    due = F.lit(True) if interval <= 1 else F.col("step") % interval == 0
    return steps.filter(due if forced is None else forced | due)


def retained(steps: DataFrame, max_to_keep: int = 5) -> DataFrame:
    """The latest ``max_to_keep`` steps of each run (a per-group limit, cut before the shuffle)."""
    latest = Window.partitionBy("run").orderBy(F.desc("step"))
    return steps.withColumn("_nth", F.row_number().over(latest)).filter(F.col("_nth") <= max_to_keep).drop("_nth")


def all_steps(steps: DataFrame) -> DataFrame:
    """``(run, step, latest)``: each known step once, the last one of a run marked."""
    each = steps.groupBy("run", "step").agg(F.lit(True).alias("_seen"))
    last = steps.groupBy("run").agg(F.max("step").alias("step")).withColumn("_last", F.lit(True))
    # Keyed by (run, step), so a run with many steps does not meet in one task.
    return each.join(last, ["run", "step"], "left").select(
        "run", "step", F.coalesce("_last", F.lit(False)).alias("latest")
    )


def latest_step(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run").agg(F.max("step").alias("latest_step"))
