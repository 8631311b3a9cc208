"""Training-log metrics of a log that keeps growing: the fold of each run is state.

A run's state is the next step it waits for, its exponential sum, its best value and its training
time.  Lines may come late and out of order: a line ahead of its turn waits in the state until the lines before it have
come, and a line whose step has been folded already is a repeat and changes nothing.  So the rows
are those of the batch operators on the whole log, in whatever micro-batches the lines arrive.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.runlog import WARM_UP_STEPS

FOLDED = "run bigint, step bigint, debiased double, best double, total_time double"
NAMES = ("run", "step", "debiased", "best", "total_time")
# ``waiting`` holds [step, loss, val_bpb, dt] of lines ahead of their turn.
STATE = "next bigint, decayed double, best double, total_time double, waiting string"


def _fold(beta: float):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, decayed, best, total, waiting = state.get if state.exists else (0, 0.0, None, 0.0, "[]")
        best = None if best is None or math.isnan(best) else best
        lines = {line[0]: line[1:] for line in json.loads(waiting)}
        for frame in frames:
            for step, *values in zip(*(frame[c].tolist() for c in ("step", "loss", "val_bpb", "dt"))):
                if step >= at:
                    lines.setdefault(int(step), values)
        rows = []
        while at in lines:
            loss, val, dt = lines.pop(at)
            decayed = beta * decayed + loss
            # A missing value and NaN are no result; neither wins.
            if not math.isnan(val) and (best is None or val < best):
                best = val
            total += dt if at > WARM_UP_STEPS else 0.0
            rows.append((key[0], at, (1 - beta) * decayed / (1 - beta ** (at + 1)), best, total))
            at += 1
        state.update((at, decayed, best, total, json.dumps([[step, *line] for step, line in lines.items()])))
        if rows:
            # A frame a run: of whole columns, which takes a fraction of the time of one of rows.
            # A run may be NULL, which is no integer.
            kinds = (None, np.int64, np.float64, np.float64, np.float64)
            yield pd.DataFrame({name: np.array(column, kind) for name, column, kind in zip(NAMES, zip(*rows), kinds)}, copy=False)

    return fold


def fold_log(log: DataFrame, beta: float = 0.9) -> DataFrame:
    """``(run, step, debiased, best, total_time)`` of a stream of lines ``(run, step, loss, val_bpb, dt)``.

    Steps count 0, 1, 2, ... in a run.  ``debiased`` is the exponential mean from 0, ``best`` the least value
    so far (NULL before any), ``total_time`` the sum of ``dt`` without the first steps.  A missing loss or ``dt`` adds nothing.
    """
    none = F.lit(0.0)
    lines = log.select(
        F.col("run").cast("bigint").alias("run"), F.col("step").cast("bigint").alias("step"), F.coalesce("loss", none).alias("loss"),
        F.col("val_bpb").cast("double").alias("val_bpb"), F.coalesce("dt", none).alias("dt"),
    )
    folded = lines.groupBy("run").applyInPandasWithState(_fold(beta), FOLDED, STATE, "append", GroupStateTimeout.NoTimeout)
    # The frames give NaN as NULL; these two are never NULL.
    return folded.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("debiased", "total_time")})


def follow_log(log: DataFrame, sink: str, beta: float = 0.9) -> StreamingQuery:
    """Start the fold; rows land under the number of their micro-batch, so a repeat replaces them."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/rows/epoch={epoch}")

    writer = fold_log(log, beta).writeStream.outputMode("append").foreachBatch(write)
    return writer.option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()


def folded_rows(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.schema(FOLDED).parquet(f"{sink}/rows/epoch=*")
