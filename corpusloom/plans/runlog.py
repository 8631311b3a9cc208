"""Run-log, sizing and checkpoint queries: events play the log, the user is the run."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import runlog, sizing, snapshots
from corpusloom.operators.running import with_position
from corpusloom.plans.tables import byte_lengths, documents, table
from corpusloom.sources import run_metadata
from corpusloom.staging import fresh_path, stage
from corpusloom.streaming import runlog as streaming

TOTAL_BATCH = 524_288
EVAL_EVERY, SAMPLE_EVERY = 25, 20
PEAK = 3e-4
SAVE_EVERY, KEEP = 5, 3
VOCAB, SEQ_LEN, DEVICE_BATCH = 50_304, 2048, 32
# Files of the streamed log, and how many of them a micro-batch takes.
LOG_FILES, FILES_A_TRIGGER = 6, 2


def _log(spark, sf_dir):
    """``(run, step, event_id, value, dt, val_bpb)``: steps count a run's events."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "event_type", "value")
    steps = with_position(events, ["run"], "event_id", "step")
    return steps.select(
        "run",
        "step",
        "event_id",
        F.col("value").alias("loss"),
        # An error took no time; a value of whole hundredths, an exact number of milliseconds.
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.round(F.col("value") * 100) / 100).alias("dt"),
        F.when(F.col("event_type") == "view", F.lit(float("nan")))
        .when(F.col("event_type") == "click", F.col("value"))
        .alias("val_bpb"),
    )


def _log_with_length(spark, sf_dir):
    """The log with the last step of its run."""
    log = _log(spark, sf_dir)
    lengths = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        (F.count(F.lit(1)) - 1).alias("n_steps")
    )
    return log.join(lengths, "run")


def debiased_ema(spark, sf_dir):
    # The smoothing reads its input twice.
    smooth = runlog.debiased_ema(stage(_log(spark, sf_dir), "log"))
    return smooth.select("run", "step", F.round("debiased", 6).alias("debiased"))


def running_best(spark, sf_dir):
    return runlog.running_best(stage(_log(spark, sf_dir), "log")).select("run", "step", "best")


def training_time(spark, sf_dir):
    timed = runlog.training_time(stage(_log(spark, sf_dir), "log"))
    return timed.select("run", "step", F.round("total_time", 6).alias("total_time"))


def streaming_log(spark, sf_dir):
    """The log's lines in mixed order over several micro-batches: smoothed loss, best value and time so far."""
    path, sink = fresh_path(spark, "log_files"), fresh_path(spark, "folded")
    log = _log(spark, sf_dir).select("run", "step", "loss", "val_bpb", "dt")
    log.repartition(LOG_FILES, F.xxhash64("run", "step")).write.parquet(path)
    lines = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", FILES_A_TRIGGER).parquet(path)
    streaming.follow_log(lines, sink).awaitTermination()
    return streaming.folded_rows(spark, sink).select(
        "run", "step", F.round("debiased", 6).alias("debiased"), "best", F.round("total_time", 6).alias("total_time")
    )


def _run_depth(column):
    return (column % 23 + 2).cast("int")


def _configs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("steps"))
    return sizing.shape_from_depth(runs.withColumn("depth", _run_depth(F.col("run"))), VOCAB, SEQ_LEN)


def scaling_counts(spark, sf_dir):
    counted = sizing.scaling_counts(_configs(spark, sf_dir))
    return counted.select(
        "run", "depth", "steps", "wte", "lm_head", "transformer_matrices", "total", "valid", "flops_per_token"
    )


def throughput(spark, sf_dir):
    flops = sizing.scaling_counts(_configs(spark, sf_dir)).select("run", "flops_per_token")
    log = _log_with_length(spark, sf_dir).join(flops, "run")
    log = log.withColumn("n_steps", F.greatest("n_steps", F.lit(1)))
    fast = runlog.throughput(log, TOTAL_BATCH, F.col("flops_per_token"))
    return fast.select(
        "run",
        "step",
        F.round("pct_done", 6).alias("pct_done"),
        "tok_per_sec",
        # Teraflops, so that six decimals are well inside a double.
        F.round(F.col("flops_per_sec") / 1e12, 6).alias("tflops_per_sec"),
    )


def cadence_filter(spark, sf_dir):
    marked = runlog.cadence(_log_with_length(spark, sf_dir), EVAL_EVERY, SAMPLE_EVERY)
    return marked.select("run", "step", "evaluates", "samples")


def lr_schedule(spark, sf_dir):
    log = _log_with_length(spark, sf_dir).withColumn("lr", F.lit(PEAK))
    return runlog.lr_audit(log, PEAK).select(
        "run", "step", F.round(F.col("lr_expected") * 1e4, 6).alias("lr_e4"), "lr_agrees"
    )


def token_budget(spark, sf_dir):
    """Depth by ratio for every source of the corpus."""
    sources = byte_lengths(spark, sf_dir).groupBy(F.col("shard").alias("source")).agg(F.sum("n").alias("corpus_tokens"))
    grid = sources.withColumn("depth", F.explode(F.sequence(F.lit(2), F.lit(24)))).withColumn(
        "ratio", F.explode(F.array(*[F.lit(r) for r in (5.0, 10.0, 20.0, 40.0)]))
    )
    sized = sizing.scaling_counts(sizing.shape_from_depth(grid, VOCAB, SEQ_LEN))
    plan = sizing.token_budget(sized, TOTAL_BATCH, DEVICE_BATCH, SEQ_LEN)
    return plan.select(
        "source",
        "depth",
        "ratio",
        "valid",
        "n_iterations",
        "accumulation_steps",
        "total_tokens",
        F.round("tokens_per_param", 6).alias("tokens_per_param"),
        F.round("epochs_needed", 6).alias("epochs_needed"),
    )


def _step_lines(spark, sf_dir):
    """Log lines as the trainer prints them, from the log's columns; errors print free text."""
    log = _log_with_length(spark, sf_dir)
    line = F.format_string(
        "step %05d/%05d (%s%%) | loss: %s | lr: %s | dt: %dms | tok/s: %s | time: %sm",
        "step",
        "n_steps",
        F.format_string("%d.%d", F.expr("step % 100"), F.expr("step % 10")),
        F.col("loss").cast("decimal(18,4)").cast("string"),
        F.format_string("%d.00e-04", F.expr("step % 9 + 1")),
        F.expr("event_id % 1000"),
        F.format_number(F.expr("event_id * 37"), 0),
        F.format_string("%d.%d", F.expr("step div 10"), F.expr("step % 10")),
    )
    text = F.when(F.col("dt") == 0, F.concat(F.lit("retry after "), F.col("step").cast("string"))).otherwise(line)
    return log.select("run", F.col("step").alias("line_no"), text.alias("line"))


def parse_step_log(spark, sf_dir):
    return runlog.parse_step_lines(_step_lines(spark, sf_dir)).drop("line")


def parse_validation_log(spark, sf_dir):
    """Validation lines among other lines."""
    log = _log(spark, sf_dir)
    bpb = F.format_string("Step %05d | Validation bpb: %s", "step", F.col("loss").cast("decimal(18,4)").cast("string"))
    other = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit(" done"))
    lines = log.select("run", F.when(F.col("event_id") % 3 == 0, bpb).otherwise(other).alias("line"))
    return runlog.parse_validation_lines(lines).drop("line")


def log_facts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    line = F.format_string(
        "%s: Shard %d of run %d read, %s GB in %d docs, %d.5 %% done, %d MB left",
        "event_type",
        F.expr("event_id % 1823"),
        "user_id",
        F.col("value").cast("decimal(18,2)").cast("string"),
        F.expr("event_id * 3"),
        F.expr("event_id % 100"),
        F.expr("event_id % 17"),
    )
    return runlog.log_facts(events.select("event_id", line.alias("line"))).drop("line")


def _steps(spark, sf_dir):
    return _log(spark, sf_dir).select("run", "step")


def snapshot_gate(spark, sf_dir):
    return snapshots.save_gate(_log_with_length(spark, sf_dir), SAVE_EVERY, F.col("step") == F.col("n_steps")).select("run", "step")


def snapshot_retention(spark, sf_dir):
    return snapshots.retained(snapshots.save_gate(_steps(spark, sf_dir), SAVE_EVERY), KEEP)


def snapshot_steps(spark, sf_dir):
    return snapshots.all_steps(snapshots.save_gate(_steps(spark, sf_dir), SAVE_EVERY))


def snapshot_latest(spark, sf_dir):
    return snapshots.latest_step(snapshots.save_gate(_steps(spark, sf_dir), SAVE_EVERY))


def snapshot_extra_fields(spark, sf_dir):
    """Fields that no schema lists, at both levels, through two writes and reads of the files."""
    kept = _steps_kept(spark, sf_dir)
    config = F.struct((F.col("run") % 7 + 1).cast("bigint").alias("n_layer"), (F.col("step") * 2).alias("rope_base"))
    optimizer = F.struct(F.lit("muon").alias("kind"), F.array(F.col("step"), F.col("run")).alias("groups"))
    extra = F.struct("step", "val_bpb", config.alias("model_config"), optimizer.alias("optimizer"))
    path = run_metadata.write_run_metadata(kept.select("run", "step", extra.alias("extra")), fresh_path(spark, "metadata"))
    records = run_metadata.read_run_records(spark, path).select("run", F.col("dir_step").alias("step"), F.col("record").alias("extra"))
    again = run_metadata.read_run_records(spark, run_metadata.write_run_metadata(records, fresh_path(spark, "metadata")))
    found = run_metadata.unknown_fields(again)
    return found.select(F.col("run").cast("bigint").alias("run"), F.col("dir_step").alias("step"), "path", F.to_json("value").alias("value"))


def _catalog(spark, sf_dir):
    """Metadata of every kept snapshot, written as JSON files and read back beside all kept steps.

    Steps that are a multiple of 15 have no metadata.
    """
    kept = _steps_kept(spark, sf_dir)
    config = sizing.shape_from_depth(kept.withColumn("depth", _run_depth(F.col("run"))), VOCAB, SEQ_LEN)
    sized = sizing.scaling_counts(config)
    extra = F.struct(
        "step",
        F.col("val_bpb"),
        F.struct(*[F.col(f).cast("bigint").alias(f) for f in run_metadata.CONFIG_FIELDS]).alias("model_config"),
        F.col("total").alias("num_params"),
        (F.col("step") * TOTAL_BATCH).alias("total_tokens"),
    )
    records = sized.filter(F.col("step") % 15 != 0).select("run", "step", extra.alias("extra"))
    path = run_metadata.write_run_metadata(records, fresh_path(spark, "metadata"))
    found = run_metadata.read_run_metadata(spark, path).withColumn("run", F.col("run").cast("bigint"))
    return run_metadata.run_catalog(kept.select("run", "step"), found)


def _steps_kept(spark, sf_dir):
    # Without any usable value yet the catalog holds NULL.
    best = runlog.running_best(_log(spark, sf_dir)).select("run", "step", F.col("best").alias("val_bpb"))
    return snapshots.retained(snapshots.save_gate(best, SAVE_EVERY), KEEP)


def run_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir).select(
        "run",
        "step",
        F.col("extra.val_bpb").alias("val_bpb"),
        F.col("extra.model_config.n_embd").alias("n_embd"),
        F.col("extra.num_params").alias("num_params"),
        F.col("extra.total_tokens").alias("total_tokens"),
    )


def snapshot_metadata(spark, sf_dir):
    return run_metadata.metadata_json(_catalog(spark, sf_dir)).select("run", "step", "extra_json")


QUERIES = {
    f.__name__: f
    for f in (
        debiased_ema,
        running_best,
        training_time,
        streaming_log,
        throughput,
        cadence_filter,
        lr_schedule,
        scaling_counts,
        token_budget,
        parse_step_log,
        parse_validation_log,
        log_facts,
        snapshot_gate,
        snapshot_retention,
        snapshot_steps,
        snapshot_latest,
        run_catalog,
        snapshot_metadata,
        snapshot_extra_fields,
    )
}

_LOG = """
log as (
  select user_id as run, row_number() over w - 1 as step, event_id, value as loss,
    case when event_type = 'error' then 0.0 else round(value * 100) / 100 end as dt,
    case when event_type = 'click' then value end as usable,
    count(*) over (partition by user_id) - 1 as n_steps
  from events window w as (partition by user_id order by event_id))"""


def _sized(runs: str) -> str:
    """Model sizes of ``runs`` with a ``depth`` column."""
    return f"""
shaped as (
  select *, depth * 64 as c, greatest(1, (depth * 64 + 127) // 128) as h from {runs}),
sized as (
  select *, ({VOCAB}::bigint * c) as wte, ({VOCAB}::bigint * c) as lm_head,
    (depth * (4 * c * h * (c // h) + 8 * c * c))::bigint as transformer_matrices, c % h = 0 as valid,
    (2 * {VOCAB}::bigint * c + depth * (4 * c * h * (c // h) + 8 * c * c))::bigint as total,
    (6 * ({VOCAB}::bigint * c + depth * (4 * c * h * (c // h) + 8 * c * c))
      + 12 * depth * h * (c // h) * {SEQ_LEN})::bigint as flops_per_token
  from shaped)"""


_DEPTH = "(run % 23 + 2)::int as depth"
_SAVED = f"select run, step from log where step % {SAVE_EVERY} = 0"
_CATALOG = f"""
with {_LOG},
best as (
  select run, step, min(usable) over (partition by run order by step) as val_bpb from log),
kept as (
  select *, {_DEPTH} from best where step % {SAVE_EVERY} = 0
  qualify row_number() over (partition by run order by step desc) <= {KEEP}),
{_sized("kept")}"""

ORACLE = {
    "debiased_ema": f"""
with recursive {_LOG},
ema as (
  select run, step, 0.1 * loss as s from log where step = 0
  union all
  select log.run, log.step, 0.9 * s + 0.1 * loss from ema join log on log.run = ema.run and log.step = ema.step + 1)
select run, step, round(s / (1 - 0.9 ** (step + 1)), 6) as debiased from ema""",
    "running_best": f"""
with {_LOG} select run, step, min(usable) over (partition by run order by step) as best from log""",
    "training_time": f"""
with {_LOG}
select run, step, round(sum(case when step > 10 then dt else 0 end) over (partition by run order by step), 6) as total_time
from log""",
    "streaming_log": f"""
with recursive {_LOG},
ema as (
  select run, step, 0.1 * loss as s from log where step = 0
  union all
  select log.run, log.step, 0.9 * s + 0.1 * loss from ema join log on log.run = ema.run and log.step = ema.step + 1)
select run, step, round(s / (1 - 0.9 ** (step + 1)), 6) as debiased, min(usable) over w as best,
  round(sum(case when step > 10 then dt else 0 end) over w, 6) as total_time
from ema join log using (run, step) window w as (partition by run order by step)""",
    "throughput": f"""
with {_LOG}, runs as (select *, {_DEPTH} from log), {_sized("runs")}
select run, step, round(100.0 * step / greatest(n_steps, 1), 6) as pct_done,
  case when dt > 0 then trunc({TOTAL_BATCH} / dt)::bigint else 0 end as tok_per_sec,
  round(case when dt > 0 then flops_per_token::double * {TOTAL_BATCH} / dt else 0 end / 1e12, 6) as tflops_per_sec
from sized""",
    "cadence_filter": f"""
with {_LOG}
select run, step, step = n_steps or step % {EVAL_EVERY} = 0 as evaluates,
  step = n_steps or (step > 0 and step % {SAMPLE_EVERY} = 0) as samples
from log""",
    "lr_schedule": f"""
with {_LOG},
warm as (select *, greatest(1, round_even(0.01 * n_steps, 0)) as w from log),
rate as (
  select run, step, case when step < w then {PEAK} * step / w
    else {PEAK} * (0.99 * 0.5 * (1 + cos(pi() * case when n_steps > w then least(step - w, n_steps - w) / (n_steps - w) else 1 end)) + 0.01)
    end as lr from warm)
select run, step, round(lr * 1e4, 6) as lr_e4, abs({PEAK} - lr) <= 0.005 * abs(lr) + 1e-12 as lr_agrees from rate""",
    "scaling_counts": f"""
with runs as (select user_id as run, count(*) as steps, (user_id % 23 + 2)::int as depth from events group by user_id),
{_sized("runs")}
select run, depth, steps, wte, lm_head, transformer_matrices, total, valid, flops_per_token from sized""",
    "token_budget": f"""
with grid as (
  select source, corpus_tokens, d::int as depth, ratio
  from (select source, sum(strlen(text) + 1) as corpus_tokens from documents group by source),
    range(2, 25) t(d), (select unnest([5.0::double, 10, 20, 40]) as ratio)),
{_sized("grid")},
plan as (select *, floor(ratio * total / {TOTAL_BATCH})::bigint as n_iterations from sized)
select source, depth, ratio, valid, n_iterations, {TOTAL_BATCH // (DEVICE_BATCH * SEQ_LEN)}::int as accumulation_steps,
  n_iterations * {TOTAL_BATCH} as total_tokens, round(n_iterations * {TOTAL_BATCH} / total, 6) as tokens_per_param,
  round(n_iterations * {TOTAL_BATCH} / corpus_tokens, 6) as epochs_needed
from plan""",
    # The fields that went into the printed lines.
    "parse_step_log": f"""
with {_LOG},
ok as (select *, dt <> 0 as parsed from log)
select run, step as line_no, parsed, case when parsed then step end as step, case when parsed then n_steps end as n_steps,
  case when parsed then step % 100 + (step % 10) / 10 end as pct_done, case when parsed then loss end as loss,
  case when parsed then (step % 9 + 1) / 1e4 end as lr, case when parsed then event_id % 1000 end as dt_ms,
  case when parsed then event_id * 37 end as tok_per_sec, case when parsed then step // 10 + (step % 10) / 10 end as time_m
from ok""",
    "parse_validation_log": f"with {_LOG} select run, step, loss as val_bpb from log where event_id % 3 = 0",
    "log_facts": """
select event_id, (f.no)::int as fact_no, f.value::double as value, f.unit as unit
from (
  select event_id, unnest([
    {'no': 0, 'value': value, 'unit': 'GB'},
    {'no': 1, 'value': event_id * 3, 'unit': 'docs'},
    {'no': 2, 'value': event_id % 100 + 0.5, 'unit': '%'},
    {'no': 3, 'value': event_id % 17, 'unit': 'MB'},
    {'no': 4, 'value': event_id % 1823, 'unit': 'shard'}]) as f
  from events)""",
    "snapshot_gate": f"with {_LOG} select run, step from log where step = n_steps or step % {SAVE_EVERY} = 0",
    "snapshot_retention": f"""
with {_LOG} {_SAVED} qualify row_number() over (partition by run order by step desc) <= {KEEP}""",
    "snapshot_steps": f"""
with {_LOG}, saved as ({_SAVED})
select run, step, step = max(step) over (partition by run) as latest from saved""",
    "snapshot_latest": f"""
with {_LOG}, saved as ({_SAVED}) select run, max(step) as latest_step from saved group by run""",
    "run_catalog": f"""
{_CATALOG}
select run, step, case when step % 15 <> 0 then val_bpb end as val_bpb, case when step % 15 <> 0 then c::bigint end as n_embd,
  case when step % 15 <> 0 then total end as num_params, case when step % 15 <> 0 then step * {TOTAL_BATCH} end as total_tokens
from sized""",
    "snapshot_extra_fields": f"""
{_CATALOG}
select run, step, path, value from (
  select run, step, ['model_config.rope_base', 'optimizer'] as paths,
    [(step * 2)::varchar, '{{"groups":[' || step || ',' || run || '],"kind":"muon"}}'] as vals from sized)
  s, lateral (select unnest(s.paths) as path, unnest(s.vals) as value) t""",
    "snapshot_metadata": f"""
{_CATALOG}
select run, step, case when step % 15 = 0 then '{{}}' else
  '{{"step":' || step || coalesce(',"val_bpb":' || val_bpb, '')
  || ',"model_config":{{"sequence_len":{SEQ_LEN},"vocab_size":{VOCAB},"n_layer":' || depth || ',"n_head":' || h
  || ',"n_kv_head":' || h || ',"n_embd":' || c || '}},"num_params":' || total
  || ',"total_tokens":' || step * {TOTAL_BATCH} || '}}' end as extra_json
from sized""",
}
