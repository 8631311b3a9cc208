"""Evaluation, scores, run log, reports, snapshots, corpus and metadata: hand-made cases."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.operators import evaluation, reports, runlog, sizing, snapshots
from corpusloom.sources import corpus, run_metadata


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i bigint, x {kind}")


LOGITS = [[1.0, 2.0, 2.0, -1.0], [1e4, -1e4, 0.0, 1e4], [0.0, 0.0, 0.0, 0.0]]


def test_scores(spark):
    df = column(spark, LOGITS, "array<float>")
    x = F.col("x")
    got = df.select(
        scores.greedy(x).alias("g"),
        scores.top_k_mask(x, 2).alias("k"),
        scores.top_k_mask(x, 99).alias("all"),
        scores.softcap(x).alias("c"),
        scores.softmax(x).alias("p"),
        scores.rms_normalize(x).alias("n"),
        scores.sample(x, F.col("i"), 0.0, 1).alias("s"),
    ).collect()
    for r, row in zip(got, LOGITS):
        a = np.array(row)
        assert r.g == r.s == int(a.argmax())
        kth = np.sort(a)[::-1][1]
        assert r.k == [v if v >= kth else -math.inf for v in row] and r["all"] == row
        assert r.c == pytest.approx(list(15 * np.tanh(a / 15)))
        e = np.exp(a - a.max())
        assert r.p == pytest.approx(list(e / e.sum()))
        assert r.n == pytest.approx(list(a / np.sqrt((a**2).mean() + 1e-6)))
    with pytest.raises(ValueError):
        scores.tempered(x, 0.0)


def test_samples_follow_the_distribution_whatever_the_partitioning(spark):
    logits = F.array(*[F.lit(v) for v in (0.0, 1.0, 2.0)])
    rows = spark.range(60000).select("id", scores.sample(logits, F.col("id"), 0.5, 7).alias("t"))
    counts = {r.t: r["count"] / 60000 for r in rows.groupBy("t").count().collect()}
    p = np.exp(np.array([0.0, 2.0, 4.0]))
    for t, share in enumerate(p / p.sum()):
        assert counts[t] == pytest.approx(share, abs=0.01)
    again = spark.range(0, 60000, 1, 13).select("id", scores.sample(logits, F.col("id"), 0.5, 7).alias("u"))
    assert rows.join(again, "id").filter("t <> u").count() == 0


def test_losses(spark):
    rows = [(0, [1.0, 2.0, 0.5], t) for t in (0, 1, 2, -1, -2)]
    df = evaluation.with_nats(spark.createDataFrame(rows, "b int, logits array<float>, target int"))
    token_bytes = spark.createDataFrame([(0, 0), (1, 3)], "token_id int, n_bytes int")
    a = np.array([1.0, 2.0, 0.5])
    nats = np.log(np.exp(a).sum()) - a
    got = evaluation.bits_per_byte(df, token_bytes).first()
    # Token 0 is special and token 2 unknown to the table.
    assert got.total_bytes == 3 and got.bpb == pytest.approx(nats[1] / (math.log(2) * 3))
    assert evaluation.bits_per_byte(df.filter("target <> 1"), token_bytes).first().bpb is None
    assert evaluation.masked_mean_loss(df.filter("target >= -1")).first().loss == pytest.approx(nats.mean())
    assert evaluation.masked_mean_loss(df.filter("target = -1")).first().loss == 0.0
    # Only the sentinel is masked: -2 still counts as a token here.
    assert evaluation.masked_mean_loss(df).first().n_tokens == 4
    assert evaluation.masked_mean_loss(df).first().loss is None
    # With the sentinel named, -2 is the last token but one; targets past the end have no nats.
    more = [*rows, (1, [1.0, 2.0, 0.5], 7)]
    wrapped = evaluation.with_nats(spark.createDataFrame(more, "b int, logits array<float>, target int"), ignore=-1)
    losses = {r.b: r.loss for r in evaluation.masked_mean_loss(wrapped, "b").collect()}
    assert losses == {0: pytest.approx((nats.sum() + nats[1]) / 4), 1: None}
    sevens = spark.createDataFrame([(7, 5), (1, 3)], "token_id int, n_bytes int")
    by = {r.b: (r.total_bytes, r.bpb) for r in evaluation.bits_per_byte(wrapped, sevens, "b").collect()}
    assert by[0][0] == 3 and by[1] == (0, None)


def test_step_lines(spark):
    good = "step 00010/00100 (10.0%) | loss: 3.1234 | lr: 3.00e-04 | dt: 120ms | tok/s: 4,369,066 | time: 0.1m"
    nan = "step 00011/00100 (11.0%) | loss: nan | lr: 3.00e-04 | dt: 0ms | tok/s: 0 | time: 0.1m"
    lines = column(spark, [good, nan, "step x", "Step 00250 | Validation bpb: 1.2345"], "string").withColumnRenamed("x", "line")
    rows = {r.i: r for r in runlog.parse_step_lines(lines).collect()}
    r = rows[0]
    assert (r.step, r.n_steps, r.pct_done, r.loss, r.lr, r.dt_ms, r.tok_per_sec, r.time_m) == (10, 100, 10.0, 3.1234, 3e-4, 120, 4369066, 0.1)
    assert rows[1].parsed and math.isnan(rows[1].loss)
    assert not rows[2].parsed and rows[2].step is None
    v = runlog.parse_validation_lines(lines).collect()
    assert [(r.step, r.val_bpb) for r in v] == [(250, 1.2345)]
    facts = runlog.log_facts(column(spark, ["Shard 12: 3.5 GB, 40% of 7docs", "none"], "string").withColumnRenamed("x", "line"))
    assert [(f.value, f.unit) for f in facts.orderBy("fact_no").collect()] == [(3.5, "GB"), (40.0, "%"), (7.0, "docs"), (12.0, "shard")]


def test_log_metrics(spark):
    values = [3.0, 2.0, float("nan"), 2.5, 1.0]
    log = spark.createDataFrame([(1, s, v, 4, 0.5 if s else 0.0) for s, v in enumerate(values)], "run int, step bigint, val_bpb double, n_steps bigint, dt double")
    assert [r.best for r in runlog.running_best(log).orderBy("step").collect()] == [3.0, 2.0, 2.0, 2.0, 1.0]
    clean = log.withColumn("loss", F.col("step") + 1.0)
    smooth = 0.0
    for r in runlog.debiased_ema(clean).orderBy("step").collect():
        smooth = 0.9 * smooth + 0.1 * r.loss
        assert r.debiased == pytest.approx(smooth / (1 - 0.9 ** (r.step + 1)))
    fast = runlog.throughput(log, 100, 7).orderBy("step").collect()
    assert (fast[0].tok_per_sec, fast[0].flops_per_sec) == (0, 0.0)
    assert (fast[1].tok_per_sec, fast[1].flops_per_sec, fast[1].pct_done) == (200, 1400.0, 25.0)
    marks = runlog.cadence(log, 2, 3).orderBy("step").collect()
    assert [r.evaluates for r in marks] == [True, False, True, False, True]
    assert [r.samples for r in marks] == [False, False, False, True, True]
    long = spark.range(14).select(F.lit(1).alias("run"), F.col("id").alias("step"), F.lit(1.0).alias("dt"))
    assert [r.total_time for r in runlog.training_time(long).orderBy("step").collect()] == [0.0] * 11 + [1.0, 2.0, 3.0]


def test_learning_rate(spark):
    n, peak = 250, 3e-4
    rows = spark.range(n + 1).select("id", runlog.learning_rate(F.col("id"), F.lit(n), peak).alias("lr")).collect()
    warm = round(0.01 * n)
    for r in rows:
        gone = (r.id - warm) / (n - warm)
        want = peak * r.id / warm if r.id < warm else peak * (0.99 * 0.5 * (1 + math.cos(math.pi * gone)) + 0.01)
        assert r.lr == pytest.approx(want)


def test_sizes(spark):
    default = [(1024, 50304, 12, 6, 6, 768), (1024, 50304, 5, 3, 3, 320)]
    configs = spark.createDataFrame(default, "sequence_len int, vocab_size int, n_layer int, n_head int, n_kv_head int, n_embd int")
    big, odd = sizing.scaling_counts(configs).orderBy(F.desc("n_layer")).collect()
    assert (big.total, big.flops_per_token, big.valid) == (162_201_600, 854_654_976, True)
    assert not odd.valid
    with pytest.raises(ValueError):
        sizing.token_budget(configs, 1000, 3, 7)


def test_report_values(spark):
    cases = [
        (9999, None, None, "9999"),
        (10000, None, None, "10,000"),
        (-20000, None, None, "-20000"),
        (None, 0.5, None, "0.5000"),
        (None, 0.00015, None, "0.0001"),
        (None, 12345678.9, None, "12345678.9000"),
        (None, float("nan"), None, "nan"),
        (None, float("-inf"), None, "-inf"),
        (None, None, "text", "text"),
        (None, None, None, "None"),
    ]
    df = spark.createDataFrame(cases, "w bigint, r double, t string, want string")
    got = df.select("want", reports.format_value(F.col("w"), F.col("r"), F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


SECTION = "## Chat\ntimestamp: soon\ntimestamp: 2024-03-05 07:08:09\n\n- MMLU: 0.1\n- MMLU: 0.2: late\nabout GSM8K\n- ChatCORE: 0.3\n"


def test_sections(spark):
    bodies = [(1, "chat-evaluation-mid", SECTION), (1, "base-model-evaluation", "timestamp: bad\n- CORE: 0.5"), (1, "notes", "x")]
    sections = spark.createDataFrame(bodies, "run int, section string, body string")
    lines = reports.section_lines(sections)
    found = {(r.section, r.key): r.value for r in reports.extract_metrics(lines, ["MMLU", "GSM8K", "CORE"], ["section"]).collect()}
    assert found["chat-evaluation-mid", "MMLU"] == "0.2"
    assert found["chat-evaluation-mid", "GSM8K"] is None
    # CORE is found inside ChatCORE unless names are compared whole.
    assert found["chat-evaluation-mid", "CORE"] == "0.3"
    exact = reports.extract_metrics(lines, ["CORE"], ["section"], exact=True).collect()
    assert [(r.section, r.value) for r in exact] == [("base-model-evaluation", "0.5")]
    times = reports.extract_timestamp(lines, "timestamp:", ["run", "section"])
    stamp = datetime.datetime(2024, 3, 5, 7, 8, 9)
    assert {r.section: r.ts for r in times.collect()} == {"chat-evaluation-mid": stamp, "base-model-evaluation": None, "notes": None}
    starts = spark.createDataFrame([(1, datetime.datetime(2024, 3, 5, 5, 8, 9)), (2, stamp)], "run int, ts timestamp_ntz")
    assert {r.run: r.wall_clock for r in reports.wall_clock(starts, times).collect()} == {1: "2h0m", 2: "unknown"}
    # The last section counts even when its time cannot be read.
    broken = times.withColumn("ts", F.when(F.col("section") != "chat-evaluation-mid", F.col("ts")))
    assert reports.wall_clock(starts, broken).filter("run = 1").first().wall_clock == "unknown"
    table = reports.summary_pivot(reports.stage_metrics(lines)).orderBy("place", "metric").collect()
    assert [(r.metric, r.base, r.mid, r.rl) for r in table] == [
        ("CORE", "0.5", "-", "-"),
        ("GSM8K", "-", "-", "-"),
        ("MMLU", "-", "0.2", "-"),
        ("ChatCORE", "-", "0.3", "-"),
    ]
    assert reports.join_sections(sections).first().report == bodies[1][2] + "\n" + SECTION + "\n"
    present = [r.section for r in reports.section_coverage(sections).filter("present").orderBy("section_no").collect()]
    assert present == ["base-model-evaluation", "chat-evaluation-mid"]


def test_rates(spark):
    df = spark.createDataFrame([("NVIDIA H100 80GB", 8), ("TPU v5 lite", 2), ("thing", 3), (None, 1)], "d string, n int")
    rates = [r[0] for r in df.select(reports.hourly_rate(F.col("d"), F.col("n"))).collect()]
    assert rates == [24.0, 8.4, 6.0, None]
    hours = spark.createDataFrame([(2.0,), (0.0,), (None,)], "h double")
    assert [r[0] for r in hours.select(reports.estimated_total(F.lit(3.0), F.col("h"))).collect()] == [6.0, None, None]


def test_snapshots(spark, tmp_path):
    steps = spark.createDataFrame([(1, s) for s in (0, 4, 5, 10, 11, 12)], "run int, step bigint")
    assert [r.step for r in snapshots.save_gate(steps, 5, F.col("step") == 12).orderBy("step").collect()] == [0, 5, 10, 12]
    assert snapshots.save_gate(steps, 1).count() == 6
    assert [r.step for r in snapshots.retained(steps, 2).orderBy("step").collect()] == [11, 12]
    assert [r.step for r in snapshots.all_steps(steps).filter("latest").collect()] == [12]
    for step, extra in ((4, {"step": 4, "val_bpb": 1.5, "model_config": {"n_embd": 768}}), (12, {"step": 12, "num_params": 7})):
        folder = tmp_path / "1" / str(step)
        folder.mkdir(parents=True)
        (folder / "_metadata.json").write_text(json.dumps(extra, indent=2))
    found = run_metadata.read_run_metadata(spark, str(tmp_path)).withColumn("run", F.col("run").cast("int"))
    rows = {r.step: json.loads(r.extra_json) for r in run_metadata.metadata_json(run_metadata.run_catalog(steps, found)).collect()}
    assert rows[4] == {"step": 4, "val_bpb": 1.5, "model_config": {"n_embd": 768}} and rows[5] == {} and rows[12]["num_params"] == 7


def test_corpus_files(spark, tmp_path):
    for k in range(3):
        df = spark.createDataFrame([Row(text=f"{k}-{i}", other=i) for i in range(5)]).coalesce(1)
        df.toPandas().to_parquet(tmp_path / f"shard_{k:05d}.parquet", row_group_size=2)
    (tmp_path / "shard_00003.parquet.tmp").write_bytes(b"unfinished")
    docs = corpus.read_corpus(spark, str(tmp_path))
    assert sorted((r.shard, r.row_index, r.text) for r in docs.collect())[6] == ("shard_00001.parquet", 1, "1-1")
    assert {r.shard for r in corpus.read_split(docs, "val").collect()} == {"shard_00002.parquet"}
    assert corpus.read_split(docs, "train").count() == 10
    with pytest.raises(ValueError):
        corpus.read_split(docs, "test")
    with pytest.raises(ValueError):
        corpus.read_split(docs.filter("shard like '%0.parquet'"), "train")
    mine = corpus.read_rank(docs, 1, 2, rows_per_group=2)
    assert sorted(r.text for r in mine.collect()) == [f"{k}-{i}" for k in range(3) for i in (2, 3)]
    assert corpus.read_rank(docs, 7, 9, rows_per_group=2).count() == 0
    manifest = corpus.shard_manifest(corpus.list_shards(spark, str(tmp_path)), wanted=5)
    assert [r.present for r in manifest.orderBy("shard_no").collect()] == [True] * 3 + [False] * 2
    totals = corpus.manifest_totals(manifest).first()
    assert (totals.successful, totals.total) == (3, 5)
    pruned = docs.select("text")._jdf.queryExecution().executedPlan().toString()
    assert "other" not in pruned


def test_log_folded_in_pieces_is_that_of_the_whole(spark, tmp_path):
    """Late, early, repeated and unusable lines over several micro-batches and a restart."""
    from corpusloom.operators import runlog
    from corpusloom.streaming.runlog import follow_log, folded_rows

    nan = float("nan")
    schema = "run long, step long, loss double, val_bpb double, dt double"
    lines = [(r, s, float(s * r % 7), (None, nan, 9.0 - s % 5)[(s + r) % 3], 0.5 * s) for r in (1, 2) for s in range(30)]
    lines += [(3, s, nan if s == 4 else float("inf") if s == 2 else 1.0, None, None) for s in range(6)]
    whole = spark.createDataFrame(lines, schema)
    mixed = sorted(lines, key=lambda line: (line[1] * 7 + line[0]) % 11)
    log, sink = f"{tmp_path}/log", f"{tmp_path}/sink"
    for part in range(4):
        rows = mixed[part * 20 : part * 20 + 20] + mixed[:3]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
        follow_log(stream, sink).awaitTermination()
    expected = runlog.training_time(runlog.running_best(runlog.debiased_ema(whole)))

    def shown(rows):
        return sorted((r.run, r.step, str(round(r.debiased, 9)), r.best, round(r.total_time, 9)) for r in rows.collect())

    assert len(mixed) <= 80 and shown(folded_rows(spark, sink)) == shown(expected)


def test_many_keys_are_found_in_one_pass(spark):
    from corpusloom.operators import reports

    keys = ["ab", "b", "", "abc", "b", "zz"] + [f"k{i}" for i in range(5000)]
    lines = [(1, 0, "xabc: 1"), (1, 1, None), (1, 2, "b: 2 : 3"), (2, 0, "k12 k4999"), (2, 1, "")]
    df = spark.createDataFrame(lines, "run long, line_no int, line string")
    got = {(r.run, r.key): r.value for r in reports.extract_many(df, keys, ["run"]).collect()}
    wanted = {}
    for run, _, line in lines:
        for key in keys if line is not None else []:
            if key in line:
                wanted[run, key] = line.split(":")[1].strip() if ":" in line else None
    assert got == wanted
    first = df.select("line", reports.first_key(spark, F.col("line"), ["zz", "b", "abc", "k4999"]).alias("at")).collect()
    assert [r.at for r in first] == [1, None, 1, 3, None]
    with pytest.raises(ValueError):
        reports.key_matcher(spark, ["x" * 70_000_000])


def test_records_keep_fields_that_no_schema_lists(spark, tmp_path):
    texts = {
        "1": '{"step": 5, "val_bpb": NaN, "model_config": {"n_layer": 4, "extra": {"a": [1, 2.5]}}, "note": "a:NaN,b"}',
        "2": '{"step": "late", "num_params": 7}', "3": "no json", "4": "{}",
    }
    for run, text in texts.items():
        folder = tmp_path / run / "10"
        folder.mkdir(parents=True)
        (folder / "_metadata.json").write_text(text)
    records = run_metadata.read_run_records(spark, str(tmp_path))
    shredded = {r.run: r.extra for r in run_metadata.known_fields(records).collect()}
    assert shredded["3"] is None and shredded["1"].step == 5 and shredded["1"].model_config.n_layer == 4
    assert shredded["1"].val_bpb is None and shredded["2"].step is None and shredded["2"].num_params == 7
    unknown = run_metadata.unknown_fields(records).select("run", "path", F.to_json("value").alias("value")).collect()
    assert {(r.run, r.path) for r in unknown} == {("1", "model_config.extra"), ("1", "note")}
    assert json.loads(next(r.value for r in unknown if r.path == "model_config.extra")) == {"a": [1, 2.5]}
    written = records.where("record is not null").select("run", F.col("dir_step").alias("step"), F.col("record").alias("extra"))
    path = run_metadata.write_run_metadata(written, f"{tmp_path}/again")
    again = {r.run: json.loads(r.j) for r in run_metadata.read_run_records(spark, path).select("run", F.to_json("record").alias("j")).collect()}
    assert again["1"]["model_config"] == {"n_layer": 4, "extra": {"a": [1, 2.5]}} and again["2"] == {"step": "late", "num_params": 7}


def test_metadata_files_share_tasks(spark, tmp_path):
    """Reading and writing use all cores, and tasks do not grow with the number of files; any depth is found."""
    from pyspark.sql import functions as F

    from corpusloom.sources import run_metadata

    cores = spark.sparkContext.defaultParallelism
    steps = spark.range(0, 3000, 1, 1).select((F.col("id") % 1000).alias("run"), (F.expr("id div 1000") * 5).alias("step"))
    records = steps.withColumn("extra", F.struct("step", F.struct("run").alias("model_config"), F.col("run").alias("more")))
    path = run_metadata.write_run_metadata(records, str(tmp_path / "runs"))
    found = run_metadata.read_run_records(spark, path)
    assert found.rdd.getNumPartitions() <= 4 * cores
    unknown = run_metadata.unknown_fields(found)
    got = sorted((int(r.run), r.dir_step, r.path, int(r.v)) for r in unknown.select("*", F.to_json("value").alias("v")).collect())
    assert got == sorted((r, s, p, r) for r in range(1000) for s in (0, 5, 10) for p in ("model_config.run", "more"))
    deep = tmp_path / "deep" / "a" / "b" / "run_7" / "step=15"
    deep.mkdir(parents=True)
    (deep / "_metadata.json").write_text('{"step": 15}')
    assert [(r.run, r.dir_step) for r in run_metadata.read_run_records(spark, str(tmp_path / "deep")).collect()] == [("run_7", 15)]


def test_folded_rows_of_many_runs_in_mixed_order(spark, tmp_path):
    """Rows of runs without any usable value, and of lines that come late, as the fold of each run in order."""
    from corpusloom.streaming.runlog import follow_log, folded_rows

    lines = [(run, step, float(run + step), None if run % 2 else 1.0 / (step + 1), 0.5) for run in range(40) for step in range(14)]
    lines += [(None, step, 1.0, 2.0, 0.5) for step in range(14)]
    schema = "run bigint, step bigint, loss double, val_bpb double, dt double"
    for part in (lines[1::2], lines[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow_log(stream, str(tmp_path / "out")).awaitTermination()
    rows = {(r.run, r.step): r for r in folded_rows(spark, str(tmp_path / "out")).collect()}
    assert len(rows) == len(lines)
    for run, step, _, val, _ in lines:
        r = rows[run, step]
        assert r.best == val and abs(r.total_time - 0.5 * max(0, step - 10)) < 1e-9
        sums = sum((0.9 ** (step - i)) * 0.1 * (1 if run is None else run + i) for i in range(step + 1))
        assert abs(r.debiased - sums / (1 - 0.9 ** (step + 1))) < 1e-6
