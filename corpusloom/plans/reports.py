"""Report queries: events give sections and values, parts give device names."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import CHAT_METRICS, EXPECTED_SECTIONS, HOURLY_RATES
from corpusloom.operators import reports
from corpusloom.plans.tables import table

METRICS = ["CORE", *CHAT_METRICS]
MANY = 10_000
# Two more names than expected sections; the last event of a run in a section is its text.
TITLES = [*EXPECTED_SECTIONS, "Side Notes", "Header"]


def _sections(spark, sf_dir):
    """``(run, section, body)``: what a run's latest event says in each section.

    Bodies hold a time (now and then an unreadable one), metric lines, a line without a colon and
    one with two.
    """
    titles = F.array(*[F.lit(t) for t in TITLES])
    names = F.array(*[F.lit(m) for m in METRICS])
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "value")
    # The hash-like product mixes the runs' sections; half of the names stay unused in short runs.
    section = F.element_at(titles, F.expr(f"cast((event_id * 7 + run) % {len(TITLES)} + 1 as int)"))
    latest = events.groupBy("run", section.alias("section")).agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("e"))
    e, value = F.col("e.event_id"), F.col("e.value").cast("decimal(18,2)").cast("string")
    stamp = F.when(e % 5 == 0, "yesterday").otherwise(
        F.format_string("2024-%02d-%02d %02d:%02d:%02d", e % 12 + 1, e % 28 + 1, e % 24, e % 60, e % 59)
    )
    name = F.element_at(names, (e % len(METRICS) + 1).cast("int"))
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), F.col("section")),
        F.concat(F.lit("timestamp: "), stamp),
        F.lit(""),
        F.concat(F.lit("- "), name, F.lit(": "), value),
        F.concat(F.lit("- GSM8K: "), (e % 100).cast("string"), F.lit(": late")),
        F.concat(F.lit("note on MMLU without value")),
        F.concat(F.lit("- ChatCORE: "), F.lit("0."), (e % 1000).cast("string")),
    )
    return latest.select("run", "section", body.alias("body"))


def slugify(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" Made By "), "p_brand")
    return parts.select("p_partkey", reports.slugify(title).alias("slug"))


def _lines(spark, sf_dir):
    return reports.section_lines(_sections(spark, sf_dir))


def extract_metrics(spark, sf_dir):
    return reports.extract_metrics(_lines(spark, sf_dir), METRICS, ["run", "section"])


def extract_metrics_exact(spark, sf_dir):
    return reports.extract_metrics(_lines(spark, sf_dir), METRICS, ["run", "section"], exact=True)


def extract_metrics_many(spark, sf_dir):
    """The metric names and ten thousand decimals as keys, in one pass over each line."""
    return reports.extract_many(_lines(spark, sf_dir), METRICS + [f"0.{i}" for i in range(MANY)], ["run", "section"])


def extract_timestamp(spark, sf_dir):
    times = reports.extract_timestamp(_lines(spark, sf_dir), "timestamp:", ["run", "section"])
    return times.withColumn("ts", F.col("ts").cast("string"))


def section_coverage(spark, sf_dir):
    return reports.section_coverage(_sections(spark, sf_dir))


def section_report(spark, sf_dir):
    return reports.join_sections(_sections(spark, sf_dir))


def summary_pivot(spark, sf_dir):
    return reports.summary_pivot(reports.stage_metrics(_lines(spark, sf_dir)))


def wall_clock(spark, sf_dir):
    starts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        F.make_timestamp_ntz(
            F.lit(2023), F.lit(12), (F.min("event_id") % 28 + 1).cast("int"), F.lit(3), F.lit(4), F.lit(5)
        ).alias("ts")
    )
    times = reports.extract_timestamp(_lines(spark, sf_dir), "timestamp:", ["run", "section"])
    return reports.wall_clock(starts, times)


def format_metrics(spark, sf_dir):
    """Every event as a report line: reals, integers, text and absent values."""
    events = table(spark, sf_dir, "events")
    real = F.when(F.col("event_type") == "view", F.col("value") / 7)
    whole = F.when(F.col("event_type").isin("click", "error"), F.col("event_id") * 3 - 5000)
    text = F.when(F.col("event_type") == "purchase", F.col("props"))
    shown = reports.format_value(whole, real, text)
    return events.select("event_id", reports.metric_line(F.col("event_type"), shown).alias("line"))


def rate_lookup(spark, sf_dir):
    """Price of each part read as a device: its size is the count, its key the hours."""
    parts = table(spark, sf_dir, "part")
    names = F.array(*[F.lit(n) for n, _ in HOURLY_RATES], F.lit("B200"))
    device = F.when(F.col("p_partkey") % 9 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("device "), F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")), F.lit(" "), "p_type")
    )
    priced = parts.select(
        "p_partkey", device.alias("device"), reports.hourly_rate(device, F.col("p_size")).alias("rate")
    )
    hours = F.col("p_partkey") % 10
    return priced.select(
        "p_partkey",
        "device",
        F.round("rate", 6).alias("rate"),
        F.round(reports.estimated_total(F.col("rate"), hours), 6).alias("estimated_total"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        slugify,
        extract_metrics,
        extract_metrics_exact,
        extract_metrics_many,
        extract_timestamp,
        section_coverage,
        section_report,
        summary_pivot,
        wall_clock,
        format_metrics,
        rate_lookup,
    )
}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_STAMP = (
    "case when e % 5 = 0 then 'yesterday' else"
    " printf('2024-%02d-%02d %02d:%02d:%02d', e % 12 + 1, e % 28 + 1, e % 24, e % 60, e % 59) end"
)
_SECTIONS = f"""
latest as (
  select user_id as run, {_list(TITLES)}[(event_id * 7 + user_id) % {len(TITLES)} + 1] as section,
    max(event_id) as e, arg_max(value, event_id) as value
  from events group by all),
sections as (
  select run, section, '## ' || section || chr(10) || 'timestamp: ' || {_STAMP} || chr(10) || chr(10)
    || '- ' || {_list(METRICS)}[e % {len(METRICS)} + 1] || ': ' || value::decimal(18,2)::varchar || chr(10)
    || '- GSM8K: ' || e % 100 || ': late' || chr(10) || 'note on MMLU without value' || chr(10)
    || '- ChatCORE: 0.' || e % 1000 as body
  from latest),
lines as (
  select run, section, unnest(ls) as line, unnest(range(len(ls))) as line_no
  from (select run, section, string_split(body, chr(10)) as ls from sections)),
keys as (select unnest({_list(METRICS)}) as key),
stamps as (
  select run, section, arg_min(try_strptime(trim(substr(line, 11)), '%Y-%m-%d %H:%M:%S'), line_no)
    filter (starts_with(line, 'timestamp:') and try_strptime(trim(substr(line, 11)), '%Y-%m-%d %H:%M:%S') is not null) as ts
  from lines group by all),
expected as (select unnest({_list(EXPECTED_SECTIONS)}) as section, unnest(range({len(EXPECTED_SECTIONS)})) as section_no)"""

_VALUE = "arg_max_null(trim(string_split(line, ':')[2]), line_no)"
_WANTED = f"""
wanted as (
  select 'base-model-evaluation' as section, 'base' as stage, 'CORE' as key
  union all select s.section, s.stage, unnest({_list(CHAT_METRICS)})
    from (values ('chat-evaluation-mid', 'mid'), ('chat-evaluation-sft', 'sft')) s(section, stage)
  union all select 'chat-evaluation-rl', 'rl', 'GSM8K'),
found as (
  select run, stage, key, {_VALUE} as value from lines join wanted using (section) where contains(line, key) group by all)"""

ORACLE = {
    "slugify": "select p_partkey, replace(lower(p_name || ' Made By ' || p_brand), ' ', '-') as slug from part",
    "extract_metrics": f"""
with {_SECTIONS}
select run, section, key, {_VALUE} as value from lines join keys on contains(line, key) group by all""",
    "extract_metrics_many": f"""
with {_SECTIONS},
every as (select key from keys union all select '0.' || i from range({MANY}) r(i))
select run, section, key, {_VALUE} as value from lines join every on contains(line, key) group by all""",
    "extract_metrics_exact": f"""
with {_SECTIONS}
select run, section, key, {_VALUE} as value from lines join keys
  on line = key or starts_with(line, '- ' || key || ':') group by all""",
    "extract_timestamp": f"""
with {_SECTIONS} select run, section, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from stamps""",
    "section_coverage": f"""
with {_SECTIONS}
select run, section_no::int as section_no, x.section, s.section is not null as present
from (select distinct run from sections) r cross join expected x left join sections s using (run, section)""",
    "section_report": f"""
with {_SECTIONS}
select run, string_agg(body || chr(10), '' order by section_no) as report
from sections join expected using (section) group by run""",
    "summary_pivot": f"""
with {_SECTIONS}, {_WANTED}
select run, (case key when 'CORE' then 0 when 'ChatCORE' then 2 else 1 end)::int as place, key as metric,
  coalesce(max(value) filter (stage = 'base'), '-') as base, coalesce(max(value) filter (stage = 'mid'), '-') as mid,
  coalesce(max(value) filter (stage = 'sft'), '-') as sft, coalesce(max(value) filter (stage = 'rl'), '-') as rl
from found group by run, key""",
    "wall_clock": f"""
with {_SECTIONS},
starts as (
  select user_id as run, make_timestamp(2023, 12, (min(event_id) % 28 + 1), 3, 4, 5.0) as start_ts from events group by user_id),
ends as (
  select run, arg_max_null(ts, section_no) as end_ts from stamps join expected using (section)
  where not contains(section, 'rl') group by run),
spans as (select run, date_diff('second', start_ts, end_ts) as s from starts left join ends using (run))
select run, case when s is null then 'unknown' else (s // 3600) || 'h' || (s % 3600 // 60) || 'm' end as wall_clock from spans""",
    "format_metrics": """
select event_id, '- ' || event_type || ': ' || case
  when event_type = 'view' then printf('%.4f', value / 7)
  when event_type in ('click', 'error') then
    case when event_id * 3 - 5000 >= 10000 then format('{:,}', event_id * 3 - 5000) else (event_id * 3 - 5000)::varchar end
  when event_type = 'purchase' then coalesce(props, 'None') else 'None' end as line
from events""",
    "rate_lookup": f"""
with devices as (
  select *, case when p_partkey % 9 <> 0 then
    'device ' || {_list([n for n, _ in HOURLY_RATES] + ["B200"])}[p_partkey % 6 + 1] || ' ' || p_type end as device
  from part),
priced as (
  select p_partkey, device, case when device is not null then
    ({[float(p) for _, p in HOURLY_RATES] + [2.0]}::double[])[p_partkey % 6 + 1] * p_size end as rate from devices)
select p_partkey, device, round(rate, 6) as rate,
  round(case when p_partkey % 10 <> 0 then rate * (p_partkey % 10) end, 6) as estimated_total
from priced""",
}
