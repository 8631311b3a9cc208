"""Run reports: section text to metrics, coverage, summary tables and wall-clock time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import (
    CHAT_METRICS,
    DEFAULT_HOURLY_RATE,
    EXPECTED_SECTIONS,
    HOURLY_RATES,
)

# Largest list of keys that is sent to tasks, in bytes.
MAX_KEY_BYTES = 64 << 20
STAGES = ["base", "mid", "sft", "rl"]
# Which section feeds which column of the summary, and the keys looked for in it.
STAGE_SOURCES = {
    "base-model-evaluation": ("base", ["CORE"]),
    "chat-evaluation-mid": ("mid", CHAT_METRICS),
    "chat-evaluation-sft": ("sft", CHAT_METRICS),
    "chat-evaluation-rl": ("rl", ["GSM8K"]),
}
_STAMP = r"^(\d{4})-(\d{1,2})-(\d{1,2}) +(\d{1,2}):(\d{1,2}):(\d{1,2})$"


def slugify(title: Column) -> Column:
    return F.replace(F.lower(title), F.lit(" "), F.lit("-"))


def section_lines(sections: DataFrame) -> DataFrame:
    """``body`` of each section as rows ``(..., line_no, line)``."""
    kept = [c for c in sections.columns if c != "body"]
    # A limit of -1 keeps empty lines at the end.
    return sections.select(*kept, F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))


def extract_metrics(lines: DataFrame, keys: list[str] | Column, by: list[str], exact: bool = False) -> DataFrame:
    """``(by..., key, value)``: the last line that contains each key, its text between two colons.

    Keys match anywhere in a line, so one key may sit inside another; ``exact`` compares the whole
    name in ``- name: value`` instead.  A matching line without a colon gives NULL.
    """
    wanted = keys if isinstance(keys, Column) else F.array(*[F.lit(k) for k in keys])
    name = F.trim(F.regexp_replace(F.split("line", ":")[0], r"^\s*-\s*", ""))
    matches = (lambda k: name == k) if exact else (lambda k: F.contains(F.col("line"), k))
    hits = lines.select(*by, "line_no", "line", F.explode(F.filter(wanted, matches)).alias("key"))
    value = F.trim(F.get(F.split("line", ":"), F.lit(1)))
    return hits.groupBy(*by, "key").agg(F.max_by(value, F.col("line_no")).alias("value"))


def key_matcher(spark: SparkSession, keys: list[str]) -> Callable[[Column], Column]:
    """A function from a text column to the 0-based places in ``keys`` of the keys it contains, in ascending order.

    One automaton finds all keys in one pass over a text, however many there are; it is built
    once per task from the broadcast keys, whose bytes are checked.  An empty key is in every text; a null text
    gives NULL.
    """
    size = sum(len(k.encode()) + 8 for k in keys)
    if size > MAX_KEY_BYTES:
        raise ValueError(f"the keys take {size} bytes; the limit is {MAX_KEY_BYTES}")
    shared = spark.sparkContext.broadcast(list(keys))

    @F.arrow_udf("array<int>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: dict[str, list[int]] = {}
        for place, key in enumerate(shared.value):
            held.setdefault(key, []).append(place)
        everywhere = held.pop("", [])
        automaton = ahocorasick.Automaton()
        for key, found in held.items():
            automaton.add_word(key, found)
        automaton.make_automaton()
        search = automaton.iter if held else lambda text: ()
        for texts in batches:
            hits = [
                None if text is None else sorted({p for _, found in search(text) for p in found}.union(everywhere))
                for text in texts.to_pylist()
            ]
            yield pa.array(hits, pa.list_(pa.int32()))

    return lambda text: places(text)


def extract_many(lines: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """As ``extract_metrics`` for any number of keys: each line is read once.

    Repeated keys count once.  A line that several keys are in gives a row for each before the last ones are
    taken, combined before the shuffle.
    """
    distinct = sorted(set(keys))
    spark = lines.sparkSession
    found = lines.select(*by, "line_no", "line", F.explode(key_matcher(spark, distinct)(F.col("line"))).alias("place"))
    value = F.trim(F.get(F.split("line", ":"), F.lit(1)))
    last = found.groupBy(*by, "place").agg(F.max_by(value, F.col("line_no")).alias("value"))
    names = spark.createDataFrame(list(enumerate(distinct)), "place int, key string")
    return last.join(names, "place").select(*by, "key", "value")


def first_key(spark: SparkSession, text: Column, keys: list[str]) -> Column:
    """Place of the first of ``keys``, in their order, that ``text`` contains; NULL if none is in it."""
    return F.get(key_matcher(spark, keys)(text), F.lit(0))


def parse_stamp(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` as a timestamp without zone; NULL when it is none."""
    parts = [F.regexp_extract(text, _STAMP, i).try_cast("int") for i in range(1, 7)]
    return F.try_make_timestamp_ntz(*parts[:5], parts[5].cast("decimal(8,6)"))


def extract_timestamp(lines: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """``(by..., ts)``: the first line with ``prefix`` whose time can be read, else NULL."""
    after_colon = F.trim(F.get(F.split("line", ":", 2), F.lit(1)))
    stamp = F.when(F.startswith(F.col("line"), F.lit(prefix)), parse_stamp(after_colon))
    order = F.when(stamp.isNotNull(), F.col("line_no"))
    return lines.groupBy(*by).agg(F.min_by(stamp, order).alias("ts"))


def section_coverage(sections: DataFrame, expected: list[str] = EXPECTED_SECTIONS) -> DataFrame:
    """``(run, section_no, section, present)``: every expected section of every run, in order."""
    spot = F.array_position(F.array(*[F.lit(s) for s in expected]), F.col("section"))
    found = sections.filter(F.col("section").isin(expected)).withColumn("section_no", (spot - 1).cast("int"))
    seen = found.groupBy("run", "section_no").agg(F.lit(True).alias("present"))
    names = F.array(*[F.lit(s) for s in expected])
    wanted = sections.select("run").distinct().select("run", F.posexplode(names).alias("section_no", "section"))
    return wanted.join(seen, ["run", "section_no"], "left").select(
        "run", "section_no", "section", F.coalesce("present", F.lit(False)).alias("present")
    )


def join_sections(sections: DataFrame, expected: list[str] = EXPECTED_SECTIONS) -> DataFrame:
    """``(run, report)``: the expected sections of a run put together in order."""
    spot = F.array_position(F.array(*[F.lit(s) for s in expected]), F.col("section"))
    # At most one row per expected section and run is gathered.
    kept = sections.filter(F.col("section").isin(expected)).select("run", spot.alias("no"), "body")
    bodies = F.array_sort(F.collect_list(F.struct("no", "body")))
    return kept.groupBy("run").agg(
        F.array_join(F.transform(bodies, lambda b: F.concat(b["body"], F.lit("\n"))), "").alias("report")
    )


def stage_metrics(lines: DataFrame) -> DataFrame:
    """``(run, stage, key, value)`` from the lines of the evaluation sections."""
    stage, keys = F.lit(None).cast("string"), F.array().cast("array<string>")
    for section, (name, wanted) in STAGE_SOURCES.items():
        here = F.col("section") == section
        stage = F.when(here, name).otherwise(stage)
        keys = F.when(here, F.array(*[F.lit(k) for k in wanted])).otherwise(keys)
    tagged = lines.withColumn("stage", stage).filter(F.col("stage").isNotNull())
    return extract_metrics(tagged, keys, ["run", "stage"])


def summary_pivot(metrics: DataFrame) -> DataFrame:
    """``(run, place, metric, base, mid, sft, rl)``: missing values ``-``; CORE first, ChatCORE last."""
    wide = metrics.groupBy("run", F.col("key").alias("metric")).pivot("stage", STAGES).agg(F.first("value"))
    place = F.when(F.col("metric") == "CORE", 0).when(F.col("metric") == "ChatCORE", 2).otherwise(1)
    return wide.fillna("-", STAGES).select("run", place.alias("place"), "metric", *STAGES)


def wall_clock(starts: DataFrame, section_times: DataFrame) -> DataFrame:
    """``(run, wall_clock)`` as ``XhYm``, from the start to the last section that is not RL.

    The last such section counts even when its time could not be read; then the result is
    ``unknown``.  Sections other than the expected ones do not count.
    """
    spot = F.array_position(F.array(*[F.lit(s) for s in EXPECTED_SECTIONS]), F.col("section"))
    counted = section_times.filter(F.col("section").isin(EXPECTED_SECTIONS) & ~F.contains("section", F.lit("rl")))
    ends = counted.groupBy("run").agg(F.max_by("ts", spot).alias("end_ts"))
    both = starts.join(ends, "run", "left")
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.col("end_ts"))
    shown = F.format_string("%dh%dm", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60))
    return both.select("run", F.when(seconds.isNull(), "unknown").otherwise(shown).alias("wall_clock"))


def format_value(whole: Column, real: Column, text: Column) -> Column:
    """A report value, of which one of three typed columns is set.

    Reals get four decimals (rounded on the binary value), integers from 10,000 up get thousands
    separators, everything else is printed as it is and an absent value as ``None``.
    """
    decimals = F.replace(F.format_number(real, 4), F.lit(","), F.lit(""))
    infinite = F.when(real > 0, "inf").otherwise("-inf")
    shown = F.when(F.isnan(real), "nan").when(F.abs(real) == float("inf"), infinite).otherwise(decimals)
    return (
        F.when(real.isNotNull(), shown)
        .when(whole >= 10000, F.format_number(whole, 0))
        .when(whole.isNotNull(), whole.cast("string"))
        .otherwise(F.coalesce(text, F.lit("None")))
    )


def metric_line(name: Column, value: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(": "), value)


def hourly_rate(device: Column, count: Column) -> Column:
    """Price per hour of ``count`` devices: the first listed name inside the device name."""
    rate = F.when(device.isNull(), None)
    for name, price in HOURLY_RATES:
        rate = rate.when(F.contains(device, F.lit(name)), price)
    return rate.otherwise(DEFAULT_HOURLY_RATE) * count


def estimated_total(rate: Column, hours: Column) -> Column:
    """Price of ``hours``; NULL when no time is given, as for 0."""
    return F.when(hours != 0, rate * hours)
