"""Per-step checkpoint metadata: one JSON record in each step folder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from pyspark.sql.types import DataType, StructType

from corpusloom.staging import filesystem, qualified, stage

CONFIG_FIELDS = ("sequence_len", "vocab_size", "n_layer", "n_head", "n_kv_head", "n_embd")
METADATA_SCHEMA = (
    "step bigint, val_bpb double, model_config struct<"
    + ", ".join(f"{f}: bigint" for f in CONFIG_FIELDS)
    + ">, num_params bigint, total_tokens bigint"
)


class RunMetadataSource(DataSource):
    """Text of the metadata files under a folder: ``(run, dir_step, text)``.

    File sources skip names with a leading underscore, as these files have.
    """

    @classmethod
    def name(cls) -> str:
        return "run_metadata"

    def schema(self) -> str:
        return "run string, dir_step bigint, text string"

    def reader(self, schema) -> DataSourceReader:
        return _MetadataReader(self.options["path"], int(self.options.get("tasks", 32)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _MetadataWriter(self.options["path"])


@dataclass
class _Folders(InputPartition):
    """Paths right below the root."""

    held: list


class _MetadataReader(DataSourceReader):
    """The planner lists the folders right below the root; tasks list and read what is in them."""

    # Folders of a task: a task's start takes as long as some hundred files, so their number follows the cores up to the larger one.
    FOLDERS, MOST_FOLDERS = 16, 8192
    FOLDER = re.compile(r"([^/=]+)/(?:step=)?(\d+)/_metadata\.json$")

    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path, tasks

    def partitions(self):
        system, root = filesystem(self.path)
        held = [f.path for f in system.get_file_info(fs.FileSelector(root))]
        each = min(max(self.FOLDERS, -(-len(held) // self.tasks)), self.MOST_FOLDERS)
        return [_Folders(held[i : i + each]) for i in range(0, len(held), each)] or [_Folders([])]

    def read(self, part: _Folders) -> Iterator[tuple]:
        system, _ = filesystem(self.path)
        for path in part.held:
            found = system.get_file_info(path)
            files = system.get_file_info(fs.FileSelector(path, recursive=True)) if found.type == fs.FileType.Directory else [found]
            for f in files:
                if m := self.FOLDER.search(f.path):
                    with system.open_input_stream(f.path) as file:
                        yield m.group(1), int(m.group(2)), file.read().decode("utf-8")


class _MetadataWriter(DataSourceWriter):
    """One file per row.  A repeated task writes the same bytes to the same names."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = filesystem(self.path)
        for row in rows:
            folder = f"{root}/{row.run}/{row.dir_step}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/_metadata.json") as file:
                file.write(row.text.encode("utf-8"))
        return WriterCommitMessage()


def _texts(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RunMetadataSource)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("run_metadata").option("tasks", tasks).load(qualified(spark, path))


def read_run_metadata(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    """``(run, dir_step, extra STRUCT)`` from ``<path>/<run>/<step>/_metadata.json``.

    Folder names may be plain or ``name=value``.
    """
    texts = _texts(spark, path)
    extra = F.from_json("text", schema, {"allowNonNumericNumbers": "true"})
    return texts.select("run", "dir_step", extra.alias("extra"))


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """``(run, dir_step, record VARIANT)``: whole records, fields of no schema included; NULL if a text is no JSON.

    Bare NaN and infinities, which JSON does not have, are read as null.
    """
    texts = _texts(spark, path)
    plain = F.regexp_replace("text", r"(?<=[:\[,])\s*(?:NaN|-?Infinity)(?=\s*[,}\]])", "null")
    record = F.coalesce(F.try_parse_json(F.col("text")), F.try_parse_json(plain))
    return texts.select("run", "dir_step", record.alias("record"))


def known_fields(records: DataFrame, schema: str = METADATA_SCHEMA) -> DataFrame:
    """``record`` shredded into the typed struct ``extra``; a field that is missing or of another type is NULL."""
    wanted = StructType.fromDDL(schema)

    def shred(path: str, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*[shred(f"{path}.{f.name}", f.dataType).alias(f.name) for f in kind.fields])
        return F.try_variant_get("record", path, kind.simpleString())

    fields = [shred(f"$.{f.name}", f.dataType).alias(f.name) for f in wanted.fields]
    return records.withColumn("extra", F.when(F.col("record").isNotNull(), F.struct(*fields)))


def unknown_fields(records: DataFrame, schema: str = METADATA_SCHEMA) -> DataFrame:
    """``(run, dir_step, path, value VARIANT)``: the fields of records that ``schema`` does not list, at any depth it has."""

    def below(rows: DataFrame, prefix: str, kind: StructType) -> DataFrame:
        spark = rows.sparkSession
        fields = rows.lateralJoin(spark.tvf.variant_explode(F.col("_at").outer()))
        strangers = fields.where(~F.col("key").isin([f.name for f in kind.fields])).select(
            "run", "dir_step", F.concat(F.lit(prefix), "key").alias("path"), "value"
        )
        for f in kind.fields:
            if isinstance(f.dataType, StructType):
                inner = fields.where(F.col("key") == f.name).select("run", "dir_step", F.col("value").alias("_at"))
                strangers = strangers.unionByName(below(inner, f"{prefix}{f.name}.", f.dataType))
        return strangers

    # Every level reads the records again, and each is a file.
    whole = stage(records.where("record is not null").select("run", "dir_step", F.col("record").alias("_at")), "records")
    return below(whole, "", StructType.fromDDL(schema))


def run_catalog(steps: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every saved step with its metadata; an empty record when none was written."""
    found = metadata.withColumnRenamed("dir_step", "step")
    return steps.join(found, ["run", "step"], "left")


def metadata_json(catalog: DataFrame) -> DataFrame:
    """``extra`` as one line of plain JSON scalars, ``{}`` when there is none."""
    return catalog.withColumn("extra_json", F.coalesce(F.to_json("extra"), F.lit("{}")))


def write_run_metadata(records: DataFrame, path: str) -> str:
    """Write ``(run, step, extra)`` as ``<path>/<run>/<step>/_metadata.json``."""
    records.sparkSession.dataSource.register(RunMetadataSource)
    # A struct or a VARIANT.
    texts = records.select(
        F.col("run").cast("string").alias("run"), F.col("step").cast("bigint").alias("dir_step"), F.to_json("extra").alias("text")
    )
    # Rows are short and files are slow: without a number of tasks the planner would put all of them into a few.
    spread = texts.repartition(4 * records.sparkSession.sparkContext.defaultParallelism, "run", "dir_step")
    spread.write.format("run_metadata").mode("append").save(qualified(records.sparkSession, path))
    return path
