"""Corpus queries: scan, split, stride, micro-batches, manifest, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import byte_ids, joined
from corpusloom.operators.codec import with_ends
from corpusloom.operators.runs import cut_runs, in_runs
from corpusloom.plans.oracle_parts import byte_list
from corpusloom.plans.tables import BOS, documents, numbered_documents
from corpusloom.sources import corpus
from corpusloom.sources.row_group_reader import rank_groups, read_rank_groups, stream_groups
from corpusloom.staging import fresh_path
from corpusloom.streaming.cut import cut_lane, cut_rows

GROUP_ROWS, BATCH_ROWS, WORLD, WANTED = 16, 8, 4, 25
# No multiple of the group size, so that the last group of a file is a short one.
FILE_ROWS = 1000
# Training rows of a lane: rows a batch, tokens a row.
LANE_ROWS, LANE_TOKENS = 2, 1024
# Streamed lanes, how often each reads its groups, groups of a micro-batch, and bytes it may grow to while there is more to read.
LANES, EPOCHS, GROUPS_A_TRIGGER, CATCH_UP = 2, 2, 24, 256 << 20


def corpus_scan(spark, sf_dir):
    return corpus.read_corpus(spark, f"{sf_dir}/documents.parquet")


def train_val_split(spark, sf_dir):
    return corpus.with_split(documents(spark, sf_dir)).select("shard", "row_index", "split")


def rank_partition(spark, sf_dir):
    return corpus.with_rank(numbered_documents(spark, sf_dir), WORLD, GROUP_ROWS)


def _grouped_files(spark, sf_dir, *keep):
    """Files with up to ``FILE_ROWS`` documents of one shard in row groups of ``GROUP_ROWS``."""
    path = fresh_path(spark, "grouped")
    docs = numbered_documents(spark, sf_dir).withColumn("file_no", F.expr(f"row_index div {FILE_ROWS}"))
    if keep:
        texts = documents(spark, sf_dir).select("shard", F.col("row_index").alias("doc_id"), *keep)
        docs = docs.join(texts, ["shard", "doc_id"])
    placed = docs.select("shard", "file_no", "doc_id", F.col("row_index").alias("_at"), *keep).repartition("shard", "file_no")
    writer = placed.sortWithinPartitions("shard", "file_no", "_at").write.partitionBy("shard", "file_no")
    writer.option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)
    return path


def row_group_partition(spark, sf_dir):
    """Ranks over the real row groups of files with up to ``FILE_ROWS`` documents of one shard."""
    path = _grouped_files(spark, sf_dir)
    rows = spark.read.parquet(path).select(
        "shard", F.col("file_no").cast("bigint").alias("file_no"), "doc_id",
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"),
    )
    found = corpus.with_row_group(rows, corpus.row_groups(spark, path)).drop("file")
    return found.withColumn("rank", F.pmod("row_group", F.lit(WORLD)))


def _in_path(name, kind):
    return F.regexp_extract("file", rf"/{name}=([^/]*)/", 1).cast(kind).alias(name)


def rank_read(spark, sf_dir):
    """What every rank reads: only its own row groups are opened."""
    path = _grouped_files(spark, sf_dir, "text")
    found = None
    for rank in range(WORLD):
        rows = read_rank_groups(spark, path, rank, WORLD, "doc_id bigint, text string").withColumn("rank", F.lit(rank))
        found = rows if found is None else found.unionByName(rows)
    shown = (_in_path("shard", "string"), _in_path("file_no", "bigint"), "row_group", "row_index", "doc_id", "text")
    return found.select("rank", *shown)


def rank_batches(spark, sf_dir):
    """The training rows of every rank's lane, cut from its row groups where they are read."""
    path = _grouped_files(spark, sf_dir, "text")
    found = None
    for rank in range(WORLD):
        runs = in_runs(read_rank_groups(spark, path, rank, WORLD), lambda text: with_ends(byte_ids(text), prepend=BOS))
        rows = cut_runs(runs, LANE_ROWS, LANE_TOKENS).withColumn("rank", F.lit(rank))
        found = rows if found is None else found.unionByName(rows)
    return found.select("rank", "batch_id", "row_in_batch", joined(F.col("inputs")).alias("inputs"), joined(F.col("targets")).alias("targets"))


def lane_stream(spark, sf_dir):
    """Training rows of two lanes that read their row groups ``EPOCHS`` times over, as a stream in micro-batches."""
    path = _grouped_files(spark, sf_dir, "text")
    running = []
    for rank in range(LANES):
        sink, groups = fresh_path(spark, "lane"), rank_groups(spark, path, rank, LANES)
        lane = stream_groups(groups, f"{sink}/progress/at", GROUPS_A_TRIGGER, epochs=EPOCHS, catch_up=CATCH_UP)
        running.append((rank, sink, cut_lane(lane, sink, byte_ids, BOS, LANE_ROWS, LANE_TOKENS)))
    found = None
    try:
        for rank, sink, query in running:
            query.processAllAvailable()
            rows = cut_rows(spark, sink).withColumn("rank", F.lit(rank))
            found = rows if found is None else found.unionByName(rows)
    finally:
        for _, _, query in running:
            query.stop()
    return found.select("rank", "batch_id", "row_in_batch", joined(F.col("inputs")).alias("inputs"), joined(F.col("targets")).alias("targets"))


def doc_batches(spark, sf_dir):
    return corpus.with_doc_batch(numbered_documents(spark, sf_dir), GROUP_ROWS, BATCH_ROWS)


def shard_manifest(spark, sf_dir):
    return corpus.shard_manifest(documents(spark, sf_dir), WANTED, "src%d")


def shard_manifest_totals(spark, sf_dir):
    return corpus.manifest_totals(shard_manifest(spark, sf_dir))


def corpus_profile(spark, sf_dir):
    return corpus.size_profile(documents(spark, sf_dir), "shard")


def corpus_rejects(spark, sf_dir):
    """Texts shorter than 200 bytes count as missing here, for the tables have no null texts."""
    text = F.when(F.octet_length("text") >= 200, F.col("text"))
    return corpus.reject_null_text(documents(spark, sf_dir).withColumn("text", text))[1]


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan,
        train_val_split,
        rank_partition,
        row_group_partition,
        rank_read,
        rank_batches,
        lane_stream,
        doc_batches,
        shard_manifest,
        shard_manifest_totals,
        corpus_profile,
        corpus_rejects,
    )
}

_NUMBERED = """select source as shard, doc_id,
  row_number() over (partition by source order by doc_id) - 1 as row_index from documents"""

def _lanes(world):
    return f"""
lanes as (
  select rank, text, doc_id, shard, row_index, shard as s, (row_index // {FILE_ROWS})::varchar as f, row_index % {FILE_ROWS} as r
  from (select n.*, d.text, (n.row_index % {FILE_ROWS}) // {GROUP_ROWS} % {world} as rank
    from ({_NUMBERED}) n join documents d using (doc_id)))"""


def _lane_rows(world, epochs):
    """Batches of every lane that reads its documents ``epochs`` times."""
    return f"""
with {_lanes(world)},
placed as (
  select rank, text, sum(strlen(text) + 1) over (partition by rank order by epoch, s, f, r) - strlen(text) - 1 as start_pos
  from lanes, range({epochs}) e(epoch)),
tokens as (
  select rank, start_pos + i as pos, t from (
    select rank, start_pos, unnest(ids) as t, unnest(range(len(ids))) as i
    from (select rank, start_pos, list_prepend({BOS}, {byte_list("text")}) as ids from placed)))
select i.rank::int as rank, i.k::bigint as batch_id, i.q::int as row_in_batch, inputs, targets from (
  select rank, pos // {_SPAN} as k, (pos % {_SPAN}) // {LANE_TOKENS} as q, string_agg(t::varchar, ' ' order by pos) as inputs
  from tokens where pos % {_SPAN} < {LANE_ROWS * LANE_TOKENS} group by all) i
join (
  select rank, pos // {_SPAN} as k, (pos % {_SPAN} - 1) // {LANE_TOKENS} as q, string_agg(t::varchar, ' ' order by pos) as targets
  from tokens where pos % {_SPAN} > 0 group by all) t using (rank, k, q)
join (select rank, count(*) // {_SPAN} as full_batches from tokens group by rank) c on c.rank = i.rank
where i.k < full_batches"""


_SPAN = LANE_ROWS * LANE_TOKENS + 1

ORACLE = {
    "rank_read": f"""
with {_lanes(WORLD)}
select rank::int as rank, shard, row_index // {FILE_ROWS} as file_no, r // {GROUP_ROWS} as row_group, r as row_index, doc_id, text
from lanes""",
    "rank_batches": _lane_rows(WORLD, 1),
    "lane_stream": _lane_rows(LANES, EPOCHS),
    "corpus_rejects": """
select source as shard, doc_id as row_index, 'null_text' as reason from documents where strlen(text) < 200""",
    "corpus_scan": "select 'documents.parquet' as shard, doc_id as row_index, text from documents",
    "train_val_split": """
select source as shard, doc_id as row_index,
  case when source = (select max(source) from documents) then 'val' else 'train' end as split
from documents""",
    "rank_partition": f"""
select *, row_index // {GROUP_ROWS} as row_group, (row_index // {GROUP_ROWS}) % {WORLD} as rank from ({_NUMBERED})""",
    "row_group_partition": f"""
select shard, row_index // {FILE_ROWS} as file_no, doc_id, row_index % {FILE_ROWS} as row_index,
  (row_index % {FILE_ROWS}) // {GROUP_ROWS} as row_group, (row_index % {FILE_ROWS}) // {GROUP_ROWS} % {WORLD} as rank
from ({_NUMBERED})""",
    "doc_batches": f"""
select *, row_index // {GROUP_ROWS} as row_group, (row_index % {GROUP_ROWS}) // {BATCH_ROWS} as doc_batch
from ({_NUMBERED})""",
    "shard_manifest": f"""
select i as shard_no, 'src' || i as shard, ('src' || i) in (select source from documents) as present
from range({WANTED}) t(i)""",
    "shard_manifest_totals": f"""
select count(*) filter (('src' || i) in (select source from documents)) as successful, count(*) as total
from range({WANTED}) t(i)""",
    "corpus_profile": """
select source as shard, sum(length(text))::bigint as characters,
  sum(len(string_split(text, chr(10))))::bigint as lines, count(*) as files,
  (sum(length(text)) // 4)::bigint as approx_tokens
from documents group by source""",
}
