"""Sequence queries on byte tokens: offsets, stream batches, packing, token shards, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import SHARD_MAGIC, SHARD_VERSION
from corpusloom.functions.text import byte_ids, joined
from corpusloom.operators import packing, runs, sequences
from corpusloom.operators.codec import with_ends
from corpusloom.plans.oracle_parts import OFFSETS, byte_list
from corpusloom.plans.tables import BOS, byte_offsets, documents
from corpusloom.sources import token_shards
from corpusloom.staging import fresh_path, spread, stage
from corpusloom.streaming.cut import cut_rows, cut_stream, read_corpus_stream

B, T, EPOCHS = 4, 2048, 3
SPAN = B * T + 1
# Tokens per file of the token-shard queries.
FILE_TOKENS = 300_000
# First and last batch that the seeking query reads of each file.
SOUGHT = (3, 5)


def _token_docs(spark, sf_dir):
    ids = with_ends(byte_ids(F.col("text")), prepend=BOS)
    docs = spread(documents(spark, sf_dir), "shard", "row_index").select("shard", "row_index", ids.alias("ids"))
    return docs.withColumn("n", F.size("ids").cast("bigint"))


def _shown(rows, *key):
    return rows.select(*key, joined(F.col("inputs")).alias("inputs"), joined(F.col("targets")).alias("targets"))


def token_offsets(spark, sf_dir):
    return byte_offsets(spark, sf_dir)


def bos_index(spark, sf_dir):
    return sequences.bos_positions(byte_offsets(spark, sf_dir))


def multi_epoch_stream(spark, sf_dir):
    stream = sequences.repeat_epochs(byte_offsets(spark, sf_dir), EPOCHS)
    return stream.select(
        "epoch",
        "shard",
        "row_index",
        "start_pos",
        F.expr(f"start_pos div {SPAN}").alias("first_batch"),
        F.expr(f"(start_pos + n - 1) div {SPAN}").alias("last_batch"),
    )


def stream_batches(spark, sf_dir):
    """Rows are cut where the documents lie; see ``operators/runs.py``."""
    placed = runs.in_runs(documents(spark, sf_dir), lambda text: with_ends(byte_ids(text), prepend=BOS))
    rows = runs.cut_runs(placed, B, T)
    return _shown(rows, "batch_id", "row_in_batch")


def shift_targets(spark, sf_dir):
    inputs, targets = sequences.shift(F.col("ids"), F.size("ids") - 1)
    docs = _token_docs(spark, sf_dir).select(
        F.col("row_index").alias("doc_id"), inputs.alias("inputs"), targets.alias("targets")
    )
    return _shown(docs, "doc_id")


def bos_pack_plan(spark, sf_dir):
    return packing.pack_plan(byte_offsets(spark, sf_dir), B, T)


def bos_pack_batch(spark, sf_dir):
    """The batches of the plan: how many segments each has and which documents they come from."""
    return (
        bos_pack_plan(spark, sf_dir)
        .groupBy("shard", "batch_id")
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.min("ord").alias("first_ord"),
            F.max("ord").alias("last_ord"),
            F.sum(F.col("end") - F.col("start")).alias("tokens"),
        )
    )


def packed_sequences(spark, sf_dir):
    rows = packing.packed(stage(_token_docs(spark, sf_dir), "encoded"), B, T)
    return _shown(rows, "shard", "batch_id", "row_in_batch")


def packing_audit(spark, sf_dir):
    offsets = stage(byte_offsets(spark, sf_dir), "positions")
    return packing.packing_audit(offsets, stage(packing.pack_plan(offsets, B, T), "plan"))


def _token_files(spark, sf_dir):
    placed = runs.in_runs(documents(spark, sf_dir), lambda text: with_ends(byte_ids(text), prepend=BOS))
    stream = runs.positions(placed).select("start_pos", "ids")
    path = token_shards.write_token_shards(stream, fresh_path(spark, "tokens"), FILE_TOKENS)
    return path


def _file(path: str):
    return F.element_at(F.split(path, "/"), -1)


def token_shard_scan(spark, sf_dir):
    chunks = token_shards.read_token_shards(spark, _token_files(spark, sf_dir))
    return chunks.select(_file("path").alias("file"), "start", joined(F.col("ids")).alias("ids"))


def token_shard_headers(spark, sf_dir):
    """Header of every file and, if it cannot be read, why."""
    headers = token_shards.shard_headers(spark, _token_files(spark, sf_dir))
    return headers.withColumn("file", _file("path")).drop("path")


def token_shard_roundtrip(spark, sf_dir):
    index = stage(token_shards.read_bos_index(spark, _token_files(spark, sf_dir), BOS), "bos")
    docs = token_shards.shard_documents(index)
    return docs.select(_file("shard").alias("file"), F.col("row_index").alias("pos"), "n")


def token_shard_batches(spark, sf_dir):
    path = _token_files(spark, sf_dir)
    index = stage(token_shards.read_bos_index(spark, path, BOS), "bos")
    docs = stage(sequences.token_offsets(token_shards.shard_documents(index), block_docs=1 << 23), "documents")
    plan = stage(packing.pack_plan(docs, B, T), "plan")
    rows = token_shards.rows_in_chunks(plan, docs, token_shards.read_token_shards(spark, path, beyond=T), T)
    return _shown(rows.withColumn("file", _file("shard")), "file", "batch_id", "row_in_batch")


def token_shard_seek(spark, sf_dir):
    """Some batches of every token file: the skip list tells where they are, and only their bytes are read."""
    path = _token_files(spark, sf_dir)
    index = token_shards.skip_list(spark, path, BOS)
    docs = stage(sequences.token_offsets(token_shards.shard_documents(index), block_docs=1 << 23), "documents")
    plan = packing.pack_plan(docs, B, T)
    rows = token_shards.batch_rows_of(spark, path, plan, docs, T, *SOUGHT)
    return _shown(rows.withColumn("file", _file("shard")), "file", "batch_id", "row_in_batch")


def streaming_batches(spark, sf_dir):
    sink = fresh_path(spark, "streamed")
    stream = read_corpus_stream(spark, f"{sf_dir}/documents.parquet")
    cut_stream(stream, sink, byte_ids, BOS, B, T).awaitTermination()
    return _shown(cut_rows(spark, sink), "batch_id", "row_in_batch")


QUERIES = {
    f.__name__: f
    for f in (
        token_offsets,
        bos_index,
        multi_epoch_stream,
        stream_batches,
        shift_targets,
        bos_pack_plan,
        bos_pack_batch,
        packed_sequences,
        packing_audit,
        token_shard_scan,
        token_shard_headers,
        token_shard_roundtrip,
        token_shard_batches,
        token_shard_seek,
        streaming_batches,
    )
}

# One row per token: position in the corpus stream and in the shard.
_TOKENS = f"""
tokens as (
  select shard, ord, start_pos + i as pos, shard_pos + i as shard_pos, t
  from (select shard, ord, start_pos, shard_pos, unnest(ids) as t, unnest(range(len(ids))) as i
    from (select *, list_prepend({BOS}, {byte_list("text")}) as ids from offsets)))"""


def _cut(source: str) -> str:
    """Batches of B * T + 1 tokens of ``source (pos, t)``."""
    return f"""
select cast(i.k as bigint) as batch_id, cast(i.r as int) as row_in_batch, inputs, targets from (
  select pos // {SPAN} as k, (pos % {SPAN}) // {T} as r, string_agg(t::varchar, ' ' order by pos) as inputs
  from {source} where pos % {SPAN} < {B * T} group by all) i
join (
  select pos // {SPAN} as k, (pos % {SPAN} - 1) // {T} as r, string_agg(t::varchar, ' ' order by pos) as targets
  from {source} where pos % {SPAN} > 0 group by all) t using (k, r)
where i.k < (select count(*) from {source}) // {SPAN}"""


# Greedy packing of ``lens_of (shard, ord, n)``: next row start of every document, then the rows
# that are reached from document 0.
_PLAN = f"""
c as (
  select shard, ord, n, sum(n) over w - n as s, sum(n) over w as e
  from lens_of window w as (partition by shard order by ord)),
j as (
  select a.shard, a.ord as i, min(b.ord) + 1 as nxt
  from c a join c b on a.shard = b.shard and b.ord >= a.ord and b.e >= a.s + {T + 1} group by all),
r as (
  select shard, 0 as row_id, i, nxt from j where i = 0
  union all
  select r.shard, r.row_id + 1, j.i, j.nxt from r join j on j.shard = r.shard and j.i = r.nxt),
k as (
  select r.* from r join (select shard, count(*) as n_rows from r group by shard) using (shard)
  where row_id < n_rows // {B} * {B}),
plan as (
  select k.shard, (row_id // {B})::bigint as batch_id, (row_id % {B})::int as row_in_batch,
    (c.ord - k.i)::int as seg_no, c.ord::bigint as ord, c.s::bigint as start,
    least(c.e, c0.s + {T + 1})::bigint as "end", c.n
  from k join c on c.shard = k.shard and c.ord >= k.i and c.ord < k.nxt
    join c c0 on c0.shard = k.shard and c0.ord = k.i)"""

_PACK = f"with recursive {OFFSETS}, lens_of as (select shard, ord, n from offsets), {_PLAN}"


def _rows(name: str, tokens: str, pos: str) -> str:
    """Inputs and targets of planned rows from a token table."""
    return f"""
select shard as {name}, batch_id, row_in_batch,
  string_agg(t::varchar, ' ' order by spot) filter (spot < {T}) as inputs,
  string_agg(t::varchar, ' ' order by spot) filter (spot > 0) as targets
from (
  select p.shard, batch_id, row_in_batch, t,
    row_number() over (partition by p.shard, batch_id, row_in_batch order by {pos}) - 1 as spot
  from plan p join {tokens} x on x.shard = p.shard and x.ord = p.ord and {pos} >= p.start and {pos} < p."end")
group by all"""


# The stream cut into files, and the documents that start inside each file.
_FILES = f"""
filed as (select printf('tokens_%06d.bin', (pos // {FILE_TOKENS})::int) as shard, pos % {FILE_TOKENS} as spot, t from tokens),
starts as (select shard, spot as bos_at, row_number() over (partition by shard order by spot) - 1 as ord from filed where t = {BOS}),
sizes as (select shard, count(*) as size from filed group by shard),
file_docs as (
  select shard, ord, bos_at, coalesce(lead(bos_at) over (partition by shard order by bos_at), size) - bos_at as n
  from starts join sizes using (shard))"""

_FILE_ROWS = f"""
with recursive {OFFSETS}, {_TOKENS}, {_FILES}, lens_of as (select shard, ord, n from file_docs), {_PLAN},
doc_tokens as (
  select f.shard, d.ord, f.spot - first_at as rel, f.t
  from filed f join (select shard, min(bos_at) as first_at from starts group by shard) using (shard)
    asof join file_docs d on d.shard = f.shard and f.spot >= d.bos_at)
{_rows('file', 'doc_tokens', 'x.rel')}"""

ORACLE = {
    "token_offsets": f"""
with {OFFSETS} select shard, doc_id as row_index, n, ord, shard_pos, start_pos from offsets""",
    "bos_index": f"with {OFFSETS} select shard, shard_pos as pos from offsets",
    "multi_epoch_stream": f"""
with {OFFSETS},
e as (
  select epoch::int as epoch, shard, doc_id as row_index, n,
    start_pos + epoch * (select sum(n) from offsets)::bigint as start_pos
  from offsets, range({EPOCHS}) t(epoch))
select epoch, shard, row_index, start_pos, start_pos // {SPAN} as first_batch, (start_pos + n - 1) // {SPAN} as last_batch
from e""",
    "stream_batches": f"with {OFFSETS}, {_TOKENS} {_cut('tokens')}",
    "shift_targets": f"""
select doc_id, array_to_string(ids[:-2], ' ') as inputs, array_to_string(ids[2:], ' ') as targets
from (select doc_id, list_prepend({BOS}, {byte_list("text")}) as ids from documents)""",
    "bos_pack_plan": f"{_PACK} select shard, batch_id, row_in_batch, seg_no, ord, start, \"end\" from plan",
    "bos_pack_batch": f"""
{_PACK} select shard, batch_id, count(*) as segments, min(ord) as first_ord, max(ord) as last_ord,
  sum("end" - start)::bigint as tokens
from plan group by shard, batch_id""",
    "packed_sequences": f"{_PACK}, {_TOKENS} {_rows('shard', 'tokens', 'x.shard_pos')}",
    "packing_audit": f"""
{_PACK},
used as (
  select shard, count(*) as segments, sum("end" - start)::bigint as kept, sum(n - ("end" - start))::bigint as cut,
    count(*) filter (seg_no = 0) as full_rows
  from plan group by shard)
select shard, docs, tokens, coalesce(segments, 0) as segments, coalesce(kept, 0) as kept, coalesce(cut, 0) as cut,
  coalesce(full_rows, 0) as full_rows, tokens - coalesce(kept, 0) - coalesce(cut, 0) as dropped
from (select shard, count(*) as docs, sum(n)::bigint as tokens from offsets group by shard) left join used using (shard)""",
    "token_shard_scan": f"""
with {OFFSETS}, {_TOKENS}, {_FILES}
select shard as file, spot // {token_shards.CHUNK_TOKENS} * {token_shards.CHUNK_TOKENS} as start,
  string_agg(t::varchar, ' ' order by spot) as ids
from filed group by all""",
    "token_shard_headers": f"""
with total as (select sum(strlen(text) + 1)::bigint as t from documents),
files as (select i, least({FILE_TOKENS}, t - i * {FILE_TOKENS})::bigint as n
  from total, range((select (t + {FILE_TOKENS - 1}) // {FILE_TOKENS} from total)) r(i))
select printf('tokens_%06d.bin', i::int) as file, {SHARD_MAGIC}::int as magic, {SHARD_VERSION}::int as version,
  n as n_tokens, {token_shards.HEADER_BYTES} + 2 * n as n_bytes, null::varchar as reason
from files""",
    "token_shard_roundtrip": f"""
with {OFFSETS}, {_TOKENS}, {_FILES} select shard as file, bos_at as pos, n from file_docs""",
    "token_shard_batches": _FILE_ROWS,
    "token_shard_seek": f"select * from ({_FILE_ROWS}) where batch_id between {SOUGHT[0]} and {SOUGHT[1]}",
    "streaming_batches": f"""
with flat as (select doc_id, strlen(text) + 1 as n, text from documents),
placed as (select doc_id, text, sum(n) over (order by doc_id) - n as start_pos from flat),
tokens as (
  select start_pos + i as pos, t from (
    select start_pos, unnest(ids) as t, unnest(range(len(ids))) as i
    from (select start_pos, list_prepend({BOS}, {byte_list("text")}) as ids from placed)))
{_cut('tokens')}""",
}
