"""Offsets, stream cutting, packing, token shards and streaming against plain-Python restatements."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import byte_ids
from corpusloom.operators import packing, sequences
from corpusloom.operators.running import decayed_sum, with_position, with_running
from corpusloom.plans.sequences import streaming_batches
from corpusloom.sources import token_shards
from corpusloom.streaming.cut import cut_rows, cut_stream, read_corpus_stream


def documents(spark, shards):
    """``shards``: name -> list of token lists."""
    rows = [(s, i, ids, len(ids)) for s, docs in shards.items() for i, ids in enumerate(docs)]
    return spark.createDataFrame(rows, "shard string, row_index bigint, ids array<int>, n bigint")


def random_shards(seed, n_shards, n_docs, longest):
    rng = random.Random(seed)
    return {
        f"s{k}": [[99] + [rng.randrange(50) for _ in range(rng.randrange(longest))] for _ in range(rng.randrange(n_docs))]
        for k in range(n_shards)
    }


def stream_rows(tokens, B, T):
    span, out = B * T + 1, []
    for k in range(len(tokens) // span):
        part = tokens[k * span : (k + 1) * span]
        for r in range(B):
            out.append((k, r, part[r * T : r * T + T], part[r * T + 1 : r * T + T + 1]))
    return out


def greedy_plan(docs, B, T):
    """Rows of (document, taken) pairs, in full batches only."""
    rows, i = [], 0
    while i < len(docs):
        row, have = [], 0
        while have < T + 1 and i < len(docs):
            take = min(len(docs[i]), T + 1 - have)
            row.append((i, take))
            have += take
            i += 1
        if have < T + 1:
            break
        rows.append(row)
    return rows[: len(rows) // B * B]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_offsets(spark, block):
    shards = random_shards(1, 5, 12, 6)
    got = {(r.shard, r.row_index): (r.ord, r.shard_pos, r.start_pos) for r in sequences.token_offsets(documents(spark, shards), block).collect()}
    expected, at = {}, 0
    for s in sorted(shards):
        inside = 0
        for i, ids in enumerate(shards[s]):
            expected[s, i] = (i, inside, at)
            inside, at = inside + len(ids), at + len(ids)
    assert got == expected


@pytest.mark.parametrize("sizes", [[8], [9], [17], [18], [3, 30, 2], [1] * 40, [5, 4, 9, 27, 1]])
def test_stream_cut(spark, sizes):
    B, T = 2, 4
    shards = {"a": [list(range(100 * i, 100 * i + n)) for i, n in enumerate(sizes)]}
    stream = sequences.token_offsets(documents(spark, shards), 2)
    rows = sequences.stream_batches(stream, B, T).collect()
    got = sorted((r.batch_id, r.row_in_batch, r.inputs, r.targets) for r in rows)
    assert got == stream_rows([t for d in shards["a"] for t in d], B, T)


def test_epochs_are_seamless(spark):
    shards = random_shards(2, 3, 8, 7)
    stream = sequences.repeat_epochs(sequences.token_offsets(documents(spark, shards)), 2)
    rows = sequences.stream_batches(stream, 2, 3).collect()
    tokens = [t for s in sorted(shards) for d in shards[s] for t in d] * 2
    assert sorted((r.batch_id, r.row_in_batch, r.inputs, r.targets) for r in rows) == stream_rows(tokens, 2, 3)


def test_shift_long(spark):
    tokens = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 8)], "row int, pos int, token int")
    rows = sequences.shift_long(tokens, ["row"]).collect()
    assert sorted((r.row, r.pos, r.token, r.target) for r in rows) == [(1, 0, 5, 6), (1, 1, 6, 7)]


@pytest.mark.parametrize("seed,block,fan_in", [(3, 6, 2), (4, 6, 3), (5, 1000, 4), (6, 7, 2), (7, 6, 1024)])
def test_packing(spark, seed, block, fan_in):
    B, T = 2, 5
    shards = random_shards(seed, 4, 60, 9)
    shards["exact"] = [[99] * (T + 1)] * 2 + [[99] * 20] * 3 + [[99] * 3] * 2
    shards["ones"] = [[99]] * 50
    shards["short"] = [[99, 1]]
    docs = sequences.token_offsets(documents(spark, shards))
    plan = packing.pack_plan(docs, B, T, block_docs=block, fan_in=fan_in)
    rows = packing.packed_rows(plan, docs, T).collect()
    got = {(r.shard, r.batch_id, r.row_in_batch): (r.inputs, r.targets) for r in rows}
    expected, kept = {}, {}
    for s, ds in shards.items():
        for k, row in enumerate(greedy_plan(ds, B, T)):
            flat = [t for d, take in row for t in ds[d][:take]]
            expected[s, k // B, k % B] = (flat[:-1], flat[1:])
            kept[s] = kept.get(s, 0) + len(flat)
    assert got == expected
    audit = {r.shard: r for r in packing.packing_audit(docs, plan).collect()}
    for s, ds in shards.items():
        if ds:
            a = audit[s]
            assert (a.tokens, a.kept) == (sum(map(len, ds)), kept.get(s, 0))
            assert a.kept + a.cut + a.dropped == a.tokens and a.full_rows * (T + 1) == a.kept


def write_bin(path, tokens, magic=20240520, version=1, n=None):
    header = np.zeros(256, "<i4")
    header[:3] = magic, version, len(tokens) if n is None else n
    path.write_bytes(header.tobytes() + np.array(tokens, "<u2").tobytes())


def test_bad_token_shards(spark, tmp_path):
    write_bin(tmp_path / "ok.bin", [7, 1, 2, 7, 3])
    write_bin(tmp_path / "empty.bin", [])
    write_bin(tmp_path / "magic.bin", [1], magic=1)
    write_bin(tmp_path / "version.bin", [1], version=2)
    write_bin(tmp_path / "short.bin", [1, 2], n=5)
    (tmp_path / "stub.bin").write_bytes(b"abc")
    reasons = {r.path.split("/")[-1]: r.reason for r in token_shards.shard_headers(spark, str(tmp_path)).collect()}
    assert reasons == {
        "ok.bin": None,
        "empty.bin": None,
        "magic.bin": "bad_magic",
        "version.bin": "bad_version",
        "short.bin": "missing_tokens",
        "stub.bin": "short_header",
    }
    assert token_shards.shard_rejects(spark, str(tmp_path)).count() == 4
    lenient = token_shards.shard_tokens(token_shards.read_token_shards(spark, str(tmp_path), strict=False))
    assert sorted((r.pos, r.token) for r in lenient.collect()) == [(0, 7), (1, 1), (2, 2), (3, 7), (4, 3)]
    assert sorted(r.pos for r in sequences.bos_index(lenient, 7).collect()) == [0, 3]
    with pytest.raises(Exception, match="bad_magic"):
        token_shards.read_token_shards(spark, str(tmp_path)).collect()


def test_packing_token_shards(spark, tmp_path):
    """Tokens before the first BOS are dropped and shards are packed alone."""
    B, T, bos = 2, 5, 99
    rng = random.Random(8)
    files = {
        "a.bin": [1, 2] + [bos if rng.random() < 0.3 else rng.randrange(50) for _ in range(400)],
        "b.bin": [5] * 30,
        "c.bin": [bos] * 25,
    }
    for name, tokens in files.items():
        write_bin(tmp_path / name, tokens)
    index = token_shards.read_bos_index(spark, str(tmp_path), bos)
    docs = sequences.token_offsets(token_shards.shard_documents(index, block_tokens=16))
    plan = packing.pack_plan(docs, B, T)
    chunks = token_shards.read_token_shards(spark, str(tmp_path))
    rows = token_shards.packed_shard_rows(plan, docs, chunks, T).collect()
    got = {(r.shard.split("/")[-1], r.batch_id, r.row_in_batch): (r.inputs, r.targets) for r in rows}
    expected = {}
    for name, tokens in files.items():
        starts = [i for i, t in enumerate(tokens) if t == bos]
        ds = [tokens[s:e] for s, e in zip(starts, starts[1:] + [len(tokens)])]
        for k, row in enumerate(greedy_plan(ds, B, T)):
            flat = [t for d, take in row for t in ds[d][:take]]
            expected[name, k // B, k % B] = (flat[:-1], flat[1:])
    assert got == expected


def test_token_shard_ids_must_fit(spark, tmp_path):
    stream = spark.createDataFrame([(0, [1, 70000])], "start_pos bigint, ids array<int>")
    with pytest.raises(Exception, match="16 bits"):
        token_shards.write_token_shards(stream, str(tmp_path / "w"))


def test_streaming_carries_left_over_tokens(spark, tmp_path):
    B, T, bos = 2, 8, 256
    texts = [["alpha beta", "x"], ["", "gamma delta epsilon zeta"], ["eta " * 20], ["theta"]]
    source = str(tmp_path / "in")
    for k, part in enumerate(texts):
        rows = spark.createDataFrame([(t,) for t in part], "text string").coalesce(1)
        rows.write.mode("append").parquet(source)
    stream = read_corpus_stream(spark, source, files_per_trigger=1)
    sink = str(tmp_path / "out")
    cut_stream(stream, sink, byte_ids, bos, B, T).awaitTermination()
    tokens = [t for part in texts for x in part for t in [bos, *x.encode()]]
    rows = cut_rows(spark, sink).collect()
    assert sorted((r.batch_id, r.row_in_batch, r.inputs, r.targets) for r in rows) == stream_rows(tokens, B, T)
    # More files later: the job goes on where it stopped.
    more = ["one more document that comes late", "and another"]
    spark.createDataFrame([(t,) for t in more], "text string").coalesce(1).write.mode("append").parquet(source)
    cut_stream(read_corpus_stream(spark, source, files_per_trigger=1), sink, byte_ids, bos, B, T).awaitTermination()
    tokens += [t for x in more for t in [bos, *x.encode()]]
    rows = cut_rows(spark, sink).collect()
    assert sorted((r.batch_id, r.row_in_batch, r.inputs, r.targets) for r in rows) == stream_rows(tokens, B, T)


def test_streaming_reads_a_table_of_one_file_or_many(spark, tmp_path):
    texts = [f"document {i} " + "word " * 3 * i for i in range(100)]
    rows = []
    for name, parts in (("file", 1), ("folder", 3)):
        path = tmp_path / name / "documents.parquet"
        (path.parent if parts == 1 else path).mkdir(parents=True)
        for k in range(parts):
            at = range(100 * k // parts, 100 * (k + 1) // parts)
            table = pa.table({"doc_id": list(at), "text": [texts[i] for i in at]})
            pq.write_table(table, path if parts == 1 else path / f"part-{k:04d}.parquet")
        rows.append(sorted(map(tuple, streaming_batches(spark, str(tmp_path / name)).collect())))
    assert len(rows[0]) > 4 and rows[0] == rows[1]


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_running_totals(spark, block):
    rng = random.Random(9)
    rows = [(k, 3 * i, rng.randrange(-20, 20) if rng.random() < 0.8 else None) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, o bigint, v bigint")
    got = with_running(df, ["k"], "o", sums={"s": F.col("v")}, mins={"m": F.col("v")}, block_rows=block).collect()
    for r in got:
        seen = [v for k, o, v in rows if k == r.k and o <= r.o and v is not None]
        assert (r.s, r.m) == ((sum(seen), min(seen)) if seen else (None, None))
    ranks = with_position(df, ["k"], "o", "p", block_rows=block).collect()
    assert all(r.p == r.o // 3 for r in ranks)


@pytest.mark.parametrize("decay", [0.9, 0.001, 0.99999])
def test_decayed_sum(spark, decay):
    rng = random.Random(10)
    values = [rng.random() for _ in range(9000)]
    df = spark.createDataFrame(list(enumerate(values)), "p bigint, v double").withColumn("k", F.lit(1))
    got = {r.p: r.d for r in decayed_sum(df, ["k"], "p", "v", decay, "d").collect()}
    s = 0.0
    for p, v in enumerate(values):
        s = decay * s + v
        assert got[p] == pytest.approx(s, rel=1e-9)


def test_decayed_sum_keeps_nan(spark):
    values = [1.0, float("nan")] + [1.0] * 20000
    df = spark.createDataFrame(list(enumerate(values)), "p bigint, v double").withColumn("k", F.lit(1))
    got = decayed_sum(df, ["k"], "p", "v", 0.9, "d").filter(~F.isnan("d")).collect()
    assert [r.p for r in got] == [0]


def test_sought_batches_read_only_their_bytes(spark, tmp_path):
    """Token files are spoilt outside the wanted stretches; the batches still equal those of the whole files."""
    from corpusloom.operators import packing, sequences
    from corpusloom.sources import token_shards as ts

    docs = [(i, [9] + [(7 * i + j) % 9 for j in range(3 + i % 11)]) for i in range(400)]
    pos, rows = 0, []
    for _, ids in docs:
        rows.append((pos, ids))
        pos += len(ids)
    path = ts.write_token_shards(spark.createDataFrame(rows, "start_pos long, ids array<int>"), f"{tmp_path}/files", 1500)
    index = ts.skip_list(spark, path, 9)
    found = sequences.token_offsets(ts.shard_documents(index))
    plan = packing.pack_plan(found, 2, 20)
    whole = ts.packed_shard_rows(plan, found, ts.read_token_shards(spark, path), 20).where("batch_id between 4 and 6")

    def shown(rows):
        return sorted((r.shard, r.batch_id, r.row_in_batch, list(r.inputs), list(r.targets)) for r in rows.collect())

    expected = shown(whole)
    at = found.select("shard", "ord", F.col("row_index").alias("at"))
    spans = plan.where("batch_id between 4 and 6").join(at, ["shard", "ord"]).groupBy("shard").agg(
        F.min("at").alias("a"), F.max(F.col("at") + F.col("end") - F.col("start")).alias("b")
    )
    for r in spans.collect():
        file = r.shard.removeprefix("file:")
        raw = np.fromfile(file, np.uint16)
        head = ts.HEADER_BYTES // 2
        raw[head : head + r.a] = 4
        raw[head + r.b :] = 4
        raw.tofile(file)
    again = ts.skip_list(spark, path, 9)
    assert again.count() == index.count()
    got = ts.batch_rows_of(spark, path, plan, found, 20, 4, 6)
    assert expected and shown(got) == expected


def test_rows_come_from_one_chunk_each(spark, tmp_path):
    """Rows that cross chunk borders too, and tokens are not grouped again after the join."""
    from corpusloom.operators import packing, sequences
    from corpusloom.sources import token_shards as ts

    rng = np.random.default_rng(3)
    for name, n in (("a.bin", 2 * ts.CHUNK_TOKENS + 777), ("b.bin", ts.CHUNK_TOKENS), ("c.bin", 40)):
        write_bin(tmp_path / name, [int(t) if t < 9 else 9 for t in rng.integers(0, 12, n)])
    index = ts.read_bos_index(spark, str(tmp_path), 9)
    docs = sequences.token_offsets(ts.shard_documents(index))
    plan = packing.pack_plan(docs, 2, 700)
    whole = ts.packed_shard_rows(plan, docs, ts.read_token_shards(spark, str(tmp_path)), 700)
    rows = ts.rows_in_chunks(plan, docs, ts.read_token_shards(spark, str(tmp_path), beyond=700), 700)

    def shown(rows):
        return sorted((r.shard, r.batch_id, r.row_in_batch, list(r.inputs), list(r.targets)) for r in rows.collect())

    expected = shown(whole)
    assert len(expected) > 250 and shown(rows) == expected
    assert "collect_list" not in rows._jdf.queryExecution().toString()
