"""What streamed cuts leave on disk: each token once, and nothing that a micro-batch staged."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusloom.functions.text import byte_ids
from corpusloom.sources.row_group_reader import rank_groups, stream_groups
from corpusloom.staging import shared_dir
from corpusloom.streaming.cut import cut_lane, cut_rows, cut_stream, read_corpus_stream

BOS, B, T = 256, 2, 7
STAGED = ("runs-", "run_starts-", "cut-", "encoded")


@pytest.fixture()
def corpus(tmp_path):
    texts = [f"row {i} " + "abc def " * (i % 9) for i in range(300)]
    path = tmp_path / "corpus"
    path.mkdir()
    for f in range(2):
        pq.write_table(pa.table({"text": texts[150 * f : 150 * f + 150]}), path / f"shard_{f:05d}.parquet", row_group_size=10)
    return str(path), [t for text in texts for t in [BOS, *text.encode()]]


def staged(spark, sink):
    root = shared_dir(spark).removeprefix("file:")
    return {name for place in (root, sink) if os.path.isdir(place) for name in os.listdir(place) if name.startswith(STAGED)}


def tokens_held(spark, sink):
    files = spark.read.option("recursiveFileLookup", True).parquet(f"{sink}/rows")
    lists = [f.name for f in files.schema.fields if f.dataType.typeName() == "array"]
    return sum(r[0] or 0 for c in lists for r in files.selectExpr(f"sum(size({c}))").collect())


@pytest.mark.parametrize("kind", ["lane", "stream"])
def test_each_token_is_kept_once_and_staged_tables_go(spark, corpus, tmp_path, kind):
    path, stream = corpus
    sink = str(tmp_path / "sink")
    before = staged(spark, sink)
    if kind == "lane":
        stream = stream * 2
        lane = stream_groups(rank_groups(spark, path, 0, 1), f"{sink}/progress/at", 7, epochs=2)
        query = cut_lane(lane, sink, byte_ids, BOS, B, T)
        query.processAllAvailable()
        query.stop()
    else:
        cut_stream(read_corpus_stream(spark, path, files_per_trigger=1), sink, byte_ids, BOS, B, T).awaitTermination()
    assert staged(spark, sink) <= before
    span, rows = B * T + 1, []
    for k in range(len(stream) // span):
        batch = stream[k * span : (k + 1) * span]
        rows += [(k, r, batch[r * T : r * T + T], batch[r * T + 1 : r * T + T + 1]) for r in range(B)]
    found = cut_rows(spark, sink)
    assert found.columns == ["batch_id", "row_in_batch", "inputs", "targets"]
    assert [f.dataType.simpleString() for f in found.schema.fields] == ["bigint", "int", "array<int>", "array<bigint>"]
    assert sorted((r.batch_id, r.row_in_batch, list(r.inputs), list(r.targets)) for r in found.collect()) == rows
    # A row has one token more than its inputs.
    assert tokens_held(spark, sink) == len(rows) * (T + 1)
