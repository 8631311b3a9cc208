"""Row groups of a rank, rows cut where documents lie, and lanes streamed over several epochs."""

import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import byte_ids
from corpusloom.operators.codec import with_ends
from corpusloom.operators.runs import cut_runs, in_runs
from corpusloom.operators.sequences import stream_batches, token_offsets
from corpusloom.sources.row_group_reader import rank_groups, read_groups, read_rank_groups, stream_groups
from corpusloom.streaming.cut import cut_lane, cut_rows

BOS, B, T = 256, 2, 7
SPAN = B * T + 1


def encode(text):
    return with_ends(byte_ids(text), prepend=BOS)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Four files with row groups of three rows; some texts are empty or longer than a batch."""
    path = tmp_path_factory.mktemp("corpus")
    files = []
    for f in range(4):
        texts = [f"file {f} row {r} " + "x" * ((7 * f + 5 * r) % 40) * (r % 3) if (r + f) % 5 else "" for r in range(7 + 4 * f)]
        pq.write_table(pa.table({"other": list(range(len(texts))), "text": texts}), path / f"shard_{f:05d}.parquet", row_group_size=3)
        files.append(texts)
    return str(path), files


def lane_texts(files, rank, world):
    return [t for texts in files for i, t in enumerate(texts) if i // 3 % world == rank]


def cut(texts):
    stream = [t for text in texts for t in [BOS, *text.encode()]]
    rows = []
    for k in range(len(stream) // SPAN):
        span = stream[k * SPAN : (k + 1) * SPAN]
        rows += [(k, r, span[r * T : r * T + T], span[r * T + 1 : r * T + T + 1]) for r in range(B)]
    return rows


def shown(rows):
    return sorted((r.batch_id, r.row_in_batch, list(r.inputs), list(r.targets)) for r in rows.collect())


@pytest.mark.parametrize("world", [1, 2, 5, 40])
def test_ranks_read_their_own_groups(spark, corpus, world):
    path, files = corpus
    for rank in {0, 1 % world, world - 1}:
        rows = read_rank_groups(spark, path, rank, world).collect()
        assert [r.text for r in sorted(rows, key=lambda r: (r.run, r.row_index))] == lane_texts(files, rank, world)
        assert all(r.row_index // 3 == r.row_group for r in rows)
    with pytest.raises(ValueError):
        read_rank_groups(spark, path, world, world)


def test_other_groups_are_not_opened(spark, tmp_path):
    """Bytes of the groups of other ranks are overwritten; the rank's own rows still come back."""
    texts = [f"text {i} " * 50 for i in range(60)]
    file = tmp_path / "shard_00000.parquet"
    pq.write_table(pa.table({"text": texts}), file, row_group_size=5)
    footer = pq.read_metadata(file)
    raw, kept = bytearray(file.read_bytes()), 0
    for g in range(footer.num_row_groups):
        column = footer.row_group(g).column(0)
        start = column.dictionary_page_offset or column.data_page_offset
        if g % 4 == 1:
            kept += column.total_compressed_size
        else:
            raw[start : start + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    file.write_bytes(bytes(raw))
    mine = read_rank_groups(spark, str(tmp_path), 1, 4)
    assert mine.rdd.getNumPartitions() == 3 and kept < 0.3 * len(raw)
    assert [r.text for r in mine.orderBy("row_index").collect()] == [t for i, t in enumerate(texts) if i // 5 % 4 == 1]


def test_rows_cut_in_place_are_those_of_the_stream(spark, corpus):
    path, files = corpus
    expected = cut([t for texts in files for t in texts])
    placed = in_runs(read_rank_groups(spark, path, 0, 1), encode)
    assert shown(cut_runs(placed, B, T)) == expected
    docs = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row_index"), "text")
    ranged = in_runs(docs.repartition(5), encode, "shard", "row_index")
    assert shown(cut_runs(ranged, B, T)) == expected
    counted = ranged.select("shard", "row_index", "ids", F.col("n"))
    assert shown(stream_batches(token_offsets(counted), B, T)) == expected
    assert shown(cut_runs(placed.limit(0), B, T)) == []


def test_lanes_stream_epochs_over_a_restart(spark, corpus, tmp_path):
    path, files = corpus
    for rank in range(2):
        sink, groups = str(tmp_path / f"lane{rank}"), rank_groups(spark, path, rank, 2)

        def lane(epochs):
            return stream_groups(groups, f"{sink}/progress/at", 2, epochs=epochs)

        expected = cut(lane_texts(files, rank, 2) * 2)
        endless = cut_lane(lane(None), sink, byte_ids, BOS, B, T)
        deadline = time.time() + 90
        while not (endless.lastProgress and endless.lastProgress["batchId"] >= 1) and time.time() < deadline:
            time.sleep(0.2)
        endless.stop()
        before = shown(cut_rows(spark, sink))
        assert before and before == cut(lane_texts(files, rank, 2) * 40)[: len(before)]
        if len(before) < len(expected):
            rest = cut_lane(lane(2), sink, byte_ids, BOS, B, T)
            rest.processAllAvailable()
            rest.stop()
            assert shown(cut_rows(spark, sink)) == expected


def test_groups_of_an_empty_list_are_no_rows(spark, corpus):
    assert read_groups(rank_groups(spark, corpus[0], 0, 1).limit(0)).count() == 0


def test_small_groups_share_tasks(spark, tmp_path):
    """Tasks follow the bytes and not the number of groups; order and places stay."""
    texts = [f"text {i}" for i in range(4000)]
    for f in range(2):
        pq.write_table(pa.table({"text": texts[2000 * f : 2000 * f + 2000]}), tmp_path / f"shard_{f:05d}.parquet", row_group_size=2)
    rows = read_rank_groups(spark, str(tmp_path), 0, 2)
    assert 8 <= rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    found = rows.collect()
    assert [r.text for r in sorted(found, key=lambda r: (r.run, r.row_index))] == [t for i, t in enumerate(texts) if i % 2000 // 2 % 2 == 0]
    assert all(r.row_index // 2 == r.row_group and r.run == r.row_group // 2 + 500 * ("00001" in r.file) for r in found)
    assert shown(cut_runs(in_runs(rows, encode), B, T)) == cut([t for i, t in enumerate(texts) if i % 2000 // 2 % 2 == 0])


def test_lane_with_many_groups_catches_up(spark, corpus, tmp_path):
    path, files = corpus
    sink = str(tmp_path / "lane")
    lane = stream_groups(rank_groups(spark, path, 0, 1), f"{sink}/progress/at", 1, epochs=3, catch_up=1 << 20)
    query = cut_lane(lane, sink, byte_ids, BOS, B, T)
    query.processAllAvailable()
    batches = query.lastProgress["batchId"]
    query.stop()
    assert shown(cut_rows(spark, sink)) == cut(lane_texts(files, 0, 1) * 3)
    groups = sum(-(-len(texts) // 3) for texts in files)
    assert 3 * groups > 40 and 3 <= batches <= 8
