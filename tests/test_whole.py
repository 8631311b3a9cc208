"""Nothing is lost: values that never fade, unknown ids, wide vocabularies, empty documents, second writes."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import codec
from corpusloom.operators.bpe import VOCAB_SCHEMA
from corpusloom.operators.packing import pack_plan
from corpusloom.operators.running import decayed_sum
from corpusloom.operators.sequences import token_offsets
from corpusloom.sources.token_shards import write_token_shards


@pytest.mark.parametrize("odd", [math.inf, math.nan, 1e300, 2.5])
@pytest.mark.parametrize("decay", [0.9, 0.5])
def test_decayed_sum_equals_the_recurrence_over_many_blocks(spark, odd, decay):
    n = 12_000
    values = [odd if i == 5 else float(i % 7) for i in range(n)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, t long, v double")
    got = {r.t: r.s for r in decayed_sum(rows, ["k"], "t", "v", decay, "s").collect()}
    total = 0.0
    for i, v in enumerate(values):
        total = decay * total + v
        if math.isfinite(total):
            assert got[i] == pytest.approx(total, rel=1e-9), i
        else:
            assert repr(got[i]) == repr(total), i


def _vocab(spark, ids):
    return spark.createDataFrame([(i, bytearray(b), False, None, len(b)) for i, b in ids], VOCAB_SCHEMA)


def test_decode_goes_by_id_and_refuses_unknown_ones(spark):
    vocab = _vocab(spark, [(i, bytes([i])) for i in range(256) if i != 10])
    ids = spark.createDataFrame([([72, 105],)], "ids array<int>")
    assert ids.select(codec.decoder(vocab)(F.col("ids"))).first()[0] == "Hi"
    unknown = spark.createDataFrame([([72, 999, 10, 105],)], "ids array<int>")
    with pytest.raises(Exception, match="no token has id 999"):
        unknown.select(codec.decoder(vocab)(F.col("ids"))).collect()
    assert unknown.select(codec.decoder(vocab, "replace")(F.col("ids"))).first()[0] == "H��i"


def test_vocabularies_wider_than_16_bits(spark):
    words = [bytes([b]) for b in range(256)] + [f"w{i:06d}".encode() for i in range(70_000)]
    vocab = _vocab(spark, list(enumerate(words)))
    docs = spark.createDataFrame([("w0",)], "text string")
    ids = docs.select(F.array(F.lit(256 + 69_999)).alias("ids"))
    assert ids.select(codec.decoder(vocab)(F.col("ids"))).first()[0] == "w069999"
    assert codec.encode_corpus(docs, vocab).first()["ids"] == [ord("w"), ord("0")]


def test_documents_without_tokens_are_passed_over(spark):
    lengths = [0 if i % 2 else 1 + i % 5 for i in range(60)]
    table = lambda ns: spark.createDataFrame([("s", i, n) for i, n in ns], "shard string, row_index long, n long")
    some = pack_plan(token_offsets(table(list(enumerate(lengths)))), 1, 4, block_docs=6)
    full = pack_plan(token_offsets(table([(i, n) for i, n in enumerate(lengths) if n])), 1, 4, block_docs=6)
    cut = lambda plan: sorted((r.batch_id, r.seg_no, r.start, r.end) for r in plan.collect())
    assert cut(some) == cut(full) and cut(some)


def test_a_second_write_into_a_folder_is_refused(spark, tmp_path):
    stream = spark.createDataFrame([(0, list(range(20)))], "start_pos long, ids array<int>")
    write_token_shards(stream, str(tmp_path / "t"))
    with pytest.raises(FileExistsError):
        write_token_shards(stream, str(tmp_path / "t"))
