"""Pre-tokens, training, encoding and decoding against independent statements of the rules."""

import base64
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers, trainers

from corpusloom.functions.fixed_values import SPECIAL_TOKENS, SPLIT_PATTERN
from corpusloom.functions import text as text_functions
from corpusloom.functions.text import byte_ids, pretokens
from corpusloom.operators import bpe, codec
from corpusloom.sources.vocab_store import import_ranks, import_tokenizer_json, load_tokenizer, save_tokenizer
from tests.conftest import SF_DIR

HAND_MADE = [
    "",
    "x  y",
    "x  y",
    "it'S we'LL they've",
    "'ſ",
    "123456 7",
    "\r\n\r\n  hi",
    "trailing   ",
    "中文 12³ かな",
    "élève",
    "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467!",
    "a\u0085b​c\u001cd",
    "<|bos|> is text",
    "tabs\t\tand  \n\n spaces",
    "nul\x00byte",
]


def corpus(spark, texts):
    rows = [("s", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "shard string, row_index bigint, text string")


def words_of(texts):
    return Counter(p for t in texts for p in regex.findall(SPLIT_PATTERN, t))


def one_at_a_time(counts, n_merges, order):
    """Merge the most frequent pair, lowest ids first among equals, until enough are made."""
    number = {b: i for i, b in enumerate(order)}
    words = {tuple(number[b] for b in p.encode()): n for p, n in counts.items()}
    merges = []
    while len(merges) < n_merges:
        pairs = Counter()
        for w, n in words.items():
            for pair in zip(w, w[1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        new, merged = 256 + len(merges), Counter()
        for w, n in words.items():
            out, i = [], 0
            while i < len(w):
                if w[i : i + 2] == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            merged[tuple(out)] += n
        words = merged
        merges.append(best)
    return merges


def learned(spark, texts, n_merges, layout="rank"):
    _, merges = bpe.train(corpus(spark, texts), 256 + 9 + n_merges, layout)
    base = 9 if layout == "specials_first" else 0
    return [(r.left_id - base, r.right_id - base) for r in merges.orderBy("rank").collect()]


def test_pieces(spark):
    rows = corpus(spark, HAND_MADE).select("text", pretokens(F.col("text")).alias("p")).collect()
    for r in rows:
        assert r.p == regex.findall(SPLIT_PATTERN, r.text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=40, max_size=40))
def test_pieces_put_together_are_the_text(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    rows = corpus(spark, texts).select("text", pretokens(F.col("text")).alias("p")).collect()
    assert all("".join(r.p) == r.text for r in rows)


TRAINING = [
    ["aaaa aaaaa aaa baab", "abab abab"],
    ["ab cd ef gh ij kl", "mn op"],
    ["low lower lowest newest widest", "new wide low low!!", "!!!! hug pug hugs pugs bun"],
    ["été été être", "naïve naïve"],
]


@pytest.mark.parametrize("texts", TRAINING)
@pytest.mark.parametrize("layout", bpe.LAYOUTS)
def test_merges_equal_one_at_a_time(spark, texts, layout):
    expected = one_at_a_time(words_of(texts), 15, bpe.byte_order(layout))
    assert learned(spark, texts, 15, layout) == expected


@pytest.mark.parametrize("held_pairs, longest", [(40, 256), (1 << 16, 8)])
def test_epochs_refills_and_long_words_change_nothing(spark, monkeypatch, held_pairs, longest):
    """Few pairs held, short epochs and words outside the index, on the corpus of the smallest scale."""
    monkeypatch.setattr(bpe, "FIRST_EPOCH", 30)
    monkeypatch.setattr(bpe, "LONGEST_EPOCH", 60)
    monkeypatch.setattr(bpe, "LONGEST_INDEXED", longest)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 30")
    histogram = bpe.pretoken_histogram(docs.select("text"))
    expected = one_at_a_time({r.piece: r.n for r in histogram.collect()}, 150, range(256))
    assert bpe.learn_merges(histogram, 150, held_pairs=held_pairs) == expected


def test_merges_end_when_no_pair_is_left(spark):
    assert learned(spark, ["ab ab"], 50) == one_at_a_time(words_of(["ab ab"]), 50, range(256))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=12), st.integers(2, 6))
def test_batches_are_exact(words, look_at):
    """The batching rule alone, on small corpora where ties and repeats are common."""
    counts = Counter(words)
    expected = one_at_a_time(counts, 12, range(256))
    state = {tuple(w.encode()): n for w, n in counts.items()}
    merges = []
    while len(merges) < 12:
        pairs = Counter()
        for w, n in state.items():
            for pair in zip(w, w[1:]):
                pairs[pair] += n
        ranked = sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda p: (-p[2], p[0], p[1]))
        if not ranked:
            break
        for a, b in bpe.exact_batch(ranked[:look_at])[: 12 - len(merges)]:
            new, after = 256 + len(merges), Counter()
            for w, n in state.items():
                out, i = [], 0
                while i < len(w):
                    hit = w[i : i + 2] == (a, b)
                    out.append(new if hit else w[i])
                    i += 2 if hit else 1
                after[tuple(out)] += n
            state = after
            merges.append((a, b))
    assert merges == expected


def test_vocabulary_sizes(spark):
    texts = corpus(spark, ["some text"])
    with pytest.raises(ValueError):
        bpe.train(texts, 264)
    vocab, merges = bpe.train(texts, 265)
    assert vocab.count() == 265 and merges.count() == 0
    with pytest.raises(ValueError):
        bpe.train(texts, 300, "other")


MIXED = [*HAND_MADE, *TRAINING[2], "lowest newest hugs " * 3, "z" * 700]


def test_ids_equal_tiktoken(spark):
    vocab, _ = bpe.train(corpus(spark, TRAINING[2]), 256 + 9 + 25)
    rows = vocab.orderBy("token_id").collect()
    ranks = {bytes(r.bytes): r.token_id for r in rows if not r.is_special}
    special = {r.name: r.token_id for r in rows if r.is_special}
    assert list(special.values()) == list(range(len(ranks), len(ranks) + 9))
    encoding = tiktoken.Encoding("t", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    encoded = codec.encode_corpus(corpus(spark, MIXED), vocab, prepend="<|bos|>", append=5)
    decoded = encoded.withColumn("back", codec.decoder(vocab)(F.col("ids"))).collect()
    for r in decoded:
        assert r.ids == [special["<|bos|>"], *encoding.encode_ordinary(r.text), 5]
        assert r.back == encoding.decode(r.ids)


def test_specials_first_equals_the_public_trainer(spark):
    texts = TRAINING[2] + TRAINING[3]
    theirs = Tokenizer(models.BPE(byte_fallback=True, unk_token=None, fuse_unk=False))
    theirs.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(SPLIT_PATTERN), "isolated", invert=False),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    theirs.decoder = decoders.ByteLevel()
    trainer = trainers.BpeTrainer(
        vocab_size=256 + 9 + 20,
        min_frequency=0,
        show_progress=False,
        initial_alphabet=pre_tokenizers.ByteLevel.alphabet(),
        special_tokens=SPECIAL_TOKENS,
    )
    theirs.train_from_iterator(texts, trainer)
    vocab, merges = bpe.train(corpus(spark, texts), 256 + 9 + 20, "specials_first")
    encoded = codec.encode_corpus(corpus(spark, [t for t in MIXED if "<|" not in t]), vocab, merges=merges).collect()
    assert all(r.ids == theirs.encode(r.text, add_special_tokens=False).ids for r in encoded)


def test_imported_ranks_encode_like_their_library(spark, tmp_path):
    vocab, _ = bpe.train(corpus(spark, TRAINING[2]), 256 + 9 + 25)
    # Ids with gaps: only the order of the ranks matters.
    ranks = {bytes(r.bytes): 3 * r.token_id for r in vocab.collect() if not r.is_special}
    lines = [base64.b64encode(b) + b" %d" % i for b, i in ranks.items()]
    (tmp_path / "t.tiktoken").write_bytes(b"\n".join(lines))
    special = {"<|end|>": 1}
    encoding = tiktoken.Encoding("t", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    handle = import_ranks(spark, str(tmp_path / "t.tiktoken"), special)
    encoded = handle.encode(corpus(spark, MIXED), append="<|end|>")
    for r in encoded.withColumn("back", handle.decode(F.col("ids"))).collect():
        assert r.ids == [*encoding.encode_ordinary(r.text), 1] and r.back == r.text + "<|end|>"
    with pytest.raises(ValueError):
        import_ranks(spark, str(tmp_path / "t.tiktoken"), {"<|end|>": 3})


def test_imported_json_encodes_like_its_library(spark, tmp_path):
    pattern = r"\s?\w+|\s|[^\w\s]+"
    theirs = Tokenizer(models.BPE())
    split = pre_tokenizers.Split(Regex(pattern), "isolated", invert=False)
    theirs.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    alphabet = pre_tokenizers.ByteLevel.alphabet()
    trainer = trainers.BpeTrainer(vocab_size=290, show_progress=False, initial_alphabet=alphabet, special_tokens=["<|x|>"])
    theirs.train_from_iterator(TRAINING[2], trainer)
    theirs.save(str(tmp_path / "tokenizer.json"))
    handle = import_tokenizer_json(spark, str(tmp_path / "tokenizer.json"))
    save_tokenizer(handle.vocab, handle.merges, str(tmp_path / "t"), handle.layout, handle.pattern)
    texts = ["lower  newest widest!!", "hugs, bun été 12", "low\tlowest\n\nnew", ""]
    for each in (handle, load_tokenizer(spark, str(tmp_path / "t"))):
        assert each.pattern == pattern
        for r in each.encode(corpus(spark, texts)).collect():
            assert r.ids == theirs.encode(r.text).ids
    theirs.model = models.WordPiece({"a": 0}, unk_token="a")
    theirs.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        import_tokenizer_json(spark, str(tmp_path / "other.json"))


def test_bytes_and_nulls(spark):
    docs = corpus(spark, ["hé", None, ""])
    rows = docs.select(byte_ids(F.col("text")).alias("ids")).collect()
    assert [r.ids for r in rows] == [[104, 195, 169], None, []]
    vocab = bpe.byte_vocab(spark)
    texts = spark.createDataFrame([([195],), ([256, 104],), ([],)], "ids array<int>")
    assert [r[0] for r in texts.select(codec.decoder(vocab)(F.col("ids"))).collect()] == ["�", "<|bos|>h", ""]


def test_lookups(spark, tmp_path):
    vocab, merges = bpe.train(corpus(spark, TRAINING[0]), 270)
    assert codec.special_id(vocab, "<|bos|>") == 261
    assert codec.special_id(vocab, "a") is None
    with pytest.raises(ValueError):
        codec.encode_corpus(corpus(spark, ["a"]), vocab, prepend="<|nope|>")
    sizes = {r.token_id: r.n_bytes for r in codec.token_byte_counts(vocab).collect()}
    assert sizes[97] == 1 and sizes[256] == 2 and sizes[261] == 0
    save_tokenizer(vocab, merges, str(tmp_path / "t"), "rank")
    again, again_merges, pattern, layout = load_tokenizer(spark, str(tmp_path / "t"))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, vocab.collect()))
    assert again_merges.count() == merges.count() and pattern == SPLIT_PATTERN and layout == "rank"


def test_ids_are_made_a_slice_at_a_time():
    """A batch's ids are several times as large as the batch: neither they nor what finds them is held whole."""
    texts = pa.array(["", None, "y" * 3_000_000, *["x" * 1000] * 8000])
    parts = list(text_functions._byte_ids.func(iter([texts.slice(1)])))
    assert max(len(p.values) for p in parts) <= 3_000_000 and sum(map(len, parts)) == len(texts) - 1
    assert parts[0][0].as_py() is None and sum(len(p.values) for p in parts) == 11_000_000
    pieces = pa.array([None, [], *[["ab", "c", f"d{i}"] * 500 for i in range(1500)]])
    tracemalloc.start()
    at = 0
    for found in codec.encoded(iter([pieces]), lambda w: [ord(c) for c in w]):
        for i in range(0, len(found), 100):
            own = pieces[at + i].as_py()
            assert found[i].as_py() == (None if own is None else [ord(c) for w in own for c in w])
        at += len(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == len(pieces) and peak < 64 << 20
