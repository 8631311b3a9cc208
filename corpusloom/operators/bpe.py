"""Learning byte-level BPE merges from a corpus.

A word is a string with one character per symbol: 256 characters stand for the bytes and each
merge adds the next code point.

Pair counts are kept, not counted again.  Training runs in epochs.  At the start of an epoch the words are
rewritten, all pairs are counted, and an inverted index from pair to words is written, sorted by
pair.  A round merges several pairs: it reads the index for them alone, brings the words found up to
date by the merges since the epoch began, and adds up how the counts change.  Words without the pairs
are not read, so rounds get cheaper as pairs get rarer.

Two facts keep the index and the driver's table small.  Merges only lengthen symbols, so a word that
holds a pair now held, at the epoch's start, the pair of symbols at its seam: the index is never
updated.  And a pair is most frequent when its younger symbol is new; from then on its count only
falls.  So the most frequent pairs of the epoch's start (a constant number) and pairs of new symbols are all that
can come to the top before the least frequent of them is reached, which starts the next epoch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import SPECIAL_TOKENS, SPLIT_PATTERN
from corpusloom.functions.text import byte_chars, pretokens
from corpusloom.operators.codec import merge_piece
from corpusloom.staging import fresh_path, spread, stage

BYTES = 256
# The specials get the highest ids ("rank") or the lowest ("specials_first").
LAYOUTS = ("rank", "specials_first")

VOCAB_SCHEMA = "token_id int, bytes binary, is_special boolean, name string, n_bytes int"
MERGES_SCHEMA = "rank int, left_id int, right_id int, new_id int"


def pretoken_histogram(corpus: DataFrame, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``(piece, n)`` over the whole corpus; counts combine before the shuffle."""
    pieces = corpus.select(F.explode(pretokens(F.col("text"), pattern)).alias("piece"))
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def symbol_char(symbol: int) -> str:
    """Character of a symbol: from U+0100 on, without the surrogates."""
    point = BYTES + symbol
    return chr(point if point < 0xD800 else point + 0x800)


def _symbol_of(point: int) -> int:
    return (point if point < 0xD800 else point - 0x800) - BYTES


def byte_order(layout: str) -> list[int]:
    """Byte value of each initial symbol.

    ``rank`` numbers bytes by value.  ``specials_first`` follows the printable byte alphabet of
    public byte-level tokenizers: bytes with a printable Latin-1 form first, then the others.
    """
    if layout == "rank":
        return list(range(BYTES))
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return printable + [b for b in range(BYTES) if b not in set(printable)]


def _initial_symbols(piece: Column, layout: str) -> Column:
    source = "".join(chr(b) for b in byte_order(layout))
    return F.translate(byte_chars(piece), source, "".join(symbol_char(i) for i in range(BYTES)))


def pair_counts(words: DataFrame) -> DataFrame:
    """``(pair BINARY, n)``: adjacent symbol pairs, as two UTF-32 characters, weighted by count.

    The generator keeps the optimizer from copying the word expression into every pair.
    """
    wide = words.select("n", F.encode("word", "UTF-32").alias("wide"))
    spots = F.expr("if(length(wide) > 4, sequence(0, length(wide) - 8, 4), null)")
    pairs = wide.select("n", "wide", F.explode(spots).alias("at"))
    return (
        pairs.select("n", F.substring("wide", F.col("at") + 1, F.lit(8)).alias("pair"))
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
    )


def _pair_of(pair: bytes) -> tuple[int, int]:
    return _symbol_of(int.from_bytes(pair[:4])), _symbol_of(int.from_bytes(pair[4:]))


def exact_batch(ranked: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The longest prefix of ``ranked`` that one-at-a-time merging would also take, in order.

    Merging (a, b) changes only pairs that end in a or begin with b.  A pair it creates is no more
    frequent than one of these; at equal counts its left symbol is the same or a new one and its right symbol is
    new, so it ranks behind every pair that ranks before the old one.  Pairs may therefore be merged together until the first
    one that ends in the left, or begins with the right, symbol of a pair taken.  (a, a) breeds
    pairs bounded only by itself and ends a batch.
    """
    lefts: set[int] = set()
    rights: set[int] = set()
    batch = []
    for left, right, _ in ranked:
        if left in rights or right in lefts:
            break
        batch.append((left, right))
        if left == right:
            break
        lefts.add(left)
        rights.add(right)
    return batch


# Pairs the driver holds; an epoch ends when the least frequent of those counted at its start is reached.
HELD_PAIRS = 1 << 16
# Merges of the first epoch; each epoch may have twice as many as the one before, up to the last value.
FIRST_EPOCH, LONGEST_EPOCH = 64, 2048
# Merges of one round, at most.
LONGEST_ROUND = 64
# Pairs whose changes a task holds before it hands them on.
HELD_CHANGES = 1 << 20
# Words with more symbols are not in the index, where a word stands once for each of its pairs; rounds pass over them.
LONGEST_INDEXED = 256


def pair_index(words: DataFrame) -> DataFrame:
    """``(pair, word, n)``: a row for each word and each different pair in it, sorted by pair.

    Range partitions by pair and word split a pair that many words share.
    """
    spots = F.expr("sequence(1, length(word) - 1)")
    pairs = F.array_distinct(F.transform(spots, lambda at: F.substring(F.col("word"), at, F.lit(2))))
    short = words.where(F.length("word").between(2, LONGEST_INDEXED))
    rows = short.select(F.explode(pairs).alias("pair"), "word", "n")
    return rows.repartitionByRange("pair", "word").sortWithinPartitions("pair")


def _words_with(index: DataFrame, seams: list[str]) -> DataFrame:
    """Rows ``(pair, word, n)`` of the index for some pairs.

    The equality tests reach the Parquet reader, which skips pages by the pairs they hold.  Their
    number is filled up to a power of two by pairs that no word has, so few different plans are compiled.
    """
    wanted = 8
    while wanted < len(seams):
        wanted *= 2
    fillers = [f"{k:02d}"[-2:] for k in range(wanted - len(seams))]
    return index.where(" or ".join(f"pair = '{seam}'" for seam in [*seams, *fillers]))


def _ranks(merges: list[tuple[int, int, int]]) -> dict[str, tuple[int, str, str]]:
    """Pair -> (rank, pair, symbol it becomes), all as characters."""
    found = ((symbol_char(a) + symbol_char(b), symbol_char(new)) for a, b, new in merges)
    return {pair: (rank, pair, new) for rank, (pair, new) in enumerate(found)}


def merge_word(word: str, ranks: dict[str, tuple[int, str, str]]) -> str:
    """``word`` after merges, lowest rank first, which is the same as one merge after the other."""
    if len(word) > 64:
        pair_rank = lambda s, m, e, left, right: ranks.get(chr(left) + chr(right), (None,))[0]
        symbols = [new for _, _, new in ranks.values()]
        return "".join(map(chr, merge_piece(word, [ord(c) for c in word], pair_rank, lambda r, s, e: ord(symbols[r]))))
    while True:
        known = [ranks[pair] for pair in map(add, word, word[1:]) if pair in ranks]
        if not known:
            return word
        _, pair, symbol = min(known)
        word = word.replace(pair, symbol)


def _apply(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Words of at least two symbols after some more merges."""
    ranks = _ranks(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = pa.array([merge_word(w, ranks) for w in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([now, batch.column(1)], ["word", "n"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint").where(F.length("word") > 1)


def _folded(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """As ``_apply`` for few merges of most words: a fold that stays in the JVM."""
    steps = F.split(F.lit(",".join("".join(map(symbol_char, m)) for m in merges)), ",")
    now = F.aggregate(steps, F.col("word"), lambda w, m: F.replace(w, F.substring(m, 1, 2), F.substring(m, 3, 1)))
    return words.select(now.alias("word"), "n").where(F.length("word") > 1)


def _count_changes(found: DataFrame, done: list[tuple[int, int, int]], batch: list[tuple[int, int, int]], seams: list[str]) -> DataFrame:
    """``(pair, n)``: how ``batch`` changes pair counts in words as they stand before ``done``.

    A word found by several pairs counts at the first of them; a null pair marks words outside the
    index.  A task adds its changes up before they are shuffled.
    """
    before, after, wanted = _ranks(done), _ranks(batch), set(seams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            kept = {pair: n for pair, n in total.items() if n}
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["pair", "n"])

        for rows_in in batches:
            for pair, word, n in zip(*(column.to_pylist() for column in rows_in.columns)):
                if pair is not None and min(p for p in map(add, word, word[1:]) if p in wanted) != pair:
                    continue
                old = merge_word(word, before)
                new = merge_word(old, after)
                if old == new:
                    continue
                for p in map(add, old, old[1:]):
                    total[p] = total.get(p, 0) - n
                for p in map(add, new, new[1:]):
                    total[p] = total.get(p, 0) + n
            if len(total) > HELD_CHANGES:
                yield rows()
        yield rows()

    changes = found.select("pair", "word", "n").mapInArrow(run, "pair string, n bigint")
    return changes.groupBy("pair").agg(F.sum("n").alias("n")).where("n <> 0")


def _seam(left: int, right: int, base: int, merges: list[tuple[int, int]]) -> tuple[int, int]:
    """The symbols below ``base`` on either side of where ``left`` and ``right`` meet."""
    while left >= base:
        left = merges[left - BYTES][1]
    while right >= base:
        right = merges[right - BYTES][0]
    return left, right


def learn_merges(
    histogram: DataFrame, n_merges: int, *, layout: str = "rank", look_at: int = 1024, held_pairs: int = HELD_PAIRS
) -> list[tuple[int, int]]:
    """``n_merges`` symbol pairs in merge order (fewer when no pair is left).

    The most frequent pair is merged first, ties by left and then right symbol.  Words and index are
    tables in the shared folder; two slots of each take turns, so old versions do not pile up.
    """
    spark = histogram.sparkSession
    first = histogram.select(_initial_symbols(F.col("piece"), layout).alias("word"), F.col("n"))
    slots = [[fresh_path(spark, label) for _ in range(2)] for label in ("words", "index")]
    words = stage(spread(first.filter(F.length("word") > 1)), "words", slots[0][0])
    merges: list[tuple[int, int]] = []
    # The first merges touch most words: for them pairs are counted anew and no index is read.
    turn = 0
    while len(merges) < min(n_merges, FIRST_EPOCH):
        top = pair_counts(words).orderBy(F.desc("n"), "pair").limit(look_at).collect()
        batch = exact_batch([(*_pair_of(r["pair"]), r["n"]) for r in top])[: n_merges - len(merges)]
        if not batch:
            return merges
        numbered = [(left, right, BYTES + len(merges) + k) for k, (left, right) in enumerate(batch)]
        merges += batch
        if len(merges) < n_merges:
            turn += 1
            words = stage(_folded(words, numbered), "words", slots[0][turn % 2])
    if len(merges) >= n_merges:
        return merges
    epoch_size, epochs = FIRST_EPOCH, turn
    while True:
        held = pair_counts(words).orderBy(F.desc("n"), "pair").limit(held_pairs).collect()
        counts = {_pair_of(r["pair"]): r["n"] for r in held}
        if not counts:
            return merges
        # Pairs that rank behind the last one held are unknown; without such pairs nothing is.
        floor = (-held[-1]["n"], _pair_of(held[-1]["pair"])) if len(held) == held_pairs else (0, ())
        index = stage(pair_index(words), "index", slots[1][epochs % 2])
        long = words.where(F.length("word") > LONGEST_INDEXED).select(F.lit(None).cast("string").alias("pair"), "word", "n")
        has_long = not long.isEmpty()
        base, done = BYTES + len(merges), []
        while len(merges) < n_merges and len(done) < epoch_size:
            top = heapq.nsmallest(look_at, ((-n, pair) for pair, n in counts.items()))
            ranked = [(*pair, -n) for n, pair in top if (n, pair) <= floor]
            batch = exact_batch(ranked)[: min(LONGEST_ROUND, n_merges - len(merges))]
            if not batch:
                break
            numbered = [(left, right, BYTES + len(merges) + k) for k, (left, right) in enumerate(batch)]
            seams = sorted({"".join(map(symbol_char, _seam(left, right, base, merges))) for left, right in batch})
            found = _words_with(index, seams)
            changes = _count_changes(found.unionByName(long) if has_long else found, done, numbered, seams)
            merges += batch
            done += numbered
            if len(merges) == n_merges:
                return merges
            # A gain belongs to a pair with a new symbol; one that ranks behind the floor is not needed.  Either
            # kind has at most a few pairs for each symbol and merge.
            for r in changes.where((F.col("n") < 0) | (F.col("n") >= -floor[0])).collect():
                pair = _symbol_of(ord(r["pair"][0])), _symbol_of(ord(r["pair"][1]))
                if pair in counts or r["n"] > 0:
                    counts[pair] = counts.get(pair, 0) + r["n"]
                    if counts[pair] <= 0:
                        del counts[pair]
        if len(merges) >= n_merges:
            return merges
        epochs += 1
        epoch_size = min(2 * epoch_size, LONGEST_EPOCH)
        words = stage(_apply(words, done), "words", slots[0][epochs % 2])


def train(
    corpus: DataFrame, vocab_size: int, layout: str = "rank", pattern: str = SPLIT_PATTERN
) -> tuple[DataFrame, DataFrame]:
    """``(vocab, merges)`` tables for a vocabulary of ``vocab_size`` ids, specials included."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, not {layout!r}")
    n_merges = vocab_size - len(SPECIAL_TOKENS) - BYTES
    if n_merges < 0:
        raise ValueError(f"vocab_size must be at least {BYTES + len(SPECIAL_TOKENS)}, not {vocab_size}")
    merges = learn_merges(pretoken_histogram(spread(corpus), pattern), n_merges, layout=layout) if n_merges else []
    return tables(corpus.sparkSession, merges, layout)


def tables(
    spark: SparkSession, merges: list[tuple[int, int]], layout: str = "rank"
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and merge tables for symbol pairs in merge order."""
    specials_first = layout == "specials_first"
    base = len(SPECIAL_TOKENS) if specials_first else 0
    token_bytes = [bytes([b]) for b in byte_order(layout)]
    for left, right in merges:
        token_bytes.append(token_bytes[left] + token_bytes[right])
    first_special = 0 if specials_first else len(token_bytes)
    rows = [(base + i, bytearray(b), False, None, len(b)) for i, b in enumerate(token_bytes)]
    rows += [(first_special + i, bytearray(s.encode()), True, s, 0) for i, s in enumerate(SPECIAL_TOKENS)]
    merge_rows = [(r, base + a, base + b, base + BYTES + r) for r, (a, b) in enumerate(merges)]
    return (
        spark.createDataFrame(sorted(rows), VOCAB_SCHEMA),
        spark.createDataFrame(merge_rows, MERGES_SCHEMA),
    )


def byte_vocab(spark: SparkSession) -> DataFrame:
    """The vocabulary without merges: bytes 0..255, specials 256..264."""
    return tables(spark, [])[0]
