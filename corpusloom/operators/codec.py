"""Encoding and decoding with a vocabulary table.

Encoding is narrow: the JVM cuts text into pieces, a task encodes each distinct piece of an Arrow
batch's slice once and gathers ids with NumPy.  No piece is shuffled, so frequent pieces cost nothing
extra.  The broadcast vocabulary is checked against a limit in bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import SPLIT_PATTERN
from corpusloom.functions.text import SLICE_PIECES, byte_ids, pretokens, slices

# Distinct pieces a task remembers, and the longest of them in characters.
MEMO_PIECES, MEMO_CHARS = 1 << 17, 64


# Largest vocabulary that is sent to tasks, in bytes: its tokens and 16 bytes for each.
MAX_VOCAB_BYTES = 256 << 20


def vocab_rows(vocab: DataFrame) -> list:
    """The whole vocabulary on the driver, in id order, after checking its size."""
    held = vocab.agg(F.coalesce(F.sum(F.octet_length("bytes") + 16), F.lit(0)).cast("bigint").alias("n")).first()["n"]
    if held > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary takes {held} bytes; the limit is {MAX_VOCAB_BYTES}")
    return vocab.orderBy("token_id").collect()


def merge_piece(piece: bytes, first_ids: list[int], rank: Callable, token: Callable) -> list[int]:
    """Ids of one piece: lowest rank first, leftmost first.

    ``rank(start, middle, end, left_id, right_id)`` is the rank of joining two neighbours or None,
    ``token(rank, start, end)`` the id of the joined token.
    """
    n = len(first_ids)
    ids, start, after, before = list(first_ids), list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = rank(start[i], start[j], end[j], ids[i], ids[j])
            if r is not None:
                heapq.heappush(queue, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        r, i, middle, stop = heapq.heappop(queue)
        j = after[i] if ids[i] >= 0 else n
        if j >= n or end[i] != middle or end[j] != stop:
            continue  # one of the two has been joined since
        ids[i], end[i], after[i], ids[j] = token(r, start[i], stop), stop, after[j], -1
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [t for t in ids if t >= 0]


def piece_encoder(rows: list, merges: list | None) -> Callable[[str], list[int]]:
    """Encoder of single pieces.

    Without ``merges`` two neighbours join when their bytes together are a token, whatever pair
    first made that token, and a piece that is a token is taken whole.  With ``merges`` only the
    learned pairs join.
    """
    ids = {bytes(r["bytes"]): r["token_id"] for r in rows if not r["is_special"]}
    single = [ids[bytes([b])] for b in range(256)]
    pairs = {(m["left_id"], m["right_id"]): (m["rank"], m["new_id"]) for m in merges or []}
    new_id = {rank: new for rank, new in pairs.values()}

    def encode(text: str) -> list[int]:
        piece = text.encode("utf-8")
        if merges is None and piece in ids:
            return [ids[piece]]
        if merges is None:
            rank = lambda s, m, e, left, right: ids.get(piece[s:e])
            token = lambda r, s, e: r
        else:
            rank = lambda s, m, e, left, right: pairs.get((left, right), (None,))[0]
            token = lambda r, s, e: new_id[r]
        return merge_piece(piece, [single[b] for b in piece], rank, token)

    return encode


def encoded(batches: Iterator[pa.Array], encode: Callable[[str], list[int]]) -> Iterator[pa.Array]:
    """Ids of lists of pieces, ``SLICE_PIECES`` pieces at a time."""
    memo: dict[str, bytes] = {}

    def ids_of(word: str) -> bytes:
        found = memo.get(word)
        if found is None:
            found = np.array(encode(word), np.int32).tobytes()
            if len(word) <= MEMO_CHARS:
                if len(memo) >= MEMO_PIECES:
                    memo.clear()
                memo[word] = found
        return found

    for batch in batches:
        for pieces in slices(batch, SLICE_PIECES):
            distinct = pieces.flatten().dictionary_encode()
            words = [ids_of(w) for w in distinct.dictionary.to_pylist()]
            lengths = np.array([len(w) for w in words], np.int64) // 4
            starts = np.cumsum(lengths) - lengths
            which = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            counts = lengths[which] if len(which) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            gather = np.arange(ends[-1]) + np.repeat(starts[which] - ends[:-1], counts)
            values = np.frombuffer(b"".join(words), np.int32)[gather]
            offsets = pieces.offsets.to_numpy()
            bounds = ends[offsets - offsets[0]].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(values), mask=pieces.is_null())


def encoder(
    vocab: DataFrame, merges: DataFrame | None = None, pattern: str = SPLIT_PATTERN
) -> Callable[[Column], Column]:
    """A function from a text column to its ``ARRAY<INT>`` of ids (ordinary text only)."""
    rows = vocab_rows(vocab)
    if all(r["is_special"] or (len(r["bytes"]) == 1 and r["token_id"] == r["bytes"][0]) for r in rows):
        return byte_ids
    merge_rows = None if merges is None else merges.orderBy("rank").collect()
    shared = vocab.sparkSession.sparkContext.broadcast((rows, merge_rows))

    @F.arrow_udf("array<int>")
    def encode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from encoded(batches, piece_encoder(*shared.value))

    return lambda text: encode_pieces(pretokens(text, pattern))


def special_id(vocab: DataFrame, name: str) -> int | None:
    """Id of a special token by exact name; None when there is no such token."""
    row = vocab.filter(F.col("is_special") & (F.col("name") == name)).select("token_id").first()
    return None if row is None else row["token_id"]


def with_ends(ids: Column, prepend: int | None = None, append: int | None = None) -> Column:
    """Add an id before and / or after each row's ids."""
    parts = [F.array(F.lit(prepend))] if prepend is not None else []
    parts += [ids]
    parts += [F.array(F.lit(append))] if append is not None else []
    return F.concat(*parts) if len(parts) > 1 else ids


def encode_corpus(
    corpus: DataFrame,
    vocab: DataFrame,
    *,
    prepend: int | str | None = None,
    append: int | str | None = None,
    merges: DataFrame | None = None,
    pattern: str = SPLIT_PATTERN,
) -> DataFrame:
    """Add ``ids ARRAY<INT>``; an end is a token id or the name of a special token."""

    def resolve(end):
        if not isinstance(end, str):
            return end
        found = special_id(vocab, end)
        if found is None:
            raise ValueError(f"{end!r} is not a special token")
        return found

    ids = encoder(vocab, merges, pattern)(F.col("text"))
    return corpus.withColumn("ids", with_ends(ids, resolve(prepend), resolve(append)))


class Tokenizer(NamedTuple):
    """Vocabulary, merges, split pattern and layout together, so that all of them reach the encoder."""

    vocab: DataFrame
    merges: DataFrame
    pattern: str = SPLIT_PATTERN
    layout: str = "rank"

    def encode(self, corpus: DataFrame, prepend: int | str | None = None, append: int | str | None = None) -> DataFrame:
        """Add ``ids`` to a corpus by the layout's own rule."""
        merges = None if self.layout == "rank" else self.merges
        return encode_corpus(corpus, self.vocab, prepend=prepend, append=append, merges=merges, pattern=self.pattern)

    def decode(self, ids: Column, errors: str = "strict") -> Column:
        return decoder(self.vocab, errors)(ids)


# Stands in the id table for an id that no token has; no hex digits.
_GAP = "-"
_REPLACEMENT = "efbfbd"


def _id_table(vocab: DataFrame, of: Callable) -> tuple[Column, int]:
    """A constant array indexed by token id + 1, and its length; ids without a token are gaps."""
    found = {r["token_id"]: of(r) for r in vocab_rows(vocab)}
    size = max(found, default=-1) + 1
    # One literal split at planning time: far cheaper than one literal per id.
    return F.split(F.lit(",".join(found.get(i, _GAP) for i in range(size))), ","), size


def _at(table: Column, size: int, i: Column, unknown: Column) -> Column:
    entry = F.when((i >= 0) & (i < size), F.element_at(table, i + 1))
    return F.when(entry != _GAP, entry).when(i.isNotNull(), unknown)


def id_bytes(vocab: DataFrame, errors: str = "strict") -> Callable[[Column], Column]:
    """A function from an id array to the hex digits of its bytes; specials give their name.

    An id without a token is an error, or with ``errors="replace"`` the character U+FFFD.
    """
    if errors not in ("strict", "replace"):
        raise ValueError(f"errors must be strict or replace, not {errors!r}")
    table, size = _id_table(vocab, lambda r: bytes(r["bytes"]).hex())

    def unknown(i: Column) -> Column:
        if errors == "replace":
            return F.lit(_REPLACEMENT)
        return F.raise_error(F.concat(F.lit("no token has id "), i.cast("string"))).cast("string")

    return lambda ids: F.array_join(F.transform(ids, lambda i: _at(table, size, i, unknown(i))), "")


def decoder(vocab: DataFrame, errors: str = "strict") -> Callable[[Column], Column]:
    """A function from an id array to text; malformed bytes become U+FFFD; unknown ids as in ``id_bytes``."""
    to_hex = id_bytes(vocab, errors)
    return lambda ids: F.make_valid_utf8(F.unhex(to_hex(ids)).cast("string"))


def token_text(vocab: DataFrame) -> Callable[[Column], Column]:
    """A function from one token id to its own text, decoded alone; NULL if no token has it."""
    table, size = _id_table(vocab, lambda r: bytes(r["bytes"]).hex())
    return lambda i: F.make_valid_utf8(F.unhex(_at(table, size, i, F.lit(None).cast("string"))).cast("string"))


def lookup_ids(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Join a ``token_id`` column with the vocabulary; unknown ids keep NULLs."""
    return tokens.join(vocab, "token_id", "left")


def token_byte_counts(vocab: DataFrame) -> DataFrame:
    """``(token_id, n_bytes)`` with 0 for tokens that must not be counted."""
    return vocab.select(
        "token_id",
        F.when(F.col("is_special"), 0).otherwise(F.octet_length("bytes")).cast("int").alias("n_bytes"),
    )
