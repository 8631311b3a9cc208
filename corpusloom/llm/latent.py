"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words.  They become TF-IDF vectors over the benchmark's words,
with document frequencies counted over all passages of the corpus.  A randomised SVD of these
vectors gives a latent space: every task multiplies its passages with a random test matrix, Spark
adds the products, and after one power step the factors are small.  The space is fitted to all
passages of all documents and of the benchmark; the pass that counts frequencies leaves the benchmark's words of each
passage in a table, which the fit reads.  The search covers every passage of every document.  A passage is a candidate for the items whose cosine with it
in the latent space is at least ``LEAST_COSINE``, both lengths being those of the full vectors, times
the share of the item's own squared length that the space retains: what the space loses of an item
it loses of its copies as well.  Items shorter than a passage are not held to what stands around
them: the passage counts as no longer than the item.  The
candidates are checked by their longest common subsequence of words with the item, and for
the item's answer where the benchmark has one.

The benchmark is a stated query set.  Its passages are taken shortest items first in blocks of
``RANK``, as many as the space has directions.  One pass over the documents, which splits them into words once,
searches as many blocks as fit in ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import hash_words, slices_by_bytes, words_of
from corpusloom.llm.bit_filter import filter_bits, in_filter
from corpusloom.llm.ranks import with_global_position
from corpusloom.staging import stage

WINDOW, STRIDE = 48, 16
RANK, OVERSAMPLE, SEED = 256, 16, 5
# Items fetched at a time, and bytes of blocks that are sent to tasks together.
FETCH_ITEMS, BROADCAST_BYTES = 256, 64 << 20
# Document frequencies are kept by hash of the word.
BUCKETS, CHUNK = 1 << 18, 1 << 14
LEAST_COSINE, LEAST_LCS = 0.2, 0.6
# Size of the bit filter of the benchmark's words.  It is fixed: with more words more of a passage's words pass, and the fit drops them.
FILTER_BITS = 1 << 23
# Each benchmark passage weighs as much as this many corpus passages in the fit, or ``ITEM_SHARE`` of them all if that is more.
ITEM_WEIGHT, ITEM_SHARE = 200.0, 0.01
# Passages compared at a time, and rows of word counts multiplied at a time: few rows have few distinct words.
BATCH, COUNTED = 512, 64


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words without punctuation at either end, and each text's bounds."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    words, bounds = words_of(lowered)
    return pc.utf8_trim(words, characters=".,;:!?\"'()[]{}<>|*#%&$_-"), bounds


def _bucket(words: pa.Array) -> np.ndarray:
    return (hash_words(words) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _encode(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a slice, the number of each word in order, and text bounds."""
    words, bounds = plain_words(texts)
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds


def window_starts(bounds: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and stop of every passage; the last one of a text may be shorter."""
    lengths = np.diff(bounds)
    count = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - window) // stride)), 0)
    text = np.repeat(np.arange(len(lengths)), count)
    start = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return text, start, np.minimum(start + window, bounds[text + 1])


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine-word step per element of ``b``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def word_counts(words: np.ndarray, rows: np.ndarray, n: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``words`` (numbers below ``vocabulary``), and how often each of ``n`` rows has them."""
    here = pc.unique(pa.array(words)).to_numpy()
    place = np.empty(vocabulary, np.int64)
    place[here] = np.arange(len(here))
    counts = np.bincount(rows * len(here) + place[words], minlength=n * len(here))
    return here, counts.reshape(n, len(here)).astype(np.float32)


def known_words(benchmark: DataFrame) -> bytes:
    """A bit filter of the hashes of all words in ``benchmark.text``."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(hash_words(pc.unique(plain_words(batch.column(0))[0])).view(np.int64))], ["h"])

    return filter_bits(benchmark.select("text").mapInArrow(hashes, "h bigint"), FILTER_BITS)


def word_passages(docs: DataFrame, known: bytes) -> DataFrame:
    """Word counts and passages (blocks of ``WINDOW`` words) of ``docs``, as a table.

    Rows ``(chunk, sums)`` say in how many passages of a task each of ``CHUNK`` word buckets occurs, after the last bucket how
    many passages there are.  Rows ``(names, which, sizes)`` hold the passages of a slice of texts as arrays: the hashes of words that
    pass the filter ``known``, which of them follow each other, and how many of these each passage has.
    """
    marks = docs.sparkSession.sparkContext.broadcast(known)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(marks.value, np.uint8)
        total, passages = np.zeros(BUCKETS, np.int64), 0
        columns = ["chunk", "sums", "names", "which", "sizes"]
        for batch in batches:
            for part in slices_by_bytes(batch.column(0), 2 << 20):
                names, which, bounds = _encode(part)
                if len(which) == 0:
                    continue
                lengths = np.diff(bounds)
                inside = np.arange(len(which)) - np.repeat(bounds[:-1], lengths)
                opens = inside % WINDOW == 0
                passage = np.cumsum(opens)
                passages += int(passage[-1])
                hashes = hash_words(names)
                buckets = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)[which]
                pairs = pc.unique(pa.array(passage * BUCKETS + buckets)).to_numpy()
                total += np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS)
                met = in_filter(hashes, bits)
                if met.any():
                    hit = met[which]
                    number = (np.cumsum(met) - 1).astype(np.uint16 if met.sum() <= 1 << 16 else np.int32)
                    sizes = np.bincount(passage[hit] - 1, minlength=int(passage[-1])).astype(np.int32)
                    held = [hashes[met].tobytes(), number[which[hit]].tobytes(), sizes.tobytes()]
                    none = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
                    yield pa.record_batch([*none, *(pa.array([x], pa.binary()) for x in held)], columns)
        total = np.append(total, passages)
        parts = [total[i : i + CHUNK].tobytes() for i in range(0, len(total), CHUNK)]
        none = pa.nulls(len(parts), pa.binary())
        yield pa.record_batch([pa.array(np.arange(len(parts))), pa.array(parts, pa.binary()), none, none, none], columns)

    return stage(docs.select("_body").mapInArrow(split, "chunk bigint, sums binary, names binary, which binary, sizes binary"), "passages")


def passage_frequencies(split: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages each word bucket occurs, and their number, of a table as ``word_passages`` gives it."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = split.where("chunk is not null").select("chunk", "sums").groupBy("chunk").applyInArrow(add, "chunk bigint, sums binary")
    found = sorted((r["chunk"], r["sums"]) for r in parts.collect())  # BUCKETS + 1 numbers
    out = np.concatenate([np.frombuffer(x, np.int64) for _, x in found]) if found else np.zeros(BUCKETS + 1, np.int64)
    return out[:BUCKETS], int(out[BUCKETS])


class Items:
    """A block of benchmark passages: words, weights and latent vectors; plain arrays in ``parts``."""

    def __init__(self, parts: dict):
        self.parts = parts

    @staticmethod
    def of(passages: list[tuple], idf: np.ndarray) -> Items:
        """``passages``: (item, its words, answer or None)."""
        encoded = pa.array([w for _, words, _ in passages for w in words], pa.string()).dictionary_encode()
        names, which = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weights = np.maximum(idf[_bucket(names)], 0)
        spans = np.split(which, np.cumsum([len(words) for _, words, _ in passages])[:-1])
        return Items({
            "names": names, "weights": weights, "spans": spans,
            "item": [p[0] for p in passages], "answers": [p[2] for p in passages],
            "norms": np.array([np.linalg.norm(weights[s]) for s in spans]),
        })

    def dense(self, vectors: np.ndarray) -> np.ndarray:
        """Benchmark passages as sums of word vectors."""
        return np.array([(self.parts["weights"][s, None] * vectors[s]).sum(axis=0) for s in self.parts["spans"]])

    def locate(self, names: pa.Array) -> np.ndarray:
        """Number of each word among the block's words, or -1."""
        return pc.fill_null(pc.index_in(names, value_set=self.parts["names"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def latent_space(split: DataFrame, items: Items, passages: int, rank: int = RANK) -> np.ndarray:
    """Orthonormal directions over the block's words from a distributed randomised SVD.

    ``split`` is a table as ``word_passages`` gives it, ``passages`` their number.
    """
    words = len(items.parts["names"])
    width = min(rank + OVERSAMPLE, words, max(1, len(items.parts["spans"]) + OVERSAMPLE))
    basis = np.random.default_rng(SEED).standard_normal((words, width)).astype(np.float32)
    weights = items.parts["weights"]
    hashes = hash_words(items.parts["names"])
    order = np.argsort(hashes)
    ordered = hashes[order]
    item_weight = max(ITEM_WEIGHT, ITEM_SHARE * passages)
    rows_of_chunk = 1024
    held = split.where("names is not null").select("names", "which", "sizes")

    def product(directions: np.ndarray) -> np.ndarray:
        """``A^T A directions`` over all corpus passages and the weighted benchmark passages."""

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((words, width))
            scaled = (weights[:, None] * directions).astype(np.float32)
            for batch in batches:
                for names, which, sizes in zip(*(batch.column(c).to_pylist() for c in ("names", "which", "sizes"))):
                    names, sizes = np.frombuffer(names, np.uint64), np.frombuffer(sizes, np.int32)
                    place = np.minimum(np.searchsorted(ordered, names), words - 1)
                    at = np.where(ordered[place] == names, order[place], -1)
                    which = np.frombuffer(which, np.uint16 if len(which) == 2 * sizes.sum() else np.int32)
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    for i in range(0, len(sizes), COUNTED):
                        j = min(i + COUNTED, len(sizes))
                        inside, row = at[which[ends[i] : ends[j]]], np.repeat(np.arange(j - i), sizes[i:j])
                        hit = inside >= 0
                        here, counts = word_counts(inside[hit], row[hit], j - i, words)
                        total[here] += counts.T @ (counts @ scaled[here])
            total *= weights[:, None]
            for chunk in range(0, words, rows_of_chunk):
                yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([total[chunk : chunk + rows_of_chunk].astype(np.float32).tobytes()], pa.binary())], ["chunk", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in sorted(table.column("sums").to_pylist()))
            return pa.table({"chunk": table.column("chunk").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

        partial = held.mapInArrow(multiply, "chunk bigint, sums binary")
        out = np.zeros((words, width))
        for r in partial.groupBy("chunk").applyInArrow(add, "chunk bigint, sums binary").collect():
            block = np.frombuffer(r["sums"], np.float64).reshape(-1, width)
            out[r["chunk"] : r["chunk"] + len(block)] = block
        for s in items.parts["spans"]:
            w = weights[s]
            np.add.at(out, s, item_weight * w[:, None] * (w[:, None] * directions[s]).sum(axis=0))
        return out

    q, _ = np.linalg.qr(product(basis))
    image = product(q.astype(np.float32))
    # A^T A restricted to the found directions: its eigenvectors are the right singular vectors.
    values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
    return (q @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


def item_passages(rows: list[tuple]) -> Iterator[tuple]:
    """``(item, words, answer)`` of the passages of ``(item, text, answer)``; instead of a short remainder the last words of a long item are a passage."""
    words, bounds = plain_words(pa.array([r[1] or "" for r in rows], pa.string()))
    text, start, stop = window_starts(bounds, WINDOW, WINDOW)
    start = np.where(stop - start < WINDOW // 2, np.maximum(stop - WINDOW, bounds[text]), start)
    for t, a, b in zip(text, start, stop):
        yield rows[t][0], words[int(a) : int(b)].to_pylist(), rows[t][2]


def blocks_of(asked: DataFrame, total: int, idf: np.ndarray) -> Iterator[Items]:
    """The benchmark's passages in blocks of ``RANK``; ``FETCH_ITEMS`` items are at the driver at a time."""
    waiting: list[tuple] = []
    for low in range(0, total, FETCH_ITEMS):
        rows = asked.where(f"_at >= {low} and _at < {low + FETCH_ITEMS}").orderBy("_at").select("_at", "text", "answer").collect()
        waiting += item_passages(rows)
        while len(waiting) >= RANK:
            yield Items.of(waiting[:RANK], idf)
            waiting = waiting[RANK:]
    if waiting:
        yield Items.of(waiting, idf)


def prepared(items: Items, space: np.ndarray) -> dict:
    """What a task needs to search a block: its passages, their latent vectors and those of its words."""
    latent = items.dense(space).astype(np.float32)
    norms = items.parts["norms"]
    retained = np.minimum(1.0, (latent.astype(np.float64) ** 2).sum(axis=1) / np.maximum(norms**2, 1e-12))
    return items.parts | {
        "latent": latent, "vectors": (items.parts["weights"][:, None] * space).astype(np.float32), "least_cosine": LEAST_COSINE * retained,
        "short": np.array([len(s) < WINDOW for s in items.parts["spans"]]),
    }


def _size(block: dict) -> int:
    return sum(block[name].nbytes for name in ("latent", "vectors", "names", "weights")) + sum(s.nbytes for s in block["spans"])


def common_share(span: list[int], words: list[int]) -> float:
    """Share of ``span`` in its longest common subsequence with ``words``.

    Under half a window, ``span`` is compared with stretches of twice its length, since a few words
    are found in any order somewhere in a longer one.
    """
    n = len(span)
    if n >= WINDOW // 2 or len(words) <= 2 * n:
        return lcs(span, words) / n
    step = max(1, n // 2)
    return max(lcs(span, words[i : i + 2 * n]) for i in range(0, len(words) - n + step, step)) / n


def search(docs: DataFrame, blocks: list[dict], idf: np.ndarray, id_type: str) -> DataFrame:
    """Checked matches ``(doc_id, item, cosine, lcs_share, start)`` of every passage of every document."""
    packed = docs.sparkSession.sparkContext.broadcast((blocks, idf))

    def candidates(block: dict, at: np.ndarray, bounds: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, mass: np.ndarray) -> Iterator[tuple]:
        """Passage, span and cosine of what is near in the latent space."""
        v, q, norms = block["vectors"], block["latent"], block["norms"]
        cap, least = np.where(block["short"], norms, np.inf), block["least_cosine"] * norms
        # Passages overlap: words are added up once for each stride, and a passage is a few of these sums.
        before = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // STRIDE))])
        first = before[text] + (start - bounds[text]) // STRIDE
        last = np.minimum(first + WINDOW // STRIDE, before[text + 1])
        known = np.flatnonzero(at >= 0)
        owner = np.searchsorted(bounds, known, side="right") - 1
        stride = before[owner] + (known - bounds[owner]) // STRIDE
        for i in range(0, len(start), BATCH):
            j = min(i + BATCH, len(start))
            lo, hi = first[i], last[j - 1]
            sums = np.zeros((hi - lo + 1, v.shape[1]), np.float32)  # the last row stays zero
            for k in range(lo, hi, 2 * COUNTED):
                n = min(2 * COUNTED, hi - k)
                a, b = np.searchsorted(stride, [k, k + n])
                here, counts = word_counts(at[known[a:b]], stride[a:b] - k, n, len(v))
                sums[k - lo : k - lo + n] = counts @ v[here]
            spots = first[i:j, None] + np.arange(WINDOW // STRIDE)
            spots = np.where(spots < last[i:j, None], spots, hi) - lo
            product = sums[spots].sum(axis=1) @ q.T
            length = np.sqrt(mass[stop[i:j]] - mass[start[i:j]])[:, None]
            for r, c in zip(*np.nonzero(product >= np.maximum(np.minimum(length, cap) * least, 1e-9))):
                yield i + r, c, float(product[r, c] / max(length[r, 0] * norms[c], 1e-9))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, weights = packed.value
        for batch in batches:
            found: list[tuple] = []
            done = 0
            for part in slices_by_bytes(batch.column(1), 2 << 20):
                names, which, bounds = _encode(part)
                ids = batch.column(0).slice(done, len(part))
                done += len(part)
                if len(which) == 0:
                    continue
                text, start, stop = window_starts(bounds)
                mass = np.concatenate([[0.0], np.cumsum((np.maximum(weights[_bucket(names)], 0) ** 2)[which])])
                spaced: dict[int, str] = {}
                for block in shared:
                    at = Items(block).locate(names)[which]
                    spans, last = [x.tolist() for x in block["spans"]], -1
                    for passage, c, cosine in candidates(block, at, bounds, text, start, stop, mass):
                        if passage != last:
                            last, t = passage, int(text[passage])
                            lo, hi = max(int(bounds[t]), int(start[passage]) - STRIDE), min(int(bounds[t + 1]), int(stop[passage]) + STRIDE)
                            words = at[lo:hi].tolist()
                            there = set(words).__contains__
                        # Words that do not occur cannot be in a common subsequence.
                        if sum(map(there, spans[c])) < LEAST_LCS * len(spans[c]):
                            continue
                        share = common_share(spans[c], words)
                        if share < LEAST_LCS:
                            continue
                        answer = block["answers"][c]
                        if answer:
                            if t not in spaced:
                                spaced[t] = " ".join(part[t].as_py().lower().split())
                            if " ".join(answer.lower().split()) not in spaced[t]:
                                continue
                        found.append((ids[t].as_py(), block["item"][c], cosine, share, lo - int(bounds[t])))
            columns = list(zip(*found)) if found else [()] * 5
            types = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item", "cosine", "lcs_share", "start"])

    return docs.mapInArrow(find, f"doc_id {id_type}, item bigint, cosine double, lcs_share double, start bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, start)``: the best match of each document with each item.

    ``benchmark`` has ``item_id``, ``text`` and maybe ``answer``; an item with an answer matches only
    documents that have it.  Null and empty texts, on either side, match nothing; an empty
    benchmark or an empty corpus gives no rows.  Repeated items are items; repeated rows of one id
    give one row per item; null ids are kept.  ``start`` is the word at which the compared stretch begins.
    Other columns are ignored.
    """
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_body"))
    id_type = body.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    asked = with_global_position(benchmark.select("item_id", "text", answer.alias("answer")), [n_words, F.col("item_id"), F.col("text")], "_at")
    total = asked.count()
    # One pass over the texts for what the fit needs; read twice for each block.
    split = word_passages(body, known_words(asked))
    frequencies, passages = passage_frequencies(split)
    idf = np.log((1 + passages) / (1 + frequencies))
    matches = None
    waiting: list[dict] = []

    def searched(before: DataFrame | None) -> DataFrame:
        found = search(body, list(waiting), idf, id_type)
        return found if before is None else before.unionByName(found)

    for items in blocks_of(asked, total, idf):
        block = prepared(items, latent_space(split, items, passages))
        if waiting and sum(map(_size, waiting)) + _size(block) > BROADCAST_BYTES:
            matches = searched(matches)
            waiting.clear()
        waiting.append(block)
    if waiting:
        matches = searched(matches)
    if matches is None:
        empty = f"doc_id {id_type}, item_id {item_type}, cosine double, lcs_share double, start bigint"
        return body.sparkSession.createDataFrame([], empty)
    best = F.max(F.struct("lcs_share", "cosine", (-F.col("start")).alias("start")))
    named = matches.join(asked.select(F.col("_at").alias("item"), "item_id"), "item")
    return named.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.cosine").alias("cosine"), F.col("b.lcs_share").alias("lcs_share"), (-F.col("b.start")).alias("start")
    )
