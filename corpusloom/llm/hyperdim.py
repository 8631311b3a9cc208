"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  A trigram is bound by
multiplying its letters' vectors, each rolled by its place; a text's profile is the sum (bundle) of
its trigrams, and a language's prototype the bundle over all its training texts.  A text takes the
language whose prototype has the largest cosine with its profile.

Bundling is linear, so a prototype is built from the trigram counts of a language: the training
pass counts trigrams, Spark sums the counts, and only then are vectors bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import code_points, slices_by_bytes

DIMENSIONS, SEED = 1024, 7
# Bytes of text that become one dense block of trigram counts.
BLOCK_BYTES = 256 << 10
# Trigrams are cut from this many bytes of text at a time: they take some fifty times as many bytes.
GRAM_BYTES = 512 << 10
# Bound trigram vectors a task remembers (a cache).
MEMO_GRAMS = 40_000
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """Letter flags by code point, built once in a process."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)], bool)
    return _letters


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram keys of texts, and the text each belongs to.

    Letters are lower-cased; every run of other characters is one blank, also at both ends.
    """
    # A blank between texts ends one and starts the next; the marks show where texts begin.
    lowered = [t.lower() for t in texts]
    points = code_points(" " + " ".join(lowered) + " ").astype(np.int64)
    lengths = np.array([len(t) + 1 for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.concatenate([owner[:1], owner])
    points[~_is_letter()[points]] = 0
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    points, owner = points[keep], owner[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    # A trigram belongs to its middle letter's text; those around a blank between two texts have it in the middle.
    middle = points[1:-1] != 0
    return keys[middle], owner[1:-1][middle]


class GramVectors:
    """Bound vectors of trigrams, remembered inside a task."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        # Entries are +1 and -1; rows not used yet take no memory.
        self.rows = np.zeros((MEMO_GRAMS, dimensions), np.int8)

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            draw = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * draw - 1).astype(np.int8)
        return self.letters[point]

    def bind(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def of(self, keys: np.ndarray) -> np.ndarray:
        if len(self.place) + len(keys) > MEMO_GRAMS:
            self.place.clear()
        if len(keys) > len(self.rows):
            self.rows = np.zeros((len(keys), self.dimensions), np.int8)
            self.place.clear()
        at = np.zeros(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            p = self.place.get(key)
            if p is None:
                p = self.place[key] = len(self.place)
                self.rows[p] = self.bind(key)
            at[i] = p
        return self.rows[at]


def profiles(texts: list[str], vectors: GramVectors, columns: int = 4096) -> np.ndarray:
    """Bundles of texts, one row each; a text without letters has a zero row."""
    keys, owner = grams_of(texts)
    out = np.zeros((len(texts), vectors.dimensions), np.float32)
    if len(keys) == 0:
        return out
    encoded = pa.array(keys).dictionary_encode()
    distinct = encoded.dictionary.to_numpy()
    which = encoded.indices.to_numpy().astype(np.int64)
    for start in range(0, len(distinct), columns):
        n = min(columns, len(distinct) - start)
        inside = slice(None) if n == len(distinct) else (which >= start) & (which < start + n)
        counts = np.bincount(owner[inside] * n + which[inside] - start, minlength=len(texts) * n)
        out += counts.reshape(len(texts), n).astype(np.float32) @ vectors.of(distinct[start : start + n]).astype(np.float32)
    return out


def gram_counts(labelled: DataFrame, label: str, text: str) -> DataFrame:
    """``(label, gram, n)`` over all rows; a task sums its texts before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by(["label", "gram"]).aggregate([("n", "sum")])
            return pa.table({"label": found["label"], "gram": found["gram"], "n": found["n_sum"]})

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for name in pc.unique(names).to_pylist():
                for part in slices_by_bytes(texts.filter(pc.equal(names, name)), GRAM_BYTES):
                    found = pc.value_counts(pa.array(grams_of(part.to_pylist())[0]))
                    label = pa.array([name], pa.string()).take(pa.array(np.zeros(len(found), np.int64)))
                    held.append(pa.table({"label": label, "gram": found.field(0), "n": found.field(1)}))
                    size += len(found)
                    if size > 500_000:
                        held = [summed()]
                        size = len(held[0])
                        if size > 400_000:  # mostly different ones: they go on as they are
                            yield from held[0].to_batches(1 << 16)
                            held, size = [], 0
        if held:
            yield from summed().to_batches(1 << 16)

    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "label string, gram bigint, n bigint")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Language names in order and their unit prototypes; one vector per language and task is summed."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors(dimensions, seed)
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names, grams, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in pc.unique(names).to_pylist():
                mine = pc.equal(names, name).to_numpy(zero_copy_only=False)
                total = held.setdefault(name, np.zeros(dimensions, np.float64))
                own, often = grams[mine], n[mine]
                for i in range(0, len(own), 4096):
                    total += often[i : i + 4096].astype(np.float64) @ vectors.of(own[i : i + 4096]).astype(np.float64)
        arrays = [pa.array(held, pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))]
        yield pa.record_batch(arrays, ["label", "part"])

    parts = counts.mapInArrow(bundle, "label string, part array<double>")
    summed = parts.select("label", F.posexplode("part")).groupBy("label", "pos").agg(F.sum("col").alias("v"))
    rows = summed.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("v"))
    found = sorted((r["label"], r["v"]) for r in rows.collect())
    names = [name for name, _ in found]
    # Sums are whole numbers, so their order does not matter.
    matrix = np.array([v for _, v in found], np.float64).reshape(len(names), dimensions)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return names, matrix / np.where(norms > 0, norms, 1)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the cosine with the chosen prototype (negative counts as 0).

    What all languages have in common is taken out before the choice: the mean prototype is
    subtracted from each.  ``und`` with score 0 if the text is null or has no letter, or if there
    are no languages.  Equal cosines: the first name.
    """
    common = matrix.mean(axis=0) if len(names) > 1 else np.zeros(matrix.shape[1])
    own = matrix - common
    norms = np.linalg.norm(own, axis=1, keepdims=True)
    own = own / np.where(norms > 0, norms, 1)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def choose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = GramVectors(matrix.shape[1] if matrix.size else DIMENSIONS)
        for texts in batches:
            chosen: list[str] = []
            scores: list[float] = []
            for part in slices_by_bytes(pc.fill_null(texts, ""), BLOCK_BYTES):
                bundles = profiles(part.to_pylist(), vectors)
                size = np.linalg.norm(bundles, axis=1).astype(np.float64)
                if not names:
                    chosen += [UNDETERMINED] * len(part)
                    scores += [0.0] * len(part)
                    continue
                best = (bundles @ own.T.astype(np.float32)).argmax(axis=1)
                dots = (bundles.astype(np.float64) * matrix[best]).sum(axis=1)
                score = np.clip(dots / np.where(size > 0, size, 1), 0.0, 1.0)
                chosen += [names[b] if s > 0 else UNDETERMINED for b, s in zip(best.tolist(), size.tolist())]
                scores += score.tolist()
            yield pa.StructArray.from_arrays([pa.array(chosen, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = docs.withColumn("_found", choose(F.col(text)))
    return found.select(*[c for c in docs.columns if c not in ("lang_pred", "score")], "_found.lang_pred", "_found.score")


def identify(docs: DataFrame, held_out) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row, learned from rows that are not held out.

    Rows without ``lang`` or ``text`` are not learned from; null ids count as empty ids.  Repeated
    rows are learned as often as they occur.  Other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    labelled = rows.where("not held_out and lang is not null and text is not null")
    names, matrix = prototypes(gram_counts(labelled, "lang", "text"))
    return predict(rows, names, matrix).select("doc_id", "held_out", "lang_pred", "score")
