"""Token counts by a public tokenizer file, lengths only.

A text is cut at ASCII white space, which the tokenizer itself drops: no token spans it, and no
normaliser of the file composes across it.  So a text's count is the sum over its words, however
long the text is.  The words of a slice of about equal bytes are dictionary-encoded; only words
not met before in the task go through the library, in batches balanced by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import slices_by_bytes, sums_between, words_of

# Bytes of distinct words a task remembers before it starts afresh (a cache: results don't change).
MEMO_BYTES = 64 << 20
# Bytes of words given to the library in one call.
BATCH_BYTES = 1 << 20


def _lengths(tokenizer, words: list[str]) -> list[int]:
    """Token counts of words, encoded in batches of about ``BATCH_BYTES``."""
    out: list[int] = []
    batch: list[str] = []
    held = 0
    for w in words:
        batch.append(w)
        held += len(w) + 16
        if held >= BATCH_BYTES:
            out += [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]
            batch, held = [], 0
    return out + [len(e.ids) for e in tokenizer.encode_batch(batch, add_special_tokens=False)]


def token_counter(path: str):
    """A function from a text column to its number of tokens.

    ``path`` names a ``tokenizers`` JSON file whose pre-tokeniser drops ASCII white space; it must
    exist on every executor.
    """

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        memo: dict[str, int] = {}
        held = 0
        for texts in batches:
            counts = []
            for part in slices_by_bytes(pc.fill_null(texts, "")):
                words, bounds = words_of(part)
                encoded = words.dictionary_encode()
                distinct = encoded.dictionary.to_pylist()
                if held > MEMO_BYTES:
                    memo, held = {}, 0
                new = [w for w in distinct if w not in memo]
                held += sum(len(w) for w in new) + 64 * len(new)
                memo.update(zip(new, _lengths(tokenizer, new)))
                lengths = np.array([memo[w] for w in distinct] or [0], np.int64)
                which = encoded.indices.to_numpy(zero_copy_only=False)
                counts.append(sums_between(lengths[which], bounds))
            yield pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row.

    Null and empty texts count 0 bytes and 0 tokens.  Repeated rows and null ids give one row each;
    other columns are ignored, so their names cannot clash.  An empty table gives no rows.
    """
    whole: Column = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(id_col), F.octet_length(whole).cast("bigint").alias("n_bytes"), token_counter(path)(whole).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
