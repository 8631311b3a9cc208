"""Saving, loading and importing a tokenizer.

A tokenizer is saved as Parquet tables.  Tokenizers that other libraries saved are imported into the
same tables; such a file is one small description, as large as its vocabulary.
"""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.fixed_values import SPLIT_PATTERN
from corpusloom.operators.bpe import MERGES_SCHEMA, VOCAB_SCHEMA, byte_order
from corpusloom.operators.codec import MAX_VOCAB_BYTES, Tokenizer
from corpusloom.staging import filesystem, qualified

# Bytes with a printable Latin-1 form come first in the byte-level alphabet and stand for themselves.
_PRINTABLE = 188


def save_tokenizer(
    vocab: DataFrame, merges: DataFrame, path: str, layout: str = "rank", pattern: str = SPLIT_PATTERN
) -> str:
    """Write ``vocab``, ``merges`` and the one-row ``meta`` table under ``path``."""
    spark = vocab.sparkSession
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
    merges.coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
    meta = spark.createDataFrame([(pattern, layout)], "pattern string, layout string")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """``(vocab, merges, pattern, layout)``; a missing folder is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return Tokenizer(
        spark.read.parquet(f"{path}/vocab"),
        spark.read.parquet(f"{path}/merges"),
        meta["pattern"],
        meta["layout"],
    )


def _content(spark: SparkSession, path: str) -> bytes:
    """A description file, after checking its size: text forms take a few times the vocabulary."""
    system, root = filesystem(qualified(spark, path))
    size = system.get_file_info(root).size
    if size is not None and size > 4 * MAX_VOCAB_BYTES:
        raise ValueError(f"{path} takes {size} bytes; the limit is {4 * MAX_VOCAB_BYTES}")
    with system.open_input_file(root) as file:
        return file.read()


def _tables(spark: SparkSession, tokens: dict[int, bytes], specials: dict[int, str], merges: list[tuple]) -> tuple:
    rows = [(i, bytearray(b), False, None, len(b)) for i, b in tokens.items()]
    rows += [(i, bytearray(name.encode()), True, name, 0) for i, name in specials.items()]
    vocab = spark.createDataFrame(sorted(rows, key=lambda r: r[0]), VOCAB_SCHEMA)
    missing = set(range(256)) - {b[0] for b in tokens.values() if len(b) == 1}
    if missing:
        raise ValueError(f"{len(missing)} bytes have no token of their own")
    return vocab, spark.createDataFrame(merges, MERGES_SCHEMA)


def import_ranks(
    spark: SparkSession, path: str, specials: dict[str, int] | None = None, pattern: str = SPLIT_PATTERN
) -> Tokenizer:
    """A tokenizer from lines of a token in base64 and its rank, which is its id.

    Such files hold neither special tokens nor the split pattern, so both are arguments.  Ids may
    have gaps.
    """
    pairs = [line.split() for line in _content(spark, path).splitlines() if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    named = {i: name for name, i in (specials or {}).items()}
    clash = tokens.keys() & named.keys()
    if clash:
        raise ValueError(f"special tokens take ids of other tokens: {sorted(clash)}")
    return Tokenizer(*_tables(spark, tokens, named, []), pattern, "rank")


def _split_pattern(step: dict | None) -> str:
    for part in (step or {}).get("pretokenizers", [step or {}]):
        if part.get("type") == "Split":
            pattern = part["pattern"]
            return pattern["Regex"] if "Regex" in pattern else re.escape(pattern["String"])
    raise ValueError("the description has no split pattern")


def import_tokenizer_json(spark: SparkSession, path: str) -> Tokenizer:
    """A tokenizer from a ``tokenizer.json`` with a byte-level BPE model and a split pattern.

    Added tokens become special tokens.  Normalizers, word prefixes or suffixes and models that
    take whole words before merging are refused: this library would encode by other rules.
    """
    spec = json.loads(_content(spark, path))
    model = spec["model"]
    if model.get("type", "BPE") != "BPE":
        raise ValueError(f"not a BPE model: {model['type']}")
    for option in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "dropout"):
        if model.get(option):
            raise ValueError(f"unsupported option: {option}")
    if spec.get("normalizer"):
        raise ValueError("normalizers are not supported")
    alphabet = {
        chr(b) if i < _PRINTABLE else chr(256 + i - _PRINTABLE): b for i, b in enumerate(byte_order("specials_first"))
    }
    specials = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    ids = model["vocab"]
    strange = [t for t, i in ids.items() if i not in specials and not alphabet.keys() >= set(t)]
    if strange:
        raise ValueError(f"not a byte-level vocabulary: {strange[:5]}")
    tokens = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if i not in specials}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(rank, ids[a], ids[b], ids[a + b]) for rank, (a, b) in enumerate(pairs)]
    return Tokenizer(*_tables(spark, tokens, specials, merges), _split_pattern(spec.get("pre_tokenizer")), "specials_first")
