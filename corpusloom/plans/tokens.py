"""Tokenizer queries: pre-tokens, bytes, training, vocabulary, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import SPECIAL_TOKENS
from corpusloom.functions.text import byte_ids, joined, pretokens
from corpusloom.operators import bpe, codec
from corpusloom.plans.oracle_parts import byte_list, pieces
from corpusloom.plans.oracle_parts import joined as joined_sql
from corpusloom.plans.tables import BOS, MERGES, documents, spread_documents, tokenizer
from corpusloom.sources.vocab_store import load_tokenizer, save_tokenizer
from corpusloom.staging import fresh_path

# Merges of the long training; its SQL would take as many recursive steps over all words, so it has none.
LONG_MERGES = 512


def pretokenize(spark, sf_dir):
    docs = spread_documents(spark, sf_dir)
    return docs.select(
        F.col("row_index").alias("doc_id"), F.posexplode(pretokens(F.col("text"))).alias("piece_no", "piece")
    )


def pretoken_histogram(spark, sf_dir):
    return bpe.pretoken_histogram(spread_documents(spark, sf_dir))


def byte_encode(spark, sf_dir):
    docs = spread_documents(spark, sf_dir)
    return docs.select(F.col("row_index").alias("doc_id"), joined(byte_ids(F.col("text"))).alias("ids"))


def encode_with_bos(spark, sf_dir):
    encoded = codec.encode_corpus(spread_documents(spark, sf_dir), bpe.byte_vocab(spark), prepend="<|bos|>")
    return encoded.select(F.col("row_index").alias("doc_id"), joined(F.col("ids")).alias("ids"))


def decode_roundtrip(spark, sf_dir):
    vocab = bpe.byte_vocab(spark)
    encoded = codec.encode_corpus(spread_documents(spark, sf_dir), vocab)
    return encoded.select(F.col("row_index").alias("doc_id"), codec.decoder(vocab)(F.col("ids")).alias("text"))


def bpe_train(spark, sf_dir):
    return tokenizer(spark, sf_dir)[1]


def bpe_train_specials_first(spark, sf_dir):
    return tokenizer(spark, sf_dir, "specials_first")[1]


def bpe_train_long(spark, sf_dir):
    """``LONG_MERGES`` merges, through several epochs of the inverted index."""
    histogram = bpe.pretoken_histogram(spread_documents(spark, sf_dir))
    return bpe.tables(spark, bpe.learn_merges(histogram, LONG_MERGES))[1]


def vocab_table(spark, sf_dir):
    vocab = tokenizer(spark, sf_dir)[0]
    return vocab.select("token_id", F.hex("bytes").alias("bytes_hex"), "is_special", "name", "n_bytes")


def token_bytes(spark, sf_dir):
    return codec.token_byte_counts(tokenizer(spark, sf_dir)[0])


def vocab_roundtrip(spark, sf_dir):
    path = save_tokenizer(*tokenizer(spark, sf_dir), fresh_path(spark, "saved"))
    vocab, merges, _pattern, _layout = load_tokenizer(spark, path)
    learned = merges.select(F.col("new_id").alias("token_id"), "left_id", "right_id")
    return vocab.join(learned, "token_id", "left").select(
        "token_id", F.hex("bytes").alias("bytes_hex"), "is_special", "left_id", "right_id"
    )


def _encoded(spark, sf_dir):
    docs = spread_documents(spark, sf_dir)
    return codec.encode_corpus(docs, tokenizer(spark, sf_dir)[0])


def encode_docs(spark, sf_dir):
    return _encoded(spark, sf_dir).select(F.col("row_index").alias("doc_id"), joined(F.col("ids")).alias("ids"))


def encode_docs_specials_first(spark, sf_dir):
    vocab, merges = tokenizer(spark, sf_dir, "specials_first")
    encoded = codec.encode_corpus(spread_documents(spark, sf_dir), vocab, merges=merges)
    return encoded.select(F.col("row_index").alias("doc_id"), joined(F.col("ids")).alias("ids"))


def decode_docs(spark, sf_dir):
    decoded = codec.decoder(tokenizer(spark, sf_dir)[0])(F.col("ids"))
    return _encoded(spark, sf_dir).select(F.col("row_index").alias("doc_id"), decoded.alias("text"))


def vocab_lookup(spark, sf_dir):
    """Every token of the vocabulary with how often the corpus uses it."""
    used = (
        _encoded(spark, sf_dir)
        .select(F.explode("ids").alias("token_id"))
        .groupBy("token_id")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    found = codec.lookup_ids(used, tokenizer(spark, sf_dir)[0])
    return found.select("token_id", F.hex("bytes").alias("bytes_hex"), "uses")


QUERIES = {
    f.__name__: f
    for f in (
        pretokenize,
        pretoken_histogram,
        byte_encode,
        encode_with_bos,
        decode_roundtrip,
        bpe_train,
        bpe_train_specials_first,
        bpe_train_long,
        vocab_table,
        token_bytes,
        vocab_roundtrip,
        encode_docs,
        encode_docs_specials_first,
        decode_docs,
        vocab_lookup,
    )
}

# One merge at a time over the whole histogram: words with one character per symbol.  ``order`` is
# a byte -> initial symbol map as an SQL expression over the byte ``b``.
_BY_VALUE = "b"
_PRINTABLE_FIRST = (
    "case when b between 33 and 126 then b - 33 when b between 161 and 172 then b - 67"
    " when b between 174 and 255 then b - 68 when b < 33 then b + 188"
    " when b between 127 and 160 then b + 94 else 255 end"
)


def _learn(order: str) -> str:
    return f"""
hist as (select unnest({pieces("text")}) as piece from documents),
words as (
  select array_to_string(list_transform({byte_list("piece")}, lambda b: chr(({order})::int)), '') as word, count(*) as n
  from hist group by piece),
learn as (
  select 0 as round, word, n, null::varchar as pair from words where length(word) > 1
  union all
  select round + 1, replace(word, best.pair, chr(256 + round)), n, best.pair
  from learn, (
    select pair from (
      select unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) as pair, n from learn
    ) group by pair order by sum(n) desc, pair limit 1) best
  where round < {MERGES}),
merges as materialized (
  select distinct round - 1 as r, ord(pair[1]) as l, ord(pair[2]) as rr from learn where round > 0)"""


def learned_sql() -> str:
    """CTEs up to ``merges (r, l, rr)``, symbols numbered by byte value."""
    return _learn(_BY_VALUE)


# Symbol strings of every document after all merges, applied in rank order.
def _encoded_words(order: str) -> str:
    return f"""{_learn(order)},
applied as materialized (
  select 0 as i, piece,
    array_to_string(list_transform({byte_list("piece")}, lambda b: chr(({order})::int)), '') as word
  from (select distinct piece from hist)
  union all
  select i + 1, piece, replace(word, chr(l::int) || chr(rr::int), chr(256 + i)) from applied join merges on r = i),
each as (
  select doc_id, unnest(ps) as piece, unnest(range(len(ps))) as no
  from (select doc_id, {pieces("text")} as ps from documents)),
enc as (
  select doc_id, string_agg(word, '' order by no) as word
  from each join (select piece, word from applied where i = {MERGES}) using (piece) group by doc_id)"""


def _doc_ids(order: str, base: int) -> str:
    return f"""
with recursive {_encoded_words(order)}
select doc_id, array_to_string(list_transform(string_split(word, ''), lambda c: ord(c) + {base}), ' ') as ids
from (select d.doc_id, coalesce(word, '') as word from documents d left join enc using (doc_id))"""


# Bytes of each token, from the merges.
_GROW = f"""
grow as (
  select 0 as i, (select list(printf('%02X', b) order by b) from range(256) t(b)) as hexes
  union all
  select i + 1, list_append(hexes, hexes[l + 1] || hexes[rr + 1]) from grow join merges on r = i),
learned as (
  select unnest(range(len(hexes))) as id, unnest(hexes) as h from grow where i = {MERGES}),
specials as (
  select {256 + MERGES} + i as id, names[i + 1] as name
  from (select [{", ".join(f"'{s}'" for s in SPECIAL_TOKENS)}] as names) t, range({len(SPECIAL_TOKENS)}) u(i))"""

ORACLE = {
    "pretokenize": f"""
select doc_id, unnest(range(len(ps)))::int as piece_no, unnest(ps) as piece
from (select doc_id, {pieces("text")} as ps from documents)""",
    "pretoken_histogram": f"""
select piece, count(*) as n from (select unnest({pieces("text")}) as piece from documents) group by piece""",
    "byte_encode": f"select doc_id, {joined_sql(byte_list('text'))} as ids from documents",
    "encode_with_bos": f"""
select doc_id, {joined_sql(f"list_prepend({BOS}, {byte_list('text')})")} as ids from documents""",
    "decode_roundtrip": "select doc_id, text from documents",
    "decode_docs": "select doc_id, text from documents",
    "bpe_train": f"""
with recursive {_learn(_BY_VALUE)}
select r::int as rank, l::int as left_id, rr::int as right_id, (256 + r)::int as new_id from merges""",
    "bpe_train_specials_first": f"""
with recursive {_learn(_PRINTABLE_FIRST)}
select r::int as rank, (l + 9)::int as left_id, (rr + 9)::int as right_id, (265 + r)::int as new_id from merges""",
    "vocab_table": f"""
with recursive {_learn(_BY_VALUE)}, {_GROW}
select id::int as token_id, h as bytes_hex, false as is_special, null::varchar as name, (length(h) // 2)::int as n_bytes
from learned
union all select id::int, hex(name), true, name, 0 from specials""",
    "token_bytes": f"""
with recursive {_learn(_BY_VALUE)}, {_GROW}
select id::int as token_id, (length(h) // 2)::int as n_bytes from learned union all select id::int, 0 from specials""",
    "vocab_roundtrip": f"""
with recursive {_learn(_BY_VALUE)}, {_GROW}
select id::int as token_id, h as bytes_hex, false as is_special, l::int as left_id, rr::int as right_id
from learned left join merges on r = id - 256
union all select id::int, hex(name), true, null, null from specials""",
    "encode_docs": _doc_ids(_BY_VALUE, 0),
    "encode_docs_specials_first": _doc_ids(_PRINTABLE_FIRST, len(SPECIAL_TOKENS)),
    "vocab_lookup": f"""
with recursive {_encoded_words(_BY_VALUE)}, {_GROW}
select id::int as token_id, any_value(h) as bytes_hex, count(*) as uses
from (select ord(unnest(string_split(word, ''))) as id from enc where word <> '') join learned using (id) group by id""",
}
