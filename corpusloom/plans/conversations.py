"""Conversation queries on the byte vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.fixed_values import SPECIAL_TOKENS
from corpusloom.functions.text import byte_ids, joined
from corpusloom.operators import bpe
from corpusloom.operators import conversations as chat
from corpusloom.plans.oracle_parts import byte_list
from corpusloom.plans.oracle_parts import pieces
from corpusloom.plans.tables import MERGES, messages, tokenizer
from corpusloom.plans.tokens import learned_sql

MAX_TOKENS, SHORT = chat.MAX_TOKENS, 128


def _messages(spark, sf_dir):
    return chat.text_messages(messages(spark, sf_dir))


def _parted(spark, sf_dir):
    """Assistant messages with one part per line, of the three kinds in turn."""
    kinds = F.array(*[F.lit(k) for k in chat.PART_TYPES])
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.struct(F.element_at(kinds, i % 3 + 1).alias("type"), line.alias("text")),
    )
    whole = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    parts = F.when(F.col("role") == "assistant", lines).otherwise(whole)
    return messages(spark, sf_dir).select("conv_id", "turn", "role", parts.alias("parts"))


def _shown(rendered):
    return rendered.select("conv_id", joined(F.col("ids")).alias("ids"), joined(F.col("mask")).alias("mask"))


def conversation_rejects(spark, sf_dir):
    return chat.rejects(_messages(spark, sf_dir))


def conversation_rejects_mixed(spark, sf_dir):
    """Faults of conversations whose roles are mixed up by the length of their messages."""
    mixed = messages(spark, sf_dir).withColumn(
        "role",
        F.when(F.length("text") % 7 == 0, "system").when(F.length("text") % 5 == 0, "assistant").otherwise(F.col("role")),
    )
    return chat.rejects(chat.text_messages(mixed))


def merge_system(spark, sf_dir):
    merged = chat.merge_system(_messages(spark, sf_dir))
    return merged.select("conv_id", "turn", "role", F.col("parts")[0]["text"].alias("text"))


def render_conversation(spark, sf_dir):
    return _shown(chat.render(_messages(spark, sf_dir), bpe.byte_vocab(spark), MAX_TOKENS))


def render_truncated(spark, sf_dir):
    return _shown(chat.render(_messages(spark, sf_dir), bpe.byte_vocab(spark), SHORT))


def render_parts(spark, sf_dir):
    return _shown(chat.render(_parted(spark, sf_dir), bpe.byte_vocab(spark), MAX_TOKENS))


def render_trained(spark, sf_dir):
    return _shown(chat.render(_messages(spark, sf_dir), tokenizer(spark, sf_dir)[0], MAX_TOKENS))


def completion_prompts(spark, sf_dir):
    prompts = chat.completion_prompts(_messages(spark, sf_dir), bpe.byte_vocab(spark), MAX_TOKENS)
    return prompts.select("conv_id", joined(F.col("ids")).alias("ids"))


def completion_rejects(spark, sf_dir):
    return chat.completion_rejects(_messages(spark, sf_dir))


def mask_audit(spark, sf_dir):
    vocab = bpe.byte_vocab(spark)
    audit = chat.mask_audit(chat.render(_messages(spark, sf_dir), vocab, MAX_TOKENS), vocab)
    return audit.withColumn("supervised_share", F.round("supervised_share", 6))


QUERIES = {
    f.__name__: f
    for f in (
        conversation_rejects,
        conversation_rejects_mixed,
        merge_system,
        render_conversation,
        render_truncated,
        render_parts,
        render_trained,
        completion_prompts,
        completion_rejects,
        mask_audit,
    )
}

_ID = {name: 256 + i for i, name in enumerate(SPECIAL_TOKENS)}
_US, _UE, _AS, _AE = (_ID[f"<|{n}|>"] for n in ("user_start", "user_end", "assistant_start", "assistant_end"))
_PS, _PE, _OS, _OE = (_ID[f"<|{n}|>"] for n in ("python_start", "python_end", "output_start", "output_end"))

_JUDGED_FROM = """
numbered as (
  select *, row_number() over w - 1 as ord, first_value(role) over w = 'system' as sys,
    count(*) over (partition by conv_id) as cnt,
    last_value(role) over (w rows between unbounded preceding and unbounded following) as last_role
  from {source} window w as (partition by conv_id order by turn)),
faults as (
  select *, case
    when sys and ord = 0 then case when cnt = 1 then 'system_only' end
    when sys and ord = 1 and role <> 'user' then 'system_without_user'
    when (ord - sys::int) % 2 = 0 and role <> 'user' then 'expected_user'
    when (ord - sys::int) % 2 = 1 and role <> 'assistant' then 'expected_assistant' end as reason
  from numbered),
merged as (
  select conv_id, turn, ord, cnt, sys, last_role, role,
    case when sys and ord = 1 then lag(text) over w || chr(10) || chr(10) || text else text end as text
  from numbered window w as (partition by conv_id order by ord))"""

_JUDGED = _JUDGED_FROM.format(source="conversations")


def _items(good: str, lines: bool = False) -> str:
    """Ids and mask of every part of the messages that pass ``good``."""
    split = "case when role = 'assistant' then string_split(text, chr(10)) else [text] end" if lines else "[text]"
    return f"""
parts as (
  select conv_id, ord, role, len(ps) as np, unnest(ps) as text, unnest(range(len(ps))) as part
  from (select *, {split} as ps from merged where not (sys and ord = 0) and {good})),
bodies as (
  select *, {byte_list("text")} as b,
    case when role = 'user' then 'u' when part % 3 = 1 then 'p' when part % 3 = 2 then 'o' else 't' end as kind from parts),
items as (
  select conv_id, ord, part,
    case when role = 'user' then [{_US}] when part = 0 then [{_AS}] else [] end as opening,
    case kind when 'p' then [{_PS}] || b || [{_PE}] when 'o' then [{_OS}] || b || [{_OE}] else b end as body,
    case when role = 'user' then [{_UE}] when part = np - 1 then [{_AE}] else [] end as closing,
    case when kind in ('u', 'o') then 0 else 1 end as bm, case when role = 'user' then 0 else 1 end as cm
  from bodies),
rendered as (
  select conv_id, [256] || flatten(list(opening || body || closing order by ord, part)) as ids,
    [0] || flatten(list(list_transform(opening, lambda x: 0) || list_transform(body, lambda x: bm)
      || list_transform(closing, lambda x: cm) order by ord, part)) as mask
  from items group by conv_id)"""


_GOOD = "conv_id not in (select conv_id from faults where reason is not null)"
# A prompt drops the last message, which is not judged; something must be left of the rest.
_PROMPT_GOOD = """ord < cnt - 1 and last_role = 'assistant' and cnt - 1 - sys::int >= 1
  and conv_id not in (select conv_id from faults where reason is not null and ord < cnt - 1)"""


def _render(n: int, lines: bool = False) -> str:
    return f"""
with {_JUDGED}, {_items(_GOOD, lines)}
select conv_id, array_to_string(ids[:{n}], ' ') as ids, array_to_string(mask[:{n}], ' ') as mask from rendered"""


# Learned tokens are numbered from 1000 while the ids are put together, to keep them apart from
# the specials of the byte vocabulary.
_TRAINED = f"""
with recursive {_JUDGED}, {learned_sql()},
texts as (select conv_id, ord, {pieces("text")} as ps from merged where not (sys and ord = 0)),
applied as materialized (
  select 0 as i, piece, array_to_string(list_transform({byte_list("piece")}, lambda b: chr(b::int)), '') as word
  from (select distinct unnest(ps) as piece from texts)
  union all
  select i + 1, piece, replace(word, chr(l::int) || chr(rr::int), chr(1000 + i)) from (
    select i, piece, word, case when l < 256 then l else l + 744 end as l, case when rr < 256 then rr else rr + 744 end as rr
    from applied join merges on r = i)),
enc as (
  select conv_id, ord as place, list_transform(string_split(string_agg(word, '' order by no), ''), lambda c: ord(c)) as b
  from (select conv_id, ord, unnest(ps) as piece, unnest(range(len(ps))) as no from texts)
    join (select piece, word from applied where i = {MERGES}) using (piece)
  group by conv_id, ord),
{_items(_GOOD).replace(byte_list("text"), "coalesce((select e.b from enc e where e.conv_id = parts.conv_id and e.place = parts.ord), [])")}
select conv_id, array_to_string(list_transform(ids[:{MAX_TOKENS}], lambda x:
    case when x >= 1000 then x - 744 when x >= 256 then x + {MERGES} else x end), ' ') as ids,
  array_to_string(mask[:{MAX_TOKENS}], ' ') as mask
from rendered"""

ORACLE = {
    "render_trained": _TRAINED,
    "conversation_rejects": f"""
with {_JUDGED}
select conv_id, turn, reason from faults where reason is not null
qualify row_number() over (partition by conv_id order by ord) = 1""",
    "conversation_rejects_mixed": f"""
with mixed as (
  select conv_id, turn, text, case when length(text) % 7 = 0 then 'system' when length(text) % 5 = 0 then 'assistant'
    else role end as role from conversations),
{_JUDGED_FROM.format(source="mixed")}
select conv_id, turn, reason from faults where reason is not null
qualify row_number() over (partition by conv_id order by ord) = 1""",
    "merge_system": f"""
with {_JUDGED}
select conv_id, turn, role, text from merged m
where not (sys and ord = 0 and exists (
  select 1 from numbered n where n.conv_id = m.conv_id and n.ord = 1 and n.role = 'user'))""",
    "render_conversation": _render(MAX_TOKENS),
    "render_truncated": _render(SHORT),
    "render_parts": _render(MAX_TOKENS, lines=True),
    "completion_prompts": f"""
with {_JUDGED}, {_items(_PROMPT_GOOD)}
select conv_id, array_to_string(ids[:{MAX_TOKENS}] || [{_AS}], ' ') as ids from rendered""",
    "completion_rejects": f"""
with {_JUDGED} select distinct conv_id, cnt - 1 as last_ord, last_role from numbered where last_role <> 'assistant'""",
    "mask_audit": f"""
with {_JUDGED}, {_items(_GOOD)},
short as (select conv_id, ids[:{MAX_TOKENS}] as ids, mask[:{MAX_TOKENS}] as mask from rendered)
select conv_id,
  array_to_string(list_transform(list_zip(ids, mask), lambda z: case when z[2] = 1 then '+' else '-' end || case
    when z[1] < 128 then chr(z[1]) when z[1] < 256 then chr(65533)
    else [{", ".join(f"'{s}'" for s in SPECIAL_TOKENS)}][z[1] - 255] end), '|') as tokens,
  len(ids)::int as n_tokens, list_sum(mask)::int as n_supervised,
  round(list_sum(mask) / len(ids), 6) as supervised_share
from short""",
}
