"""Chat conversations to token ids and supervision masks.

Messages are rows ``(conv_id, turn BIGINT, role, parts ARRAY<STRUCT<type, text>>)``; plain text is
one ``text`` part.  Rules that need a whole conversation are map-side-combined aggregates, so a
conversation of any length is judged without gathering it.  Rendering keeps at most ``max_tokens``
ids, and every message gives at least two, so only the first ``max_tokens`` messages are gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.codec import encoder, token_text, vocab_rows
from corpusloom.operators.running import with_position
from corpusloom.staging import stage

MAX_TOKENS = 2048
PART_TYPES = ("text", "python", "python_output")


def text_messages(conversations: DataFrame) -> DataFrame:
    """Messages of a ``(conv_id, turn, role, text)`` table."""
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    return conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.array(part).alias("parts"))


def numbered(messages: DataFrame) -> DataFrame:
    """Add ``ord``, the 0-based place of a message in its conversation."""
    return with_position(messages, ["conv_id"], "turn", "ord")


def _numbered_once(messages: DataFrame) -> DataFrame:
    """As ``numbered``, as a table, for operators that judge conversations and then use their messages."""
    return stage(numbered(messages), "messages")


def _plain(parts: Column) -> Column:
    return (F.size(parts) == 1) & (parts[0]["type"] == "text")


def _fault(index: Column) -> Column:
    """Reason why the message at 0-based place ``index`` is not allowed there, or NULL."""
    role, parts = F.col("role"), F.col("parts")
    from_user = index % 2 == 0
    known = F.forall(parts, lambda p: p["type"].isin(*PART_TYPES))
    return (
        F.when(from_user & (role != "user"), "expected_user")
        .when(~from_user & (role != "assistant"), "expected_assistant")
        .when(from_user & ~_plain(parts), "user_content_not_text")
        .when(~from_user & ~known, "unknown_part_type")
    )


def verdicts(messages: DataFrame) -> DataFrame:
    """One row per conversation: its size, how it starts and ends, and its first fault, if any.

    ``messages`` carries ``ord``.  Faults are found for both ways a conversation can start, with
    and without a system message; the first message then says which of the two counts.
    """
    at, turn, role = F.col("ord"), F.col("turn"), F.col("role")
    after_system = (
        F.when((at == 0) & ~_plain(F.col("parts")), "system_content_not_text")
        .when((at == 1) & (F.col("role") != "user"), "system_without_user")
        .when(at >= 1, _fault(at - 1))
    )
    place = F.struct(at.alias("ord"), turn.alias("turn"))

    def first(fault: Column) -> Column:
        return F.min(F.when(fault.isNotNull(), F.struct(at.alias("ord"), turn.alias("turn"), fault.alias("reason"))))

    summary = messages.groupBy("conv_id").agg(
        F.max(F.when(at == 0, F.col("role"))).alias("_first_role"),
        F.max(place).alias("_last"),
        F.max_by("role", at).alias("last_role"),
        F.max(F.when((at == 0) & (role == "system"), F.col("parts")[0]["text"])).alias("system_text"),
        F.min(F.when(at == 0, turn)).alias("_first_turn"),
        first(_fault(at)).alias("_plain_fault"),
        first(after_system).alias("_system_fault"),
    )
    with_system = F.col("_first_role") == "system"
    alone = F.struct(
        F.lit(0).cast("bigint").alias("ord"), F.col("_first_turn").alias("turn"), F.lit("system_only").alias("reason")
    )
    fault = F.when(with_system & (F.col("_last.ord") == 0), alone).when(with_system, F.col("_system_fault"))
    return summary.select(
        "conv_id",
        with_system.alias("with_system"),
        F.col("_last.ord").alias("last_ord"),
        "last_role",
        "system_text",
        fault.otherwise(F.col("_plain_fault")).alias("fault"),
    )


def rejects(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, reason)``: the first fault of every conversation that has one."""
    faults = verdicts(numbered(messages)).filter(F.col("fault").isNotNull())
    return faults.select("conv_id", F.col("fault.turn").alias("turn"), F.col("fault.reason").alias("reason"))


def merge_system(messages: DataFrame) -> DataFrame:
    """Put a leading system message in front of the user message after it.

    Only the first two messages of a conversation meet in a group.  Rows keep ``conv_id, turn,
    ord, role, parts`` with ``ord`` counted before the merge; a system message that no user
    message follows stays, to be rejected.
    """
    rows = messages if "ord" in messages.columns else numbered(messages)
    head, rest = rows.filter(F.col("ord") <= 1), rows.filter(F.col("ord") > 1)
    pair = Window.partitionBy("conv_id").orderBy("ord")
    before = F.lag(F.struct("role", "parts")).over(pair)
    after = F.lead("role").over(pair)
    looked = head.withColumn("_before", before).withColumn("_after", after)
    merges = (F.col("role") == "user") & (F.col("_before.role") == "system")
    text = F.concat(F.col("_before.parts")[0]["text"], F.lit("\n\n"), F.col("parts")[0]["text"])
    joined = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    gone = (F.col("ord") == 0) & (F.col("role") == "system") & (F.coalesce("_after", F.lit("")) == "user")
    merged = looked.filter(~gone).withColumn("parts", F.when(merges, joined).otherwise(F.col("parts")))
    return merged.select(rest.columns).unionByName(rest)


def render(
    messages: DataFrame,
    vocab: DataFrame,
    max_tokens: int = MAX_TOKENS,
    *,
    encode: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(conv_id, ids, mask)`` of every conversation without a fault; mask 1 is trained on."""
    rows = _numbered_once(messages)
    good = verdicts(rows).filter(F.col("fault").isNull()).select("conv_id", "with_system", "system_text")
    # A system message is merged away, so one message more may be needed.
    short = rows.filter(F.col("ord") <= max_tokens).join(good, "conv_id")
    return _render(_with_system_text(short), vocab, max_tokens, encode)


def _with_system_text(rows: DataFrame) -> DataFrame:
    """Messages of allowed conversations with the system message put in front of the user message after it.

    The verdict has brought the system's text to every message of its conversation, so nothing
    is joined or sorted here.
    """
    text = F.concat(F.col("system_text"), F.lit("\n\n"), F.col("parts")[0]["text"])
    merged = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    parts = F.when(F.col("with_system") & (F.col("ord") == 1), merged).otherwise(F.col("parts"))
    return rows.filter(~F.col("with_system") | (F.col("ord") > 0)).withColumn("parts", parts).drop("with_system", "system_text")


def _render(rows: DataFrame, vocab: DataFrame, max_tokens: int, encode: Callable | None) -> DataFrame:
    special = {r["name"]: r["token_id"] for r in vocab_rows(vocab) if r["is_special"]}
    encode = encode or encoder(vocab)

    def mark(name: str) -> Column:
        return F.array(F.lit(special[f"<|{name}|>"]))

    none = F.array().cast("array<int>")
    # A message without parts still opens and closes.
    blank = F.array(F.struct(F.lit("text").alias("type"), F.lit("").alias("text")))
    short = rows.withColumn("parts", F.when(F.size("parts") == 0, blank).otherwise(F.col("parts")))
    parts = short.select("conv_id", "ord", "role", F.size("parts").alias("_n"), F.posexplode("parts").alias("part", "p"))
    user, kind = F.col("role") == "user", F.col("p.type")
    python, output = ~user & (kind == "python"), ~user & (kind == "python_output")
    opening = F.when(user, mark("user_start")).when(F.col("part") == 0, mark("assistant_start")).otherwise(none)
    before = F.when(python, mark("python_start")).when(output, mark("output_start")).otherwise(none)
    after = F.when(python, mark("python_end")).when(output, mark("output_end")).otherwise(none)
    closing = F.when(user, mark("user_end")).when(F.col("part") == F.col("_n") - 1, mark("assistant_end")).otherwise(none)
    body_mask = F.when(user | output, 0).otherwise(1)
    end_mask = F.when(user, 0).otherwise(1)
    pieces = parts.select(
        "conv_id",
        "ord",
        "part",
        opening.alias("opening"),
        F.concat(before, encode(F.col("p.text")), after).alias("body"),
        closing.alias("closing"),
        body_mask.alias("body_mask"),
        end_mask.alias("end_mask"),
    )
    pieces = pieces.select(
        "conv_id",
        "ord",
        "part",
        F.slice(F.concat("opening", "body", "closing"), 1, max_tokens).alias("ids"),
        F.slice(
            F.concat(
                F.array_repeat(F.lit(0), F.size("opening")),
                F.array_repeat("body_mask", F.size("body")),
                F.array_repeat("end_mask", F.size("closing")),
            ),
            1,
            max_tokens,
        ).alias("mask"),
    ).filter(F.size("ids") > 0)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "part", "ids", "mask")))
    whole = pieces.groupBy("conv_id").agg(ordered.alias("_parts"))
    ids = F.concat(mark("bos"), F.flatten(F.transform("_parts", lambda p: p["ids"])))
    mask = F.concat(F.array(F.lit(0)), F.flatten(F.transform("_parts", lambda p: p["mask"])))
    return whole.select("conv_id", F.slice(ids, 1, max_tokens).alias("ids"), F.slice(mask, 1, max_tokens).alias("mask"))


def completion_prompts(
    messages: DataFrame,
    vocab: DataFrame,
    max_tokens: int = MAX_TOKENS,
    *,
    encode: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``(conv_id, ids)``: the conversation without its last message, ready for an answer.

    The last message must come from the assistant and is not judged itself.  The start-of-answer
    token is added after cutting, so a prompt may hold ``max_tokens + 1`` ids.
    """
    rows = _numbered_once(messages)
    left = F.when(F.col("with_system"), F.col("last_ord") - 1).otherwise(F.col("last_ord"))
    usable = (
        verdicts(rows)
        .filter(F.col("last_role") == "assistant")
        .filter(F.col("fault").isNull() | (F.col("fault.ord") >= F.col("last_ord")))
        # Something must be left, and a system message needs the user message after it.
        .filter(left >= 1)
        .select("conv_id", "last_ord", "with_system", "system_text")
    )
    # At most max_tokens + 1 messages of a conversation take part, so the join cannot skew.
    kept = rows.filter(F.col("ord") <= max_tokens).join(usable, "conv_id").filter(F.col("ord") < F.col("last_ord"))
    prompts = _render(_with_system_text(kept.drop("last_ord")), vocab, max_tokens, encode)
    start = next(r["token_id"] for r in vocab_rows(vocab) if r["name"] == "<|assistant_start|>")
    return prompts.select("conv_id", F.array_append("ids", F.lit(start)).alias("ids"))


def completion_rejects(messages: DataFrame) -> DataFrame:
    """Conversations whose last message is not from the assistant."""
    ended = verdicts(numbered(messages)).filter(F.col("last_role") != "assistant")
    return ended.select("conv_id", "last_ord", "last_role")


def mask_audit(rendered: DataFrame, vocab: DataFrame) -> DataFrame:
    """Each token decoded alone behind ``+`` (trained on) or ``-``, and the share of the former."""
    text = token_text(vocab)
    shown = F.zip_with(
        "ids", "mask", lambda i, m: F.concat(F.when(m == 1, "+").otherwise("-"), text(i))
    )
    supervised = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    return rendered.select(
        "conv_id",
        F.array_join(shown, "|").alias("tokens"),
        F.size("ids").alias("n_tokens"),
        supervised.alias("n_supervised"),
        (supervised / F.size("ids")).alias("supervised_share"),
    )
