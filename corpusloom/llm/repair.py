"""Repair of the turn structure of conversations at the least cost.

Allowed are conversations whose roles read ``(system)? (user assistant)+``, and empty ones.  Each row is
kept (0), given another role (2) or deleted (3); empty messages may be inserted anywhere (2).  Blank and
duplicate rows must be deleted; a truncated row that stays costs 1.  Of the cheapest repairs the one
whose audit, the initials of its edits in order, comes first in ASCII is taken.

*Depth-first branch-and-bound.*  A node is (rows done, place in the pattern).  An explicit stack holds
prefixes of edits; a prefix is given up if its cost and the least cost of the rows still to come exceed
the incumbent (cost, audit), or if the node's dominance table holds a prefix that is no worse.
When the stack is empty the incumbent is proved optimal.  Comparing prefixes of a node by (cost, audit) is
sound: two of equal cost have edited the same rows, so neither is the start of the other and what
follows cannot change their order.

A conversation of any length is cut into blocks of consecutive rows.  The search solves each block
for every place in the pattern it may be entered at and left at, in parallel; the
few results of the blocks of a conversation are then joined in order, by the same comparison, by a
stream that keeps one path per place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.chat_log import batches_of
from corpusloom.llm.turns import SPACES, in_order, order_keys, plain
from corpusloom.staging import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# Places in the pattern: nothing yet, after the system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
# Which place an initial leads to, by the place it is met at.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# Where a place can lead to at all, and where a conversation may end.
REACH = ((START, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))
ENDS = (START, ASSISTANT)
# Values of ``pos`` that one search covers.
BLOCK = 64


def least_costs(rows: list[tuple[str, bool, bool]]) -> list[int]:
    """Suffix lower bounds: what the rows from each one on cost at least, whatever stands around them."""
    bounds = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        initial, gone, cut = rows[i]
        stays = TRUNCATED_COST * cut + (0 if initial in ("s", "u", "a") else REROLE_COST)
        bounds[i] = bounds[i + 1] + (DELETE_COST if gone else min(stays, DELETE_COST))
    return bounds


def search(rows: list[tuple[str, bool, bool]], entry: int, goals: tuple[int, ...], open_end: bool) -> dict[int, tuple[int, str]]:
    """Cheapest ``{goal: (cost, audit)}`` of rows ``(role initial, must go, truncated)``.

    The pattern is entered at the place ``entry`` and left at one of ``goals``.  ``open_end`` allows inserts after the
    last row; inside a conversation they belong to the block that follows.
    """
    n = len(rows)
    bounds = least_costs(rows)
    incumbent: dict[int, tuple[int, str]] = {}
    dominance: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, place = stack.pop()
        known = dominance.get((i, place))
        if known is not None and known <= (cost, audit):
            continue
        ahead = cost + bounds[i]
        if all(g in incumbent and (ahead, audit) > (incumbent[g][0], incumbent[g][1][: len(audit)]) for g in REACH[place] if g in goals):
            continue
        dominance[i, place] = (cost, audit)
        if i == n and place in goals and (place not in incumbent or (cost, audit) < incumbent[place]):
            incumbent[place] = (cost, audit)
        following = STEPS[place]
        if i < n or open_end:
            for initial in ("u", "a"):
                if initial in following:
                    stack.append((cost + INSERT_COST, audit + INSERT, i, following[initial]))
        if i == n:
            continue
        initial, gone, cut = rows[i]
        stack.append((cost + DELETE_COST, audit + DELETE, i + 1, place))
        if not gone:
            stays = cost + TRUNCATED_COST * cut
            for other in ("u", "a"):
                if other in following:
                    stack.append((stays + REROLE_COST, audit + REROLE, i + 1, following[other]))
            if initial in following:
                stack.append((stays, audit + KEEP, i + 1, following[initial]))
    return incumbent


def edited(audit: str, place: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """``(edit, role, text)`` after each edit of ``rows (role, text)``; deleted rows have neither."""
    following = iter(rows)
    for edit in audit:
        role, text = next(following) if edit != INSERT else (None, "")
        if edit == DELETE:
            yield edit, None, None
            continue
        to = role[:1] if edit == KEEP else "a" if place == USER else "u"
        place = STEPS[place][to]
        yield edit, role if edit == KEEP else {"a": "assistant", "u": "user"}[to], text


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage by crc32(``conv_id:turn``) % 20, and their place ``pos``; nulls become one blank.

    0 drops the row, 1 empties its text, 2 removes all of ``.!?`` from it, 3 repeats the row next to itself, 4
    makes it the user's.  ``turn`` keeps its nulls.
    """
    blank = F.lit(" ")
    c, t = (F.coalesce(F.col(n).cast("string"), blank) for n in ("conv_id", "turn"))
    fate = F.crc32(F.concat(c, F.lit(":"), t)) % 20
    rows = plain(conversations).withColumns(
        {"role": F.coalesce("role", blank), "text": F.coalesce("text", blank), "fate": fate}
    )
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    placed = in_order(rows.where("fate <> 0"), order_keys(), "damaged")
    once = F.array(F.col("pos") * 2)
    places = F.explode(F.when(F.col("fate") == 3, F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)).otherwise(once))
    return placed.select("conv_id", places.alias("pos"), "turn", role.alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, initial, fault`` of rows ``conv_id, pos, turn, role, text``; no texts.

    ``fault`` is blank, duplicate (role and text stand earlier in the conversation), truncated (the last
    character that is no space is none of ``.!?``) or null, the first of these that holds.
    """
    said = [F.xxhash64("role", "text").alias("_a"), F.xxhash64("text", "role").alias("_b")]
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    narrow = rows.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), *said)
    narrow = stage(narrow, "faults")
    # The key has no null, so that a null conversation joins like any other.
    same = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast("bigint")).alias("id"), "_a", "_b")
    keyed = narrow.select("*", same.alias("_same"))
    first = keyed.groupBy("_same").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    known = keyed.join(first, "_same", "left")
    again = F.col("_first").isNotNull() & (F.col("pos") > F.col("_first"))
    judged = F.when(F.col("fault") == "blank", "blank").when(again, "duplicate").otherwise(F.col("fault"))
    return known.select("conv_id", "pos", "turn", "initial", judged.alias("fault"))


def summary(judged: DataFrame) -> DataFrame:
    """Per conversation: gaps in its turns, faults of each kind, first and last ``pos``.

    Gaps are maxTurn - minTurn + 1 - distinct turns, nulls ignored; 0 if all turns are null.
    """
    kinds = ["blank", "duplicate", "truncated"]
    by_turn = judged.groupBy("conv_id", "turn").agg(
        *[F.count_if(F.col("fault") == k).alias(k) for k in kinds], F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv_id").agg(
        gaps.cast("bigint").alias("gaps"), *[F.sum(k).alias(k) for k in kinds],
        F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"),
    )


# -- the search, block by block ---------------------------------------------------------------------

OPTIONS = (
    "conv_id bigint, block bigint, entry bigint, goal bigint, cost bigint, audit string, "
    "head string, tail string, illegal bigint"
)
PLAN = "conv_id bigint, block bigint, entry bigint, audit string, cost bigint, illegal bigint"
EDITS = "conv_id bigint, block bigint, place bigint, edit string, role string, text string"
REPAIRS = "conv_id bigint, audit string, repaired_sha256 string"
_LEGAL = ("su", "ua", "au")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns, across batches."""
    here, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:n_keys] != here:
                if rows:
                    yield here, rows
                here, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield here, rows


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def options() -> Iterator[tuple]:
        for key, block in _groups(batches, 2):
            initials = [initial for _, initial, *_ in block]
            rows = [(initial, fault in ("blank", "duplicate"), fault == "truncated") for _, initial, fault, *_ in block]
            first, last = block[0][0] == block[0][3], block[-1][0] == block[-1][4]
            about = (initials[0], initials[-1], _illegal(initials))
            for entry in (START,) if first else (START, SYSTEM, USER, ASSISTANT):
                goals = tuple(g for g in REACH[entry] if not last or g in ENDS)
                for goal, (cost, audit) in search(rows, entry, goals, last).items():
                    yield (*key, entry, goal, cost, audit, *about)

    return batches_of(options(), OPTIONS)


class _Path:
    """Edits of a block after those of the blocks before; paths share what they have in common."""

    __slots__ = ("audit", "before", "block", "entry")

    def __init__(self, audit: str, before: _Path | None, block: int, entry: int):
        self.audit, self.before, self.block, self.entry = audit, before, block, entry


def _first_by_audit(x: _Path, y: _Path) -> _Path:
    """The path whose audit comes first; both have edited the same blocks."""
    ours, theirs, a, b = [], [], x, y
    while a is not b:
        ours.append(a.audit)
        theirs.append(b.audit)
        a, b = a.before, b.before
    return x if "".join(reversed(ours)) <= "".join(reversed(theirs)) else y


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def plans() -> Iterator[tuple]:
        conv, paths, tail, illegal = (), {}, None, 0
        for (*now, block), options in _groups(batches, 2):
            if tuple(now) != conv:
                if conv:
                    yield from ended(conv, paths, illegal)
                conv, paths, tail, illegal = tuple(now), {START: (0, None)}, None, 0
            _, _, _, _, head, last, inside = options[0]
            illegal += inside + (tail is not None and tail + head not in _LEGAL)
            tail, after = last, {}
            for entry, goal, cost, audit, *_ in options:
                if entry not in paths:
                    continue
                total, before = paths[entry]
                total, path = total + cost, _Path(audit, before, block, entry)
                known = after.get(goal)
                if known is None or total < known[0] or (total == known[0] and _first_by_audit(path, known[1]) is path):
                    after[goal] = (total, path)
            paths = after
        if conv:
            yield from ended(conv, paths, illegal)

    def ended(conv: tuple, paths: dict, illegal: int) -> Iterator[tuple]:
        (cost, path), *others = (paths[g] for g in ENDS if g in paths)
        for total, other in others:
            if total < cost or (total == cost and _first_by_audit(other, path) is other):
                cost, path = total, other
        while path:
            yield (*conv, path.block, path.entry, path.audit, cost, illegal)
            path = path.before

    return batches_of(plans(), PLAN)


def plan_repairs(judged: DataFrame, about: DataFrame) -> DataFrame:
    """``PLAN``: for each block of each conversation its audit, and the conversation's cost and illegal neighbours.

    ``judged`` comes from ``faults``, ``about`` from ``summary``.
    """
    ends = about.select(F.col("conv_id").alias("_c"), "first_pos", "last_pos")
    rows = judged.join(ends, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "initial", "fault", "first_pos", "last_pos"
    )
    blocks = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    options = blocks.mapInArrow(_search_blocks, OPTIONS)
    joined = options.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return joined.mapInArrow(_join_blocks, PLAN)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def edits() -> Iterator[tuple]:
        for key, ((_, entry, audit, *_), *rows) in _groups(batches, 2):
            for place, edit in enumerate(edited(audit, entry, [row[-2:] for row in rows])):
                yield (*key, place, *edit)

    return batches_of(edits(), EDITS)


def apply_repairs(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, block, place, edit, role, text`` of the repaired conversations, in the order of block and place.

    Deleted rows stay as edits without role and text.  Blocks of a conversation are edited apart.
    """
    none = F.lit(None)
    said = rows.select("conv_id", F.expr(f"pos div {BLOCK}").alias("block"), "pos", none.cast("bigint").alias("entry"), none.cast("string").alias("audit"), "role", "text")
    heads = plan.select("conv_id", "block", F.lit(-1).cast("bigint").alias("pos"), "entry", "audit", none.cast("string").alias("role"), none.cast("string").alias("text"))
    blocks = heads.unionByName(said).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    return blocks.mapInArrow(_apply, EDITS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def repairs() -> Iterator[tuple]:
        conv, audit, state, said = (), [], None, False
        for batch in batches:
            for now, _, _, edit, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                if (now,) != conv:
                    if conv:
                        yield (*conv, "".join(audit), state.hexdigest())
                    conv, audit, state, said = (now,), [], hashlib.sha256(), False
                audit.append(edit)
                if edit != DELETE:
                    state.update(f"{chr(10) if said else ''}{role}:{text}".encode())
                    said = True
        if conv:
            yield (*conv, "".join(audit), state.hexdigest())

    return batches_of(repairs(), REPAIRS)


def repair_digests(edits: DataFrame) -> DataFrame:
    """Audit of each conversation and SHA-256 of its repaired ``role:text`` lines, in one stream over its edits."""
    return edits.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").mapInArrow(_digest, REPAIRS)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """Every conversation after ``damage``: its faults, and the cheapest repair.

    Columns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.  A
    conversation that lost all rows has zeros, an empty audit and the empty text's digest.  Rows with equal
    turns stand in the order of role and text hash; rows with a null ``conv_id`` are a conversation of
    their own.  No conversations, no rows.
    """
    everyone = conversations.select(F.col("conv_id").cast("bigint").alias("_all")).distinct()
    rows = stage(damage(conversations), "rows")
    judged = stage(faults(rows), "judged")
    about = stage(summary(judged), "summary")
    plan = stage(plan_repairs(judged, about), "plan")
    digests = repair_digests(apply_repairs(rows, plan))
    costs = plan.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"))
    costs, digests = costs.withColumnRenamed("conv_id", "_c"), digests.withColumnRenamed("conv_id", "_d")
    c = F.col("_all")
    found = everyone.join(about, c.eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(costs, c.eqNullSafe(F.col("_c")), "left").join(digests, c.eqNullSafe(F.col("_d")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        c.alias("conv_id"), *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
