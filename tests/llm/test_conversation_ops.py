"""Prefix trie, chat logs and structure repair against plain Python versions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_log, prefix_trie, repair
from corpusloom.llm.queries import QUERIES
from tests.conftest import SF_DIR

SCHEMA = "conv_id long, turn long, role string, text string, pos long, depth long, message string"
ODD = [
    (0, 0, "user", "Hi."), (0, 1, "assistant", "Hello."), (0, 2, "user", "Bye."), (0, None, None, None),
    (1, 5, "user", ""), (1, 5, "user", ""), (1, 9, "tool", "[INST] x </s> \\[INST] \\"), (3, None, "user", "a"), (3, None, "assistant", "b"),
    (5, 0, "system", "Be brief."), (5, 1, "user", "Hi?"), (5, 2, "assistant", "Yes!"), (6, 0, "system", "Be brief."), (6, 1, "user", "Hi?"),
    (6, 2, "assistant", "Yes!"), (7, 0, "assistant", " \t"), (8, 3, "assistant", "long " * 3000 + "end."), (12, 0, "user", "only"), (-7, 0, "user", "neg"),
]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with odd conversations, with none, with deep and copied ones, and the driver's."""
    deep = [(c, t, "user" if t % 2 == 0 else "assistant", f"{'x' if t < 40 else c % 3} {t}.") for c in range(20, 26) for t in range(60)]
    deep += [(c, t, "user", "same") for c in range(30, 90) for t in range(3)]
    out = {"driver": SF_DIR}
    for name, rows in (("odd", ODD), ("empty", []), ("deep", deep)):
        out[name] = str(tmp_path_factory.mktemp(name))
        conversations(spark, rows).repartition(3).write.parquet(f"{out[name]}/conversations.parquet")
    return out


def by_turn(spark, path):
    """Rows of every conversation in order, read without the library."""
    rows = spark.read.parquet(f"{path}/conversations.parquet").withColumn("tie", F.xxhash64("text")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.role is not None, r.role or "", r.text is not None, r.tie)):
        found.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return found


def expected_trie(found):
    own = {c: [(role or "", text or "") for _, role, text in rows] for c, rows in found.items()}
    built = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + rows[h:]
    nodes = {}
    for c, rows in built.items():
        for d in range(len(rows) + 1):
            nodes.setdefault(tuple(rows[:d]), []).append(c)
    children = {n: [] for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(saved[k] for k in children[n])
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(n)))
        parent = min(nodes[n[:-1]]) if n else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(n), parent, len(members), len(children[n]), leaves[n], saved[n], digest))
    return out


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in df.select(*names).collect()]


@pytest.mark.parametrize("name", ["odd", "empty", "deep", "driver"])
def test_trie_is_that_of_all_prefixes(spark, tables, name):
    turns = prefix_trie.numbered_turns(spark.read.parquet(f"{tables[name]}/conversations.parquet"))
    got = trie_rows(prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns)))
    assert sorted(got, key=repr) == sorted(expected_trie(by_turn(spark, tables[name])), key=repr)


def test_trie_of_a_null_conversation_is_empty(spark):
    turns = prefix_trie.numbered_turns(conversations(spark, [(None, 1, "user", "a")]))
    assert not trie_rows(prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns)))


# -- chat logs --------------------------------------------------------------------------------------


def test_escapes_are_reversible_and_keep_other_text():
    random.seed(1)
    parts = ["\\", "\\", "a", "<", "[", "/", "\n", *chat_log.CONTROLS]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
        assert chat_log.unescape(chat_log.escape(text)) == text
        for role in ("user", "assistant", "system", "tool", "", text):
            formatted, start, end = chat_log.segment(role, text)
            assert chat_log.read_segment(formatted) == (role, text)
            assert chat_log.unescape(formatted[start:end]) == (text if role == "assistant" else "")
    assert chat_log.escape("a \\ b [x] </i>") == "a \\ b [x] </i>"
    assert len(chat_log.escape("\\" * 300_000 + "x")) == 300_001


def test_events_fold_in_sequence(spark):
    log = [
        (1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "He"), (1, 0, 2, "delta", None, "y"), (1, 0, 2, "delta", None, "y"),
        (1, 1, 0, "start", "assistant", None), (1, 1, 3, "delta", None, "B"), (1, 1, 2, "regenerate", None, None), (1, 1, 1, "delta", None, "A"),
        (1, 2, 5, "edit", None, "new"), (1, 2, 1, "delta", None, "old"), (1, 2, 6, "delta", None, "er"), (1, 2, 7, "other", "x", "x"),
        (2, 0, 0, "start", None, None), (2, 0, 1, "delta", None, None), (None, None, 1, "delta", None, "n"),
    ]
    got = chat_log.fold_events(spark.createDataFrame(log, chat_log.EVENTS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        [(1, 0, "user", "Hey"), (1, 1, "assistant", "B"), (1, 2, "", "newer"), (2, 0, "", ""), (None, None, "", "n")], key=repr
    )


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["odd", "empty", "driver"])
def test_chats_read_back_what_was_said(spark, tables, name):
    found = by_turn(spark, tables[name])
    found[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    wanted = []
    for c, rows in found.items():
        said = [(role or "", text or "") for _, role, text in rows]
        loss = "".join(text for role, text in said if role == "assistant")
        chars = sum(len(chat_log.segment(*m)[0]) for m in said)
        wanted.append((c, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), chars))
    got = QUERIES["op12_event_sourced_chats"](spark, tables[name])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(wanted, key=repr)


# -- repair -----------------------------------------------------------------------------------------


def cheapest(rows, entry, goals, open_end):
    """All repairs up to a length, tried one by one: (cost, audit) by goal."""
    best = {}

    def go(i, place, cost, audit, inserts):
        if i == len(rows) and place in goals:
            best[place] = min(best.get(place, (10**9, "")), (cost, audit))
        if inserts and (i < len(rows) or open_end):
            for to in repair.STEPS[place]:
                if to != "s":
                    go(i, repair.STEPS[place][to], cost + 2, audit + "I", inserts - 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, place, cost + 3, audit + "D", inserts)
            if not gone:
                for to, after in repair.STEPS[place].items():
                    if to != "s":
                        go(i + 1, after, cost + 2 + cut, audit + "R", inserts)
                    if to == initial:
                        go(i + 1, after, cost + cut, audit + "K", inserts)

    go(0, entry, 0, "", 3)
    return best


def test_search_proves_the_least_repair():
    random.seed(2)
    for _ in range(400):
        rows = [(random.choice("suatua"), random.random() < 0.2, random.random() < 0.2) for _ in range(random.randint(0, 4))]
        for entry in range(4):
            for open_end in (True, False):
                goals = repair.REACH[entry]
                got, wanted = repair.search(rows, entry, goals, open_end), cheapest(rows, entry, goals, open_end)
                # Without inserts at the end more of them may be needed before the last row than the trial has.
                assert {g: v for g, v in got.items() if g in wanted} == wanted


def expected_repair(rows):
    """Row of the contract for one conversation; costs by a table over (rows done, place)."""
    kept = []
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    numbers = [t for t, _, _ in kept if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    faults, seen = [], set()
    for _, role, text in kept:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    initials = [role[:1] for _, role, _ in kept]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    best = {repair.START: (0, "", [])}

    def insert(states):
        for _ in range(3):
            for place, (cost, audit, lines) in list(states.items()):
                for to, after in repair.STEPS[place].items():
                    said = {"u": "user:", "a": "assistant:"}.get(to)
                    if said and (cost + 2, audit + "I") < states.get(after, (10**9, ""))[:2]:
                        states[after] = (cost + 2, audit + "I", [*lines, said])
        return states

    for (_, role, text), fault in zip(kept, faults):
        after_row = {}
        for place, (cost, audit, lines) in insert(best).items():
            ways = [(place, cost + 3, "D", lines)]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                for to, after in repair.STEPS[place].items():
                    if to != "s":
                        ways.append((after, cost + 2 + cut, "R", [*lines, f"{'user' if to == 'u' else 'assistant'}:{text}"]))
                    if to == role[:1]:
                        ways.append((after, cost + cut, "K", [*lines, f"{role}:{text}"]))
            for after, total, edit, now in ways:
                if (total, audit + edit) < after_row.get(after, (10**9, ""))[:2]:
                    after_row[after] = (total, audit + edit, now)
        best = after_row
    cost, audit, lines = min(v for place, v in insert(best).items() if place in repair.ENDS)
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, sha("\n".join(lines))


@pytest.mark.parametrize("name", ["odd", "empty", "deep", "driver"])
def test_repairs_are_the_cheapest(spark, tables, name):
    wanted = [(c, *expected_repair([(c, *r) for r in rows])) for c, rows in by_turn(spark, tables[name]).items()]
    got = QUERIES["op13_structure_repair"](spark, tables[name])
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(wanted, key=repr)


def test_repair_of_a_null_conversation(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", None)]
    conversations(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    (got,) = QUERIES["op13_structure_repair"](spark, str(tmp_path)).collect()
    assert tuple(got) == (None, *expected_repair(rows))
