"""Chat rendering against a plain-Python statement of the rules."""

import pytest

from corpusloom.functions.fixed_values import SPECIAL_TOKENS
from corpusloom.operators import bpe
from corpusloom.operators import conversations as chat

ID = {name[2:-2]: 256 + i for i, name in enumerate(SPECIAL_TOKENS)}


def U(text):
    return ("user", [("text", text)])


def A(*parts):
    return ("assistant", [p if isinstance(p, tuple) else ("text", p) for p in parts])


def S(text):
    return ("system", [("text", text)])


CONVERSATIONS = {
    1: [U("hi"), A("hello")],
    2: [S("be kind"), U("hi"), A("yes"), U("more")],
    3: [S("alone")],
    4: [S("sys"), A("no user")],
    5: [U("a"), U("b")],
    6: [A("first")],
    7: [U("calc"), A("sure", ("python", "1+1"), ("python_output", "2"), "done")],
    8: [U("q"), A(("image", "x"))],
    9: [U("é"), A("")],
    10: [U("x" * 300), A("y" * 300), U("z"), A("w")],
    11: [U("tool"), ("tool", [("text", "t")])],
    12: [("user", [("text", "two"), ("text", "parts")]), A("a")],
    13: [U("q"), A()],
    14: [S("sys"), U("only")],
    15: [U("a"), A("b"), A("c")],
    16: [U("a"), A("b"), U("c"), A("d"), A("e"), A("f")],
}
REASONS = {
    3: (0, "system_only"),
    4: (1, "system_without_user"),
    5: (1, "expected_assistant"),
    6: (0, "expected_user"),
    8: (1, "unknown_part_type"),
    11: (1, "expected_assistant"),
    12: (0, "user_content_not_text"),
    15: (2, "expected_user"),
    16: (4, "expected_user"),
}


def rendered(messages, max_tokens):
    ids, mask = [], []

    def add(new, m):
        ids.extend(new)
        mask.extend([m] * len(new))

    if messages[0][0] == "system":
        merged = messages[0][1][0][1] + "\n\n" + messages[1][1][0][1]
        messages = [U(merged), *messages[2:]]
    add([ID["bos"]], 0)
    for role, parts in messages:
        if role == "user":
            add([ID["user_start"], *parts[0][1].encode(), ID["user_end"]], 0)
            continue
        add([ID["assistant_start"]], 0)
        for kind, text in parts:
            body = list(text.encode())
            if kind == "python":
                add([ID["python_start"], *body, ID["python_end"]], 1)
            elif kind == "python_output":
                add([ID["output_start"], *body, ID["output_end"]], 0)
            else:
                add(body, 1)
        add([ID["assistant_end"]], 1)
    return ids[:max_tokens], mask[:max_tokens]


@pytest.fixture(scope="module")
def messages(spark):
    # Turns are numbered with gaps: only their order counts.
    rows = [(c, 10 * t + 5, role, parts) for c, ms in CONVERSATIONS.items() for t, (role, parts) in enumerate(ms)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, parts array<struct<type:string,text:string>>")


def test_rejects(messages):
    got = {r.conv_id: ((r.turn - 5) // 10, r.reason) for r in chat.rejects(messages).collect()}
    assert got == REASONS


@pytest.mark.parametrize("max_tokens", [2048, 610, 3, 1])
def test_render(spark, messages, max_tokens):
    got = {r.conv_id: (r.ids, r.mask) for r in chat.render(messages, bpe.byte_vocab(spark), max_tokens).collect()}
    good = {c: ms for c, ms in CONVERSATIONS.items() if c not in REASONS}
    assert got == {c: rendered(ms, max_tokens) for c, ms in good.items()}


@pytest.mark.parametrize("max_tokens", [2048, 20])
def test_prompts(spark, messages, max_tokens):
    got = {r.conv_id: r.ids for r in chat.completion_prompts(messages, bpe.byte_vocab(spark), max_tokens).collect()}
    # The last message is not judged, so 8 (unknown part) is usable; 15 becomes user, assistant.
    usable = [1, 7, 8, 9, 10, 13, 15]
    assert got == {c: rendered(CONVERSATIONS[c][:-1], max_tokens)[0] + [ID["assistant_start"]] for c in usable}
    assert {r.conv_id for r in chat.completion_rejects(messages).collect()} == {2, 3, 5, 11, 14}


def test_mask_audit(spark, messages):
    vocab = bpe.byte_vocab(spark)
    audit = {r.conv_id: r for r in chat.mask_audit(chat.render(messages, vocab), vocab).collect()}
    assert audit[9].tokens == "-<|bos|>|-<|user_start|>|-�|-�|-<|user_end|>|-<|assistant_start|>|+<|assistant_end|>"
    assert (audit[9].n_tokens, audit[9].n_supervised) == (7, 1)
