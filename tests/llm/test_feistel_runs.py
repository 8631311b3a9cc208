"""Cards inside runs of digits of any length, against a brute-force search of the same rules."""

import random
import re

import pytest

from corpusloom.llm import feistel

CARD = "4111 1111 1111 1111"
GROUPED = re.compile(r"\d{3,}(?: \d{3,})*(?: \d{1,2})?")


def valid(digits):
    if not 13 <= len(digits) <= 19 or set(digits) == {"0"}:
        return False
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def cards(groups):
    """``(first group, groups)`` of the cards of a run, from the left, the longest first."""
    if valid("".join(groups)):
        return [(0, len(groups))]
    found, at = [], 0
    while at < len(groups):
        fits = [
            n for n in range(1, min(19, len(groups) - at) + 1)
            if valid("".join(groups[at : at + n])) and (at == 0 or GROUPED.fullmatch(" ".join(groups[at : at + n])))
        ]
        if fits:
            found.append((at, max(fits)))
        at += max(fits, default=1)
    return found


def replaced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in feistel.pseudonymise(rows, "key").collect()}


@pytest.mark.parametrize("before", [0, 28, 127, 128, 3_000])
def test_a_card_anywhere_in_a_run(spark, before):
    text = " ".join(["1234"] * before + [CARD] + ["9999"])
    got = replaced(spark, [text])[0]
    assert got.n_values == 1 and CARD not in got.text and len(got.text) == len(text)
    assert valid(got.text[before * 5 : before * 5 + 19].replace(" ", ""))
    assert got.text[: before * 5] == text[: before * 5] and got.text.endswith(" 9999")


def test_runs_against_brute_force(spark):
    rng = random.Random(7)
    runs = []
    for n in [*range(4, 40), 130, 260, 400]:
        runs.append(["".join(rng.choice("0123456789") for _ in range(rng.choice((3, 4, 4, 4, 5, 6)))) for _ in range(n)])
    got = replaced(spark, [" ".join(r) for r in runs])
    for i, groups in enumerate(runs):
        inside = {at + k for at, n in cards(groups) for k in range(n)}
        after = got[i].text.split(" ")
        assert [len(g) for g in after] == [len(g) for g in groups]
        assert all(a == b for k, (a, b) in enumerate(zip(groups, after)) if k not in inside)
        for at, n in cards(groups):
            new = "".join(after[at : at + n])
            assert valid(new) and new != "".join(groups[at : at + n])


def test_other_blanks_letters_and_forms_around_a_card(spark):
    blanks = [CARD.replace(" ", b) for b in "\u00a0\u2007\u2009\u202f-"]
    texts = [*blanks, CARD + " 12ab", CARD + " 2024-05-06", "x" + CARD, "1" * 150 + " " + CARD, "7" * 20_000]
    got = replaced(spark, texts)
    for i, text in enumerate(blanks):
        assert got[i].n_values == 1 and got[i].text != text and got[i].text[4::5] == text[4::5]
    n = len(blanks)
    assert got[n].text.endswith(" 12ab") and CARD not in got[n].text
    assert got[n + 1].n_values == 2 and CARD not in got[n + 1].text
    assert got[n + 3].text.startswith("1" * 150) and CARD not in got[n + 3].text
    assert got[n + 4].text == texts[n + 4]
