"""Mixing against the sharing of targets and the bounds of pivotal rounding, on copies and odd rows."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def shared_targets(sizes):
    """Targets by weights 1, 2, 3 in code point order, null last, stopped at three times the size; exact."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    stopped, left = {}, set(names)
    while left:
        rate = Fraction(sum(sizes.values()) - sum(stopped.values()), sum(weight[s] for s in left))
        above = {s for s in left if weight[s] * rate > 3 * sizes[s]}
        if not above:
            return stopped | {s: weight[s] * rate for s in left}
        stopped |= {s: Fraction(3 * sizes[s]) for s in above}
        left -= above
    return stopped


@pytest.fixture(scope="module")
def rows():
    same = [(1, "one two three four", "b")] * 3_000
    own = [(i, " ".join(["w"] * (i % 37 + 1)), ("a", "c", "é", None)[i % 4]) for i in range(2, 1_500)]
    return same + own + [(None, "null id", None), (5, None, "b"), (6, "", "b"), (7, " \t ", "nothing")]


def test_targets_copies_and_blocks(spark, rows, monkeypatch):
    levels = []
    stage = mixing.stage

    def recording(df, label, path=None):
        out = stage(df, label, path)
        if label == "level" and "_docs" in out.columns:
            levels.append(out)
        return out

    monkeypatch.setattr(mixing, "stage", recording)
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert max(r.n for r in levels[0].select(F.size("_docs").alias("n")).collect()) <= mixing.BLOCK
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").split())) for i, t, _ in rows)

    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets = shared_targets(sizes)
    # Sources are told apart by their sizes here, which differ.
    assert len(set(sizes.values())) == len(sizes)
    of_size = {n: s for s, n in sizes.items()}
    taken, largest = Counter(), Counter()
    for r in got:
        source = of_size[r.source_size]
        assert r.target == pytest.approx(float(targets[source]))
        rate = targets[source] / sizes[source] if sizes[source] else 0
        if r.size:
            assert r.taken % r.size == 0 and int(rate) <= r.taken // r.size <= -(-rate // 1) and r.taken <= 3 * r.size
        else:
            assert r.taken == 0
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for source, target in targets.items():
        assert abs(taken[source] - float(target)) <= largest[source]


def test_reruns_agree(spark, rows):
    first, again = (
        sorted((r.size, r.source_size, r.taken, r.doc_id or 0) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(n)).collect())
        for n in (3, 11)
    )
    assert first == again
