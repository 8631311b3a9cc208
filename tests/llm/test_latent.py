"""Latent decontamination against a brute-force search for items of every length."""

import numpy as np
import pytest

from corpusloom.llm import latent


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("n", [2, 6, 40])
def test_common_share(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        span, words = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, 70).tolist()
        whole = plain_lcs(span, words) / n
        assert latent.common_share(span, words) <= whole
        assert latent.lcs(span, words) == plain_lcs(span, words)
        at = int(rng.integers(0, 70 - n))
        assert latent.common_share(span, words[:at] + span + words[at:]) == 1


def _corpus(rng, n_words, length, copies):
    """Items of ``n_words`` words, and texts of which every second holds a whole item, in words of very unequal frequency."""
    word = lambda k: [f"w{x}" for x in np.minimum(rng.zipf(1.2, k), 50_000)]
    items = [word(n_words) for _ in range(length)]
    docs, wanted = [], set()
    for i in range(copies * 2):
        body = word(150)
        if i % 2 == 0:
            item = int(rng.integers(0, length))
            body[70:70] = items[item]
            wanted.add((i, item))
        docs.append((i, " ".join(body)))
    return [(i, " ".join(w)) for i, w in enumerate(items)], docs, wanted


@pytest.mark.parametrize("n_words,length", [(6, 120), (10, 120), (48, 120), (480, 64)])
def test_exact_copies_are_found(spark, n_words, length):
    items, docs, wanted = _corpus(np.random.default_rng(n_words), n_words, length, 60)
    got = latent.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert wanted <= found
    # What else is reported has a common subsequence of the promised length: no item is found out of nothing.
    texts, asked = dict(docs), dict(items)
    for r in got:
        if (r.doc_id, r.item_id) not in wanted and n_words <= latent.WINDOW:
            assert plain_lcs(asked[r.item_id].split(), texts[r.doc_id].split()) >= latent.LEAST_LCS * n_words


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(3)
    items, docs, wanted = _corpus(rng, 60, 80, 60)
    edited = []
    for i, text in docs:
        words = text.split()
        for at in rng.choice(len(words), len(words) // 10, replace=False):
            words[at] = f"edit{at}"
        edited.append((i, " ".join(words)))
    got = latent.contaminated(
        spark.createDataFrame(edited, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert len(wanted & {(r.doc_id, r.item_id) for r in got.collect()}) >= 0.95 * len(wanted)


def test_the_end_of_a_long_item_is_found(spark):
    """A remainder of under half a passage is searched with the words before it."""
    rng = np.random.default_rng(5)
    items = [[f"i{k}w{x}" for x in rng.permutation(70)] for k in range(20)]
    filler = [[f"f{x}" for x in rng.integers(0, 900, 120)] for _ in items]
    docs = [(i, " ".join([*f[:60], *item[30:], *f[60:]])) for i, (f, item) in enumerate(zip(filler, items))]
    got = latent.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"),
    )
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(20)}


def test_the_space_is_fitted_to_all_passages(spark):
    """Of 3,000 texts every passage counts: the directions are those of a plain SVD over all of them."""
    rng = np.random.default_rng(6)
    texts = [[f"w{x}" for x in np.minimum(rng.zipf(1.3, rng.integers(0, 130)), 400)] for _ in range(3000)]
    items = [[f"w{x}" for x in rng.integers(1, 60, 40)] for _ in range(6)]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "_body string").repartition(4)
    asked = spark.createDataFrame([(" ".join(t),) for t in items], "text string")
    split = latent.word_passages(docs, latent.known_words(asked))
    frequencies, passages = latent.passage_frequencies(split)
    blocks = [t[i : i + latent.WINDOW] for t in texts for i in range(0, len(t), latent.WINDOW)]
    assert passages == len(blocks)
    idf = np.log((1 + passages) / (1 + frequencies))
    block = latent.Items.of([(i, t, None) for i, t in enumerate(items)], idf)
    space = latent.latent_space(split, block, passages, rank=8)
    place = {w: i for i, w in enumerate(block.parts["names"].to_pylist())}
    dense = np.zeros((len(blocks) + len(items), len(place)))
    for row, words in enumerate([*blocks, *items]):
        for w in words:
            if w in place:
                dense[row, place[w]] += block.parts["weights"][place[w]]
    dense[len(blocks) :] *= np.sqrt(max(latent.ITEM_WEIGHT, latent.ITEM_SHARE * passages))
    best = np.linalg.svd(dense, full_matrices=False)[2][:8]
    kept = np.linalg.norm(dense @ space) ** 2 / np.linalg.norm(dense @ best.T) ** 2
    assert kept > 0.98
