"""Each operator of the subpackage against brute force or an exact round trip, and on odd tables."""

import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import arrays, attention, chaining, components, feistel, hyperdim, latent, minhash, mixing, shards, simhash, syncmers
from corpusloom.llm.queries import QUERIES
from tests.conftest import SF_DIR

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, _body string"
LONG = " ".join(f"long{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "one two three", "en", "a"), (4, "one two three", "en", None),
    (5, "12 34 !?", None, "b"), (6, LONG, "en", "b"), (7, "le chat noir dort sous la table", "fr", "b"),
    (7, "le chat noir dort sous la table", "fr", "b"), (None, "der hund schläft im haus", "de", "c"), (None, None, "de", "c"),
]


def _table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 0, 0, 0, "x") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Paths of a folder with odd documents and of one whose tables are empty."""
    out = []
    for name, rows in (("odd", ODD), ("empty", [])):
        path = str(tmp_path_factory.mktemp(name))
        _table(spark, rows).write.parquet(f"{path}/documents.parquet")
        items = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, "")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out.append(path)
    return out


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op8", "op10", "op11", "op12", "op13"))])
def test_odd_rows_come_back_once_each_and_empty_tables_give_none(spark, folders, name):
    odd, empty = (QUERIES[name](spark, path).collect() for path in folders)
    assert len(odd) == len(ODD) and not empty


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith(("op8", "op10"))])
def test_searches_on_odd_and_empty_tables(spark, folders, name):
    odd, empty = (QUERIES[name](spark, path).collect() for path in folders)
    assert not empty
    assert not [r for r in odd if r.doc_id == r[3] and name.startswith("op10")]


def test_pipeline_on_odd_and_empty_tables(spark, folders):
    odd, empty = (corpus_pipeline.run(spark, path).collect() for path in folders)
    assert odd and not empty


def test_feistel_permutes_within_the_format(spark):
    n = spark.range(17 * 43).select(feistel.permute_number(F.col("id"), (17, 43), "k", "t").alias("x"))
    assert sorted(r.x for r in n.collect()) == list(range(17 * 43))
    text = "a 4111 1111 1111 1111 b 1985-03-12 c GB82WEST12345698765432 d 123-45-6789 e 10.0.0.1 f x.y@z.org g 4111 1111 1111 1112"
    row = feistel.pseudonymise(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"), "k").collect()
    assert row[0].text == row[1].text and row[0].n_values == 6
    card = re.search(r"a ([\d ]+) b", row[0].text)[1].replace(" ", "")
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(card))]
    assert sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
    assert row[0].text.endswith("4111 1111 1111 1112")


def test_syncmers_are_context_free_and_edits_are_exact(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away from here"
    inside = {h for h in syncmers.syncmer_anchors(a)[0].tolist()}
    around = {h for h in syncmers.syncmer_anchors("zzzz " + a + " yyyy")[0].tolist()}
    assert inside <= around
    rows = [(3, a), (1, "short"), (2, "x" * 50)]
    got = {r.doc_id: r for r in syncmers.compare_with_following(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, follows = dict(rows), {3: 2, 2: 1, 1: 3}
    for i, t in texts.items():
        cut = len(t) // 3
        edited = t[: len(t) - cut] + texts[follows[i]][:cut]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[3].near_edited > got[3].near_next


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = QUERIES["op3_hyperdimensional_language"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[1] > 20 and held[0] > 0.95


def test_token_counts_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = ["It's  a\ttest.", "naïve café ÉCOLE", "<|endoftext|> x<|startoftext|>y", "a b c 12,5", "  ", "e ́x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from corpusloom.llm.token_counts import token_counts

    got = {r.doc_id: r.n_tokens for r in token_counts(rows, public.path("word_bpe_49k.json")).collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_base_scores_equal_their_formula(spark):
    pytest.importorskip("public_tokenizers")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op5_attention_scores"](spark, SF_DIR).collect()
    words = {i: [w.decode() for w in t.encode().lower().split()] + ["\0"] for i, t in docs.items()}
    counts: dict[str, int] = {}
    for i, ws in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(docs)
    for r in got:
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.train_tokens == n and r.n_tokens == len(words[r.doc_id])
        assert r.score < 0


def test_tiles_find_every_link():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.concatenate([seeds] + [seeds ^ (np.uint64(1) << np.uint64(k)) for k in (1, 5, 9)] + [rng.integers(0, 1 << 63, 900, dtype=np.uint64)])
    values = np.unique(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 2
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    a, b = simhash.tile_links(values, 2)
    parent = {int(v): int(v) for v in values}
    for x, y in zip(a.tolist(), b.tolist()):
        parent[x] = y
    groups: dict[int, set] = {}
    for i, v in enumerate(values.tolist()):
        groups.setdefault(int(label[i]), set()).add(parent[v])
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_large_tiles_are_split_without_losing_links(spark):
    values = [(7 << 50) | (i << 3) for i in range(64)] + [123456789 * i for i in range(1, 40)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    few, many = (
        {r.node: r.root for r in components.components(simhash.near_links(fps, 2, tile)).collect()} for tile in (1024, 8)
    )
    assert few == many and few


def test_shards_are_even_and_copies_stay_together(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i // 2 if i % 3 == 1 else i}", None, "s") for i in range(1000)]
    got = shards.assign_shards(_table(spark, rows)).collect()
    sizes = np.bincount([r.shard for r in got], minlength=40)
    assert sizes.max() - sizes.min() <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = {i: t for i, t, *_ in rows}
    # 334 copies; a shard of 25 takes 22 seeds, so they fill 16 shards and may touch one more.
    assert len({r.shard for r in got if text[r.doc_id] == "same"}) <= 17


def test_mix_reaches_its_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), None, "abcd"[i % 4]) for i in range(1200)]
    first, again = (sorted(map(tuple, mixing.mix(_table(spark, rows).repartition(n)).collect())) for n in (3, 7))
    assert first == again
    by: dict[float, list] = {}
    for doc_id, size, _, target, taken, _ in first:
        assert taken <= 3 * size
        by.setdefault(rows[doc_id][3], []).append((target, taken))
    for source, pairs in by.items():
        assert abs(sum(t for _, t in pairs) - pairs[0][0]) <= 90
    assert sum(p[0][0] for p in by.values()) == pytest.approx(sum(s for _, s, *_ in first))


def test_benchmark_passages_are_found_and_clean_texts_are_not(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    plain = lambda t: " ".join(w.strip(".,;:!?\"'()[]{}<>|*#%&$_-") for w in t.lower().split())
    wanted = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in latent.contaminated(docs, items).collect()}
    assert len(wanted & got) >= 0.9 * len(wanted) and len(got - wanted) <= 0.1 * len(got)


def test_repeated_passages(spark):
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    shared = word(60)
    fuzzy = list(shared)
    fuzzy[30] = "other"
    docs = [(1, word(100) + shared + word(50)), (2, word(20) + shared + word(90)), (3, word(10) + fuzzy), (4, word(300)), (5, word(30) + shared[:40])]
    got = chaining.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2, 1), (3, 1)}
    exact = next(r for r in got if r.doc_id == 2)
    assert (exact.start, exact.stop, exact.other_start, exact.other_stop) == (20, 80, 100, 160)
    a, b = np.array([1, 5, 9, 30]), np.array([11, 15, 19, 2])
    assert chaining.chains(a, b)[0] == [0, 1, 2]


def test_passages_of_parts_first_seen_in_different_documents(spark):
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    pool = [word(int(rng.integers(3, 40))) for _ in range(25)] + [word(1) * 30, word(3) * 12]
    texts = {i: sum((pool[k] for k in rng.integers(0, len(pool), int(rng.integers(2, 12)))), []) for i in range(100)}
    x, y = word(30), word(30)
    texts |= {100: word(9) + x, 101: y + word(9), 102: x + y, 103: word(5) + x + y}
    got = chaining.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()
    assert (103, 102) in {(r.doc_id, r.other_id) for r in got}
    # Texts with 50 equal words are joined by rows that hold these words in both, in steps if not at once.
    places: dict[tuple, list] = {}
    for i, w in texts.items():
        for at in range(len(w) - 49):
            places.setdefault(tuple(w[at : at + 50]), []).append((i, at))
    shared = [where for where in places.values() if len({i for i, _ in where}) > 1]
    assert len(shared) > 200
    for where in shared:
        held = lambda i, lo, hi: any(j == i and lo <= at <= hi - 50 for j, at in where)
        label = {i: i for i, _ in where}
        for r in got:
            if held(r.doc_id, r.start, r.stop) and held(r.other_id, r.other_start, r.other_stop):
                label = {i: label[r.doc_id] if k == label[r.other_id] else k for i, k in label.items()}
        assert len(set(label.values())) == 1


def test_scores_do_not_depend_on_how_blocks_are_cut(spark, folders, monkeypatch):
    name = next(n for n in QUERIES if n.startswith("op5"))
    shown = lambda: sorted(str((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), f"{r.score:.5g}")) for r in QUERIES[name](spark, folders[0]).collect())
    whole = shown()
    monkeypatch.setattr(attention, "PART_BYTES", 20)
    assert shown() == whole and len(whole) == len(ODD)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    text = [f"v{x}" for x in rng.integers(0, 10**6, 200)]
    near = list(text)
    near[50] = "changed"
    rows = [(1, " ".join(text), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(text), "en", "a"), (4, " ".join(reversed(text)), "en", "a")]
    assert sorted(r.doc_id for r in simhash.one_of_each(_table(spark, rows)).collect()) == [1, 4]


def test_linked_fingerprints_are_candidates_without_minhash_keys(spark, monkeypatch):
    rng = np.random.default_rng(12)
    text = [f"v{x}" for x in rng.integers(0, 10**6, 2000)]
    changed = (" ".join([*text[:i], "changed", *text[i + 1 :]]) for i in range(100, 2000, 50))
    near = next(t for t in changed if 0 < (simhash.simhash(t) ^ simhash.simhash(" ".join(text))).bit_count() <= simhash.RADIUS)
    rows = [(1, " ".join(text), "en", "a"), (2, near, "en", "a"), (3, " ".join(reversed(text)), "en", "a"), (4, None, "en", "a"), (5, " ", "en", "a")]
    found = minhash.candidates
    beyond = F.slice("keys", minhash.BANDS + 1, 1).alias("keys")
    monkeypatch.setattr(minhash, "candidates", lambda nodes: found(nodes.select("node", beyond)))
    assert sorted(r.doc_id for r in simhash.one_of_each(_table(spark, rows)).collect()) == [1, 3, 4]


def test_only_texts_with_candidates_and_rows_that_may_go_are_joined(spark, monkeypatch):
    rng = np.random.default_rng(21)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(40)]
    near = " ".join([*texts[3].split()[:-1], "changed"])
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(50, near, "en", "a"), (7, texts[7], "en", "a"), (51, texts[9], "en", "b"), (None, None, None, None)]
    filters = []
    made = simhash.filter_bits
    monkeypatch.setattr(simhash, "filter_bits", lambda *asked: filters.append(made(*asked)) or filters[-1])
    shown = lambda: sorted(str(r.doc_id) for r in simhash.one_of_each(_table(spark, rows)).collect())
    wanted = sorted([*map(str, range(40)), "None"])
    assert shown() == wanted
    # Asked for are the two texts that are alike; no row but their second, one equal row and one copy may go.
    assert [int(np.bitwise_count(np.frombuffer(f, np.uint8)).sum()) for f in filters] == [2, 3]
    monkeypatch.setattr(simhash, "filter_bits", lambda asked, n: b"\xff" * (n // 8))
    assert shown() == wanted


def test_hash_words_by_content():
    words = pa.array(["a", "b", "ab", "ba", "", "x" * 70, "y" + "x" * 69, "a"])
    h = arrays.hash_words(words)
    assert len(set(h.tolist())) == 7 and h[0] == h[7] and (arrays.hash_words(words.slice(3)) == h[3:]).all()


def test_profiles_of_texts_without_letters_are_empty():
    assert not hyperdim.profiles(["12 !", ""], hyperdim.GramVectors()).any()


def test_gram_vectors_take_a_byte_an_entry():
    vectors = hyperdim.GramVectors()
    keys = np.arange(1, 6001, dtype=np.int64) * 7919 + (97 << 42) + (98 << 21)
    assert (vectors.of(keys)[[5, 4000]] == np.array([vectors.bind(int(keys[i])) for i in (5, 4000)])).all()
    assert vectors.rows.nbytes <= hyperdim.MEMO_GRAMS * hyperdim.DIMENSIONS


def test_gram_counts_are_those_of_brute_force(spark):
    rows = [("en", "The cat, the CAT"), ("en", "x" * 5), ("fr", "le chat"), ("fr", ""), ("de", "12 !")] * 3
    wanted = {}
    for label, t in rows:
        for key in hyperdim.grams_of([t])[0].tolist():
            wanted[label, key] = wanted.get((label, key), 0) + 1
    got = hyperdim.gram_counts(spark.createDataFrame(rows, "label string, text string"), "label", "text").collect()
    assert {(r.label, r.gram): r.n for r in got} == wanted and len(got) == len(wanted)


def test_only_leaking_rows_go_whatever_their_ids(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = words(40)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [words(80) for _ in range(4)]
    leaking = words(20) + " " + passage
    rows = [(None, leaking), (None, clean[0]), (None, None), (5, leaking), (5, clean[1]), (5, clean[1]), (6, clean[2]), (7, clean[3])]
    kept = corpus_pipeline.decontaminate(spark, _table(spark, [(i, t, "en", "a") for i, t in rows]), str(tmp_path)).collect()
    wanted = [(i, t) for i, t in rows if t != leaking]
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept])) == sorted(map(str, wanted))


def _jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, pairs = [], []
    for pair in range(300):
        a = words(int(rng.integers(120, 400)))
        b, wanted = list(a), rng.uniform(0.7, 0.9)
        changed = max(1, round(len(a) * (1 - wanted) / (1 + wanted)) - 4)
        if pair % 2:
            at = int(rng.integers(0, len(a) - changed))
            b[at : at + changed] = words(changed)
        else:
            for at in rng.integers(0, len(a), max(1, changed // 5)):
                b[at] = words(1)[0]
        pairs.append((" ".join(a), " ".join(b)))
        rows += [(2 * pair, pairs[-1][0], "en", "a"), (2 * pair + 1, pairs[-1][1], "en", "a")]
    likeness = [_jaccard(a, b) for a, b in pairs]
    assert min(sum(x >= 0.8 for x in likeness), sum(x < 0.8 for x in likeness)) > 60
    kept = {r.doc_id for r in simhash.one_of_each(_table(spark, rows)).collect()}
    wanted = {2 * i for i in range(300)} | {2 * i + 1 for i, x in enumerate(likeness) if x < 0.8}
    assert kept == wanted


def test_components_do_not_depend_on_the_smallest_of_a_key(spark):
    sets = {1: range(0, 100), 2: range(12, 112), 3: range(24, 124), 4: range(18, 118), 5: range(500, 600), 6: range(505, 605), 7: range(900, 910)}
    met = spark.createDataFrame([(9, n, 1, 7) for n in sets], "key long, node long, head long, n long")
    stored = spark.createDataFrame([(n, bytearray(np.array(list(x), np.uint64).tobytes())) for n, x in sets.items()], "node long, set binary")
    alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) >= 0.8
    assert not alike(sets[1], sets[2]) and alike(sets[2], sets[4]) and alike(sets[3], sets[4])
    got = {r.node: r.root for r in minhash.alike_components(met, stored).collect()}
    assert got == {3: 2, 4: 2, 6: 5}


def test_nodes_alike_to_the_last_of_a_key_are_linked_before_prefix_pairs(spark, monkeypatch):
    sets = {1: range(0, 100), 2: range(12, 112), 3: range(24, 124), 4: range(18, 118)}
    met = spark.createDataFrame([(9, n, 1, 4) for n in sets], "key long, node long, head long, n long")
    stored = spark.createDataFrame([(n, bytearray(np.array(list(x), np.uint64).tobytes())) for n, x in sets.items()], "node long, set binary")
    left = []
    found = minhash.prefix_pairs
    monkeypatch.setattr(minhash, "prefix_pairs", lambda nodes, sets: left.extend(nodes.collect()) or found(nodes, sets))
    assert {r.node: r.root for r in minhash.alike_components(met, stored).collect()} == {3: 2, 4: 2}
    assert {(r.node, r.root) for r in left} == {(1, 1), (2, 2), (3, 2), (4, 2)}


def test_prefix_pairs_hold_all_alike_sets_and_few_others(spark):
    rng = np.random.default_rng(9)
    common = rng.integers(-(1 << 62), 1 << 62, 200)
    sets = []
    for i in range(120):
        if i % 3 == 0 and i:  # a near copy of an earlier set
            base = sets[int(rng.integers(0, i))]
            drop = rng.random(len(base)) < rng.uniform(0.0, 0.15)
            sets.append(np.unique(np.concatenate([base[~drop], rng.integers(-(1 << 62), 1 << 62, int(drop.sum()))])))
        else:  # shares three quarters of its shingles with all others
            sets.append(np.unique(np.concatenate([common[:150], rng.integers(-(1 << 62), 1 << 62, 50)])))
    stored = spark.createDataFrame([(i, bytearray(np.sort(s.view(np.uint64)).tobytes())) for i, s in enumerate(sets)], "node long, set binary")
    nodes = spark.range(len(sets)).select(F.col("id").alias("node"), F.col("id").alias("root"))
    got = {frozenset((r.a, r.b)) for r in minhash.prefix_pairs(nodes, stored).collect()}
    held = [set(s.tolist()) for s in sets]
    alike = {frozenset((i, j)) for i in range(120) for j in range(i) if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j])}
    assert len(alike) > 20 and alike <= got
    assert len(got) < 3 * len(alike)
    together = nodes.withColumn("root", F.lit(0).cast("long"))
    assert minhash.prefix_pairs(together, stored).isEmpty()


def test_pipeline_keeps_columns_of_any_name_and_type(spark, tmp_path, folders):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, _leak long, row int, `a.b` string, m map<string,int>, leak string"
    texts = ["one two three four five six", "le chat noir dort sous la table", "der hund liegt im haus und bellt laut"]
    data = [(i, t, l, "s", 1, "keepme", 7, 8, "dot", {"k": 1}, "x") for i, (t, l) in enumerate(zip(texts, ["en", "fr", "de"]))]
    docs = spark.createDataFrame(data, schema)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folders[1])
        assert out.columns == docs.columns, name
        found = out.collect()
        assert {(r._key, r._leak, r.row, r["a.b"], r.m["k"], r.leak) for r in found} == {("keepme", 7, 8, "dot", 1, "x")}, name
        if name != "mixture":
            assert sorted(r.doc_id for r in found) == [0, 1, 2], name
    assert corpus_pipeline.sharding(spark, docs, folders[1]).count() == 3


def test_scratch_of_a_stage_goes_once_its_result_is_written(spark, folders, tmp_path):
    docs = spark.read.parquet(f"{folders[0]}/documents.parquet")
    app = spark.sparkContext.applicationId
    corpus_pipeline.near_duplicates(spark, docs, folders[0]).write.parquet(f"{tmp_path}/written")
    paths = corpus_pipeline._scratch[app]
    assert paths
    corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{tmp_path}/written"), folders[0])
    assert not [p for p in paths if os.path.exists(p)]


def test_texts_under_one_repeated_run_stay_apart(spark):
    rng = np.random.default_rng(8)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 100)) for _ in range(6)]
    rows = [(i, "0 " * 300 + t, "en", "a") for i, t in enumerate(own)] + [(9, "0  " * 300 + own[0].upper(), "en", "a")]
    assert len({simhash.simhash(t) for _, t, *_ in rows}) == 1
    assert sorted(r.doc_id for r in simhash.one_of_each(_table(spark, rows)).collect()) == list(range(6))


def test_cards_and_accounts_beside_other_digits_and_words(spark):
    card, iban, date = "4111 1111 1111 1111", "BE68 5390 0754 7034", "1985-03-12"
    forms = [
        f"{card} 123", f"{card} 12/25", f"2 {card}", f"12345 {card}", f"{card} 5500 0000 0000 0004", f"{card} 12/25/1985",
        f"{card} 10.0.0.1", "4111-1111-1111-1111 123", "3782 822463 10005 1234", f"{iban} BIC", f"{iban} BANK CODE", f"{iban} {card}",
        f"{iban} GB82 WEST 1234 5698 7654 32", f"AB13 {iban}", f"{card} {date}", f"{card} 555-123-4567",
    ]
    secret = [card, "4111-1111-1111-1111", "3782 822463 10005", "5500 0000 0000 0004", iban, "GB82 WEST 1234 5698 7654 32", "12/25/1985", "10.0.0.1", date, "555-123-4567"]
    kept = ["4111 1111 1111 1112 123", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "BE68 5390 0754 7035 BIC"]
    rows = spark.createDataFrame(list(enumerate(forms + kept + [card, iban])), "doc_id long, text string")
    got = {r.doc_id: r.text for r in feistel.pseudonymise(rows, "k").collect()}
    new_card, new_iban = got[len(forms + kept)], got[len(forms + kept) + 1]
    for i, text in enumerate(forms):
        assert not [x for x in secret if x in got[i]], (text, got[i])
        assert (card not in text or new_card in got[i]) and (iban not in text or new_iban in got[i]), (text, got[i])
    assert got[0] == new_card + " 123" and got[1] == new_card + " 12/25" and got[2] == "2 " + new_card and got[9] == new_iban + " BIC"
    assert [got[len(forms) + i] for i in range(len(kept))] == kept
