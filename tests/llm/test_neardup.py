import itertools
import random
import re

import numpy as np
import pytest

from quire.llm.minhash import BandConfig, band_keys, signatures
from quire.llm.neardup import NearConfig, components, near_classes, near_pairs, near_texts

SCHEMA = "kind string, id string, owner string, text string, sketch string, tid int"
CONFIG = NearConfig(width=2, similarity=0.6, min_words=20)
#: So many bands that no pair at 0.6 is missed; for comparisons that must be exact.
EXACT = NearConfig(width=2, similarity=0.6, min_words=20, bands=BandConfig(rows=2, bands=60), max_bits=34)
VOCABULARY = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ar", "el", "in", "or", "um", "ash", "eth", "ing")]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(rows):
    sets = {}
    for kind, key, owner, text, *_ in rows:
        w = words(text)
        if len(w) >= 20:
            sets[kind, key, owner] = set(zip(w, w[1:]))
    out = set()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if a[0] == b[0] and a[2] != b[2] and len(x & y) >= 0.6 * len(x | y):
            out.add(tuple(sorted((a[1], b[1]))))
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 and rows:
            w = rows[rng.randrange(len(rows))][3].split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "inserted")
        else:
            w = rng.choices(VOCABULARY, k=rng.randrange(25, 60))
        rows.append(("chunk", f"c{i:03d}", f"c{i:03d}", " ".join(w), "clash", 1))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus(120)
    rows += rows[:5]  # repeated rows
    rows += [("evidence", "e1", "c001", rows[1][3], None, None), ("evidence", "e2", "c001", rows[1][3], None, None), ("evidence", "e3", "c002", rows[1][3], None, None)]
    rows += [("chunk", "n1", "n1", None, None, None), ("chunk", "n2", "n2", "", None, None), ("chunk", "n3", "n3", "too short", None, None), (None, None, None, None, None, None)]
    found = {tuple(r) for r in near_pairs(near_texts(spark.createDataFrame(rows, SCHEMA), EXACT)).collect()}
    want = brute([r for r in rows if r[1]])
    assert found == want
    usual = {tuple(r) for r in near_pairs(near_texts(spark.createDataFrame(rows, SCHEMA), CONFIG)).collect()}
    assert usual <= want and len(usual) >= 0.97 * len(want)
    assert ("e1", "e3") in found and ("e1", "e2") not in found


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(corpus(60), SCHEMA)
    one = sorted(map(tuple, near_pairs(near_texts(df.repartition(1), CONFIG)).collect()))
    many = sorted(map(tuple, near_pairs(near_texts(df.repartition(9), CONFIG)).collect()))
    assert one == many and one


def test_very_long_text_and_copies(spark):
    long = " ".join(random.Random(1).choices(VOCABULARY, k=60_000))
    df = spark.createDataFrame([("chunk", "a", "a", long, "", 0), ("chunk", "b", "b", long + " tail", "", 0), ("chunk", "c", "c", long, "", 0)], SCHEMA)
    assert {tuple(r) for r in near_pairs(near_texts(df, CONFIG)).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_pairs(near_texts(empty, CONFIG)).count() == 0
    assert near_classes(near_texts(empty, CONFIG)).count() == 0


def test_classes_join_chains_and_copies(spark):
    rows = corpus(60)
    got = {r.id: (r.class_id, r.n_links) for r in near_classes(near_texts(spark.createDataFrame(rows, SCHEMA), EXACT)).collect()}
    parent = {r[1]: r[1] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = brute(rows)
    for a, b in pairs:
        parent[root(a)] = root(b)
    linked = {x for p in pairs for x in p}
    assert set(got) == linked
    for a, b in itertools.combinations(sorted(linked), 2):
        assert (got[a][0] == got[b][0]) == (root(a) == root(b))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.node: r.class_id for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(51)}, 200: 200, 201: 200}


@pytest.mark.parametrize("s", [0.3, 0.6, 0.9])
def test_signature_estimates_similarity(s):
    rng = np.random.default_rng(5)
    shared = int(2000 * s)
    rest = 2000 - shared
    pool = rng.choice(2**31 - 1, shared + rest, replace=False).astype(np.int32)
    a, b = pool[: shared + rest // 2], np.concatenate([pool[:shared], pool[shared + rest // 2 :]])
    signature = signatures(np.concatenate([a, b]), np.array([0, len(a)]), 512)
    assert abs((signature[0] == signature[1]).mean() - s) < 0.07


def test_bands_differ_by_number():
    signature = np.zeros((1, 8), np.uint32)
    keys = band_keys(signature, BandConfig(rows=2, bands=4))
    assert len(set(keys[0].tolist())) == 4
    assert BandConfig(4, 28).recall(0.65) > 0.99


def test_pruning_loses_no_pair_of_the_bands(spark):
    rng = random.Random(11)
    rows = []
    for i in range(3000):
        w = [f"w{i}x{j}" for j in range(42)]
        edited = list(w)
        for j in rng.sample(range(2, 40, 3), 5):
            edited[j] += "z"
        rows += [("chunk", f"a{i}", f"a{i}", " ".join(w), None, None), ("chunk", f"b{i}", f"b{i}", " ".join(edited), None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    unpruned = NearConfig(width=2, similarity=0.6, min_words=20, small=0, max_bits=64)
    found = lambda config: {tuple(r)[:2] for r in near_texts(df, config).links.collect()}
    # sets of some 40 shingles: by parities, and by sketches alone
    assert found(CONFIG) == found(unpruned) == found(NearConfig(width=2, similarity=0.6, min_words=20, small=0))
