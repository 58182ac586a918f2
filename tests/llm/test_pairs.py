import itertools
import math
import random
import re
from collections import Counter

from quire.llm.pairs import Mentions, associated, co_occurrence, pair_counts, stale_edges

EVIDENCE = "evidence_id string, chunk_id string, evidence_text string, items string, n long"
VOCABULARY = [("soul", "Soul"), ("souls", "Soul"), ("mask", "Mask"), ("social mask", "Social Mask"), ("dark friend", "Friend"), ("friend", "Friend"), ("self-image", "Image"), ("moon", "Moon"), ("", "Empty"), (None, "None"), ("x", None)]


def naive_names(text):
    t = " ".join(re.sub(r"[^a-z0-9\s-]", " ", text.lower()).split())
    taken, names = [False] * len(t), set()
    for alias, name in sorted((v for v in VOCABULARY if v[0] and v[1]), key=lambda v: (-len(v[0]), v[0])):
        for m in re.finditer(f"(?={re.escape(alias)})", t):
            a, b = m.start(), m.start() + len(alias)
            if any(taken[a:b]) or (a and t[a - 1].isalnum()) or (b < len(t) and t[b].isalnum()):
                continue
            taken[a:b] = [True] * len(alias)
            names.add(name)
    return names


def data(n=400):
    rng = random.Random(8)
    parts = ["the soul", "Souls!", "a social  mask", "Mask;", "dark friend", "my friend", "self-image", "moonlight", "the moon", "nothing", "dark, friend", "soulless"]
    rows = [(f"e{i}", f"c{i % 37}", " and ".join(rng.sample(parts, rng.randrange(1, 5))), "clash", 1) for i in range(n)]
    return rows + rows[:20] + [("n", "c1", None, None, None), ("b", "c1", "", None, None), (None, None, "soul and mask", None, None)]


def test_equals_brute_force(spark):
    rows = data()
    records = {(c, t or "") for _, c, t, *_ in rows}
    single, pair = Counter(), Counter()
    for _, t in records:
        names = sorted(naive_names(t))
        single.update(names)
        pair.update(itertools.combinations(names, 2))
    df = co_occurrence(spark.createDataFrame(rows, EVIDENCE), spark.createDataFrame(VOCABULARY, "alias string, canonical string"))
    got = {(r.concept_a, r.concept_b): r for r in df.collect()}
    assert {k: r.n_ab for k, r in got.items()} == dict(pair)
    n = len(records)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n_records) == (single[a], single[b], n)
        cells = pair[a, b], single[a] - pair[a, b], single[b] - pair[a, b], n - single[a] - single[b] + pair[a, b]
        x = [c + 0.5 for c in cells]
        assert abs(r.log_odds - math.log(x[0] * x[3] / (x[1] * x[2]))) < 1e-5
    kept = {(r.concept_a, r.concept_b) for r in associated(df).collect()}
    assert kept == {k for k, v in pair.items() if v >= 5 and v * n >= 2 * single[k[0]] * single[k[1]]}


def test_hot_pair_and_partitions(spark):
    records = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN array(1, 5, 9) WHEN id % 3 = 1 THEN array(2) ELSE cast(array() as array<int>) END AS items")
    want = {(1 << 32) | 5: 10_000, (1 << 32) | 9: 10_000, (5 << 32) | 9: 10_000, (1 << 32) | 1: 10_000, (5 << 32) | 5: 10_000, (9 << 32) | 9: 10_000, (2 << 32) | 2: 10_000, -1: 30_000}
    for df in (records, records.repartition(1), records.repartition(7)):
        assert {r.code: r.n for r in pair_counts(df).collect()} == want


def test_longest_alias_claims_first():
    find = Mentions([("social mask", 1), ("mask", 0), ("soul", 2)])
    assert find("the social mask") == [1] and find("mask social mask") == [0, 1] and find("souls") == [] and find("") == []
    assert Mentions([])("mask") == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], EVIDENCE)
    words = spark.createDataFrame(VOCABULARY, "alias string, canonical string")
    assert co_occurrence(none, words).count() == 0
    assert co_occurrence(spark.createDataFrame(data(5), EVIDENCE), words.limit(0)).count() == 0


def test_stale_edges(spark):
    evidence = spark.createDataFrame([("e1",), ("e2",), ("e2",), (None,)], "evidence_id string")
    edges = spark.createDataFrame(
        [("a", ["e1", "e2"], 2), ("a", ["e1", "e2"], 2), ("b", ["e1", "e1"], 2), ("c", ["gone"], 1), ("d", None, None), ("e", [], 0), ("f", ["e1"], None), (None, ["e1"], 9)],
        "edge_id string, evidence_ids array<string>, evidence_count long",
    )
    assert {tuple(r) for r in stale_edges(edges, evidence).collect()} == {("b", 2, 1), ("c", 1, 0), ("d", None, 0), ("f", None, 1)}
