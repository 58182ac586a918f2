import random
import re

import numpy as np
import pytest

from quire.llm.leaks import LeakConfig, hash_runs, leak_report, leaked, postings, retrieve

DOCS = "doc_id long, text string, question_id string, answer_share double"
ITEMS = "question_id string, question string, reference_answer string, doc_id int"
VOCABULARY = ["the", "of", "and", "a", "in"] * 6 + [f"w{i}" for i in range(120)]


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def data():
    rng = random.Random(4)
    answers = [" ".join(rng.choices(VOCABULARY, k=rng.randrange(10, 90))) for _ in range(40)]
    answers += ["the of and a in " * 6, answers[3] + " extra words at the end", "short answer only"]
    items = [(f"q{i}", f"What about w{i} and w{i + 1}?", a, 0) for i, a in enumerate(answers)]
    docs = []
    for i in range(300):
        w = rng.choices(VOCABULARY, k=rng.randrange(5, 400))
        if i % 4 == 0:
            source = words(rng.choice(answers))
            n = min(len(source), rng.choice([11, 12, 13, 30]))
            at = rng.randrange(len(source) - n + 1)
            k = rng.randrange(len(w))
            w[k:k] = source[at : at + n]
        docs.append((i, ", ".join(w).upper() if i % 8 == 0 else " ".join(w), "clash", 0.0))
    return docs, items


def brute(docs, items, run=12):
    grams = lambda t: {tuple(w[i : i + run]) for w in [words(t)] for i in range(len(w) - run + 1)}
    of = {q: grams(a) for q, _, a, _ in items}
    return {(d, q) for d, t, *_ in docs for own in [grams(t)] for q, g in of.items() if own & g}


@pytest.mark.parametrize("group_words", [2_000_000, 700])
def test_equals_brute_force(spark, group_words):
    docs, items = data()
    docs += docs[:4] + [(900, None, None, None), (901, "", None, None)]
    items += items[:2] + [("qn", "No answer?", None, None), (None, "x", items[0][2], None)]
    found = leaked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), LeakConfig(group_words=group_words)).collect()
    assert {(r.doc_id, r.question_id) for r in found} == brute(docs, [i for i in items if i[0] and i[2]])
    assert len(found) == len({(r.doc_id, r.question_id) for r in found}) and all(0 < r.answer_share <= 1 for r in found)


def test_long_text_holds_all_of_an_item(spark):
    docs, items = data()
    long = " ".join(random.Random(1).choices(VOCABULARY, k=50_000)) + " " + items[0][2]
    found = leaked(spark.createDataFrame([(1, long, "", 0.0)], DOCS), spark.createDataFrame(items[:1], ITEMS))
    assert [(r.question_id, r.answer_share) for r in found.collect()] == [("q0", 1.0)]
    assert leak_report(found).collect()[0].n_whole == 1


def test_empty_tables(spark):
    docs, items = data()
    d, i = spark.createDataFrame(docs[:3], DOCS), spark.createDataFrame(items, ITEMS)
    assert leaked(d.limit(0), i).count() == 0 and leaked(d, i.limit(0)).count() == 0
    assert leaked(d, spark.createDataFrame(items[-1:], ITEMS)).count() == 0


def test_pivots_find_all_scores_and_skip_the_rest():
    config = LeakConfig()
    rng = np.random.default_rng(2)
    p = 1 / np.arange(1, 401)
    draw = lambda k: rng.choice(400, k, p=p / p.sum()).astype(np.int64)
    items = [draw(rng.integers(12, 40)) for _ in range(90)]
    df = np.bincount(np.concatenate([np.unique(w) for w in items]), minlength=400)
    index = postings([(w, df[w]) for w in items], 90, float(np.mean([len(w) for w in items])), config)
    flat = draw(32 * 400)
    begin = np.arange(400) * 32
    for i in range(0, 400, 5):  # planted runs
        flat[begin[i] + 9 : begin[i] + 21] = items[i % 90][:12]
    seen = [0, 0, 0]
    got = set(zip(*map(np.ndarray.tolist, retrieve(index, flat, begin, begin + 32, config, seen))))
    dense = np.zeros((len(index["terms"]), 90))
    dense[index["key"][:-1] // 90, index["key"][:-1] % 90] = index["weight"]
    want = set()
    for q in range(400):
        at = [np.searchsorted(index["terms"], t) for t in np.unique(flat[q * 32 : q * 32 + 32]) if t in index["terms"]]
        want |= {(q, int(i)) for i in np.flatnonzero(dense[at].sum(axis=0) >= 1)}
    assert got == want and {(i, i % 90) for i in range(0, 400, 5)} <= got
    # pivots are far fewer than items, and block maxima spare many of them the scoring
    assert seen[0] < 0.8 * 400 * 90 and seen[1] < 0.8 * seen[0] and seen[2] == 400
    assert len(hash_runs(np.arange(5), 12)) == 0
