import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.scoring import dense_vectors, hash_features
from quire.operators import evaluation, evidence, retrieval

LEG = "query_id string, id string, score double, rank int"


def legs(spark, dense, lexical):
    make = lambda names: spark.createDataFrame([("q", n, 1.0 - i / 10, i + 1) for i, n in enumerate(names)], LEG)
    return make(dense), make(lexical)


def test_fusion_values_and_ties(spark):
    rows = retrieval.fuse(*legs(spark, ["x1", "x2"], ["x2", "x3"]), 10).orderBy("fusion_rank").collect()
    assert [(r.id, r.fusion_score) for r in rows] == [("x2", 0.032522), ("x1", 0.016393), ("x3", 0.016129)]
    assert [r.id for r in retrieval.fuse(*legs(spark, ["bbb"], ["aaa"]), 10).orderBy("fusion_rank").collect()] == ["aaa", "bbb"]
    one = retrieval.fuse(*legs(spark, ["both"], ["both"]), 10).collect()
    assert len(one) == 1 and (one[0].dense_rank, one[0].bm25_rank) == (1, 1)
    assert retrieval.fuse(*legs(spark, [], ["a"]), 10).collect()[0].dense_rank is None
    with pytest.raises(ValueError):
        retrieval.fuse(*legs(spark, ["a"], ["b"]), 10, rrf_k=0)


def okapi(query, docs):
    tokens = {k: re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)*", t.lower()) for k, t in docs.items()}
    n, average = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    out = {}
    for k, t in tokens.items():
        s = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in query.lower().split() if w in t)
        if round(s, 6) > 0:
            out[k] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_follows_the_formula(spark):
    rng = random.Random(1)
    docs = {f"d{i:02d}": " ".join(rng.choices(["the", "the", "sun", "moon", "self-image", "shadow", "gold"], k=rng.randrange(3, 12))) for i in range(40)}
    queries = [("a", "the moon gold moon"), ("b", "self-image shadow"), ("c", "nothing known"), ("d", "")]
    got = retrieval.bm25_topk(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(list(docs.items()), "chunk_id string, text string"), 5)
    for key, text in queries:
        rows = [(r.id, r.score) for r in got.where(F.col("query_id") == key).orderBy("rank").collect()]
        assert rows == pytest.approx(okapi(text, docs)[:5]) if not rows else [r[0] for r in rows] == [k for k, _ in okapi(text, docs)[:5]]


def test_dense_equals_brute_force_however_partitioned(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[7] = 0
    v[9] = v[8]
    items = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None)], "id long, embedding array<double>")
    queries = items.where("id % 20 = 0 AND id < 200").withColumnRenamed("id", "query_id")
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    for df in (items.repartition(1), items.repartition(7)):
        got = {}
        for r in retrieval.dense_topk(queries, df, 5, block=3).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id))
        for q in range(0, 200, 20):
            order = sorted((i for i in range(200) if i != 7), key=lambda i: (-round(float(unit[q] @ unit[i]), 6), i))[:5]
            assert [i for _, i in sorted(got[q])] == order


def test_hash_vectors_are_unit(spark):
    features = hash_features(spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "id string, text string"), "id", "text")
    rows = dense_vectors(features).collect()
    assert [r.id for r in rows] == ["a"] and len(rows[0].embedding) == 64 and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("m", "a", 1, "r1"), ("m", "a", 2, "r2"), ("m", "b", 1, "x"), ("m", "b", 2, "y"), ("m", "b", 3, "r3")], "mode string, query_id string, rank int, key string")
    labels = spark.createDataFrame([("a", "r1"), ("a", "zz"), ("b", "r3"), ("b", "r3")], "query_id string, key string")
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    rows = {(r.query_id, r.k): r for r in evaluation.metrics(ranked, labels, questions).collect()}
    assert (rows["a", 1].hit, rows["a", 1].recall, rows["a", 3].precision, rows["a", 1].mrr) == (1.0, 0.5, 0.5, 1.0)
    assert rows["a", 3].ndcg == round(1 / (1 + 1 / math.log2(3)), 6)
    assert (rows["b", 1].hit, rows["b", 3].recall, rows["b", 3].mrr, rows["b", 3].precision) == (0.0, 1.0, 0.333333, 0.333333)
    assert (rows["c", 10].hit, rows["c", 10].ndcg, rows["c", 10].first_rank) == (0.0, 0.0, None)
    means = {r.k: r for r in evaluation.by_mode(evaluation.metrics(ranked, labels, questions)).collect()}
    assert means[1].hit == 0.3333


def test_failures(spark):
    rows = []
    for query, hits in {"qa": (1, None, 1, 2), "qb": (None, 1, 2, 1), "qc": (None,) * 4}.items():
        for mode, rank in zip(("dense", "bm25", "hybrid", "hybrid_rerank"), hits):
            rows.append((mode, query, 10, 1.0 if rank else 0.0, rank))
    found = evaluation.failures(spark.createDataFrame(rows, "mode string, query_id string, k int, hit double, first_rank int"))
    assert {tuple(r) for r in found.collect()} == {
        ("qa", "dense_only_win"), ("qa", "reranker_hurts_rank"), ("qb", "bm25_only_win"), ("qb", "reranker_improves_rank"), ("qc", "all_methods_fail"),
    }


CANDIDATE = (
    "query_id string, id string, document_id string, section_id string, title string, text string, source_block_ids array<string>, "
    "page_numbers array<int>, heading_path array<string>, reranker_score double, fusion_rank int, place string"
)


def candidate(i, text=None, doc="d", section=None, blocks=None, pages=None, score=None):
    return ("q", f"c{i:02d}", doc, section, None, text or " ".join(f"w{i}x{k}" for k in range(20)), blocks if blocks is not None else [f"b{i}"], pages or [i * 8], [], 50.0 - i if score is None else score, i, "clash")


def fates(spark, rows, **config):
    packs = evidence.evidence_packs(spark.createDataFrame(rows, CANDIDATE), evidence.PackConfig(**config))
    return {r.id: (r.fate, r.evidence_id) for r in packs.collect()}


def test_repeats_and_caps(spark):
    rows = [candidate(0), candidate(1, blocks=["b0"]), candidate(2, text=" ".join(f"w0x{k}" for k in range(18)) + " a b"), candidate(3, pages=[1]), candidate(4, pages=[2]), candidate(5, pages=[3])]
    got = fates(spark, rows)
    assert got["c00"] == ("selected", "S1") and got["c01"][0] == got["c02"][0] == "duplicate"
    assert got["c03"][0] == got["c04"][0] == "selected" and got["c05"][0] == "per_region"
    got = fates(spark, [candidate(i, section="s") for i in range(6)])
    assert [got[f"c{i:02d}"][0] for i in range(6)] == ["selected"] * 4 + ["per_section"] * 2


def test_budget(spark):
    rows = [candidate(0, text="word " * 300), candidate(1), candidate(2), candidate(3)]
    got = fates(spark, rows, max_tokens=45)
    assert got == {"c00": ("oversized", None), "c01": ("selected", "S1"), "c02": ("selected", "S2"), "c03": ("left_out", None)}
    assert [v[0] for v in fates(spark, rows[1:], max_items=1).values()].count("selected") == 1


def test_order_of_candidates(spark):
    rows = [candidate(3, score=1.0), candidate(1, score=None), candidate(2, score=1.0)]
    rows[1] = (*rows[1][:9], None, *rows[1][10:])
    got = fates(spark, rows)
    assert (got["c02"][1], got["c03"][1], got["c01"][1]) == ("S1", "S2", "S3")


def test_safe_pairs(spark):
    df = spark.createDataFrame([(200, 500), (10, 500), (10, 20)], "q int, t int")
    got = [(r.query_kept, r.text_kept) for r in retrieval.safe_pairs(df, F.col("q"), F.col("t"), 128).collect()]
    assert got == [(93, 32), (10, 115), (10, 20)]
    with pytest.raises(ValueError):
        retrieval.safe_pairs(df, F.col("q"), F.col("t"), 7)
