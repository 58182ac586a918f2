import os

import pytest

from quire.llm.mix import MixConfig, TOKENIZER, allocate, mix, sized

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
DOCS = "doc_id long, text string, source string, n_tokens string, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def documents(n=600):
    rows = [(i, "word " * (5 + i % 40), ["big", "BIG ", "mid", "big", "sm_all"][i % 5] if i % 50 else "tiny", "clash", 1) for i in range(n)]
    return rows + rows[:9] + [(9001, None, "big", None, None), (9002, "", "mid", None, None), (9003, "text", None, None, None), (None, "lost", "big", None, None), (9004, "out", "unlisted", None, None)]


LIST = [("big", 0.4, 2), ("mid", 0.3, 3), ("sm-all", 0.2, 4), ("tiny", 0.1, 2), ("none", 0.0, 5), ("absent", 0.05, 2), ("nulls", None, None)]


def test_shares_caps_and_sizes(spark):
    out = mix(spark.createDataFrame(documents(), DOCS), spark.createDataFrame(LIST, TARGETS))
    chosen, shares = out.chosen.collect(), {r.source: r for r in out.shares.collect()}
    cap = {s: r or 0 for s, _, r in LIST}
    assert all(1 <= r.copies <= cap[r.source] for r in chosen)
    assert len({r.doc_id for r in chosen}) == len(chosen)
    assert shares["tiny"].tokens == 2 * shares["tiny"].held_tokens  # out of reach: all it may give
    assert shares["absent"].tokens == shares["nulls"].tokens == shares["none"].tokens == 0
    total = sum(r.held_tokens for r in shares.values())
    given = allocate([(r.source, r.target_share, r.max_repeats, r.held_tokens) for r in shares.values()], None)
    assert abs(sum(given.values()) - total) < 1e-6
    for r in shares.values():
        assert given[r.source] - 60 <= r.tokens <= given[r.source] + 1e-6
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-4


def test_same_seed_same_sample_however_partitioned(spark):
    d, t = spark.createDataFrame(documents(), DOCS), spark.createDataFrame(LIST, TARGETS)
    pick = lambda df, seed: sorted((r.doc_id, r.copies) for r in mix(df, t, MixConfig(seed=seed)).chosen.collect())
    assert pick(d, 1) == pick(d.repartition(11), 1) != pick(d, 2)


def test_weights_favour_heavy_records(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, "word " * 10, "s", "", 0) for i in range(2000)], DOCS)
    t = spark.createDataFrame([("s", 1.0, 1)], TARGETS)
    weight = F.when(F.col("doc_id") < 1000, 9.0).otherwise(1.0)
    chosen = mix(d, t, MixConfig(total=4000), weight).chosen.collect()
    heavy = sum(r.doc_id < 1000 for r in chosen)
    assert 0.82 < heavy / len(chosen) < 0.97


def test_allocation():
    assert allocate([("a", 0.5, 1, 100), ("b", 0.5, 9, 100)], 400) == {"a": 100.0, "b": 300.0}
    assert allocate([("a", 0.5, 1, 100), ("b", 0.5, 1, 100)], 1000) == {"a": 100.0, "b": 100.0}
    assert allocate([], 10) == {} and allocate([("a", 0.0, 1, 5)], 10) == {"a": 0.0}


def test_tokenizers_of_each_kind_and_empty_tables(spark):
    folder = os.path.dirname(TOKENIZER)
    d = spark.createDataFrame([(1, "Hello, world! <|endoftext|>", "s", "", 0), (2, None, None, "", 0)], DOCS)
    n = {f: {r.doc_id: r.n_tokens for r in sized(d, os.path.join(folder, f)).collect()} for f in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")}
    assert n["byte_bpe_50k.tiktoken"] == n["byte_bpe_50k.json"] and n["piece_bpe_32k.model"][1] > 3 and n["byte_bpe_50k.json"][2] == 0
    empty = mix(d.limit(0), spark.createDataFrame(LIST, TARGETS))
    assert empty.chosen.count() == 0 and empty.shares.count() == len(LIST)
    assert mix(d, spark.createDataFrame([], TARGETS)).chosen.count() == 0
