import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.split import SplitConfig, pieces_of, split_oversized

TOKEN = re.compile(r"\w+|[^\w\s]")
SCHEMA = "chunk_id string, text string, source_block_ids array<string>, token_count int, piece_no int, n_tokens string"


def tokens(text):
    return TOKEN.findall(text)


def prose(n, seed=0):
    rng = random.Random(seed)
    paragraphs = []
    for _ in range(n):
        topic = [f"topic{rng.randrange(40)}" for _ in range(6)]
        paragraphs.append(" ".join(f"The {rng.choice(topic)} meets a {rng.choice(topic)} by the {rng.choice(topic)}." for _ in range(8)))
    return "\n\n".join(paragraphs)


def check(text, ids, config):
    rows = pieces_of(text, ids, None, config)
    total = len(tokens(text))
    assert all(len(tokens(r[2])) == r[3] <= config.limit for r in rows)
    assert all(text[r[4] : r[5]] == r[2] for r in rows)
    if total > config.limit:
        again = tokens(rows[0][2])
        for before, after in zip(rows, rows[1:]):
            own = tokens(after[2])
            assert own[: config.overlap] == tokens(text[: before[5]])[-config.overlap :] or config.overlap == 0
            again += own[config.overlap :]
        assert again == tokens(text)
    return rows


def test_pieces_rebuild_the_text_and_name_their_blocks():
    text = prose(12)
    ids = [f"b{i}" for i in range(12)]
    rows = check(text, ids, SplitConfig())
    assert len(rows) > 3 and {r[6] for r in rows[:-1]} <= {"paragraph", "sentence"}
    assert [b for b in ids if any(b in r[7] for r in rows)] == ids
    for r in rows:
        for b in r[7]:
            start = sum(len(p) + 2 for p in text.split("\n\n")[: int(b[1:])])
            assert start < r[5] and start + len(text.split("\n\n")[int(b[1:])]) > r[4]


def test_without_boundaries_the_last_token_that_fits_is_cut():
    rows = check(" ".join(f"w{i}" for i in range(1000)), ["b"], SplitConfig())
    assert {r[6] for r in rows[:-1]} == {"token"} and rows[0][3] == 300


def test_abbreviations_are_no_boundary():
    rows = pieces_of("One may compare it (cf. vol. ii, p. 5) with that of Dr. Stone. " * 40, ["b"], None, SplitConfig())
    assert all(r[2].rstrip().endswith("Stone.") for r in rows[:-1] if r[6] == "sentence")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n_é„—1", min_size=0, max_size=600), st.sampled_from([(20, 4), (30, 0), (12, 5)]))
def test_any_text_round_trips(text, sizes):
    if tokens(text):
        check(text, ["x"], SplitConfig(*sizes))


def test_operator_on_dirty_rows(spark):
    text = prose(6, 2)
    rows = [
        ("big", text, [f"b{i}" for i in range(6)], None, 9, "clash"), ("big", text, [f"b{i}" for i in range(6)], 5, 9, "clash"),
        ("small", "A few words.", ["s"], 4, 1, ""), ("none", None, None, None, None, None), ("blank", "   ", [], 0, 0, ""), (None, "lost id", ["q"], 1, 1, ""),
        ("nulls", text, None, None, None, None),
    ]
    got = split_oversized(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert len(by["big"]) == by["big"][0].n_pieces == len({r.piece_no for r in by["big"]}) > 1
    assert by["small"][0].text == "A few words." and by["none"][0].n_tokens == 0 and by[None][0].text == "lost id"
    assert all(r.source_block_ids == [] for r in by["nulls"])
    assert split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bad_sizes():
    with pytest.raises(ValueError):
        SplitConfig(limit=50, overlap=30)


def test_a_repeated_id_is_one_item(spark):
    short, long = "A few words here.", " ".join(f"word{i} and more." for i in range(200))
    rows = [("a", short, ["x"]), ("a", long, ["y"]), ("a", short, ["x"]), ("b", short, ["x"]), (None, short, None), (None, long, None)]
    out = split_oversized(spark.createDataFrame(rows, "chunk_id string, text string, source_block_ids array<string>")).collect()
    of = lambda key: {(r.source_tokens, r.n_pieces) for r in out if r.chunk_id == key}
    assert len(of("a")) == len(of("b")) == len(of(None)) == 1
    # the greatest of differing texts is kept
    assert next(iter(of("a")))[1] > 1 and len([r for r in out if r.chunk_id == "a"]) == next(iter(of("a")))[1]
