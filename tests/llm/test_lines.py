import re
from collections import defaultdict

from quire.llm.lines import RepeatConfig, repeated_lines, without_repeats

BLOCKS = "document_id string, block_id string, text string, section string, n_docs int"
DOCS = "document_id string, section string, title string"
NOTICE = "Reprinted by permission of the Harbour Press, page {}"


def form(line):
    return re.sub(r"\d+", "#", re.sub(r"[\W_]+", " ", line.lower())).strip()


def data():
    blocks, docs = [], []
    for i in range(40):
        docs.append((f"d{i}", "letters" if i < 30 else "clinic", "t"))
        lines = [f"An own line of document number {chr(97 + i % 26) * 5} and no other {'x' * (i // 26)}"]
        if i % 3 == 0 or i in (31, 32):
            lines.append(NOTICE.format(i))
        if i < 4:
            lines.append("Only four documents carry this long line")
        lines.append("short line")
        blocks.append((f"d{i}", "b0", "\n".join(lines), "clash", 1))
    return blocks, docs


def brute(blocks, docs, config):
    section = defaultdict(set)
    for d, s, _ in docs:
        if d and s:
            section[d].add(s)
    has = defaultdict(set)
    for d, *_ in blocks:
        for s in section[d]:
            has[s].add(d)
    seen = defaultdict(set)
    for d, b, t, *_ in blocks:
        for line in (t or "").split("\n"):
            for s in section[d]:
                seen[s, form(line)].add(d)
    out = set()
    for d, b, t, *_ in blocks:
        for k, line in enumerate((t or "").split("\n"), 1):
            f = form(line)
            if len(f) >= config.min_chars and any(len(seen[s, f]) >= config.min_docs and len(seen[s, f]) * config.min_share >= len(has[s]) for s in section[d]):
                out.add((d, b, k))
    return out


def test_equals_brute_force_on_dirty_rows(spark):
    blocks, docs = data()
    blocks += blocks[:3] + [("d1", "b1", None, None, None), ("d1", "b2", "", None, None), ("lost", "b0", NOTICE.format(1), None, None), (None, None, NOTICE.format(2), None, None)]
    blocks.append(("d2", "b9", (NOTICE.format(7) + "\n") * 3000, None, None))
    docs += docs[:2] + [("d5", "clinic", "t"), ("x", None, None), (None, "letters", None)]
    for config in (RepeatConfig(), RepeatConfig(min_share=2), RepeatConfig(min_docs=2)):
        found = repeated_lines(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(docs, DOCS), config)
        got = {(r.document_id, r.block_id, r.line_no) for r in found.lines.collect()}
        assert got == brute([b for b in blocks if b[0]], docs, config)


def test_many_documents_fill_several_words(spark):
    docs = [(f"d{i:04d}", "s", "") for i in range(700)]
    blocks = [(d, "b", NOTICE.format(i), "", 0) for i, (d, *_) in enumerate(docs) if i % 7]
    found = repeated_lines(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(docs, DOCS))
    assert found.lines.count() == len(blocks)
    assert {r.n_with for r in found.bitmaps.collect()} == {len(blocks)} and found.bitmaps.count() >= 10


def test_texts_without_the_lines(spark):
    blocks, docs = data()
    blocks.append(("d3", "only", NOTICE.format(9), "", 0))
    blocks.append(("d3", "null", None, "", 0))
    df = spark.createDataFrame(blocks, BLOCKS)
    out = {(r.document_id, r.block_id): r for r in without_repeats(df, repeated_lines(df, spark.createDataFrame(docs, DOCS))).collect()}
    assert len(out) == len(blocks)
    assert out["d3", "only"].text == "" and out["d3", "null"].text is None
    assert NOTICE.format(3) not in out["d3", "b0"].text and "short line" in out["d3", "b0"].text and out["d3", "b0"].n_removed == 1
    assert out["d1", "b0"].n_removed == 0 and out["d1", "b0"].section == "clash"


def test_empty_tables(spark):
    empty = repeated_lines(spark.createDataFrame([], BLOCKS), spark.createDataFrame([], DOCS))
    assert empty.lines.count() == 0 and empty.bitmaps.count() == 0
