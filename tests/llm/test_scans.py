import numpy as np

from quire.llm import scans
from quire.llm.scans import BODY, BREAK, FOLIO, HEADER, LineModel, ScanConfig, divisions, evident, observe, paragraphs, repaired_blocks, scan_damage

BLOCKS = (
    "document_id string, page_number int, block_id string, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, "
    "reading_order int, extraction_method string, damage string, word string"
)
DOCS = "document_id string, title string"
NATIVE = "the quiet lanterns garden explains a silver lantern and the root-image of every harbour before the attic"
HEAD = "Silver lanterns and the harbour"


def block(doc, n, text, kind="PARAGRAPH", page=1, how="OCR", box=(50.0, 200.0, 545.0, 300.0)):
    return (doc, page, f"p{page:04d}-o{n:03d}", kind, text, box, n, how, "clash", None)


def rows():
    out = [block("n", i, NATIVE + ".", how="NATIVE") for i in range(6)]
    out += [block("n", 90 + i, "MS 12 Vrabol " + NATIVE, how="NATIVE") for i in range(4)]
    out.append(block("d", 0, HEAD, "HEADING"))
    out.append(block("d", 1, "The quiet gar-\nden explains a silver lan¬\ntern and the root-\nimage of every harbour."))
    out.append(block("d", 2, "The quiet gardcn explains\nthe si1ver lantern and\nthe attic before."))
    out.append(block("d", 3, "The quiet harbour before the lan-\n3 SILVER LANTERNS AND THE HARBOUR\ntern explains the garden."))
    out.append(block("d", 4, "Silver lantems and the harbour 4", "HEADER"))
    out.append(block("d", 5, "- 1 -", "FOOTER", box=(50.0, 800.0, 545.0, 814.0)))
    out.append(block("d", 6, "MS 44b at Trekolan explains\nthe harbour in\n1894."))
    out.append(block("d", 7, None))
    out.append(block("d", 8, ""))
    out.append(out[-5])
    out += [block(f"f{i}", k, t, kind) for i in range(30) for k, (t, kind) in enumerate([("Every garden explains the attic\nbefore the lantern and the harbour.", "PARAGRAPH"), (f"{i}", "PAGE_NUMBER"), (f"Title number {i}", "HEADER")])]
    return out


def docs():
    return [("d", "The Quiet Attic"), ("d", "The Quiet Attic"), ("x", None), *[(f"f{i}", f"Title number {i}") for i in range(30)]]


def damage_of(spark, block_rows):
    found = scan_damage(spark.createDataFrame(block_rows, BLOCKS), spark.createDataFrame(docs(), DOCS), None, ScanConfig(min_count=3))
    kinds = {}
    for r in found.damage.collect():
        kinds.setdefault((r.document_id, r.block_id), set()).add(r.damage)
    return found, kinds


def test_damage_of_each_kind(spark):
    found, kinds = damage_of(spark, rows())
    of = lambda n: kinds.get(("d", f"p0001-o{n:03d}"), set())
    assert of(0) == set()
    assert of(1) == {"hyphen"}
    assert of(2) == {"chars"}
    assert of(3) == {"hyphen", "header"}
    assert of(4) == {"header", "chars"}
    assert of(5) == {"folio"}
    assert of(6) == set() and of(7) == set() and of(8) == set()
    assert len(found.damage.collect()) == len(set(map(tuple, found.damage.collect())))
    text = {r.block_id: r.text for r in repaired_blocks(found).where("document_id = 'd'").collect()}
    assert text["p0001-o001"] == "The quiet garden explains a silver lantern and the root-image of every harbour."
    assert text["p0001-o002"] == "The quiet garden explains the silver lantern and the attic before."
    assert text["p0001-o003"] == "The quiet harbour before the lantern explains the garden."
    assert text["p0001-o005"] == ""


def test_paragraphs_go_on_over_pages(spark):
    block_rows = rows() + [block("d", 20, "Every harbour explains the", page=2), block("d", 21, "2", "PAGE_NUMBER", page=2), block("d", 0, "silver lantern.", page=3)]
    found, _ = damage_of(spark, block_rows)
    texts = {r.text: (r.first_page, r.last_page) for r in paragraphs(found, spark.createDataFrame(block_rows, BLOCKS)).where("document_id = 'd'").collect()}
    assert texts["Every harbour explains the silver lantern."] == (2, 3)
    assert HEAD in texts


def test_compound_split_at_its_hyphen_is_no_damage(spark):
    _, kinds = damage_of(spark, [*rows(), block("d", 30, "The root-\nimage of every harbour.")])
    assert ("d", "p0001-o030") not in kinds


def test_empty_tables(spark):
    found = scan_damage(spark.createDataFrame([], BLOCKS), spark.createDataFrame([], DOCS))
    assert found.damage.count() == 0 and repaired_blocks(found).count() == 0


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    lines = [["one line of body text", "12", "and more of it."], ["3", "text goes on here"]]
    model = LineModel.fit([(observe(x, "PARAGRAPH", 0, set()), evident(x, "PARAGRAPH", set(), set(), None, None)) for x in lines * 5], gain=7.0)
    seq = [tuple(int(rng.integers(s)) for s in scans._SIZES) for _ in range(4)]

    def score(path):
        total = model.start[path[0]]
        for i, state in enumerate(path):
            total += model.bias[state] + sum(t[state, v] for t, v in zip(model.emit, seq[i])) + (model.move[path[i - 1], state] if i else 0)
        return total

    paths = sorted(np.ndindex(4, 4, 4, 4), key=score)
    assert abs(score(paths[-1]) - score(model.label([seq])[0])) < 1e-9
    first = paths[-1][0]
    allowed = max((p for p in paths if p[0] != first), key=score)
    assert abs(score(allowed) - score(model.label([seq], [[(0, first)]])[0])) < 1e-9
    assert model.label([[]]) == [[]]


def test_evidence_is_not_observed():
    text = ["The garden explains", "Silver Lanterns", "the harbour."]
    assert evident(text, "PARAGRAPH", {2}, set(), 1, "And then") == [BODY, HEADER, BREAK]
    assert evident(text, "PARAGRAPH", set(), set(), 1, "and then") == [BODY, BODY, BODY]
    # the features of a line don't tell whether it is a head of the document, nor what comes next
    assert observe(text, "PARAGRAPH", 0, set()) == observe(list(text), "PARAGRAPH", 0, set())


def test_labels_decide(spark, monkeypatch):
    """Without the line model no head or folio is found, nothing is broken into paragraphs, and not every known line is a head."""
    more = [block("d", 50 + i, f"{NATIVE}\nthe garden explains it all.\nA new one begins with the attic\nand the lantern.", page=4 + i) for i in range(3)]
    block_rows = rows() + more
    found, kinds = damage_of(spark, block_rows)
    made = [r.text for r in paragraphs(found, spark.createDataFrame(block_rows, BLOCKS)).where("document_id = 'd'").collect()]
    assert any(t.startswith("A new one begins") for t in made)
    flat = lambda self, sequences, never=None: [[BODY] * len(x) for x in sequences]
    monkeypatch.setattr(LineModel, "label", flat)
    found, without = damage_of(spark, block_rows)
    assert not any(k & {"header", "folio"} for k in without.values()) and any(k & {"header", "folio"} for k in kinds.values())
    plain = [r.text for r in paragraphs(found, spark.createDataFrame(block_rows, BLOCKS)).where("document_id = 'd'").collect()]
    assert not any(t.startswith("A new one begins") for t in plain) and len(plain) != len(made)


def test_offset_of_printed_numbers(spark):
    own = [block("o", i, f"The quiet harbour explains\n{100 + i}\nthe garden.", page=i) for i in range(1, 6)] + [block("o", 9, "The quiet harbour explains\n777\nthe garden.", page=9)]
    _, kinds = damage_of(spark, [*rows(), *own])
    assert all("folio" in kinds[("o", f"p{i:04d}-o{i:03d}")] for i in range(1, 6)) and ("o", "p0009-o009") not in kinds


def test_divisions_skip_intruders():
    lines = ["a divi-", "7", "ded word", "year 1890-", "95 and", "THR-", "ESHOLD here"]
    got = [(i, j, a + b) for i, j, _, a, b in divisions(lines, [BODY, FOLIO, BODY, BODY, BODY, BODY, BODY])]
    assert got == [(0, 2, "divided"), (5, 6, "THRESHOLD")]
    assert divisions(["his own-", "HEAD LINE"], [BODY, HEADER]) == []


def test_heads_that_end_as_sentences(spark):
    own = [block("d", 40, "What Is the Shadow?", "HEADING"), block("d", 41, "The quiet harbour before the\nWhat Is the Shadow?\nlantern explains the garden."), block("d", 42, "WHAT IS THE SHADOW? 42", "HEADER")]
    _, kinds = damage_of(spark, [*rows(), *own])
    assert "header" in kinds.get(("d", "p0001-o041"), set()) and "header" in kinds.get(("d", "p0001-o042"), set())
    assert "header" not in kinds.get(("d", "p0001-o040"), set())
