from quire.operators import graph, structure

EDGE = "edge_id string, source_node_id string, target_node_id string, relationship_type string, confidence double, evidence_ids array<string>, evidence_count bigint, status string, build_id string"
SPAN = "evidence_id string, document_id string, chunk_id string, page_numbers array<int>, evidence_text string"
CHUNK = "chunk_id string, document_id string, text string, source_block_ids array<string>, page_numbers array<int>, start_page int, end_page int, token_count int, chunk_index int"
BLOCK = "document_id string, page_number int, block_id string, block_type string, text string, reading_order int"


def test_graph_violations_of_counts_spans_and_merging(spark):
    a, b = "concept:ego", "concept:self"
    edges = [
        ("fine", a, b, "R", 0.8, ["e"], 1, "TRUSTED", "g1"), ("zero", a, b, "S", 0.8, ["e"], 0, "TRUSTED", "g1"), ("bare", a, b, "T", 0.8, [], 2, "TRUSTED", "g1"),
        ("null", a, b, "U", 0.8, ["e"], None, "TRUSTED", "g1"), ("weak", a, b, "V", 0.5, ["e"], 0, "WEAK", "g1"), ("back", b, a, "R", 0.8, ["e"], 1, "TRUSTED", "g1"),
        ("other", a, b, "R", 0.8, ["e"], 1, "TRUSTED", "g2"), ("other", a, b, "R", 0.8, ["e"], 1, "TRUSTED", "g2"),
    ]
    spans = [("e", "d", "c", [1], "x"), ("twice", "d", "c", [1], "x"), ("twice", "d", "c", [1], "x"), ("paged", "d", "c", [], "x"), ("unpaged", "d", "c", None, "x"), ("blank", "d", "c", [1], " \n"), ("lone", None, "c", [1], "x")]
    vocabulary = spark.createDataFrame([("ego", "Ego"), ("self", "Self")], "alias string, canonical string")
    chunks = spark.createDataFrame([("c",)], "chunk_id string")
    got = {tuple(r) for r in graph.graph_violations(spark.createDataFrame(edges, EDGE), spark.createDataFrame(spans, SPAN), vocabulary, chunks).collect()}
    assert got == {
        ("zero", "trusted_without_evidence"), ("bare", "trusted_without_evidence"), ("fine", "unmerged_edge"), ("back", "unmerged_edge"),
        ("twice", "duplicate_evidence"), ("paged", "no_pages"), ("unpaged", "no_pages"), ("blank", "empty_span"), ("lone", "no_document"),
    }


def test_chunk_violations_of_pages_order_and_repeats(spark):
    text = lambda *b: "\n\n".join(b)
    chunks = [
        ("ok", "d", text("a", "b", "c"), ["b1", "b2", "b3"], [1, 2], 1, 2, 3, 0), ("far", "d", "b", ["b2"], [2, 3], 2, 3, 1, 1),
        ("swap", "d", text("b", "a"), ["b2", "b1"], [2], 2, 2, 2, 2), ("again", "d", "c", ["b3"], [2], 2, 2, 1, 3), ("dup", "d", "x", ["b4"], [2], 2, 2, 1, 4), ("zero", "e", "y", ["b1"], [0], 2, 2, 1, 0),
    ]
    blocks = [("d", 1, "b1", "P", "a", 1), ("d", 1, "b2", "P", "b", 2), ("d", 2, "b3", "P", "c", 0), ("d", 2, "b4", "P", "x", 1), ("d", 2, "b4", "P", "x", 1), ("e", 1, "b1", "P", "y", 0)]
    documents = spark.createDataFrame([("d", 2), ("d", 2)], "document_id string, page_count int")
    found = structure.chunk_violations(spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(blocks, BLOCK), documents)
    assert {tuple(r) for r in found.collect()} == {("far", "page_outside"), ("swap", "block_order"), ("dup", "repeated_block"), ("zero", "page_outside")}
