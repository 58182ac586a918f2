import json

import pytest
from pyspark.sql import functions as F

from quire.operators import evaluation, graph, ingest, retrieval, structure
from quire.operators.chunking import _TOKEN, ChunkConfig, chunk_blocks, pack
from quire.sources import files


def test_registry_by_checksum_then_first_path(spark):
    docs = spark.createDataFrame(
        [("a", "S1", "Lib\\Letters\\One.pdf"), ("b", None, "lib/letters/two.pdf"), ("c", "s9", "lib/other.pdf"), ("d", None, None), ("a", "S1", "Lib\\Letters\\One.pdf")],
        "document_id string, source_sha256 string, source_path string",
    )
    entries = spark.createDataFrame(
        [(1, None, "Letters/", "INCLUDE", None, None), (2, "s1", None, "EXCLUDE", "T", None), (3, None, "letters\\two", "REVIEW", None, None), (4, " ", "", "INCLUDE", None, None)],
        "entry_no int, sha256 string, path string, index_status string, title string, author string",
    )
    found = {r.document_id: (r.entry_no, r.matched_by) for r in ingest.registry_lookup(docs, entries).collect()}
    assert found == {"a": (2, "sha"), "b": (1, "path"), "c": (None, None), "d": (None, None)}
    named = docs.dropDuplicates(["document_id"]).select("document_id", F.lit("INCLUDE").alias("index_status"), F.lit("own").alias("title"), F.lit("me").alias("author"))
    got = {r.document_id: (r.index_status, r.title, r.author) for r in ingest.registry_apply(named, ingest.registry_lookup(docs, entries), entries).collect()}
    assert got == {"a": ("EXCLUDE", "T", "me"), "b": ("INCLUDE", "own", "me"), "c": ("REVIEW", "own", "me"), "d": ("REVIEW", "own", "me")}
    assert ingest.registry_lookup(docs.limit(0), entries.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "X", "p\\Q")], "entry_no int, sha256 string, path string")
    assert {tuple(r) for r in ingest.registry_keys(both).collect()} == {(1, "x", None), (1, None, "p/q")}


def test_filters():
    f = ingest.SearchFilter.of({"author": [" Ann ", "BOB"], "source_type": "primary"})
    assert f.values == {"author": ("ann", "bob"), "source_type": ("PRIMARY",)}
    assert ingest.SearchFilter.of(None).predicate() is None
    for bad in ({"colour": "x"}, {"title": " "}, {"title": []}, {"title": None}, {"source_type": "tertiary"}):
        with pytest.raises(ValueError):
            ingest.SearchFilter.of(bad)


def test_filter_narrows_hits_not_statistics(spark):
    docs = spark.createDataFrame([("d1", " Ann", "x"), ("d2", "ann", "x"), ("d3", "Bob", "x"), ("d4", None, None)], "document_id string, author string, title string")
    assert {r.document_id for r in ingest.SearchFilter.of({"author": "ANN"}).documents(docs).collect()} == {"d1", "d2"}
    chunks = spark.createDataFrame([("c1", "soul and shadow"), ("c2", "soul of stone"), ("c3", "nothing here"), ("c4", None), ("c5", "other words")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "soul"), ("blank", ""), ("none", None)], "query_id string, query string")
    every = {r.id: r.score for r in retrieval.bm25_topk(asked, chunks, 5).collect()}
    some = {r.id: r.score for r in retrieval.bm25_topk(asked, chunks, 5, among=spark.createDataFrame([("c2",)], "id string")).collect()}
    assert set(every) == {"c1", "c2"} and some == {"c2": every["c2"]}


def test_best_of_a_task_keeps_ties_by_id(spark):
    chunks = spark.createDataFrame([(f"c{i:04d}", "soul " * (1 + i % 3) + "stone") for i in range(3000)] + [(f"x{i}", "plain words only") for i in range(4000)], "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "soul soul stone"), ("q2", "words")], "query_id string, query string")
    got = retrieval.bm25_topk(asked, chunks.repartition(5), 4).orderBy("query_id", "rank").collect()
    one = retrieval.bm25_topk(asked, chunks.repartition(1), 4).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in one] and [r.id for r in got if r.query_id == "q1"] == sorted(r.id for r in got if r.query_id == "q1")


def test_stages_reasons_and_actions(spark):
    files_ = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", None), ("d", "4", "broken"), ("e", "5", None)], "document_id string, sha256 string, error string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    state = spark.createDataFrame([("a", "1", 3), ("b", "old", 3), ("c", "3", 0)], "document_id string, sha256 string, chunk_count int")
    stages = ingest.stage_of_files(files_, ids("a", "b", "c", "d"), ids("a", "a", "b"), state)
    assert {r.document_id: r.stage for r in stages.collect()} == {"a": "INDEXED", "b": "CHUNKED", "c": "PROCESSED", "d": "ERROR", "e": "DISCOVERED"}
    now = files_.select("document_id", "sha256", F.lit("v2").alias("config_version"), F.lit("m").alias("model_name"))
    old = spark.createDataFrame([("a", "1", "v2", "m"), ("b", "old", "v1", "m"), ("c", "3", "v1", "x"), ("d", "4", "v2", None)], "document_id string, sha256 string, config_version string, model_name string")
    reasons = ingest.reindex_reasons(now, old)
    assert {r.document_id: r.reason for r in reasons.collect()} == {"a": "unchanged", "b": "source_changed", "c": "config_changed", "d": "model_changed", "e": "new"}
    assert {r.document_id: r.action for r in ingest.ingest_ledger(stages, reasons).collect()} == {"a": "reuse", "b": "parse", "c": "chunk", "d": "failed", "e": "parse"}
    assert ingest.state_differences({"a": 1, "b": 2}, {"a": 1, "b": 3}, ("a", "b")) == ["b"] and ingest.state_differences({}, None, ("a",)) == ["missing"]


def test_set_hash_ignores_order_and_sees_changes(spark):
    rows = [("a", 1), ("b", None), ("b", None)]
    h = lambda r: tuple(ingest.set_hash(spark.createDataFrame(r, "x string, y int"), ["x", "y"]).first())
    assert h(rows) == h(rows[::-1]) and h(rows) != h(rows[:2]) and h(rows) != h([("a", 1), ("b", None), ("b", 0)]) and h([])[0] == 0


def test_graph_tables(spark):
    edges = spark.createDataFrame(
        [("e1", "concept:a", "concept:b", "TRUSTED", 5), ("e2", "concept:b", "concept:c", "WEAK", None), ("e3", "concept:c", "concept:d", "TRUSTED", 1)],
        "edge_id string, source_node_id string, target_node_id string, status string, evidence_count long",
    )
    words = spark.createDataFrame([("a", "A", "T"), ("alpha", "A", "T"), ("b", "B", "T"), ("z", "Z", "U")], "alias string, canonical string, node_type string")
    nodes = {r.name: (r.n_edges, r.evidence_count) for r in graph.nodes(edges, words).collect()}
    assert nodes == {"A": (1, 5), "B": (2, 5), "Z": (0, 0)}
    assert {r.name for r in graph.filter_nodes(words, "t", "LPH").collect()} == {"A"}
    shown = graph.capped_neighbourhood(edges, None, 2, max_nodes=2, max_edges=1).collect()
    assert [(r.kind, r.id, r.n_hidden) for r in sorted(shown, key=lambda r: (r.kind != "node", r.place))] == [("node", "concept:a", 1), ("node", "concept:b", 1), ("edge", "e1", 0)]
    assert graph.capped_neighbourhood(edges.limit(0)).count() == 0


def test_derivation(spark):
    blocks = spark.createDataFrame([("d", "b1", "The old Garden, of"), ("d", "b2", "stone and  water."), ("d", "b3", None)], "document_id string, block_id string, text string")
    rows = [("c1", "d", "old garden of\nSTONE", ["b1", "b2"]), ("c2", "d", "old stone water", ["b1", "b2"]), ("c3", "d", "stone old", ["b1", "b2"]), ("c4", "d", None, None), ("c5", "d", "x", ["b9"])]
    got = {r.chunk_id: (r.contiguous, r.ordered) for r in structure.derivation(spark.createDataFrame(rows, "chunk_id string, document_id string, text string, source_block_ids array<string>"), blocks).collect()}
    assert got == {"c1": (True, True), "c2": (False, True), "c3": (False, False), "c4": (True, True), "c5": (False, False)}
    with pytest.raises(ValueError, match="c5"):
        structure.require_none(spark.createDataFrame([("c5", "bad")], "id string, problem string"))


def test_chunks_never_pass_their_size(spark):
    text = lambda n: " ".join(["word"] * (n - 1)) + "."
    config = ChunkConfig()
    for sizes in ([221, 295], [299], [295, 40, 295], [700, 10], [50, 270, 60]):
        rows = [("h", "HEADING", 1, "A long heading"), *[(f"b{i}", "PARAGRAPH", 1, text(n)) for i, n in enumerate(sizes)]]
        out = pack(rows, config)
        assert all(len(_TOKEN.findall(t)) <= config.most for t, *_ in out), sizes
        assert out[0][1][0] == "h" and len(out[0][1]) > 1  # the heading stands with content
    # a document is packed by sections, numbered through
    rows = [("d", 1, i, f"b{i}", "HEADING" if i % 5 == 0 else "PARAGRAPH", f"Head {i}" if i % 5 == 0 else text(90)) for i in range(60)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, reading_order int, block_id string, block_type string, text string")
    got = chunk_blocks(df).orderBy("chunk_index").collect()
    want = pack([(b, k, p, t) for _, p, _, b, k, t in rows], config)
    assert [(r.chunk_index, r.text, r.source_block_ids, r.heading) for r in got] == [(i, t, b, h) for i, (t, b, _, h) in enumerate(want)]


def test_sections_of_two_levels(spark):
    rows = [("d", 1, i, f"b{i}", k, t) for i, (k, t) in enumerate([("PARAGRAPH", "x"), ("TITLE", "T1"), ("HEADING", "H1"), ("PARAGRAPH", "y"), ("TITLE", "T2"), (None, "z")])]
    got = structure.sections(spark.createDataFrame(rows, "document_id string, page_number int, reading_order int, block_id string, block_type string, text string")).orderBy("block_id").collect()
    assert [(r.section_no, r.heading, r.heading_path) for r in got] == [(0, None, []), (1, "T1", ["T1"]), (2, "H1", ["T1", "H1"]), (2, "H1", ["T1", "H1"]), (3, "T2", ["T2"]), (3, "T2", ["T2"])]


def test_block_kinds_without_evidence(spark):
    rows = [("Figure 3", 8.0), ("small note", 8.0), ("short line", 11.0), ("It ends.", 11.0), ("x" * 45, None), ("- one\n- two\n", 11.0), ("", 11.0)]
    df = spark.createDataFrame(rows, "t string, f double")
    kind = structure.block_kind(F.col("t"), F.col("f"), F.lit(11.0), F.lit(300.0), F.lit(320.0), F.lit(842.0))
    assert [r[0] for r in df.select(kind).collect()] == ["CAPTION", "UNKNOWN", "UNKNOWN", "PARAGRAPH", "PARAGRAPH", "LIST", "UNKNOWN"]


def test_labels_and_metrics(spark):
    items = spark.createDataFrame([("q1", "What?"), ("q1", "Who?"), ("q2", " ")], "question_id string, question string")
    labels = spark.createDataFrame([("l1", "d1", "c1", [1]), ("l2", "d1", "c9", [7]), ("l3", "d2", "c1", None)], "label_id string, document_id string, chunk_id string, page_numbers array<int>")
    chunks = spark.createDataFrame([("c1", "d1")], "chunk_id string, document_id string")
    docs = spark.createDataFrame([("d1", 3)], "document_id string, page_count int")
    got = {tuple(r) for r in evaluation.label_violations(items, labels, chunks, docs).collect()}
    assert got == {("q1", "duplicate_question"), ("q2", "blank_question"), ("l2", "unknown_chunk"), ("l2", "page_outside"), ("l3", "unknown_document"), ("l3", "other_document")}


def test_sinks_and_sources(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps({"documents": [{"sha256": "a", "path": "p"}, {"path": "q", "title": "T"}]}))
    assert [(r.entry_no, r.path, r.title) for r in files.read_registry(spark, str(tmp_path / "registry.json")).collect()] == [(0, "p", None), (1, "q", "T")]
    df = spark.createDataFrame([("r", "bm25", 1, 0.5, 0.1, 0.2, 0.3, 0.4), ("r", "bm25", 5, 0.6, 0.1, 0.2, 0.3, 0.4)], "run string, mode string, k int, hit double, recall double, precision double, ndcg double, mrr double")
    files.write_comparison(df, str(tmp_path / "cmp"), (5, 1))
    back = spark.read.option("header", True).csv(str(tmp_path / "cmp"))
    assert back.columns[:4] == ["run", "mode", "hit@1", "hit@5"] and back.first()["hit@5"] == "0.6"
    files.write_report(df, str(tmp_path / "report"), "2024-01-01")
    (tmp_path / "report" / "latest" / "broken.json").write_text("{no json\n")
    assert files.read_runs(spark, str(tmp_path / "report" / "latest"), df.schema).count() == 2
    files.write_graph({"nodes": df, "state": df.limit(1)}, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "state")).count() == 1
    assert json.loads(files.as_json(spark.createDataFrame([("k", None)], "key string, x int"), "key").first().json) == {"key": "k"}
