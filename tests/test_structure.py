import re

from pyspark.sql import functions as F

from quire.operators import chunking, corpus, graph, structure
from quire.sources import files
from quire.streaming import ingest

BLOCKS = "document_id string, page_number int, block_id string, block_type string, text string, reading_order int"
TOKEN = re.compile(r"\w+|[^\w\s]")


def test_page_classes(spark):
    rows = [(0, 0, 0, 0.0), (10, 1, 1, 0.8), (10, 1, 0, 0.0), (400, 0, 0, 0.0), (400, 3, 1, 0.2), (2000, 9, 1, 0.2)]
    df = spark.createDataFrame(rows, "l int, b int, i int, r double")
    kinds = [r[0] for r in df.select(structure.page_class(F.col("l"), F.col("b"), F.col("i"), F.col("r"))).collect()]
    assert kinds == ["EMPTY", "OCR_REQUIRED", "EMPTY", "SUSPICIOUS", "HYBRID", "NATIVE"]


def test_sections_and_runs(spark):
    rows = [("d", 1, "b0", "PARAGRAPH", "before", 0), ("d", 1, "b1", "HEADING", " One \n two ", 1), ("d", 1, "b2", "HEADER", "h", 2), ("d", 2, "b3", None, "x", 0), ("d", 3, "b4", "TITLE", "T", 0), ("e", 1, "b0", "PARAGRAPH", None, None)]
    got = {(r.document_id, r.block_id): (r.section_no, r.heading) for r in structure.sections(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got == {("d", "b0"): (0, None), ("d", "b1"): (1, "One two"), ("d", "b3"): (1, "One two"), ("d", "b4"): (2, "T"), ("e", "b0"): (0, None)}


def test_two_columns(spark):
    boxes = [("d", 1, f"c{i}{s}", dict(x0=x, y0=100.0 * i, x1=x + 200, y1=100.0 * i + 80)) for i in range(1, 5) for s, x in (("l", 50.0), ("r", 345.0))]
    df = spark.createDataFrame([(*b, "TWO_COLUMN", 595.0) for b in boxes], "document_id string, page_number int, block_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>, layout string, width double")
    order = [r.block_id for r in structure.reading_order(df).orderBy("place").collect()]
    assert order == ["c1l", "c2l", "c3l", "c4l", "c1r", "c2r", "c3r", "c4r"]
    gap = structure.gutters(structure.occupancy(df)).collect()
    assert len(gap) == 1 and 20 < gap[0].first_bin <= gap[0].last_bin < 30
    one = df.withColumn("bbox", F.col("bbox").withField("x0", F.lit(50.0)).withField("x1", F.lit(545.0)))
    assert structure.gutters(structure.occupancy(one)).count() == 0


def test_token_windows_cover_the_text(spark):
    df = spark.createDataFrame([("a", " ".join(map(str, range(25)))), ("b", "x"), ("c", ""), ("d", None)], "id string, text string")
    rows = structure.token_windows(df, "id", "text", 10, 3).orderBy("id", "window_no").collect()
    assert [(r.id, r.n_tokens, r.text.split()[0]) for r in rows] == [("a", 10, "0"), ("a", 10, "7"), ("a", 10, "14"), ("a", 4, "21"), ("b", 1, "x")]


def test_packing_keeps_every_block_in_order(spark):
    text = "The quiet garden explains a lantern near the attic. " * 4
    rows = [("d", 1 + i // 5, f"b{i:02d}", "HEADING" if i % 7 == 0 else "PARAGRAPH", f"Heading {i}" if i % 7 == 0 else text, i) for i in range(20)]
    rows += [("d", 9, "big", "PARAGRAPH", "word " * 900, 99), ("d", 9, "foot", "FOOTER", "f", 98), ("d", 9, "none", "PARAGRAPH", None, 97), rows[3]]
    out = chunking.chunk_blocks(spark.createDataFrame(rows, BLOCKS)).orderBy("chunk_index").collect()
    assert all(r.token_count == len(TOKEN.findall(r.text)) <= 300 + 30 for r in out)
    seen = list(dict.fromkeys(b for r in out for b in r.source_block_ids))
    assert seen == [r[2] for r in rows[:20]] + ["big"]
    assert [r.chunk_index for r in out] == list(range(len(out)))


def test_tail_overlap():
    assert chunking.tail_overlap("One two. Three four five. Six.", 3) == "Six."
    assert chunking.tail_overlap("One two three four five six.", 3) == "One two three"
    assert chunking.tail_overlap("", 5) == ""


def test_chunk_violations(spark):
    schema = "chunk_id string, document_id string, text string, source_block_ids array<string>, page_numbers array<int>, start_page int, end_page int, token_count int, chunk_index int"
    chunks = [("ok", "d", "a b", ["x"], [1], 1, 1, 2, 0), ("bad", "d", " ", ["gone"], [], 3, 2, None, 1), ("late", "d", "c", ["y"], [2], 2, 2, 1, 2)]
    blocks = [("d", 1, "x", "PARAGRAPH", "a b ", 0), ("d", 1, "y", "PARAGRAPH", "other", 0)]
    got = {tuple(r) for r in structure.chunk_violations(spark.createDataFrame(chunks, schema), spark.createDataFrame(blocks, BLOCKS)).collect()}
    assert got == {("bad", p) for p in ("empty_text", "no_pages", "bad_span", "bad_count", "unknown_block")} | {("late", "page_order"), ("late", "text_differs")}


def test_relations_and_edges(spark):
    vocabulary = spark.createDataFrame([("ego", "Ego"), ("shadow", "Shadow"), ("self", "Self"), ("persona", "Persona")], "alias string, canonical string")
    chunks = [("c1", "d1", "The ego confronts the shadow directly. The persona is part of the Self.", ["H"]), ("c2", "d2", "The persona contrasts with the shadow.", []), ("c3", "d2", None, None)]
    df = spark.createDataFrame(chunks, "chunk_id string, document_id string, text string, heading_path array<string>")
    rows = {(r.chunk_id, r.a, r.b): (r.source, r.relation) for r in graph.relations(df, vocabulary).collect()}
    assert rows["c1", "Ego", "Shadow"] == ("sentence", "RELATED_TO")
    assert rows["c1", "Persona", "Self"] == ("pattern", "PART_OF")
    assert rows["c2", "Persona", "Shadow"] == ("pattern", "CONTRASTS_WITH")
    assert rows["c1", "Ego", "Self"] == ("block", "ASSOCIATED_WITH")
    edge = {(r.source_node_id, r.target_node_id): r for r in graph.edges(graph.relations(df, vocabulary)).collect()}
    both = edge["concept:persona", "concept:shadow"]
    assert (both.relation, both.n_chunks, both.n_documents, both.confidence) == ("CONTRASTS_WITH", 2, 2, 0.72)


def test_neighbourhood_rings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "source_node_id string, target_node_id string")
    assert {tuple(r) for r in graph.neighbourhood(edges, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_fingerprints_and_changes(spark):
    a = spark.createDataFrame([("d1", "c1", "x"), ("d2", "c2", "y"), ("d3", "c3", "z")], "document_id string, chunk_id string, text string")
    b = spark.createDataFrame([("d1", "c1", " x "), ("d2", "c2", "changed"), ("d4", "c4", "new")], a.schema)
    prints = lambda df: corpus.fingerprints(df, "document_id", "chunk_id", "text")
    assert {tuple(r) for r in corpus.change_plan(prints(a), prints(b), "document_id").collect()} == {("d1", "unchanged"), ("d2", "changed"), ("d3", "deleted"), ("d4", "new")}
    assert {r.chunk_id for r in corpus.upsert(a, b, "document_id").collect()} == {"c1", "c2", "c3", "c4"}
    assert corpus.latest(a.unionByName(a), ["document_id"], "chunk_id").count() == 3


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    files.write_partitioned(df, str(tmp_path / "t"), "k")
    files.write_partitioned(df.where("k = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "t"), "k")
    assert {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"v": "1", "n": 1}\nbroken\n')
    assert files.read_json(spark, str(tmp_path / "j"), "v string, n int").count() == 2
    found = files.discover(spark, str(tmp_path / "j"), "*.json").collect()
    assert found[0]["name"] == "x.json" and len(found[0].sha256) == 64
    files.write_csv(df, str(tmp_path / "c"))
    files.write_markdown(df, str(tmp_path / "m"), "k", "k")
    assert spark.read.text(str(tmp_path / "m")).count() >= 2


def test_stream_drops_repeats(spark, tmp_path):
    schema = "block_id string, extraction_method string, text string, at timestamp"
    source = str(tmp_path / "in")
    rows = [("b1", "OCR", "x", "2021-01-01 00:00:00"), ("b1", "OCR", "x", "2021-01-01 00:01:00"), ("b2", "NATIVE", None, "2021-01-01 00:02:00")]
    spark.createDataFrame(rows, "block_id string, extraction_method string, text string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = ingest.deduplicated(stream, ["block_id"], "at", "1 hour").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("kept").count() == 2
    query = ingest.upsert_sink(stream, str(tmp_path / "out"), "block_id", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
