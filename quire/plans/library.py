"""Queries of the corpus library: registry, stages, filters, lookups, graph tables and checks of a benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, graph, ingest, retrieval, structure
from ..operators.answering import coverage
from ..sources.files import as_json
from ..sources.tables import table
from .catalog import _blocks, _chunk_rows, _chunks, _documents, _edges, _evidence, _labels, _pages, _packs, _per_query, _questions, query

# registry and stages: the registry of these queries curates each section by path and the files under review by checksum


def _entries(s, d):
    docs = table(s, d, "source_documents")
    by_sha = docs.where("index_status = 'REVIEW' and source_sha256 is not null").select(
        F.col("document_id").alias("entry_no"), F.col("source_sha256").alias("sha256"), F.lit(None).cast("string").alias("path"),
        F.lit("EXCLUDE").alias("index_status"), F.lit(None).cast("string").alias("title"), F.lit("curator").alias("author"),
    )
    by_path = docs.where("section is not null").select(
        F.concat(F.lit("~"), "section").alias("entry_no"), F.lit(None).cast("string").alias("sha256"), F.concat("section", F.lit("\\The_")).alias("path"),
        F.lit("INCLUDE").alias("index_status"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"),
    )
    return by_sha.unionByName(by_path).distinct()


@query
def read_registry(s, d):
    return ingest.registry_keys(_entries(s, d))


@query
def registry_lookup(s, d):
    return ingest.registry_lookup(table(s, d, "source_documents"), _entries(s, d))


@query
def registry_apply(s, d):
    docs = _documents(s, d).select("document_id", "index_status", "title", "author")
    return ingest.registry_apply(docs, ingest.registry_lookup(table(s, d, "source_documents"), _entries(s, d)), _entries(s, d))


def _state(s, d):
    """The state of an earlier build: the documents with chunks; those without an author had other sources, PRIMARY ones another configuration."""
    docs = _documents(s, d)
    n = _chunks(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    sha = F.when(F.col("author").isNotNull(), F.col("source_sha256")).otherwise("before")
    return docs.join(n, "document_id").select(
        "document_id", sha.alias("sha256"), F.when(F.col("source_type") == "PRIMARY", "v1").otherwise("v2").alias("config_version"),
        F.when(F.col("page_count") > 2, "old").otherwise("hash-64").alias("model_name"), "chunk_count",
    )


def _stages(s, d):
    files = table(s, d, "source_documents").select("document_id", F.col("source_sha256").alias("sha256"), F.when(F.col("source_path").isNull(), "no path").alias("error"))
    return ingest.stage_of_files(files, table(s, d, "blocks").select("document_id"), _chunks(s, d).select("document_id"), _state(s, d))


@query
def status_join(s, d):
    return _stages(s, d)


def _reasons(s, d):
    now = _documents(s, d).select("document_id", F.col("source_sha256").alias("sha256"), F.lit("v2").alias("config_version"), F.lit("hash-64").alias("model_name"))
    return ingest.reindex_reasons(now, _state(s, d).drop("chunk_count"))


@query
def reindex_reasons(s, d):
    return _reasons(s, d)


@query
def ingest_batch(s, d):
    return ingest.ingest_ledger(_stages(s, d), _reasons(s, d))


@query
def batch_totals(s, d):
    docs = ingest.totals(_documents(s, d), {"n_pages": F.col("page_count"), "n_documents": F.lit(1)})
    blocks = ingest.totals(_blocks(s, d), {"n_blocks": F.lit(1)})
    chunks = ingest.totals(_chunks(s, d), {"n_chunks": F.lit(1)})
    same = ingest.totals(_reasons(s, d), {"n_unchanged": (F.col("reason") == "unchanged").cast("int")})
    return docs.crossJoin(blocks).crossJoin(chunks).crossJoin(same)  # one row each


@query
def discovery_hash(s, d):
    return ingest.set_hash(table(s, d, "source_documents").select("source_path", "source_sha256", "page_count").distinct(), ["source_path", "source_sha256", "page_count"])


@query
def dataset_fingerprint(s, d):
    return ingest.set_hash(_questions(s, d), ["query_id", "query", "reference_answer"])


@query
def graph_staleness(s, d):
    """Builds of the graph whose edges name evidence that is gone or of other chunks than the present ones."""
    listed = _edges(s, d).select("build_id", "edge_id", F.explode("evidence_ids").alias("evidence_id"))
    live = _evidence(s, d).join(_chunks(s, d).select("chunk_id"), "chunk_id", "left_semi").select("evidence_id", F.lit(True).alias("live"))
    by = listed.join(live, "evidence_id", "left").groupBy("build_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.count_if(F.col("live").isNull()).alias("n_stale"))
    return by.withColumn("stale", F.col("n_stale") > 0)


@query
def source_type_from_path(s, d):
    return _documents(s, d).select("document_id", ingest.source_type(F.col("source_path")).alias("type"))


@query
def embedded_metadata(s, d):
    return _documents(s, d).select("document_id", ingest.filled(F.col("title")).alias("title"), ingest.filled(F.col("author")).alias("author"))


@query
def list_document_ids(s, d):
    return _chunks(s, d).select("document_id").distinct()


@query
def discovered_summary(s, d):
    docs = _documents(s, d)
    stem = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return docs.join(_stages(s, d), "document_id").select("document_id", F.coalesce(ingest.filled(F.col("title")), stem).alias("title"), "page_count", "n_chunks", "stage")


# filters and lookups


@query
def filtered_search(s, d):
    wanted = ingest.SearchFilter.of({"source_type": "primary"})
    allowed = _chunks(s, d).join(wanted.documents(_documents(s, d)), "document_id", "left_semi").select(F.col("chunk_id").alias("id"))
    return retrieval.bm25_topk(_questions(s, d), _chunk_rows(s, d), 5, among=allowed)


@query
def filter_blocks_page(s, d):
    return _blocks(s, d).where(F.col("page_number") == 1).select("document_id", "block_id", "block_type", "reading_order")


@query
def structure_filter(s, d):
    shown = ~F.coalesce(F.col("block_type").isin(*structure.FURNITURE), F.lit(False))
    hit = F.contains(F.lower("text"), F.lit("garden")) | F.contains(F.lower("block_type"), F.lit("garden"))
    return _blocks(s, d).where(shown & hit).select("document_id", "block_id", "block_type")


@query
def filter_sections_paths(s, d):
    return _documents(s, d).where(F.col("section").isin("reading-room", "clinic-files") & (F.col("index_status") == "INCLUDE")).select("document_id", "source_path")


@query
def filter_graph_nodes(s, d):
    return graph.filter_nodes(table(s, d, "vocabulary"), "concept", "er")


@query
def selected_blocks(s, d):
    used = _chunks(s, d).where(F.col("chunk_index") == 0).select("document_id", F.explode("source_block_ids").alias("block_id")).distinct()
    return _blocks(s, d).join(used, ["document_id", "block_id"], "left_semi").select("document_id", "page_number", "block_id")


@query
def section_items(s, d):
    return structure.sections(_blocks(s, d)).groupBy("document_id", "section_no").agg(F.count(F.lit(1)).alias("n_items"), F.min("page_number").alias("first_page"))


@query
def serialise_pages(s, d):
    pages = table(s, d, "page_inspections").select("document_id", "page_number", "classification", "layout", "ocr_confidence", "warnings").distinct()
    return as_json(pages.withColumn("key", F.concat_ws(":", "document_id", "page_number")), "key")


# graph


@query
def graph_nodes(s, d):
    documents = _edges(s, d).select("source_node_id", "target_node_id", F.explode("evidence_ids").alias("evidence_id")).join(_evidence(s, d).select("evidence_id", "document_id"), "evidence_id")
    out = graph.nodes(_edges(s, d), table(s, d, "vocabulary"), documents)
    return out.select("node_id", "name", "node_type", F.array_join("aliases", "|").alias("aliases"), "n_edges", "evidence_count", "n_documents")


@query
def graph_totals(s, d):
    e = _edges(s, d)
    sums = e.agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("status") == "TRUSTED").alias("n_trusted"), F.round(F.avg(F.when(F.col("status") == "TRUSTED", F.col("evidence_count"))), 1).alias("avg_trusted"),
        F.round(F.avg((F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0).cast("int")), 3).alias("backed_ratio"),
    )
    orphans = graph.nodes(e, table(s, d, "vocabulary")).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("n_edges") == 0).alias("n_orphans"))
    return sums.crossJoin(orphans)  # one row each


@query
def node_names(s, d):
    names = table(s, d, "vocabulary").select(graph.node_id(F.col("canonical")).alias("node_id"), "canonical").distinct()
    ends = lambda side: names.select(F.col("node_id").alias(f"{side}_node_id"), F.col("canonical").alias(f"{side}_name"))
    return _edges(s, d).join(ends("source"), "source_node_id", "left").join(ends("target"), "target_node_id", "left").select("edge_id", "source_name", "target_name")


@query
def evidence_detail(s, d):
    return _evidence(s, d).select("evidence_id", "document_id", "chunk_id", "relation_source", F.length("evidence_text").alias("n_chars"))


@query
def edge_sort(s, d):
    pairs = _edges(s, d).groupBy("source_node_id", "target_node_id").agg(F.max("confidence").alias("confidence"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence_count"))
    return graph.top_per_node(pairs, 12)


@query
def build_evidence(s, d):
    found = graph.relations(table(s, d, "chunks"), table(s, d, "vocabulary"))
    return graph.evidence_rows(found, table(s, d, "chunks")).select("evidence_id", "a", "b", "chunk_id", "document_id", "relation_source")


@query
def build_graph(s, d):
    found = graph.relations(table(s, d, "chunks"), table(s, d, "vocabulary"))
    evidence = graph.evidence_rows(found, table(s, d, "chunks"))
    edges = graph.edges(found)
    ends = evidence.select(graph.node_id(F.col("a")).alias("source_node_id"), graph.node_id(F.col("b")).alias("target_node_id"), "document_id")
    return graph.nodes(edges, table(s, d, "vocabulary"), ends).select("node_id", "name", "node_type", "n_edges", "evidence_count", "n_documents")


@query
def edge_hashes(s, d):
    found = graph.relations(table(s, d, "chunks"), table(s, d, "vocabulary"))
    return graph.edge_hashes(graph.evidence_rows(found, table(s, d, "chunks"))).select("a", "b", "edge_hash", F.size("evidence_ids").alias("n_evidence"))


@query
def shown_neighbourhood(s, d):
    return graph.capped_neighbourhood(_edges(s, d))


# evaluation


@query
def failure_counts(s, d):
    return evaluation.failure_counts(evaluation.failures(_per_query(s, d)))


@query
def evidence_summary(s, d):
    cover = coverage(_packs(s, d), _labels(s, d))
    numbers = [c for c, t in cover.dtypes if t in ("double", "float")]
    return cover.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in numbers])


@query
def dataset_integrity(s, d):
    """Evidence rows serve as labels: each names a chunk, a document and pages."""
    labels = table(s, d, "graph_evidence").select(F.col("evidence_id").alias("label_id"), "document_id", "chunk_id", "page_numbers")
    return evaluation.label_violations(table(s, d, "bench_items"), labels, table(s, d, "chunks"), table(s, d, "source_documents"))


@query
def page_metrics(s, d):
    """Metrics by page: pages ranked by first appearance, against the pages of the relevant chunks."""
    tokens = retrieval.tokenised(_chunk_rows(s, d))
    chunks = _chunks(s, d).select(F.col("chunk_id").alias("id"), "document_id", "page_numbers")
    ranked = retrieval.bm25_topk(_questions(s, d), None, 10, tokens).select(F.lit("bm25").alias("mode"), "query_id", "rank", "id")
    pages = evaluation.pages_in_order(ranked, chunks)
    labels = _labels(s, d, tokens).select("query_id", F.col("key").alias("id")).join(chunks, "id").select("query_id", "document_id", F.explode("page_numbers").alias("page"))
    labels = labels.select("query_id", F.concat_ws(":", "document_id", "page").alias("key"))
    return evaluation.metrics(pages, labels, _questions(s, d).select("query_id"), modes=("bm25",))


@query
def run_summary(s, d):
    rows = _per_query(s, d)
    return evaluation.run_summary(evaluation.by_mode(rows), evaluation.failures(rows), "batch")


# chunks against their blocks


@query
def derivation_check(s, d):
    return structure.derivation(table(s, d, "chunks"), table(s, d, "blocks")).select("chunk_id", "contiguous")


@query
def ordered_derivation(s, d):
    return structure.derivation(table(s, d, "chunks"), table(s, d, "blocks")).select("chunk_id", "ordered")


@query
def page_sizes(s, d):
    return _pages(s, d)
