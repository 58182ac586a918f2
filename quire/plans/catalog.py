"""Queries of the core operators over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import answering, chunking, corpus, evaluation, evidence, graph, retrieval, structure
from ..sources.tables import table
from .lineage import spread, write_table
from .ordered import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """One row a chunk_id; repeated rows agree in these columns."""
    return table(s, d, "chunks").select("chunk_id", "document_id", "text", "source_block_ids", "page_numbers", "heading_path", "token_count", "section_id", "chunk_index", "start_page", "end_page").dropDuplicates(["chunk_id"])


def _chunk_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", "text").dropDuplicates(["chunk_id"])


def _chunk_rows(s: SparkSession, d: str) -> DataFrame:
    """Ids and texts as stored, for operators that drop repeated rows themselves."""
    return table(s, d, "chunks").select("chunk_id", "text")


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "blocks").drop("extracted_at", "ingested_at", "heuristic_quality_score").dropDuplicates(["document_id", "block_id"])


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Size of each page; repeated rows of a page count once."""
    return table(s, d, "page_inspections").groupBy("document_id", "page_number").agg(F.max("width").alias("width"), F.max("height").alias("height"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_documents").dropDuplicates(["document_id"])


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "graph_evidence").dropDuplicates(["evidence_id"])


def _edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "graph_edges").dropDuplicates(["edge_id"])


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bench_items").select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), "reference_answer").dropDuplicates(["query_id"])


# texts and scalars


@query
def lex_tokens(s, d):
    return _chunk_text(s, d).select("chunk_id", F.array_join(text.lex_tokens(F.col("text")), " ").alias("tokens"))


@query
def count_tokens(s, d):
    return _chunk_text(s, d).select("chunk_id", text.count_tokens(F.col("text")).alias("n_tokens"))


@query
def truncate_tokens(s, d):
    kept = F.slice(text.tokens(F.col("text")), 1, 40)
    joined = F.array_join(F.transform(kept, lambda t: F.when(t.rlike(r"^[\p{L}\p{N}_]"), F.concat(t, F.lit(" "))).otherwise(t)), "")
    return _chunk_text(s, d).select("chunk_id", F.trim(joined).alias("cut"))


@query
def preview(s, d):
    return _chunk_text(s, d).select("chunk_id", text.preview(F.col("text")).alias("preview"))


@query
def split_sentences_graph(s, d):
    return graph.sentences(_chunk_text(s, d), "chunk_id", "text").groupBy(F.col("id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query
def split_sentences_chunk(s, d):
    return _chunk_text(s, d).select("chunk_id", F.size(F.split("text", r"(?<=[.!?:;”’])\s+")).alias("n_sentences"))


@query
def norm_tokens(s, d):
    parts = F.transform(F.split(F.lower(F.trim(F.regexp_replace("text", text.SPACE, " "))), " "), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return _chunk_text(s, d).select("chunk_id", F.array_join(F.filter(parts, lambda w: w != ""), " ").alias("tokens"))


@query
def is_folio(s, d):
    lines = _blocks(s, d).where(F.length("text") > 0).select("document_id", "block_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(evidence.is_folio(F.col("line"))).select("document_id", "block_id", "pos", F.trim("line").alias("line"))


@query
def strip_edge_numbers(s, d):
    heads = _blocks(s, d).where(F.col("block_type").isin("HEADER", "FOOTER") & (F.length("text") > 0))
    return heads.select("document_id", "block_id", evidence.normal_line(evidence.without_edge_numbers(F.col("text"))).alias("bare"))


@query
def running_head(s, d):
    lines = _blocks(s, d).where(F.length("text") > 0).select("document_id", "block_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    titled = lines.join(_documents(s, d).select("document_id", "title"), "document_id")
    return titled.where(evidence.is_running_head(F.col("line"), F.col("title"), F.array().cast("array<string>"))).select("document_id", "block_id", "pos")


@query
def clean_evidence(s, d):
    rows = _chunks(s, d).join(_documents(s, d).select("document_id", "title"), "document_id", "left")
    c = evidence.cleaned(F.col("text"), F.col("title"), F.col("heading_path"))
    return rows.select("chunk_id", c.alias("c")).select("chunk_id", "c.removed", F.length("c.clean").alias("n_chars"))


@query
def pages_display(s, d):
    return _chunks(s, d).select("chunk_id", evidence.pages_display(F.col("page_numbers")).alias("pages"))


@query
def page_region(s, d):
    return _chunks(s, d).select("chunk_id", F.floor(F.array_min("page_numbers") / 8).alias("region"))


@query
def bbox_geometry(s, d):
    w, h = F.col("bbox.x1") - F.col("bbox.x0"), F.col("bbox.y1") - F.col("bbox.y0")
    return _blocks(s, d).select("document_id", "block_id", F.round(w, 4).alias("width"), F.round(h, 4).alias("height"), F.round(w * h, 4).alias("area"))


@query
def document_id_hash(s, d):
    return _documents(s, d).select("document_id", scoring.document_key(F.col("source_path")).alias("path_key"), F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"))


@query
def concept_norm(s, d):
    return table(s, d, "vocabulary").select("alias", graph.concept_form(F.col("alias")).alias("form"), graph.node_id(F.col("canonical")).alias("node_id")).distinct()


@query
def citations(s, d):
    answers = _questions(s, d).select("query_id", F.concat_ws(" ", F.lit("See [S1] and [s3], then [S1]"), "reference_answer", F.lit("[S12].")).alias("answer"))
    return answers.select("query_id", F.array_join(evidence.citations(F.col("answer")), ",").alias("cited"))


# vectors


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query
def l2_normalize(s, d):
    v = scoring.l2_normalize(F.col("embedding"))
    return _vectors(s, d).select("id", F.round(v[0], 6).alias("first"), F.round(scoring.dot(v, v), 6).alias("square"))


@query
def dense_topk(s, d):
    asked = _vectors(s, d).where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "embedding")
    return retrieval.dense_topk(asked, _vectors(s, d).select("id", "embedding"), 10)


@query
def hash_embed(s, d):
    return scoring.hash_features(_questions(s, d), "query_id", "query").select("id", "dim", F.round("weight", 6).alias("weight"))


# retrieval over all questions at once


def _bm25_leg(s, d, k=30, tokens=None):
    return retrieval.bm25_topk(_questions(s, d), _chunk_rows(s, d), k, tokens)


def _dense_leg(s, d, k=30):
    asked = scoring.dense_vectors(scoring.hash_features(_questions(s, d), "query_id", "query")).withColumnRenamed("id", "query_id")
    items = scoring.dense_vectors(scoring.hash_features(spread(_chunk_text(s, d), "chunk_id"), "chunk_id", "text"))
    return retrieval.dense_topk(asked, items, k)


def _legs(s, d, tokens=None):
    return write_table(_dense_leg(s, d), "dense"), write_table(_bm25_leg(s, d, tokens=tokens), "bm25")


@query
def bm25_stats(s, d):
    stats = retrieval.term_statistics(retrieval.lengths(_chunk_text(s, d)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(s, d):
    return _bm25_leg(s, d, 10)


@query
def retrieve_dense(s, d):
    return _dense_leg(s, d, 10)


@query
def retrieve_hybrid(s, d):
    return retrieval.fuse(*_legs(s, d), 20)


def _reranked(s, d, pool=None, k=10):
    pool = retrieval.fuse(*_legs(s, d), 20) if pool is None else pool
    full = pool.join(_questions(s, d).select("query_id", "query"), "query_id").join(_chunks(s, d).withColumnRenamed("chunk_id", "id"), "id")
    return retrieval.rerank(full, k)


@query
def retrieve_rerank(s, d):
    return _reranked(s, d).select("query_id", "id", "fusion_rank", "reranker_rank", "reranker_score")


@query
def safe_pairs(s, d):
    pool = _bm25_leg(s, d, 5).join(_questions(s, d).select("query_id", "query"), "query_id").join(_chunk_text(s, d).withColumnRenamed("chunk_id", "id"), "id")
    cut = retrieval.safe_pairs(pool, text.count_tokens(F.col("query")), text.count_tokens(F.col("text")), 128)
    return cut.select("query_id", "id", "query_kept", "text_kept")


def _packs(s, d):
    """Packs choose from the whole fused pool, all of it reranked."""
    titled = _reranked(s, d, k=20).join(_documents(s, d).select("document_id", "title"), "document_id", "left")
    return evidence.evidence_packs(titled)


@query
def assemble_evidence(s, d):
    return _packs(s, d).select("query_id", "id", "place", "fate", "evidence_id", "n_tokens")


@query
def render_pack(s, d):
    sources = _chunks(s, d).join(_documents(s, d).select("document_id", "title"), "document_id", "left")
    return evidence.render_packs(_packs(s, d), sources.select(F.col("chunk_id").alias("id"), "title", evidence.pages_display(F.col("page_numbers")).alias("pages")))


# evaluation: the relevant chunks of a question are the three that its reference answer finds


def _labels(s, d, tokens=None):
    answers = _questions(s, d).where(F.col("reference_answer").isNotNull()).select("query_id", F.col("reference_answer").alias("query"))
    return retrieval.bm25_topk(answers, _chunk_rows(s, d), 3, tokens).select("query_id", F.col("id").alias("key"))


MODES = ("bm25", "dense", "hybrid", "hybrid_rerank")


def _runs(s, d, tokens=None):
    """Ranks of all modes; tokens, legs and the fused pool are made once."""
    dense, lexical = _legs(s, d, tokens)
    hybrid = write_table(retrieval.fuse(dense, lexical, 20), "fused")
    reranked = _reranked(s, d, hybrid)
    row = lambda df, mode, rank: df.select(F.lit(mode).alias("mode"), "query_id", F.col("id").alias("key"), F.col(rank).alias("rank"))
    return row(dense, "dense", "rank").unionByName(row(lexical, "bm25", "rank")).unionByName(row(hybrid, "hybrid", "fusion_rank")).unionByName(row(reranked, "hybrid_rerank", "reranker_rank"))


def _per_query(s, d):
    tokens = retrieval.tokenised(_chunk_rows(s, d))
    runs = _runs(s, d, tokens)
    return write_table(evaluation.metrics(runs, _labels(s, d, tokens), _questions(s, d).select("query_id"), modes=MODES), "metrics")


@query
def level_metrics(s, d):
    return _per_query(s, d)


@query
def mode_aggregate(s, d):
    return evaluation.by_mode(_per_query(s, d))


@query
def comparison_table(s, d):
    return evaluation.comparison_table(evaluation.by_mode(_per_query(s, d)))


@query
def run_deltas(s, d):
    return evaluation.run_deltas(evaluation.by_mode(_per_query(s, d)), "hybrid", "hybrid_rerank")


@query
def failure_categories(s, d):
    return evaluation.first_per_category(evaluation.failures(_per_query(s, d)))


@query
def page_first_seen(s, d):
    ranked = _bm25_leg(s, d, 10).select(F.lit("bm25").alias("mode"), "query_id", "rank", "id")
    return evaluation.pages_in_order(ranked, _chunks(s, d).select(F.col("chunk_id").alias("id"), "document_id", "page_numbers"))


# pages, blocks and sections


@query
def page_signals(s, d):
    return structure.page_signals(_blocks(s, d))


@query
def classify_page(s, d):
    # a page's pictures are its FIGURE blocks
    kind = structure.page_class(F.col("text_length"), F.col("n_blocks"), F.coalesce("n_images", F.lit(0)), F.coalesce("ratio", F.lit(0.0)))
    pictures = structure.page_pictures(_blocks(s, d), _pages(s, d))
    return structure.page_signals(_blocks(s, d)).join(pictures, ["document_id", "page_number"], "left").select("document_id", "page_number", kind.alias("class"))


@query
def weighted_median(s, d):
    return structure.median_body_size(_blocks(s, d)).select("document_id", F.round("body_size", 4).alias("body_size"))


def _typed(s, d):
    b = _blocks(s, d).where(F.col("text").isNotNull()).join(structure.median_body_size(_blocks(s, d)), "document_id", "left")
    sized = b.join(_pages(s, d), ["document_id", "page_number"], "left").withColumn("height", F.coalesce("height", F.lit(842.0)))
    args = (F.col("text"), F.col("font_size"), F.col("body_size"), F.col("bbox.y0"), F.col("bbox.y1"), F.col("height"))
    return sized.withColumn("kind", structure.block_kind(*args)).withColumn("score", structure.quality_score(F.col("kind"), *args))


@query
def classify_block(s, d):
    return _typed(s, d).select("document_id", "block_id", "kind")


@query
def quality_score(s, d):
    return _typed(s, d).select("document_id", "block_id", "score")


@query
def upper_median_size(s, d):
    return structure.upper_median_size(_blocks(s, d))


@query
def line_rects(s, d):
    return structure.line_rects(_blocks(s, d))


@query
def reading_order(s, d):
    pages = table(s, d, "page_inspections").groupBy("document_id", "page_number").agg(F.max("layout").alias("layout"), F.max("width").alias("width"))
    return structure.reading_order(_blocks(s, d).join(pages, ["document_id", "page_number"])).select("document_id", "page_number", "block_id", "place")


@query
def section_fill(s, d):
    return structure.sections(_blocks(s, d)).select("document_id", "block_id", "section_no", "heading", F.array_join("heading_path", " / ").alias("path"))


@query
def page_groups(s, d):
    return structure.page_runs(_blocks(s, d).select("document_id", "block_id", "page_number", (F.col("page_number") * 1000 + F.col("reading_order")).alias("reading_order")))


@query
def token_windows(s, d):
    return structure.token_windows(_chunk_text(s, d), "chunk_id", "text", 120, 20).withColumnRenamed("id", "chunk_id")


@query
def x_occupancy(s, d):
    return structure.occupancy(_blocks(s, d))


@query
def detect_gutter(s, d):
    return structure.gutters(structure.occupancy(_blocks(s, d)))


@query
def detect_layout(s, d):
    return structure.layouts(_blocks(s, d))


@query
def drop_furniture(s, d):
    kept = _blocks(s, d).where(~F.coalesce(F.col("block_type").isin(*structure.FURNITURE), F.lit(False)))
    return kept.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n_blocks"))


@query
def page_inspection(s, d):
    pages = table(s, d, "page_inspections").select("document_id", "page_number", "classification").groupBy("document_id", "page_number").agg(F.max("classification").alias("classification"))
    mean = _blocks(s, d).groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n_blocks"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))
    return pages.join(mean, ["document_id", "page_number"], "left").select("document_id", "page_number", "classification", F.coalesce("n_blocks", F.lit(0).cast("long")).alias("n_blocks"), "mean_confidence")


@query
def chunk_blocks(s, d):
    return chunking.chunk_blocks(_blocks(s, d)).select("chunk_id", "document_id", "chunk_index", "token_count", "start_page", "end_page", F.array_join("source_block_ids", ",").alias("block_ids"))


@query
def validate_chunks(s, d):
    return structure.chunk_violations(table(s, d, "chunks"), table(s, d, "blocks"), table(s, d, "source_documents"))


@query
def chunk_block_join(s, d):
    used = _chunks(s, d).select("chunk_id", "document_id", F.posexplode("source_block_ids").alias("pos", "block_id"))
    return used.join(_blocks(s, d), ["document_id", "block_id"]).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"), F.min("page_number").alias("first_page"))


@query
def source_loss_anti(s, d):
    used = _chunks(s, d).select("document_id", F.explode("source_block_ids").alias("block_id")).distinct()
    content = _blocks(s, d).where(F.length(F.trim("text")) > 0)
    return content.join(used, ["document_id", "block_id"], "left_anti").groupBy("block_type").agg(F.count(F.lit(1)).alias("n_lost"))


@query
def order_check(s, d):
    rows = running(_chunks(s, d).select("document_id", "chunk_index", "chunk_id", "start_page"), ["document_id"], ["chunk_index", "chunk_id"], {"prior": ("lag", F.col("start_page"))})
    return rows.where(F.col("start_page") < F.col("prior")).select("chunk_id", "start_page", "prior")


# corpus


@query
def corpus_report(s, d):
    return corpus.corpus_report(table(s, d, "source_documents"))


@query
def diagnostics(s, d):
    return corpus.block_diagnostics(_blocks(s, d))


@query
def chunk_stats(s, d):
    return corpus.chunk_statistics(_chunks(s, d))


@query
def corpus_fingerprint(s, d):
    return corpus.fingerprints(_chunks(s, d), "document_id", "chunk_id", "text")


@query
def needs_reindex(s, d):
    now = corpus.fingerprints(_chunks(s, d), "document_id", "chunk_id", "text")
    stored = _chunks(s, d).where(F.col("chunk_index") > 0)
    return corpus.change_plan(corpus.fingerprints(stored, "document_id", "chunk_id", "text"), now, "document_id")


@query
def duplicate_ids(s, d):
    rows = table(s, d, "graph_evidence").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))
    rows = rows.unionByName(table(s, d, "graph_edges").select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))
    return corpus.duplicate_keys(rows.unionByName(table(s, d, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))), ["kind", "id"])


@query
def author_title_filter(s, d):
    named = F.lower(F.trim("author")).isin("k. nugilumar", "t. notemolund") | F.lower(F.trim("title")).like("the %")
    return _documents(s, d).where(named & F.col("source_type").isin("PRIMARY", "SECONDARY")).select("document_id", "title", "author")


@query
def filter_chunks(s, d):
    hit = F.array_contains("page_numbers", 2) & F.contains(F.lower(F.array_join("heading_path", " ")), F.lit("and the"))
    return _chunks(s, d).where(hit).select("chunk_id", "start_page", "end_page")


@query
def doc_summary(s, d):
    n = _chunks(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    docs = _documents(s, d).join(n, "document_id", "left")
    return docs.select("document_id", F.coalesce("title", "document_id").alias("title"), F.coalesce("author", F.lit("unknown")).alias("author"), F.coalesce("n", F.lit(0).cast("long")).alias("n_chunks"))


# graph


@query
def find_mentions(s, d):
    spans = table(s, d, "graph_evidence").select("chunk_id", "evidence_text").distinct()
    return graph.mentions(spans, "evidence_text", table(s, d, "vocabulary")).select("chunk_id", F.sha2(F.coalesce("evidence_text", F.lit("")), 256).alias("span"), F.array_join("names", "|").alias("names"))


@query
def relation_type(s, d):
    spans = table(s, d, "graph_evidence").select("evidence_text").distinct()
    return spans.groupBy(F.coalesce(graph.relation_type(F.col("evidence_text")), F.lit("RELATED_TO")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query
def extract_relations(s, d):
    return graph.relations(table(s, d, "chunks"), table(s, d, "vocabulary")).select("chunk_id", "a", "b", "source", "relation")


@query
def build_edges(s, d):
    return graph.edges(graph.relations(table(s, d, "chunks"), table(s, d, "vocabulary")))


@query
def node_stats(s, d):
    return graph.both_ends(_edges(s, d)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("n_evidence"), F.count_distinct("other_id").alias("n_neighbours"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query
def graph_overview(s, d):
    return _edges(s, d).groupBy("status", "relationship_type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.size("evidence_ids") > 0).alias("n_backed"), F.round(F.avg("evidence_count"), 4).alias("avg_evidence"))


@query
def edge_evidence(s, d):
    listed = _edges(s, d).select("edge_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    return listed.join(_evidence(s, d).select("evidence_id", "document_id", "chunk_id"), "evidence_id").select("edge_id", "pos", "evidence_id", "document_id", "chunk_id")


@query
def neighbors(s, d):
    strong = graph.both_ends(_edges(s, d).where(F.col("confidence") >= 0.7))
    return strong.groupBy("node_id", "other_id").agg(F.count(F.lit(1)).alias("n_edges"), F.max("confidence").alias("confidence"))


@query
def node_detail(s, d):
    return graph.top_per_node(_edges(s, d).groupBy("source_node_id", "target_node_id").agg(F.max("confidence").alias("confidence"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence_count")), 5)


@query
def graph_search(s, d):
    return graph.search_nodes(table(s, d, "vocabulary"), "soul")


@query
def graph_neighborhood(s, d):
    return graph.neighbourhood(_edges(s, d).where("status = 'TRUSTED'"), "concept:exile", 2)


@query
def edge_filter(s, d):
    return _edges(s, d).where((F.col("status") == "TRUSTED") & (F.col("evidence_count") >= 2)).select("edge_id", "relationship_type", "confidence", F.round(0.5 + F.sqrt("evidence_count") / 2.2, 6).alias("size"))


@query
def validate_graph(s, d):
    return graph.graph_violations(table(s, d, "graph_edges"), table(s, d, "graph_evidence"), table(s, d, "vocabulary"), table(s, d, "chunks"))


@query
def pair_aggregate(s, d):
    spans = _evidence(s, d).groupBy("chunk_id", "evidence_text").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.col("relation_source") == "sentence").alias("in_sentence"), F.bool_or(F.size("heading_path") > 0).alias("under_heading"))
    return spans.groupBy("n_rows", "in_sentence", "under_heading").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("n_chunks"))


# answers


@query
def ask(s, d):
    packs = write_table(_packs(s, d), "packs")
    sources = _chunks(s, d).join(_documents(s, d).select("document_id", "title"), "document_id", "left")
    rendered = evidence.render_packs(packs, sources.select(F.col("chunk_id").alias("id"), "title", evidence.pages_display(F.col("page_numbers")).alias("pages")))
    answered = write_table(answering.answers(answering.prompts(_questions(s, d), rendered)), "answers")
    warned = answering.citation_warnings(answered, packs)
    cited = evidence.checked_citations(answered, packs).groupBy("query_id").agg(F.count_if(F.col("status") == "valid").alias("n_valid"))
    return answered.join(cited, "query_id", "left").join(warned, "query_id", "left").select("query_id", "answer", F.coalesce("n_valid", F.lit(0).cast("long")).alias("n_valid"), "warning")


@query
def evidence_cover(s, d):
    return answering.coverage(_packs(s, d), _labels(s, d))


# lookups, filters and sets


@query
def vector_get_by_ids(s, d):
    asked = s.createDataFrame([([40, 20, 100_000, 0],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "id"))
    return asked.join(_vectors(s, d), "id", "left").select("pos", "id", "label")


@query
def vector_count(s, d):
    return _vectors(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("dimension"))


@query
def upsert_vectors(s, d):
    stored = _vectors(s, d).select("id", "label")
    incoming = _vectors(s, d).where(F.col("id") >= 200).select("id", (F.col("label") + 100).alias("label"))
    return corpus.upsert(stored, incoming, "id")


@query
def stale_vector_anti(s, d):
    first = _chunks(s, d).where(F.col("chunk_index") == 0).select("chunk_id")
    return _evidence(s, d).select("chunk_id").distinct().join(first, "chunk_id", "left_anti")


@query
def json_or_default(s, d):
    parsed = F.from_json("props", "map<string,string>")
    return table(s, d, "events").select("event_id", F.coalesce(F.size(parsed), F.lit(0)).alias("n_props"))


@query
def distinct_types(s, d):
    nodes = table(s, d, "vocabulary").select(F.lit("node").alias("kind"), F.col("node_type").alias("type"))
    return nodes.unionByName(_edges(s, d).select(F.lit("edge").alias("kind"), F.col("relationship_type").alias("type"))).distinct()


@query
def library_sort(s, d):
    status = F.coalesce(F.array_position(F.array(F.lit("INCLUDE"), F.lit("REVIEW"), F.lit("EXCLUDE")), F.col("index_status")), F.lit(0))
    rows = _documents(s, d).select("section", "title", "document_id", F.when(status == 0, 9).otherwise(status).alias("status"))
    return running(rows, ["section"], ["status", "title", "document_id"], {"place": ("sum", F.lit(1))}).select("section", F.col("place").cast("int").alias("place"), "document_id")


@query
def library_union(s, d):
    known = _documents(s, d).select("document_id", F.lit("registered").alias("origin"))
    seen = _chunks(s, d).select("document_id", F.lit("chunks").alias("origin")).distinct()
    both = known.unionByName(seen.join(known, "document_id", "left_anti"))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query
def corpus_lane(s, d):
    first = F.lower(F.regexp_extract("source_path", r"^[^/\\]+[/\\]([^/\\]+)", 1))
    lane = F.when(F.col("source_type").isin("PRIMARY", "SECONDARY"), F.col("source_type")).otherwise(F.coalesce(F.when(first != "", first), F.lit("unknown")))
    return _documents(s, d).groupBy(lane.alias("lane")).agg(F.count(F.lit(1)).alias("n"))


@query
def latest_blocks(s, d):
    rows = table(s, d, "blocks").select("document_id", "block_id", "ingested_at", "page_number")
    return corpus.latest(rows, ["document_id", "block_id"], "ingested_at").groupBy("page_number").agg(F.count(F.lit(1)).alias("n"), F.max("ingested_at").cast("string").alias("last"))


@query
def bench_tags(s, d):
    return table(s, d, "bench_items").select("question_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_distinct("question_id").alias("n"))


@query
def enrich_author_title(s, d):
    hits = _bm25_leg(s, d, 3).join(_chunks(s, d).select(F.col("chunk_id").alias("id"), "document_id"), "id")
    return hits.join(_documents(s, d).select("document_id", "title", "author"), "document_id", "left").select("query_id", "rank", "id", "title", "author")
