"""Batch retrieval: BM25 and dense top-k, reciprocal rank fusion and reranking for many queries in one plan.

Queries are rows (query_id, query); every operator works on all of them at once and none loops on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import overlap_coefficient
from ..functions.text import lex_tokens
from ..plans.bounded import bounded_rows
from ..plans.lineage import spread, write_table

#: Fixed constants of Okapi scoring.
K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, dl); repeated rows of an id must be gone already."""
    return chunks.select(F.col(id_col).alias("id"), lex_tokens(F.col(text_col)).alias("tokens")).withColumn("dl", F.size("tokens"))


def term_statistics(tokenised: DataFrame) -> DataFrame:
    """(term, df, idf): Okapi idf; terms in more than half of the records get EPSILON times the mean idf."""
    df = tokenised.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = tokenised.agg(F.count(F.lit(1)).alias("n"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))  # one row


def postings(tokenised: DataFrame) -> DataFrame:
    """(term, id, tf, dl)."""
    return tokenised.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def top_k(scores: DataFrame, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The k best rows of each query with rank; scores are rounded first, ties go to the smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return scores.withColumn(score, F.round(score, digits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tokenised(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """lengths(chunks), written once; statistics and all queries read it from there.

    Repeated rows of an id count once; they are dropped after the one shuffle that spreads the texts.
    """
    rows = spread(chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id").dropDuplicates(["id"])
    return write_table(lengths(rows, "id"), "tokens")


class _Best:
    """The k best (query, id) of each query that a task has met so far; ties go to the smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size, self.kept = k, [], 0, 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, score))
            self.size += len(query)
            if self.size > 2 * self.kept + 100_000:
                self.prune()

    def prune(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = rank < self.k
        self.parts = [(query[keep], ids[keep], score[keep])]
        self.size = self.kept = int(keep.sum())

    def batch(self, names: list, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        if self.parts:
            self.prune()
        query, ids, score = self.parts[0] if self.parts else (np.empty(0, int), np.empty(0, object), np.empty(0))
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in query.tolist()], types[0]), pa.array(ids.tolist(), types[1]), pa.array(score)], ["query_id", "id", "score"]
        )


def _asked_idf(tokens: DataFrame, terms: list[str]) -> tuple[dict[str, float], float]:
    """The idf of those terms that some record holds, and the mean length of the records; as term_statistics, in one pass over all terms."""
    size = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    raw = F.log(F.lit(size.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    counted = tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = tokens.sparkSession.createDataFrame([(t, True) for t in terms], "term string, asked boolean")
    found = counted.join(asked, "term", "left").select("term", raw.alias("raw"), "asked")
    # one row: the asked terms' values, whose number is checked, and the mean of all
    one = found.agg(F.avg("raw").alias("mean"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("x")).first()
    return {r.term: EPSILON * one.mean if r.raw < 0 else r.raw for r in one.x}, size.avgdl or 1.0


def bm25_topk(queries: DataFrame, chunks: DataFrame | None, k: int, tokens: DataFrame | None = None, among: DataFrame | None = None, max_terms: int = 5_000_000, block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank) with positive scores only; blank queries have no hits.

    The terms of the queries, at most max_terms over all, are held by every task as an inverted index of the
    queries. Each record is scored where it is read, against all queries in blocks, and only a task's k best
    a query are shuffled: no posting of the corpus is. Document frequencies are counted over all records
    with partial sums. tokens, if given, are those of the chunks, as written by `tokenised`. among (id) narrows
    the hits, not the statistics.
    """
    tokens = tokenised(chunks) if tokens is None else tokens
    asked = queries.select("query_id", F.explode(lex_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    rows = bounded_rows(asked, max_terms, "the terms of the query set")
    names, terms = sorted({r.query_id for r in rows}), sorted({r.term for r in rows})
    idf, average = _asked_idf(tokens, terms)
    number, at = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(terms)}
    rows = sorted((at[r.term], number[r.query_id], r.qtf * idf[r.term]) for r in rows if r.term in idf)
    term_of, query_of, weight = (np.array(x) for x in zip(*rows)) if rows else (np.empty(0, int),) * 3
    kinds = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(tokens.dtypes)["id"]}
    shared = tokens.sparkSession.sparkContext.broadcast((names, terms, term_of, query_of, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, term_of, query_of, weight = shared.value
        known = pa.array(terms, pa.string())
        parts = []  # the queries' terms by block of queries
        for begin in range(0, len(names), block):
            own = (query_of >= begin) & (query_of < begin + block)
            parts.append((begin, np.searchsorted(term_of[own], np.arange(len(terms) + 1)), query_of[own] - begin, weight[own]))
        best, id_type = _Best(k), pa.string()
        for batch in batches:
            id_type = batch.schema.field(0).type
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
            term = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(offsets)
            row = np.repeat(np.arange(len(size)), size)
            hit = term >= 0
            code, tf = np.unique(row[hit] * max(len(terms), 1) + term[hit], return_counts=True)
            row, term = np.divmod(code, max(len(terms), 1))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / average))
            ids = np.array(batch.column(0).to_pylist())
            for begin, first, query, w in parts:
                times = first[term + 1] - first[term]
                start = np.repeat(first[term] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                pair = query[start] * len(size) + np.repeat(row, times)
                pairs, inverse = np.unique(pair, return_inverse=True)
                score = np.round(np.bincount(inverse, w[start] * np.repeat(part, times), len(pairs)), 6)
                good = score > 0
                q, r = np.divmod(pairs[good], len(size))
                best.add(q + begin, ids[r], score[good])
        yield best.batch(names, (pa.array(names).type if names else pa.string(), id_type))

    scored = tokens.where(F.col("id").isNotNull()) if among is None else tokens.join(among.select("id"), "id", "left_semi")
    found = scored.select("id", "tokens").mapInArrow(search, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_k(found, k)


def dense_topk(queries: DataFrame, items: DataFrame, k: int, max_queries: int = 100_000, block: int = 1024) -> DataFrame:
    """Exact cosine top-k of each query (query_id, embedding) over all items (id, embedding).

    The queries, at most max_queries, are sent to every task once and scored in blocks, a batch of items as
    one matrix product; a task keeps its k best a query over all its batches, and only these leave it. Items
    of another dimension raise; null and zero vectors are never hits. Ties go to the smaller id.
    """
    rows = sorted(bounded_rows(queries.where(F.col("embedding").isNotNull()), max_queries, "the query set"), key=lambda r: str(r.query_id))
    names = [r.query_id for r in rows]
    matrix = np.array([r.embedding for r in rows], float) if rows else np.empty((0, 0))
    norm = np.linalg.norm(matrix, axis=1, keepdims=True) if rows else matrix
    unit = np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)
    ids = {"query_id": dict(queries.dtypes)["query_id"], "id": dict(items.dtypes)["id"]}
    usable = items.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).where((F.size("embedding") > 0) & F.col("id").isNotNull())
    shared = items.sparkSession.sparkContext.broadcast((names, unit))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = shared.value
        best, id_type = _Best(k), pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            if not names or not batch.num_rows:
                continue
            vectors = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            size = np.linalg.norm(vectors, axis=1)
            keep = np.flatnonzero(size > 0)
            if not len(keep):
                continue
            own = np.array(batch.column(0).to_pylist())[keep]
            order = np.argsort(own, kind="stable")
            own, vectors = own[order], vectors[keep[order]] / size[keep[order]][:, None]
            for first in range(0, len(names), block):
                scores = np.round(unit[first : first + block] @ vectors.T, 6)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(top)), top.shape[1])
                best.add(q + first, own[top.ravel()], scores[q, top.ravel()])
        yield best.batch(names, (pa.array(names).type if names else pa.string(), id_type))

    found = usable.mapInArrow(search, f"query_id {ids['query_id']}, id {ids['id']}, score double")
    return top_k(found, k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two legs (query_id, id, score, rank), one row a record, null for an absent leg.

    The fused score is rounded to 6 digits before ordering; ties go to the smaller id.
    """
    if rrf_k < 1:
        raise ValueError("rrf_k must be at least 1")
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = lexical.select("query_id", "id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    part = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    both = d.join(b, ["query_id", "id"], "full_outer").withColumn("fusion_score", part("dense_rank") + part("bm25_rank"))
    return top_k(both, k, "fusion_score").withColumnRenamed("rank", "fusion_rank")


def keyword_scores(query: Column, text: Column) -> Column:
    """Number of distinct lexical tokens that query and text share."""
    return F.size(F.array_intersect(F.array_distinct(lex_tokens(query)), F.array_distinct(lex_tokens(text)))).cast("double")


def rerank(candidates: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Order candidates (query_id, id, query, text, ...) by a scorer; unrounded scores rank, ties go to the smaller id."""
    raw = score if score is not None else keyword_scores(F.col("query"), F.col("text"))
    best = Window.partitionBy("query_id").orderBy(F.desc("raw"), "id")
    return (
        candidates.withColumn("raw", raw)
        .withColumn("reranker_rank", F.row_number().over(best)).where(F.col("reranker_rank") <= k)
        .withColumn("reranker_score", F.round("raw", 6)).drop("raw")
    )


def safe_pairs(pairs: DataFrame, query_tokens: Column, text_tokens: Column, max_length: int) -> DataFrame:
    """Token budgets of (query, text) pairs for a model of max_length tokens: how many of each are kept.

    Three tokens are the model's own; at least min(32, half) are kept for the text.
    """
    if max_length < 8:
        raise ValueError("max_length must be at least 8")
    usable = max_length - 3
    floor = min(32, usable // 2)
    kept = F.least(query_tokens, F.lit(usable - floor))
    room = F.greatest(F.lit(floor), F.lit(usable) - kept)
    return pairs.withColumn("query_kept", kept).withColumn("text_kept", F.least(text_tokens, room))


def near_in_pool(a: Column, b: Column, a_blocks: Column, b_blocks: Column) -> Column:
    """Whether two retrieved passages repeat each other: by half of their blocks or four fifths of their tokens."""
    return (overlap_coefficient(a_blocks, b_blocks) >= 0.5) | (overlap_coefficient(a, b) >= 0.8)
