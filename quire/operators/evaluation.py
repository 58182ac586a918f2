"""Retrieval metrics over rankings (mode, query_id, rank, key) and relevance labels (query_id, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.bounded import bounded_rows

#: Cut-offs that are reported.
KS = (1, 3, 5, 10)


def metrics(ranked: DataFrame, labels: DataFrame, questions: DataFrame, ks: tuple[int, ...] = KS, modes: tuple[str, ...] | None = None) -> DataFrame:
    """(mode, query_id, k, hit, recall, precision, ndcg, mrr, first_rank) for every mode, question and cut-off.

    Questions without labels score 0 everywhere; a question without results has 0 and a null first_rank.
    A key that is ranked twice counts twice in ndcg, once in recall. Values are rounded to 6 digits. All
    cut-offs are columns of one aggregation. modes are those of `ranked`, which is asked for them if None.
    """
    if min(ks) < 1:
        raise ValueError("cut-offs must be at least 1")
    if modes is None:
        modes = tuple(sorted(r.mode for r in bounded_rows(ranked.select("mode").distinct(), 1000, "the set of modes")))
    marked = ranked.join(labels.select("query_id", "key").distinct().withColumn("relevant", F.lit(True)), ["query_id", "key"], "left")
    total = labels.groupBy("query_id").agg(F.count_distinct("key").alias("n_relevant"))
    hit, gain = F.col("relevant").isNotNull(), 1 / F.log2(F.col("rank") + 1)
    by_key = marked.groupBy("mode", "query_id", "key").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks],
        *[F.sum(F.when(hit & (F.col("rank") <= k), gain)).alias(f"dcg{k}") for k in ks],
    )
    sums = by_key.groupBy("mode", "query_id").agg(
        F.min("first").alias("first_rank"),
        *[F.count_if(F.col("first") <= k).alias(f"found{k}") for k in ks],
        *[F.sum(f"n{k}").alias(f"returned{k}") for k in ks],
        *[F.sum(F.when(F.col("first").isNotNull(), F.col(f"n{k}"))).alias(f"hits{k}") for k in ks],
        *[F.sum(f"dcg{k}").alias(f"dcg{k}") for k in ks],
    )
    cut = lambda k: F.struct(F.lit(k).alias("k"), *[F.col(f"{name}{k}").alias(name) for name in ("found", "returned", "hits", "dcg")])
    grid = questions.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, modes)) if modes else F.array().cast("array<string>")).alias("mode"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.col("k").cast("long")).cast("int")),
        F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1),
    )
    none = F.coalesce("n_relevant", F.lit(0)) == 0
    r = lambda c: F.round(F.when(none, 0.0).otherwise(F.coalesce(c, F.lit(0.0))), 6)
    return (
        grid.join(sums, ["mode", "query_id"], "left").join(total, "query_id", "left")
        .select("mode", "query_id", "first_rank", "n_relevant", F.explode(F.array(*map(cut, ks))).alias("c"))
        .select("mode", "query_id", "first_rank", "n_relevant", "c.*")
        .select(
            "mode", "query_id", "k",
            r(F.when(F.col("found") > 0, 1.0)).alias("hit"),
            r(F.col("found") / F.col("n_relevant")).alias("recall"),
            r(F.col("hits") / F.greatest(F.lit(1), F.least(F.col("k").cast("long"), F.col("returned")))).alias("precision"),
            r(F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal)).alias("ndcg"),
            r(1 / F.col("first_rank")).alias("mrr"),
            F.when(~none, F.col("first_rank")).alias("first_rank"),
        )
    )


def by_mode(per_query: DataFrame) -> DataFrame:
    """Means over the questions of each mode and cut-off, rounded to 4 digits."""
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return per_query.groupBy("mode", "k").agg(mean("hit"), mean("recall"), mean("precision"), mean("ndcg"), mean("mrr"), F.count(F.lit(1)).alias("n_questions"))


def comparison_table(means: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row a mode with hit, recall and ndcg at each cut-off side by side."""
    wide = means.groupBy("mode").pivot("k", list(ks)).agg(F.max("hit").alias("hit"), F.max("recall").alias("recall"), F.max("ndcg").alias("ndcg"))
    renamed = [F.col(f"`{k}_{m}`").alias(f"{m}_at_{k}") for k in ks for m in ("hit", "recall", "ndcg")]
    return wide.select("mode", *renamed)


def run_deltas(means: DataFrame, before: str, after: str) -> DataFrame:
    """Metric changes from one mode to another at each cut-off, rounded to 3 digits."""
    names = ("hit", "recall", "ndcg", "mrr")
    a = means.where(F.col("mode") == before).select("k", *[F.col(c).alias(f"a_{c}") for c in names])
    b = means.where(F.col("mode") == after).select("k", *[F.col(c).alias(f"b_{c}") for c in names])
    return a.join(b, "k").select("k", *[F.round(F.col(f"b_{c}") - F.col(f"a_{c}"), 3).alias(f"{c}_delta") for c in names])


def failures(per_query: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, category): where modes differ at cut-off k. Modes dense, bm25, hybrid and hybrid_rerank."""
    at = per_query.where(F.col("k") == k)
    one = at.groupBy("query_id").pivot("mode", ["dense", "bm25", "hybrid", "hybrid_rerank"]).agg(F.max("hit").alias("hit"), F.max("first_rank").alias("rank"))
    h = lambda m: F.coalesce(F.col(f"{m}_hit"), F.lit(0.0)) > 0
    before, after = F.col("hybrid_rank"), F.col("hybrid_rerank_rank")
    category = F.array_compact(F.array(
        F.when(h("dense") & ~h("bm25"), "dense_only_win"),
        F.when(h("bm25") & ~h("dense"), "bm25_only_win"),
        F.when(h("hybrid") & ~h("dense") & ~h("bm25"), "hybrid_fixes_both"),
        F.when(after < before, "reranker_improves_rank"),
        F.when(after > before, "reranker_hurts_rank"),
        F.when(~h("dense") & ~h("bm25") & ~h("hybrid") & ~h("hybrid_rerank"), "all_methods_fail"),
    ))
    return one.select("query_id", F.explode(category).alias("category"))


def first_per_category(found: DataFrame, n: int = 20) -> DataFrame:
    """The first n questions of each category, with their place."""
    order = Window.partitionBy("category").orderBy("query_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def pages_in_order(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """(mode, query_id, key, rank): the document's pages by first appearance over ranked records.

    ranked: mode, query_id, rank, id. pages: id, document_id, page_numbers.
    """
    seen = (
        ranked.join(pages, "id").select("mode", "query_id", "rank", "document_id", F.posexplode("page_numbers").alias("pos", "page"))
        .groupBy("mode", "query_id", F.concat_ws(":", "document_id", "page").alias("key")).agg(F.min(F.struct("rank", "pos")).alias("at"))
    )
    order = Window.partitionBy("mode", "query_id").orderBy("at", "key")
    return seen.select("mode", "query_id", "key", F.row_number().over(order).alias("rank"))


def failure_counts(failed: DataFrame) -> DataFrame:
    """(category, n) of failures (query_id, category)."""
    return failed.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def label_violations(items: DataFrame, labels: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(key, problem) of a benchmark: empty when all is well.

    items: question_id, question. labels: label_id, document_id, chunk_id, page_numbers. Problems:
    duplicate_question (different questions of one id), blank_question, unknown_chunk, unknown_document,
    other_document (the chunk lies in another), page_outside, duplicate_label.
    """
    say = lambda df, key, problem: df.select(F.col(key).alias("key"), F.lit(problem).alias("problem"))
    one = labels.select("label_id", "document_id", "chunk_id", "page_numbers").distinct()
    home = chunks.groupBy("chunk_id").agg(F.min("document_id").alias("home"))
    size = documents.groupBy("document_id").agg(F.max("page_count").alias("page_count"))
    located = one.join(home, "chunk_id", "left").join(size.withColumn("known", F.lit(True)), "document_id", "left")
    pages = located.select("label_id", "page_count", F.explode("page_numbers").alias("page"))
    parts = [
        say(items.select("question_id", "question").distinct().groupBy("question_id").count().where("count > 1"), "question_id", "duplicate_question"),
        say(items.where(F.trim(F.coalesce("question", F.lit(""))) == ""), "question_id", "blank_question"),
        say(located.where("home is null"), "label_id", "unknown_chunk"),
        say(located.where("known is null"), "label_id", "unknown_document"),
        say(located.where("home <> document_id"), "label_id", "other_document"),
        say(pages.where("page < 1 or page > page_count"), "label_id", "page_outside"),
        say(one.groupBy("label_id").count().where("count > 1"), "label_id", "duplicate_label"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def run_summary(by_mode_rows: DataFrame, failed: DataFrame, run: str) -> DataFrame:
    """(run, mode, summary): one JSON text a mode with its means by cut-off, and one for the failures under the mode '_failures'."""
    means = by_mode_rows.groupBy("mode").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), F.struct("hit", "recall", "precision", "ndcg", "mrr")))))).alias("summary"))
    counts = failure_counts(failed).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n"))))).alias("summary")).select(F.lit("_failures").alias("mode"), "summary")
    return means.unionByName(counts).select(F.lit(run).alias("run"), "mode", "summary")
