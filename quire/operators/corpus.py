"""Corpus reports, fingerprints and incremental state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line


def corpus_report(documents: DataFrame) -> DataFrame:
    """Documents and pages by section, by status and in all, as one pass of grouping sets: level, key, n_documents, n_pages."""
    one = documents.groupBy("document_id").agg(F.max(F.struct("section", "index_status", "page_count")).alias("d")).select("d.*")
    section, status = F.col("section"), F.col("index_status")
    level = F.grouping_id("section", "index_status")
    sums = one.groupingSets([[section], [status], []], section, status).agg(
        F.when(level == 1, "section").when(level == 2, "status").otherwise("all").alias("level"),
        F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("n_pages"),
    )
    return sums.select("level", F.coalesce("section", "index_status").alias("key"), "n_documents", "n_pages")


def block_diagnostics(blocks: DataFrame) -> DataFrame:
    """Blocks of each type: n_blocks, n_measured, mean of the measured confidences (4 digits, null if none)."""
    return blocks.groupBy("block_type").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count("confidence").alias("n_measured"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Of each document: n_chunks, least, most and mean token count, chunks of several pages, distinct pages."""
    per = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.count_if(F.size("page_numbers") > 1).alias("n_multi_page"),
    )
    pages = chunks.select("document_id", F.explode("page_numbers").alias("p")).groupBy("document_id").agg(F.count_distinct("p").alias("n_pages"))
    return per.join(pages, "document_id", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0).cast("long")))


def record_hash(key: Column, text: Column) -> Column:
    """SHA-256 of an id and its text on one line."""
    return F.sha2(F.concat(F.lit("\x00"), key, F.lit("\x01"), one_line(text)), 256)


def fingerprints(records: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, n, fingerprint) of each group's records, whatever their order.

    Each record is hashed where it lies; the first 48 bits of its SHA-256, the next and the next are summed,
    with partial sums, and the sums are hashed. No group is gathered.
    """
    hashed = records.select(group, record_hash(F.col(key), F.col(text)).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 12 * i + 1, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return hashed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("-", *[part(i) for i in range(3)]), 256).alias("fingerprint"))


def change_plan(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, action) of two fingerprint tables: new, changed, unchanged or deleted."""
    a = before.select(key, F.col("fingerprint").alias("old"))
    b = now.select(key, F.col("fingerprint").alias("new"))
    action = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted")
        .when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows of documents that `incoming` doesn't replace, and all incoming rows; the columns of `stored`."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*stored.columns)).select(*stored.columns)


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row a key, the one with the greatest (by, all columns); ties of whole rows are one row."""
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(F.col(by).alias("__by"), *[F.to_json(F.struct(F.col(c))).alias(f"__o{i}") for i, c in enumerate(rest)], *rest)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[packed[f] for f in ["__by", *[f"__o{i}" for i in range(len(rest))]]])).alias("__x")).select(*keys, "__x.*")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
