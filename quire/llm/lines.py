"""Problem 3: lines repeated across the documents of one source.

Method: each line's documents are kept as a compressed bitmap per source. Documents have ordinals that
run through a source; a bitmap is the set of its non-zero 64-bit words, each with its word number, so
that empty stretches cost nothing and a line of a third of all documents takes an eighth of a byte a
document. Bitmaps of variant lines are united word by word (bit_or), cardinalities are exact (bit_count),
and lines are deleted by looking up the document's bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounded import broadcast_if_small
from ..plans.lineage import write_table


@dataclass(frozen=True)
class RepeatConfig:
    """A line is repeated with at least min_chars characters, in min_docs documents and 1/min_share of the source's.

    max_broadcast: sources whose document counts are sent to all tasks; more are joined by key.
    """

    min_chars: int = 25
    max_broadcast: int = 100_000
    min_docs: int = 5
    min_share: int = 125


def normal_line(line: Column) -> Column:
    """Lower case, runs of other characters as one blank, runs of digits as #, trimmed."""
    spaced = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(spaced, r"\p{N}+", "#"))


@dataclass(frozen=True)
class Repeats:
    """lines: (document_id, block_id, line_no, ...) of the repeated lines; bitmaps: their united bitmaps by word."""

    lines: DataFrame
    bitmaps: DataFrame


def repeated_lines(blocks: DataFrame, documents: DataFrame, config: RepeatConfig = RepeatConfig()) -> Repeats:
    """Every occurrence of a line that repeats within a source.

    blocks: document_id, block_id, text. documents: document_id, section. Only these columns are read.
    Lines are numbered from 1 between "\\n". Null or empty texts have no lines; a document without a
    section belongs to no source and keeps all lines; repeated rows of a block or document count once,
    as sets of bits do not grow. A document of several sections counts in each. Empty input gives empty
    results. No step gathers a line's documents in one row: a hot line is spread over its words.
    """
    raw = (
        blocks.where(F.length("text") >= config.min_chars)
        .select("document_id", "block_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length("line") >= config.min_chars)
        .select("document_id", "block_id", (F.col("pos") + 1).alias("line_no"), normal_line(F.col("line")).alias("form"), F.xxhash64("line").alias("variant"))
        .where(F.length("form") >= config.min_chars)
        .select("document_id", "block_id", "line_no", F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(7), "form").alias("k2"), "variant")
    )
    lines = write_table(raw, "lines")

    # ordinals: documents in order of source; the id's high bits are the partition, its low bits run on without gaps
    sections = documents.where(F.col("section").isNotNull() & F.col("document_id").isNotNull()).select("document_id", "section").distinct()
    ordered = (
        blocks.select("document_id").distinct().join(sections, "document_id")
        .repartitionByRange("section", "document_id").sortWithinPartitions("section", "document_id")
        .withColumn("ordinal", F.monotonically_increasing_id())
    )
    ordinals = write_table(ordered, "ordinals")
    totals = ordinals.groupBy("section").agg(F.count(F.lit(1)).alias("n_docs"))

    placed = lines.join(ordinals, "document_id").withColumn("word_no", F.shiftright("ordinal", 6))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("ordinal").bitwiseAND(F.lit(63)).cast("int"))
    by_variant = placed.groupBy("section", "k1", "k2", "variant", "word_no").agg(F.bit_or(bit).alias("word"))
    united = by_variant.groupBy("section", "k1", "k2", "word_no").agg(F.bit_or("word").alias("word"))
    counted = united.groupBy("section", "k1", "k2").agg(F.sum(F.bit_count("word")).alias("n_with"))
    hot = (
        counted.where(F.col("n_with") >= config.min_docs)
        .join(broadcast_if_small(totals, config.max_broadcast), "section")
        .where(F.col("n_with") * config.min_share >= F.col("n_docs"))
    )
    bitmaps = write_table(united.join(hot, ["section", "k1", "k2"]), "bitmaps")
    found = (
        placed.join(bitmaps, ["section", "k1", "k2", "word_no"])
        .where(F.col("word").bitwiseAND(bit) != 0)
        .select("document_id", "block_id", "line_no", "section", "n_with", "n_docs")
    )
    return Repeats(found, bitmaps)


def without_repeats(blocks: DataFrame, repeats: Repeats) -> DataFrame:
    """blocks with the repeated lines removed from text, and n_removed.

    All rows and columns of blocks are kept; a block that consists of repeated lines only becomes empty,
    a null text stays null. A column of blocks named n_removed is replaced.
    """
    drop = repeats.lines.groupBy("document_id", "block_id").agg(F.collect_set("line_no").alias("__drop"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__drop", i + 1))
    return (
        blocks.join(drop, ["document_id", "block_id"], "left")
        .withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_removed", F.coalesce(F.size("__drop"), F.lit(0)))
        .drop("__drop")
    )
