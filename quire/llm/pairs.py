"""Problem 5: items that appear together.

Method: external sort of packed 64-bit pair codes. Each task packs the pairs of its records into codes,
sorts them in bounded runs and counts equal codes; the runs (code, count) are then brought together by
code, sorted on disk where they don't fit in memory, merged and counted by run length. A pair that fills
a third of all records leaves each task as one row a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounded import bounded_rows
from ..plans.lineage import write_table

#: Pair codes sorted at once in a task.
RUN = 1 << 20
_RUNS = "code long, n long"


@dataclass(frozen=True)
class PairConfig:
    """Fixed thresholds of the reported pairs, and the largest vocabulary that a task holds."""

    min_together: int = 5
    min_ratio: int = 2
    max_aliases: int = 200_000


def normal_text(text: Column) -> Column:
    """Lower case; all but a-z, 0-9, hyphen and white space as a blank; white space collapsed."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s\p{Z}-]", " ")
    return F.trim(F.regexp_replace(kept, r"[\s\p{Z}\x{85}\x1c-\x1f]+", " "))


class Mentions:
    """Finds aliases in normalised text: longest first, no letter or digit beside, no character claimed twice."""

    def __init__(self, aliases: list[tuple[str, int]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for alias, code in aliases:
            self.automaton.add_word(alias, (len(alias), code))
        if aliases:
            self.automaton.make_automaton()
        self.any = bool(aliases)

    def __call__(self, text: str) -> list[int]:
        """Distinct item codes of the text, ascending."""
        if not self.any or not text:
            return []
        hits = []
        end_of_text = len(text)
        for last, (size, code) in self.automaton.iter(text):
            start, end = last - size + 1, last + 1
            if (start == 0 or not text[start - 1].isalnum()) and (end == end_of_text or not text[end].isalnum()):
                hits.append((-size, start, code))
        if len(hits) < 2:
            return [code for _, _, code in hits]
        hits.sort()
        taken: list[tuple[int, int]] = []
        codes = set()
        for size, start, code in hits:
            end = start - size
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                codes.add(code)
        return sorted(codes)


def item_codes(vocabulary: DataFrame, config: PairConfig) -> tuple[list[tuple[str, int]], list[str]]:
    """Aliases with the codes of their canonical names, and the names in order; codes follow the names' order.

    Null or blank aliases are left out; an alias of two names belongs to the smaller one.
    """
    rows = bounded_rows(
        vocabulary.select(normal_text(F.col("alias")).alias("alias"), "canonical")
        .where(F.col("canonical").isNotNull() & (F.length("alias") > 0))
        .groupBy("alias").agg(F.min("canonical").alias("canonical")),
        config.max_aliases, "the vocabulary",
    )
    names = sorted({r.canonical for r in rows})
    code = {name: i for i, name in enumerate(names)}
    return [(r.alias, code[r.canonical]) for r in rows], names


def records_with_items(evidence: DataFrame, aliases: list[tuple[str, int]]) -> DataFrame:
    """items ARRAY<INT> of each distinct (chunk_id, evidence_text); a null text is a record without items."""
    records = (
        evidence.select("chunk_id", F.coalesce("evidence_text", F.lit("")).alias("evidence_text"))
        .distinct()
        .select(normal_text(F.col("evidence_text")).alias("text"))
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mentions = Mentions(aliases)
        kind = pa.list_(pa.int32())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mentions(t) for t in batch.column(0).to_pylist()], kind)], ["items"])

    return records.mapInArrow(find, "items array<int>")


def _run_lengths(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of a sorted array and the sums of their counts."""
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[starts], np.add.reduceat(counts, starts)


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])


def _codes_of(offsets: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Codes of one batch of records: a << 32 | b for pairs, a << 32 | a for single items, -1 for each record."""
    sizes = np.diff(offsets)
    parts = [np.full(len(sizes), -1, np.int64)]
    for size in np.unique(sizes):
        if size == 0:
            continue
        rows = flat[offsets[:-1][sizes == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size)
        parts.append(((rows[:, i] << 32) | rows[:, j]).ravel())
    return np.concatenate(parts)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        items = batch.column(0)
        codes = _codes_of(items.offsets.to_numpy().astype(np.int64), items.values.to_numpy(zero_copy_only=False).astype(np.int64))
        held.append(codes)
        size += len(codes)
        if size >= RUN:
            run = np.sort(np.concatenate(held))
            yield _batch(*_run_lengths(run, np.ones(len(run), np.int64)))
            held, size = [], 0
    if size:
        run = np.sort(np.concatenate(held))
        yield _batch(*_run_lengths(run, np.ones(len(run), np.int64)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length count of a sorted stream; the last code of a batch is held until its run ends."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = _run_lengths(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if last is not None:
            if codes[0] == last:
                counts[0] += total
            else:
                yield _batch(np.array([last]), np.array([total]))
        last, total = int(codes[-1]), int(counts[-1])
        if len(codes) > 1:
            yield _batch(codes[:-1], counts[:-1])
    if last is not None:
        yield _batch(np.array([last]), np.array([total]))


def pair_counts(records: DataFrame) -> DataFrame:
    """(code, n) of every pair and item that occurs in `items`, and of all records under -1.

    `items` holds distinct codes in ascending order. The sort is Spark's: it spills sorted runs and
    merges them, so the number of distinct pairs is not bounded by memory.
    """
    runs = records.select("items").mapInArrow(_sorted_runs, _RUNS)
    together = runs.repartition("code").sortWithinPartitions("code")
    return together.mapInArrow(_merged, _RUNS)


def co_occurrence(evidence: DataFrame, vocabulary: DataFrame, config: PairConfig = PairConfig()) -> DataFrame:
    """Each pair of items named in one record: counts, ratio to chance, and log odds ratio.

    Columns concept_a < concept_b, n_ab, n_a, n_b, n_records, lift (n_ab * N / (n_a * n_b)), log_odds
    (natural log of the odds ratio with 0.5 added to each cell, so that empty cells stay finite).
    A record is a distinct (chunk_id, evidence_text); repeated rows count once, null texts count as
    records without items. An empty vocabulary or table gives no rows. The counts of single items and
    of all records, at most max_aliases + 1 rows, are joined as a broadcast side.
    """
    spark = evidence.sparkSession
    aliases, names = item_codes(vocabulary, config)
    counts = write_table(pair_counts(records_with_items(evidence, aliases)), "pair-counts")
    a, b = F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    split = counts.select("n", a.alias("a"), b.alias("b"), "code")
    single = split.where((F.col("a") == F.col("b")) & (F.col("code") >= 0)).select(F.col("a").alias("item"), F.col("n").alias("n_item"))
    total = split.where(F.col("code") < 0).select(F.col("n").alias("n_records"))
    label = spark.createDataFrame(list(enumerate(names)), "item long, name string")
    items = F.broadcast(single.join(F.broadcast(label), "item"))
    left = items.select(F.col("item").alias("a"), F.col("name").alias("concept_a"), F.col("n_item").alias("n_a"))
    right = items.select(F.col("item").alias("b"), F.col("name").alias("concept_b"), F.col("n_item").alias("n_b"))
    n, na, nb, nab = (F.col(c).cast("double") for c in ("n_records", "n_a", "n_b", "n_ab"))
    odds = ((nab + 0.5) * (n - na - nb + nab + 0.5)) / ((na - nab + 0.5) * (nb - nab + 0.5))
    return (
        split.where((F.col("code") >= 0) & (F.col("a") != F.col("b")))
        .select("a", "b", F.col("n").alias("n_ab"))
        .join(left, "a").join(right, "b")
        .crossJoin(F.broadcast(total))  # one row
        .select("concept_a", "concept_b", "n_ab", "n_a", "n_b", "n_records", F.round(nab * n / (na * nb), 6).alias("lift"), F.round(F.log(odds), 6).alias("log_odds"))
    )


def associated(pairs: DataFrame, config: PairConfig = PairConfig()) -> DataFrame:
    """Pairs that occur together often enough, and at least min_ratio times as often as by chance (in whole numbers)."""
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    exact = whole("n_ab") * whole("n_records") >= config.min_ratio * (whole("n_a") * whole("n_b"))
    return pairs.where((F.col("n_ab") >= config.min_together) & exact)


def stale_edges(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Edges whose evidence_count is null or differs from the number of their distinct evidence rows that exist.

    Columns edge_id, evidence_count, n_evidence. Repeated rows of an edge or evidence count once. An edge
    with null or empty evidence_ids has n_evidence 0.
    """
    one = edges.where(F.col("edge_id").isNotNull()).groupBy("edge_id").agg(F.max("evidence_count").alias("evidence_count"), F.max("evidence_ids").alias("evidence_ids"))
    known = evidence.select("evidence_id").where(F.col("evidence_id").isNotNull()).distinct()
    real = (
        one.select("edge_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
        .join(known, "evidence_id", "left_semi").groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        one.join(real, "edge_id", "left")
        .select("edge_id", "evidence_count", F.coalesce("n", F.lit(0).cast("long")).alias("n_evidence"))
        .where(~F.col("evidence_count").eqNullSafe(F.col("n_evidence")))
    )
