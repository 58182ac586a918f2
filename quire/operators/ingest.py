"""Files, registry and state of a corpus: discovery, curation entries, status of each document, reasons to build anew."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bounded import bounded_rows

#: Fixed: values a filter may name.
SOURCE_TYPES = ("PRIMARY", "SECONDARY", "UNKNOWN")


def slashed(path: Column) -> Column:
    """A path with forward slashes, lower-cased."""
    return F.lower(F.translate(path, "\\", "/"))


def source_type(path: Column) -> Column:
    """PRIMARY if the path says so anywhere, else SECONDARY."""
    return F.when(F.contains(F.lower(path), F.lit("primary")), "PRIMARY").otherwise("SECONDARY")


def filled(value: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(value), F.lit(""))


def registry_keys(entries: DataFrame) -> DataFrame:
    """(entry_no, sha, needle) of a registry (entry_no, sha256, path): an entry with both keys has a row for each; blank keys have none."""
    keys = F.array(
        F.struct(F.lower(filled(F.col("sha256"))).alias("sha"), F.lit(None).cast("string").alias("needle")),
        F.struct(F.lit(None).cast("string").alias("sha"), slashed(filled(F.col("path"))).alias("needle")),
    )
    rows = entries.select("entry_no", F.explode(keys).alias("k")).select("entry_no", "k.*")
    return rows.where("sha is not null or needle is not null")


def registry_lookup(documents: DataFrame, entries: DataFrame, max_needles: int = 100_000) -> DataFrame:
    """(document_id, entry_no, matched_by): the registry entry of each document, null if there is none.

    By checksum first; else the first entry (by entry_no) whose path is part of the document's path. Paths of
    the registry, a curated list of at most max_needles, are found by one automaton in every task, so
    documents and entries are never crossed. Repeated rows of a document count once.
    """
    import ahocorasick

    docs = documents.groupBy("document_id").agg(F.max("source_sha256").alias("sha"), F.max("source_path").alias("path"))
    keys = registry_keys(entries)
    by_sha = keys.where("sha is not null").groupBy("sha").agg(F.min("entry_no").alias("own"))
    kind = dict(entries.dtypes)["entry_no"]
    needles = bounded_rows(keys.where("needle is not null").groupBy("needle").agg(F.min("entry_no").alias("entry_no")), max_needles, "the registry")
    shared = documents.sparkSession.sparkContext.broadcast({r.needle: r.entry_no for r in needles})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for needle, entry in shared.value.items():
            automaton.add_word(needle, entry)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            paths = batch.column(1).to_pylist()
            first = [min((e for _, e in automaton.iter(p)), default=None) if p and shared.value else None for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.string() if kind == "string" else pa.int64())], ["document_id", "near"])

    by_path = docs.select("document_id", slashed(F.col("path")).alias("path")).mapInArrow(find, f"document_id string, near {'string' if kind == 'string' else 'long'}")
    both = docs.select("document_id", F.lower("sha").alias("sha")).join(by_sha, "sha", "left").join(by_path, "document_id", "left")
    return both.select(
        "document_id", F.coalesce("own", F.col("near").cast(kind)).alias("entry_no"), F.when(F.col("own").isNotNull(), "sha").when(F.col("near").isNotNull(), "path").alias("matched_by")
    )


def registry_apply(documents: DataFrame, found: DataFrame, entries: DataFrame) -> DataFrame:
    """documents with index_status, title and author of their registry entry; REVIEW without one, own values where the entry has none."""
    entry = entries.select("entry_no", F.col("index_status").alias("e_status"), F.col("title").alias("e_title"), F.col("author").alias("e_author"))
    own = found.select("document_id", "entry_no").join(entry, "entry_no", "left")
    rest = [c for c in documents.columns if c not in ("index_status", "title", "author")]
    joined = documents.join(own, "document_id", "left")
    return joined.select(*rest, F.coalesce("e_status", F.lit("REVIEW")).alias("index_status"), F.coalesce("e_title", "title").alias("title"), F.coalesce("e_author", "author").alias("author"))


def pipeline_stage(processed: Column, chunked: Column, indexed: Column, failed: Column) -> Column:
    """How far a file has come: ERROR, INDEXED (needs the processed form too), CHUNKED, PROCESSED or DISCOVERED."""
    return (
        F.when(failed, "ERROR").when(indexed & processed, "INDEXED").when(indexed | chunked, "CHUNKED").when(processed, "PROCESSED").otherwise("DISCOVERED")
    )


def stage_of_files(files: DataFrame, processed: DataFrame, chunks: DataFrame, state: DataFrame) -> DataFrame:
    """(document_id, n_chunks, stage) of every file.

    files: document_id, sha256, error. processed: document_id. chunks: document_id. state: document_id, sha256,
    chunk_count. A file is indexed if its state has its checksum and at least one chunk. Repeated rows count once.
    """
    one = files.groupBy("document_id").agg(F.max("sha256").alias("sha256"), F.max("error").alias("error"))
    has = processed.select("document_id").distinct().withColumn("p", F.lit(True))
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    ready = state.where(F.col("chunk_count") > 0).select("document_id", "sha256").distinct().withColumn("i", F.lit(True))
    joined = one.join(has, "document_id", "left").join(n, "document_id", "left").join(ready, ["document_id", "sha256"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    stage = pipeline_stage(yes("p"), F.coalesce("n_chunks", F.lit(0)) > 0, yes("i"), F.col("error").isNotNull())
    return joined.select("document_id", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), stage.alias("stage"))


def reindex_reasons(now: DataFrame, state: DataFrame) -> DataFrame:
    """(document_id, reason): new, source_changed, config_changed, model_changed or unchanged, the first that holds.

    Both sides: document_id, sha256, config_version, model_name. Nulls differ from values.
    """
    old = state.select("document_id", *[F.col(c).alias(f"o_{c}") for c in ("sha256", "config_version", "model_name")], F.lit(True).alias("known"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
    reason = (
        F.when(F.col("known").isNull(), "new").when(differs("sha256"), "source_changed")
        .when(differs("config_version"), "config_changed").when(differs("model_name"), "model_changed").otherwise("unchanged")
    )
    return now.join(old, "document_id", "left").select("document_id", reason.alias("reason"))


def state_differences(now: dict[str, object], stored: dict[str, object] | None, fields: tuple[str, ...]) -> list[str]:
    """Names of the fields in which a build's stored state differs, in order; ['missing'] without a state."""
    if not stored:
        return ["missing"]
    return [f for f in fields if now.get(f) != stored.get(f)]


def ingest_ledger(stages: DataFrame, reasons: DataFrame) -> DataFrame:
    """(document_id, action): failed, parse (not processed yet, or its source changed), chunk, index (chunks are there), or reuse."""
    action = (
        F.when(F.col("stage") == "ERROR", "failed")
        .when(F.col("stage").isin("DISCOVERED") | F.col("reason").isin("source_changed"), "parse")
        .when((F.col("stage") == "PROCESSED") | (F.col("reason") == "config_changed"), "chunk")
        .when((F.col("stage") == "CHUNKED") | (F.col("reason") == "model_changed"), "index")
        .otherwise("reuse")
    )
    return stages.join(reasons, "document_id", "left").select("document_id", action.alias("action"))


@dataclass(frozen=True)
class SearchFilter:
    """Constraints of a search by field: any value within a field, all fields. Names and titles compare trimmed and without case."""

    values: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def of(cls, raw: dict[str, object] | None) -> SearchFilter:
        """Scalars become lists; unknown keys, blank values and unknown source types raise ValueError."""
        out: dict[str, tuple[str, ...]] = {}
        for key, value in (raw or {}).items():
            if key not in ("document_id", "source_type", "author", "title"):
                raise ValueError(f"unknown filter: {key}")
            listed = [str(v).strip() for v in (value if isinstance(value, (list, tuple, set)) else [value])]
            if not listed or any(not v or v == "None" for v in listed):
                raise ValueError(f"blank value in filter: {key}")
            if key == "source_type":
                listed = [v.upper() for v in listed]
                if unknown := set(listed) - set(SOURCE_TYPES):
                    raise ValueError(f"unknown source type: {sorted(unknown)[0]}")
            out[key] = tuple(sorted({v.lower() for v in listed} if key in ("author", "title") else set(listed)))
        return cls(out)

    def predicate(self) -> Column | None:
        """The constraints as one condition on documents, which the scan takes; None if there are none."""
        condition = None
        for key, listed in sorted(self.values.items()):
            column = F.lower(F.trim(key)) if key in ("author", "title") else F.col(key)
            condition = column.isin(*listed) if condition is None else condition & column.isin(*listed)
        return condition

    def documents(self, rows: DataFrame) -> DataFrame:
        """(document_id) of the rows that satisfy the filter."""
        condition = self.predicate()
        return (rows if condition is None else rows.where(condition)).select("document_id").distinct()


def totals(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row of sums; 0 for an empty table."""
    return rows.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in values.items()])


def set_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, fingerprint) of a set of rows whatever their order: sums of parts of each row's hash, hashed; repeated rows count."""
    h = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 12 * i + 1, 12), 16, 10).cast("decimal(20,0)")).cast("string"), F.lit("0"))
    return rows.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("-", *[part(i) for i in range(3)]), 256).alias("fingerprint"))
