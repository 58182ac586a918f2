"""Evidence packs: cleanup, deduplication, diversity caps, token budget and rendering, for many queries in one plan.

Greedy steps run as folds over each query's ranked candidates, a list of at most a pool's size; nothing
folds over a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, count_tokens, lex_tokens
from ..plans.lineage import spread, write_table

#: Fixed: a page number alone on a line, and the longest running head.
FOLIO = r"(?i)^\s*[-—–|.]?\s*(\d{1,4}|[ivxlcdm]{1,7})\s*[-—–|.]*\s*$"
HEAD_CHARS = 80


@dataclass(frozen=True)
class PackConfig:
    """Limits of a pack; pool is the number of candidates considered."""

    max_tokens: int = 2500
    max_items: int = 8
    shared_blocks: float = 0.5
    shared_text: float = 0.8
    per_document: int = 8
    per_section: int = 4
    per_region: int = 3
    region_pages: int = 8

    def __post_init__(self) -> None:
        if min(self.max_tokens, self.max_items, self.per_document, self.per_section, self.per_region, self.region_pages) < 1:
            raise ValueError("limits must be positive")


def is_folio(line: Column) -> Column:
    return line.rlike(FOLIO) & (F.length(F.trim(line)) <= 12)


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def without_edge_numbers(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s*\d{1,4}\s+|\s+\d{1,4}\s*$", " "))


def is_running_head(line: Column, title: Column, path: Column) -> Column:
    """Whether a line equals the title, one of the first two headings, or title and heading together, with or without a page number."""
    heads = F.transform(F.slice(F.coalesce(path, F.array().cast("array<string>")), 1, 2), lambda h: normal_line(h))
    t = normal_line(F.coalesce(title, F.lit("")))
    known = F.array_union(F.array_union(F.array(t), heads), F.transform(heads, lambda h: F.when(t != "", F.concat_ws(" ", t, h)).otherwise("")))
    variants = F.array(normal_line(line), normal_line(without_edge_numbers(line)))
    return (F.trim(line) != "") & (F.length(F.trim(line)) <= HEAD_CHARS) & F.arrays_overlap(F.array_remove(F.array_compact(known), ""), variants)


def cleaned(text: Column, title: Column, path: Column) -> Column:
    """STRUCT(clean, removed): text without page furniture at either end and without repeated heads inside.

    A text of furniture only is kept as it is. A head inside stays if it is the first of its text.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    flag = lambda x: F.when(is_folio(x), 1).when(is_running_head(x, title, path), 2).otherwise(0)
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), flag(x).alias("kind"), (F.trim(x) == "").alias("blank")))

    def trim(m: Column) -> Column:
        n = F.size(m)
        first = F.coalesce(F.array_position(F.transform(m, lambda x: (x["kind"] == 0).cast("int")), 1), F.lit(0)).cast("int")
        back = F.array_position(F.transform(F.reverse(m), lambda x: ((x["kind"] == 0) & ~x["blank"]).cast("int")), 1).cast("int")
        last = n - back + 1
        body = F.when((first > 0) & (back > 0) & (last >= first), F.slice(m, first, last - first + 1)).otherwise(F.slice(m, 1, 0))
        headed = F.exists(F.slice(m, 1, F.greatest(first - 1, F.lit(0))), lambda x: x["kind"] == 2) | F.exists(
            F.slice(m, F.greatest(last + 1, F.lit(1)), F.greatest(back - 1, F.lit(0))), lambda x: x["kind"] == 2
        )
        start = F.struct(F.array().cast("array<string>").alias("out"), headed.alias("seen"), F.lit(0).alias("blanked"))
        step = lambda s, x: F.struct(
            F.concat(s["out"], F.array(F.when((x["kind"] == 2) & s["seen"], "").otherwise(x["line"]))).alias("out"),
            (s["seen"] | (x["kind"] == 2)).alias("seen"),
            (s["blanked"] + F.when((x["kind"] == 2) & s["seen"], 1).otherwise(0)).alias("blanked"),
        )
        done = F.aggregate(body, start, step)
        return F.struct(F.trim(F.array_join(done["out"], "\n"), F.lit(" \n\t\r")).alias("clean"), (n - F.size(body) + done["blanked"]).alias("removed"))

    whole = F.trim(F.coalesce(text, F.lit("")), F.lit(" \n\t\r"))
    out = F.element_at(F.transform(F.array(marked), trim), 1)
    return F.element_at(F.transform(F.array(out), lambda o: F.when(o["clean"] == "", F.struct(whole.alias("clean"), F.lit(0).alias("removed"))).otherwise(o)), 1)


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """One row a query: its candidates in order of reranker score (nulls last), fusion rank (nulls last) and id.

    candidates: query_id, id, document_id, section_id, title, text, source_block_ids, page_numbers,
    heading_path, reranker_score, fusion_rank. The list is as long as the query's pool.
    """
    order = F.struct(
        F.coalesce(-F.col("reranker_score"), F.lit(float("inf"))).alias("o1"),
        F.coalesce(F.col("fusion_rank"), F.lit(1_000_000_000)).alias("o2"), "id",
    )
    clean = cleaned(F.col("text"), F.col("title"), F.col("heading_path"))
    item = F.struct(
        order.alias("o"), "id", "document_id", F.coalesce("section_id", F.lit("none")).alias("section"),
        F.coalesce("source_block_ids", F.array().cast("array<string>")).alias("blocks"),
        F.coalesce("page_numbers", F.array().cast("array<int>")).alias("pages"),
        F.array_distinct(lex_tokens(F.col("text"))).alias("words"), F.col("c").alias("c"), count_tokens(F.col("c.clean")).alias("n"),
    )
    # texts are cleaned and counted once, in the stage that writes them
    ready = write_table(spread(candidates.withColumn("c", clean), "query_id", "id").select("query_id", item.alias("x")), "candidates")
    return ready.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("pool"))


def _overlap(a: set, b: set) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def fates(pool: list[dict], config: PackConfig) -> list[str]:
    """The fate of each candidate of one query, in order of rank; candidates have sets blocks, words and pages."""

    def repeats(x: dict, k: dict) -> bool:
        """Shared blocks, or shared words, or somewhat of both on a shared page."""
        blocks, text = _overlap(x["blocks"], k["blocks"]), _overlap(x["words"], k["words"])
        if (x["blocks"] and blocks >= config.shared_blocks) or (x["words"] and text >= config.shared_text):
            return True
        return bool(x["pages"] & k["pages"]) and blocks >= 0.6 * config.shared_blocks and text >= 0.6 * config.shared_text

    kept, held, used, n, done = [], [], 0, 0, False
    out = []
    for x in pool:
        if any(repeats(x, k) for k in kept):
            out.append("duplicate")
            continue
        kept.append(x)
        same = [k for k in held if k["document_id"] == x["document_id"] and x["document_id"] is not None]
        region = lambda k: min(k["pages"]) // config.region_pages if k["pages"] else None
        if len(same) >= config.per_document:
            out.append("per_document")
        elif sum(k["section"] == x["section"] for k in same) >= config.per_section:
            out.append("per_section")
        elif sum(region(k) == region(x) for k in same) >= config.per_region:
            out.append("per_region")
        else:
            held.append(x)
            if done or n >= config.max_items:
                fate = "left_out"
            elif x["n"] > config.max_tokens:
                fate = "oversized"
            else:
                fate = "left_out" if used + x["n"] > config.max_tokens else "selected"
            if fate == "selected":
                used, n = used + x["n"], n + 1
            done = done or fate == "left_out"
            out.append(fate)
    return out


def evidence_packs(candidates: DataFrame, config: PackConfig = PackConfig()) -> DataFrame:
    """Every candidate with its fate: query_id, id, place, fate, evidence_id, n_tokens, clean, removed.

    fate is duplicate, per_document, per_section, per_region, oversized, selected or left_out. Candidates
    are taken greedily by rank: repeats of kept ones go first, then the caps, then the budget; an item that
    alone exceeds the budget is passed over, the first that doesn't fit any more ends the pack. Pools are
    folded in Arrow batches of queries; a pool is as long as the retrieval's depth.
    """
    pools = ranked_candidates(candidates)
    kind = dict(candidates.dtypes)["query_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for query, pool in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ready = [x | {name: {v for v in x[name] if v is not None} for name in ("blocks", "words", "pages")} for x in pool]
                number = 0
                for place, (x, fate) in enumerate(zip(pool, fates(ready, config)), 1):
                    number += fate == "selected"
                    for column, value in zip(out, (query, x["id"], place, fate, x["n"], x["c"]["clean"], x["c"]["removed"], f"S{number}" if fate == "selected" else None)):
                        column.append(value)
            types = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string())
            names = ["query_id", "id", "place", "fate", "n_tokens", "clean", "removed", "evidence_id"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return pools.mapInArrow(fold, f"query_id {kind}, id string, place int, fate string, n_tokens int, clean string, removed int, evidence_id string")


def render_packs(packs: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, evidence): the selected items of each pack as numbered text. sources: id, title, pages."""
    item = F.concat(
        F.lit("["), "evidence_id", F.lit("] "), F.coalesce("title", F.lit("Untitled")), F.lit(", p. "), "pages", F.lit("\n"), "clean",
    )
    listed = packs.where(F.col("fate") == "selected").join(sources, "id").select("query_id", F.struct("place", item.alias("t")).alias("x"))
    return listed.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["t"], "\n\n").alias("evidence"))


def pages_display(pages: Column) -> Column:
    """'?' without pages, '5' for one, '5-7' for several."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low.isNull(), "?").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def citations(text: Column) -> Column:
    """Distinct cited evidence ids ([S1], in any case) in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\[S(\d+)\]"), F.lit(1)), lambda d: F.concat(F.lit("S"), d)))


def checked_citations(answers: DataFrame, packs: DataFrame) -> DataFrame:
    """(query_id, evidence_id, status) of each citation: valid if its pack holds the item, else unknown."""
    cited = answers.select("query_id", F.explode(citations(F.col("answer"))).alias("evidence_id"))
    held = packs.select("query_id", "evidence_id").where(F.col("evidence_id").isNotNull()).distinct().withColumn("ok", F.lit(True))
    return cited.join(held, ["query_id", "evidence_id"], "left").select("query_id", "evidence_id", F.when(F.col("ok"), "valid").otherwise("unknown").alias("status"))
