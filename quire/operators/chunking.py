"""Packing the blocks of a document into chunks of a target size, with provenance and overlap.

Packing carries state from block to block within a section, and begins anew at each heading; sections are
packed in parallel, so a long document is many groups. Text order is reading order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread
from ..plans.ordered import running
from .structure import ANCHORS, FURNITURE

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?:;”’])\s+")


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in tokens: a chunk is closed at `target`, never passes `most`, heading and overlap included, and starts with `overlap` of the last.

    A chunk whose own text is below `least` is closed by a heading only, never for want of room for its overlap.
    """

    target: int = 220
    most: int = 300
    least: int = 50
    overlap: int = 30

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.least <= self.target <= self.most:
            raise ValueError("sizes must satisfy 0 <= overlap < least <= target <= most")


def tail_overlap(text: str, budget: int) -> str:
    """The last sentences that fit into `budget` tokens; of a longer last sentence its first tokens."""
    kept: list[str] = []
    room = budget
    for sentence in reversed(_SENTENCE.split(text.strip())):
        n = len(_TOKEN.findall(sentence))
        if n > room:
            if not kept and budget > 0:
                spans = [m.end() for m in _TOKEN.finditer(sentence)]
                return sentence[: spans[min(budget, len(spans)) - 1]] if spans else ""
            break
        kept.append(sentence)
        room -= n
    return " ".join(reversed(kept))


def _windows(text: str, size: int, overlap: int) -> list[str]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    step, out, at = max(1, size - overlap), [], 0
    while spans:
        end = min(at + size, len(spans))
        out.append(text[spans[at][0] : spans[end - 1][1]])
        if end == len(spans):
            break
        at += step
    return out


def pack(blocks: list[tuple[str, str, int, str]], config: ChunkConfig) -> list[tuple[str, list[str], list[int], str | None]]:
    """(text, block ids, pages, heading) of the chunks of consecutive sections; blocks are (id, type, page, text) in order.

    Headings open the first chunk of their section and are no chunk of their own while content follows
    that fits beside a part of it. An oversized block is cut into windows, the first of which holds the open
    heading. The overlap gives way, whole, where it would take a chunk over `most`.
    """
    out: list[tuple[str, list[str], list[int], str | None]] = []
    held: list[tuple[str, int, str]] = []
    size, tail, heading, bare = 0, "", None, True  # bare: only headings are held
    count = lambda text: len(_TOKEN.findall(text))

    def flush() -> None:
        nonlocal held, size, tail, bare
        if not held:
            return
        body = "\n\n".join(t for _, _, t in held)
        room = config.most - size
        lead = tail if tail and count(tail) <= room else ""
        out.append((f"{lead}\n\n{body}" if lead else body, [b for b, _, _ in held], sorted({p for _, p, _ in held}), heading))
        tail = tail_overlap(body, config.overlap) if config.overlap and not bare else ""
        held, size, bare = [], 0, True

    def cut(block: str, page: int, text: str) -> None:
        """Windows of an oversized block, the first beside the headings that are held."""
        nonlocal held, size, bare, tail
        opened = "\n\n".join(t for _, _, t in held)
        room = config.most - size
        if not held or room < config.least:
            flush()
            room, opened = config.most, ""
        first = _windows(text, room, 0)[0] if opened else ""
        if first:
            out.append((f"{opened}\n\n{first}", [*(b for b, _, _ in held), block], sorted({page, *(p for _, p, _ in held)}), heading))
            rest = text[text.index(first) + len(first) :]
            lead = tail_overlap(first, config.overlap) if config.overlap else ""
            text = f"{lead} {rest.strip()}" if rest.strip() else ""
            held, size, bare = [], 0, True
        for window in _windows(text, config.most, config.overlap):
            out.append((window, [block], [page], heading))
        tail = tail_overlap(text or first, config.overlap) if config.overlap else ""

    for block, kind, page, text in blocks:
        n = count(text)
        if kind in ANCHORS:
            if not bare:
                flush()
                tail = ""
            if size + n > config.most:
                flush()
            heading = " ".join(text.split())
            held.append((block, page, text))
            size += n
            continue
        if n > config.most:
            if not bare:
                flush()
            cut(block, page, text)
            continue
        if not bare and size + n > config.most:
            flush()
        if bare and size + n > config.most:
            cut(block, page, text)  # beside its headings the block doesn't fit
            continue
        held.append((block, page, text))
        size, bare = size + n, False
        if size >= config.target:
            flush()
    flush()
    return out


#: Columns of packed chunks: name, type in Spark, type in Arrow.
_PACKED = (
    ("document_id", "string", pa.string()), ("__group", "long", pa.int64()), ("__i", "int", pa.int32()), ("text", "string", pa.string()),
    ("source_block_ids", "array<string>", pa.list_(pa.string())), ("page_numbers", "array<int>", pa.list_(pa.int32())), ("heading", "string", pa.string()),
    ("token_count", "int", pa.int32()), ("start_page", "int", pa.int32()), ("end_page", "int", pa.int32()),
)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(_PACKED)], [name for name, _, _ in _PACKED])


def chunk_blocks(blocks: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of every document: chunk_id, document_id, chunk_index, text, source_block_ids, page_numbers, heading, token_count, start_page, end_page.

    Furniture and blank blocks are left out; repeated rows of a block count once (the latest text by
    order of text). Sections are packed in parallel. A run of headings belongs to the section it opens.
    """
    content = (
        blocks.where(F.length(F.trim("text")) > 0)
        .groupBy("document_id", "block_id").agg(F.max(F.struct("page_number", "reading_order", "block_type", "text")).alias("b"))
        .select("document_id", "block_id", "b.*")
        .where(~F.coalesce(F.col("block_type").isin(*FURNITURE), F.lit(False)))
    )

    # a group begins with a heading that follows content; it begins without state
    order = ["page_number", "reading_order", "block_id"]
    anchor = F.coalesce(F.col("block_type").isin(*ANCHORS), F.lit(False))
    content = running(content.where(F.col("document_id").isNotNull()), ["document_id"], order, {"__before": ("lag", anchor)})
    opens = (anchor & ~F.coalesce("__before", F.lit(True))).cast("int")
    ordered = running(content.withColumn("__opens", opens), ["document_id"], order, {"__group": ("sum", F.col("__opens"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs the sections of a partition, which lie one after another; a section may go on in the next batch."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[column.to_pylist() for column in batch.columns])

        out: list[tuple] = []
        for (doc, group), section in groupby(rows(), key=itemgetter(0, 1)):
            packed = pack([(block, kind or "UNKNOWN", page or 0, text.strip()) for _, _, page, block, kind, text in section], config)
            out += [(doc, group, i, t, b, p, h, len(_TOKEN.findall(t)), p[0], p[-1]) for i, (t, b, p, h) in enumerate(packed)]
            if len(out) >= 2000:
                yield _table(out)
                out = []
        yield _table(out)

    ready = spread(ordered, "document_id", "__group").sortWithinPartitions("document_id", "__group", *order)
    packed = ready.select("document_id", "__group", "page_number", "block_id", "block_type", "text").mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind, _ in _PACKED))
    numbered = running(packed, ["document_id"], ["__group", "__i"], {"chunk_index": ("sum", F.lit(1))}).withColumn("chunk_index", (F.col("chunk_index") - 1).cast("int"))
    return numbered.select(
        F.format_string("%s-c%05d", "document_id", "chunk_index").alias("chunk_id"), "document_id", "chunk_index", "text", "source_block_ids", "page_numbers", "heading", "token_count", "start_page", "end_page"
    )
