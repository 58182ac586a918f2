"""Problem 2: cutting oversized items at natural boundaries.

Method: lexical-cohesion segmentation. At every natural boundary (paragraph, line or sentence end) the
words of the blocks before and after are compared; a valley of that similarity marks a change of topic.
Inside each size window the deepest valley is cut, and each further piece starts with the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens
from ..plans.lineage import write_table

_TOKEN = re.compile(r"\w+|[^\w\s]")
_STOP = re.compile(r"[.!?…]")
_CLOSER = set("\"'”’»)]")
#: Fixed: words whose full stop ends no sentence; single capitals count as initials.
_ABBREVIATIONS = {"dr", "mr", "mrs", "ms", "st", "prof", "no", "vol", "fig", "cf", "pp", "p", "ed", "eds", "vs", "etc"}
#: Preference among valleys of equal depth, and the name given in the column `cut`.
_KINDS = {3: "paragraph", 2: "line", 1: "sentence", 0: "token"}

PIECES = (
    "piece_no int, n_pieces int, text string, n_tokens int, start_char int, end_char int, "
    "cut string, source_block_ids array<string>, source_tokens int"
)


@dataclass(frozen=True)
class SplitConfig:
    """limit and overlap in tokens; block is the number of content words compared on each side of a gap."""

    limit: int = 300
    overlap: int = 30
    block: int = 20

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit // 2:
            raise ValueError("overlap must be at least 0 and less than half of limit")


def _gap_kind(text: str, spans: list[tuple[int, int]], i: int) -> int:
    """Kind of the boundary before token i: 3 paragraph, 2 line, 1 sentence, 0 none."""
    end, start = spans[i - 1][1], spans[i][0]
    between = text[end:start]
    if "\n" in between:
        return 3 if between.count("\n") > 1 else 2
    if not between:
        return 0
    k = i - 1
    while k > 0 and text[spans[k][0]] in _CLOSER and k > i - 4:
        k -= 1
    if not _STOP.match(text[spans[k][0]]):
        return 0
    word = text[spans[k - 1][0] : spans[k - 1][1]] if k and text[spans[k][0]] == "." and spans[k - 1][1] == spans[k][0] else ""
    if word.lower() in _ABBREVIATIONS or (len(word) == 1 and word.isupper()):
        return 0
    # other abbreviations go on in lower case or digits
    return 0 if text[start].islower() or text[start].isdigit() else 1


def _similarity(words: list[str], position: int, block: int) -> float:
    """Cosine of the word counts of the blocks that meet at `position` in the list of content words."""
    left, right = words[max(0, position - block) : position], words[position : position + block]
    if not left or not right:
        return 0.0
    counts: dict[str, int] = {}
    for w in left:
        counts[w] = counts.get(w, 0) + 1
    other: dict[str, int] = {}
    for w in right:
        other[w] = other.get(w, 0) + 1
    dot = sum(n * other.get(w, 0) for w, n in counts.items())
    norm = sum(n * n for n in counts.values()) * sum(n * n for n in other.values())
    return dot / norm**0.5


def _depths(scores: list[float]) -> list[float]:
    """Depth of each gap: how far the similarity rises to the nearest peak on either side."""
    n = len(scores)
    left, right = [0.0] * n, [0.0] * n
    for side, order in ((left, range(n)), (right, range(n - 1, -1, -1))):
        peak, before = 0.0, None
        for i in order:
            peak = scores[i] if before is None or scores[i] > before else max(peak, scores[i]) if scores[i] == before else peak
            side[i] = peak - scores[i]
            before = scores[i]
    return [a + b for a, b in zip(left, right)]


def cut_points(text: str, config: SplitConfig) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Token spans of the text, and the cuts as (token index, kind); empty when the text fits."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= config.limit:
        return spans, []
    gaps, kinds, content, before = [], [], [], []
    for i, (a, b) in enumerate(spans):
        if i and (kind := _gap_kind(text, spans, i)):
            gaps.append(i)
            kinds.append(kind)
            before.append(len(content))
        if b - a > 3:
            content.append(text[a:b].lower())
    depths = _depths([_similarity(content, p, config.block) for p in before])
    cuts: list[tuple[int, int]] = []
    start, g = 0, 0
    while n - start + (config.overlap if cuts else 0) > config.limit:
        room = config.limit - (config.overlap if cuts else 0)
        last = start + room
        first = start + room // 2
        tail = n - room // 4
        high = tail if first < tail < last else last
        while g < len(gaps) and gaps[g] <= start:
            g += 1
        window = []
        h = g
        while h < len(gaps) and gaps[h] <= last:
            window.append(h)
            h += 1
        # the deepest valley of the window proper, else the last natural boundary that still fits
        inside = [h for h in window if first <= gaps[h] <= high]
        if inside:
            best = max(inside, key=lambda h: (round(depths[h], 6), kinds[h], gaps[h]))
        elif window:
            best = max(window, key=lambda h: gaps[h] if gaps[h] <= high else gaps[h] - n)
        else:
            best = -1
        cut, kind = (gaps[best], kinds[best]) if best >= 0 else (last, 0)
        cuts.append((cut, kind))
        start = cut
    return spans, cuts


def _blocks_between(bounds: list[tuple[int, int, str]], start: int, end: int) -> list[str]:
    return list(dict.fromkeys(b for s, e, b in bounds if s < end and e > start))


def _block_bounds(text: str, ids: list[str], lengths: list[int] | None) -> list[tuple[int, int, str]]:
    """Character range of each source block; blocks are joined by an empty line."""
    if not ids:
        return []
    if lengths is not None and len(lengths) == len(ids) and sum(lengths) + 2 * (len(ids) - 1) == len(text):
        sizes = lengths
    else:
        sizes = [len(p) for p in text.split("\n\n")]
        if len(sizes) != len(ids):  # the blocks can't be told apart: each piece may draw on any of them
            return [(0, len(text), b) for b in ids]
    bounds, at = [], 0
    for size, block in zip(sizes, ids):
        bounds.append((at, at + size, block))
        at += size + 2
    return bounds


def pieces_of(text: str, ids: list[str], lengths: list[int] | None, config: SplitConfig) -> list[tuple]:
    """The pieces of one text, in order, as rows of PIECES."""
    spans, cuts = cut_points(text, config)
    bounds = _block_bounds(text, ids, lengths)
    edges = [0, *[c for c, _ in cuts], len(spans)]
    rows = []
    for k in range(len(edges) - 1):
        first = max(0, edges[k] - (config.overlap if k else 0))
        start, end = spans[first][0], spans[edges[k + 1] - 1][1]
        cut = _KINDS[cuts[k][1]] if k < len(cuts) else "end"
        rows.append(
            (k, len(edges) - 1, text[start:end], edges[k + 1] - first, start, end, cut, _blocks_between(bounds, start, end), len(spans))
        )
    return rows


def split_oversized(
    items: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    blocks_col: str | None = "source_block_ids",
    lengths_col: str | None = None,
    config: SplitConfig = SplitConfig(),
) -> DataFrame:
    """Pieces of at most config.limit tokens for every item, one row a piece.

    Items that fit stay whole and never leave the JVM; only oversized texts go to Python, a batch at a
    time. The result has the id and the columns of PIECES; other columns of `items` are not carried, so
    none can clash. Repeated rows of one id count once (of differing texts the greatest is kept). A null
    or blank text gives one piece with 0 tokens and an empty text; rows without an id are one item.
    A text without any natural boundary is cut after the last token that fits. lengths_col may give the
    characters of each source block; it is needed only where block texts hold empty lines themselves.
    """
    cols = [
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.col(blocks_col) if blocks_col else F.lit(None)).cast("array<string>").alias("ids"),
        (F.col(lengths_col) if lengths_col else F.lit(None)).cast("array<int>").alias("lengths"),
    ]
    rows = items.select(*cols)
    # one row an id before anything else; texts are shuffled only where an id is repeated
    repeated = write_table(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")), "repeated")
    same = rows["id"].eqNullSafe(repeated["again"])
    one = rows.join(repeated, same, "left_semi").groupBy("id").agg(F.max(F.struct("text", "ids", "lengths")).alias("x")).select("id", "x.*")
    base = rows.join(repeated, same, "left_anti").unionByName(one).withColumn("source_tokens", count_tokens(F.col("text")))
    kind = dict(items.dtypes)[id_col]

    whole = (
        base.where(F.col("source_tokens") <= config.limit)
        .select(
            "id",
            F.lit(0).alias("piece_no"),
            F.lit(1).alias("n_pieces"),
            "text",
            F.col("source_tokens").alias("n_tokens"),
            F.lit(0).alias("start_char"),
            F.length("text").alias("end_char"),
            F.lit("end").alias("cut"),
            F.coalesce("ids", F.array().cast("array<string>")).alias("source_block_ids"),
            "source_tokens",
        )
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", *(part.split()[0] for part in PIECES.split(", "))]
        for batch in batches:
            rows = []
            for key, text, ids, lengths in zip(batch["id"], batch["text"], batch["ids"], batch["lengths"]):
                blocks = [b for b in ids if b is not None] if ids is not None else []
                sizes = [int(x) for x in lengths] if lengths is not None else None
                rows.extend((key, *row) for row in pieces_of(text, blocks, sizes, config))
            yield pd.DataFrame(rows, columns=names)

    over = base.where(F.col("source_tokens") > config.limit).select("id", "text", "ids", "lengths").mapInPandas(split, schema=f"id {kind}, {PIECES}")
    return whole.unionByName(over).withColumnRenamed("id", id_col)
