"""Problem 4: noise in text from scanned pages.

Method: a hidden Markov model labels the lines of every scanned block as running head, folio, body or
break (the line that ends a paragraph) from layout features: place and length of the line, its case and
ending, the lines around it, its recurrence in the document, and the place of its block on the page. It is
fitted on a sample labelled by evidence that the features don't hold: the document's title and headings,
the numbers of its pages, and how the text goes on behind a line. Lines labelled as heads or folios are
then checked exactly, and the labelled lines are reassembled into paragraphs: a break ends one, within a
block or at its end. Divided words are rejoined over intruding lines, and misread words are recognised by their
strokes: letters that scanners confuse are spelled in the same strokes, so a word that is unknown but has
the strokes of a known word is a misreading of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import write_table
from ..plans.ordered import running

#: Fixed: marks that divide a word at a line's end.
MARKS = "-‐‑¬­"
#: Fixed: the form of a Roman numeral below 400.
ROMAN = r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
#: Fixed: characters that scanners confuse, spelled in the strokes they are made of.
STROKES = {
    "à": "a", "5": "s", "+": "t", "0": "o", "ſ": "f", "6": "b", "q": "g", "c": "e",
    "l": "i", "1": "i", "ı": "i", "r": "i", "n": "ii", "h": "ii", "u": "ii", "m": "iii", "d": "ei", "w": "vv",
}
_FOLIO = re.compile(rf"^\W*(?:p(?:age|\.)?\s*)?(?:\d{{1,5}}|{ROMAN})\W*$", re.IGNORECASE)
_EDGE_NUMBER = re.compile(rf"^\W{{0,8}}(?:\d{{1,5}}|{ROMAN})\W+\w|\w\W{{1,8}}(?:\d{{1,5}}|{ROMAN})\W{{0,8}}$", re.IGNORECASE)
_END = re.compile(r"[.!?:;…][\"'”’»)\]]*\s*$")
_DIVIDED = re.compile(rf"([^\W_+]|\+)([{MARKS}])[ \t]*$")
_TOKEN = re.compile(r"(?:[^\W_]|\+)+")
_LAST = re.compile(rf"((?:[^\W_]|[+'’])+(?:-(?:[^\W_]|\+)+)*)[{MARKS}][ \t]*$")
_FIRST = re.compile(r"^\s*((?:[^\W_]|[+'’])+)")
_DIGITS = re.compile(r"\d+")
_NUMERIC = re.compile(r"^\d+[a-z]?$")

HEADER, FOLIO, BODY, BREAK = range(4)
#: Sizes of the observed features, in the order of `observe`.
_SIZES = (4, 3, 3, 4, 3, 3, 2, 2, 2)
#: What is known of a line beside its text: it is a head of its document, it recurs there, it is numbered as the page.
KNOWN, AGAIN, PAGED = 1, 2, 4
_CAPITALS = re.compile(r"\b[^\W\d_]")


@dataclass(frozen=True)
class ScanConfig:
    """sample: blocks that the line model is fitted on; gain: times that a missed head or folio costs more than one
    proposed in vain, as proposals are checked; offset_pages: pages whose numbers differ from page_number alike
    before the difference counts as the document's; part_pages: pages of a paragraph that are one row; min_count: uses that make a word known; frequent: known words held by a task.

    Words beyond `frequent` are still known: they are taken out by a join after the tasks.
    """

    sample: int = 4000
    gain: float = 10_000.0
    offset_pages: int = 3
    part_pages: int = 16
    min_count: int = 3
    frequent: int = 50_000


def strokes(word: Column) -> Column:
    """The strokes of lower-cased text, letter by letter."""
    single = {k: v for k, v in STROKES.items() if len(v) == 1}
    out = F.translate(F.lower(word), "".join(single), "".join(single.values()))
    for letter, spelled in STROKES.items():
        if len(spelled) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


_STROKE_TABLE = str.maketrans(STROKES)


def head_form(line: Column) -> Column:
    """Strokes of the letters and digits of a line, single blanks between, without a page number at either end."""
    numeral = rf"^(?:\p{{Nd}}{{1,5}}|{ROMAN})$"
    # each step is bound once, as it is referred to several times
    first, last = (lambda x: F.substring_index(x, " ", 1)), (lambda x: F.substring_index(x, " ", -1))
    behind = lambda x: F.when(F.contains(x, F.lit(" ")) & first(x).rlike(numeral), F.substring(x, F.length(first(x)) + 2, F.length(x))).otherwise(x)
    before = lambda x: F.when(F.contains(x, F.lit(" ")) & last(x).rlike(numeral), F.left(x, F.length(x) - F.length(last(x)) - 1)).otherwise(x)
    bare = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}+]+", " "))
    return strokes(_once(_once(bare, behind), before))


def document_heads(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, form) of each document's title and headings; forms of fewer than 4 strokes are left out."""
    titles = documents.select("document_id", F.col("title").alias("line"))
    heads = blocks.where(F.col("block_type").isin("TITLE", "HEADING")).select("document_id", F.regexp_replace("text", r"\s+", " ").alias("line"))
    return titles.unionByName(heads).select("document_id", head_form(F.col("line")).alias("form")).where(F.length("form") >= 4).distinct()


def known_words(blocks: DataFrame, config: ScanConfig) -> DataFrame:
    """(word, n, n_lower, form) of the words of text that wasn't scanned, lower-cased, and of the parts of hyphenated ones.

    n counts all uses, n_lower those written in lower case; names are known words that nothing is a misreading of.
    """
    joined = F.regexp_replace(F.col("text"), rf"(?<=\p{{L}})[{MARKS}][ \t]*\n(?=\p{{L}})", "")
    written = (
        blocks.where(F.col("extraction_method") != "OCR")
        .select(F.explode(F.regexp_extract_all(joined, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("word").rlike(r"^[\p{L}-]+$"))
        .select(F.lower("word").alias("word"), "n", F.when(F.col("word") == F.lower("word"), F.col("n")).otherwise(0).alias("n_lower"))
    )
    parts = written.where(F.contains("word", F.lit("-"))).select(F.explode(F.split("word", "-")).alias("word"), "n", "n_lower")
    return (
        written.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_lower").alias("n_lower"))
        .where(F.col("n") >= config.min_count)
        .withColumn("form", strokes(F.col("word")))
    )


def _case(line: str) -> int:
    """0 begins in lower case, 1 capitals or most words capitalised, 2 begins with a capital, 3 no letters."""
    first = next((c for c in line if c.isalpha()), "")
    if not first:
        return 3
    if first.islower():
        return 0
    if line.isupper():
        return 1
    begins = _CAPITALS.findall(line)
    return 1 if sum(c.isupper() for c in begins) >= 0.6 * len(begins) else 2


def observe(lines: list[str], kind: str, edge: int, again: set[int]) -> list[tuple[int, ...]]:
    """The features of each line: position, shape, ending, case, length, kind of block, edge of the page, recurrence, intrusion.

    A line intrudes if the one before it has no end and the one behind goes on in lower case.
    """
    n, longest = len(lines), max(len(x) for x in lines) or 1
    group = 0 if kind in ("HEADER", "FOOTER", "PAGE_NUMBER") else 1 if kind in ("TITLE", "HEADING") else 2
    endings = [0 if _END.search(x) else 1 if _DIVIDED.search(x) else 2 for x in lines]
    cases = [_case(x) for x in lines]
    rows = []
    for i, line in enumerate(lines):
        position = 0 if n == 1 else 1 if i == 0 else 2 if i == n - 1 else 3
        shape = 0 if len(line) <= 16 and _FOLIO.match(line) else 1 if _EDGE_NUMBER.search(line) else 2
        ratio = len(line) / longest
        intrudes = 0 < i < n - 1 and endings[i - 1] > 0 and cases[i] > 0 and cases[i + 1] == 0
        rows.append((position, shape, endings[i], cases[i], 0 if ratio < 0.5 else 1 if ratio < 0.85 else 2, group, edge, int(i + 1 in again), int(intrudes)))
    return rows


def evident(lines: list[str], kind: str, known: set[int], paged: set[int], page: int | None, follower: str | None) -> list[int]:
    """Labels of a sample block's lines by evidence that isn't observed.

    Heads are those of the document, folios have the page's number. A line ends its paragraph if text that
    begins otherwise than in lower case comes next, and within a block only if it ends short with a stop.
    follower: the text that comes next on the page, if any; behind the last of a page the stop decides.
    """
    longest = max(len(x) for x in lines) or 1
    heading = kind in ("TITLE", "HEADING")
    labels = []
    for i, line in enumerate(lines):
        if i + 1 in known and not heading:
            labels.append(HEADER)
        elif _is_page(line, i + 1, lines, page, paged):
            labels.append(FOLIO)
        else:
            last = i == len(lines) - 1
            after = follower if last else lines[i + 1]
            stop = bool(_END.search(line))
            ends = _case(after) > 0 if after else stop
            labels.append(BREAK if ends and (last or (stop and len(line) < 0.85 * longest)) else BODY)
    return labels


class LineModel:
    """Hidden Markov model over the lines of a block; features are independent given the label."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray], gain: float = 1.0) -> None:
        self.start, self.move, self.emit = np.log(start), np.log(move), [np.log(e) for e in emit]
        self.bias = np.log(np.array([gain, gain, 1.0, 1.0]))

    @classmethod
    def fit(cls, sequences: list[tuple[list[tuple[int, ...]], list[int]]], gain: float = 1.0) -> LineModel:
        """Smoothed counts over observed lines and their labels."""
        start, move = np.ones(4), np.ones((4, 4))
        emit = [np.ones((4, size)) for size in _SIZES]
        for rows, labels in sequences:
            for i, (row, label) in enumerate(zip(rows, labels)):
                if i:
                    move[labels[i - 1], label] += 1
                else:
                    start[label] += 1
                for table, value in zip(emit, row):
                    table[label, value] += 1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), [e / e.sum(axis=1, keepdims=True) for e in emit], gain)

    def label(self, sequences: list[list[tuple[int, ...]]], never: list[list[tuple[int, int]]] | None = None) -> list[list[int]]:
        """The likeliest labels of each sequence, without those (line, label) in `never`; sequences of one length are decoded together."""
        by_length: dict[int, list[int]] = {}
        for i, rows in enumerate(sequences):
            by_length.setdefault(len(rows), []).append(i)
        out: list[list[int]] = [[] for _ in sequences]
        for n, which in by_length.items():
            if not n:
                continue
            seen = np.array([sequences[i] for i in which])  # sequence, line, feature
            score = self.bias + sum(table.T[seen[:, :, k]] for k, table in enumerate(self.emit))
            if never:
                for row, i in enumerate(which):
                    for line, label in never[i]:
                        score[row, line, label] = -1e9
            best = self.start + score[:, 0]
            back = np.zeros((n, len(which), 4), np.int8)
            for t in range(1, n):
                ways = best[:, :, None] + self.move[None]
                back[t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + score[:, t]
            at = best.argmax(axis=1)
            path = np.empty((len(which), n), np.int8)
            for t in range(n - 1, -1, -1):
                path[:, t] = at
                at = back[t][np.arange(len(which)), at]
            for i, row in zip(which, path.tolist()):
                out[i] = row
        return out


def _is_page(line: str, number: int, lines: list[str], page: int | None, paged: set[int]) -> bool:
    """Whether a line in the form of a folio is a page number: Roman, the number of the page as the document counts, or alone in its block."""
    if len(line) > 16 or not _FOLIO.match(line):
        return False
    digits = _DIGITS.search(line)
    return digits is None or page is None or int(digits[0]) == page or number in paged or len(lines) == 1


def divisions(lines: list[str], labels: list[int]) -> list[tuple[int, int, str, str, str]]:
    """(line, line that goes on, mark, left part, right part) of each word divided at a line's end.

    Heads, folios and other intruding lines between the halves are passed over.
    """
    out = []
    for i, line in enumerate(lines[:-1]):
        if not _DIVIDED.search(line) or labels[i] in (HEADER, FOLIO):
            continue
        left = _LAST.search(line)
        if not left or left[1].isdigit():
            continue
        mark = _DIVIDED.search(line)[2]
        upper = left[1].isupper() and len(left[1]) > 1
        for j in range(i + 1, min(i + 4, len(lines))):
            right = _FIRST.match(lines[j])
            if labels[j] not in (HEADER, FOLIO) and right and (not right[1][0].isupper() or (upper and right[1].isupper())):
                out.append((i, j, mark, left[1], right[1]))
                break
        else:
            if mark != "-":
                out.append((i, i + 1, mark, left[1], ""))
    return out


def rejoined(lines: list[str], labels: list[int], keep: set[str]) -> tuple[list[str], list[int]]:
    """Lines with divided words made whole on their first line; a compound in `keep` gets its hyphen back."""
    lines = list(lines)
    for i, j, mark, left, right in divisions(lines, labels):
        stem = re.sub(rf"[{MARKS}][ \t]*$", "", lines[i])
        whole = f"{left}-{right}".lower()
        rest = lines[j].lstrip()[len(right) :] if right else lines[j]
        lines[i] = stem + ("-" if mark == "-" and whole in keep else "") + right
        tail = re.match(r"\S*", rest)[0]  # punctuation stays with its word
        lines[i] += tail
        lines[j] = rest[len(tail) :].lstrip()
    return lines, labels


_FACTS = "document_id string, block_id string, damage string, word string, form string"


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[column.to_pylist() for column in batch.columns])


def _marked(marks: list[int] | None, bit: int) -> set[int]:
    """The numbers of the lines of which `bit` is known; marks are 8 times the number of a line and its bits."""
    return {m >> 3 for m in marks or () if m & bit}


def _labelled(batch: pa.RecordBatch, model: LineModel) -> tuple[list[tuple], list[list[str]], list[list[int]]]:
    """Rows, lines and labels. Where a proposed head is none of its document's, or a folio isn't the page's, the block is decoded once more without that label."""
    rows = list(_rows(batch))
    texts = [r[3].split("\n") for r in rows]
    seen = [observe(x, r[2], r[4], _marked(r[5], AGAIN)) for r, x in zip(rows, texts)]
    labels = model.label(seen)
    false: dict[int, list[tuple[int, int]]] = {}
    for k, (r, lines, label) in enumerate(zip(rows, texts, labels)):
        if HEADER in label or FOLIO in label:
            known = set() if r[2] in ("TITLE", "HEADING") else _marked(r[5], KNOWN)
            paged = _marked(r[5], PAGED)
            # neither label remains possible for a line that failed as one
            for i, x in enumerate(label):
                if x in (HEADER, FOLIO):
                    head, folio = i + 1 in known, _is_page(lines[i], i + 1, lines, r[6], paged)
                    if not (head if x == HEADER else folio):
                        false.setdefault(k, []).extend([(i, HEADER)] * (not head) + [(i, FOLIO)] * (not folio))
    if false:
        # the others keep what was confirmed, and the lines around are labelled anew
        again = list(false)
        for k in again:
            false[k] += [(i, y) for i, x in enumerate(labels[k]) if x in (HEADER, FOLIO) and (i, x) not in false[k] for y in range(4) if y != x]
        open_lines = [[(i, y) for i, x in enumerate(labels[k]) if x not in (HEADER, FOLIO) for y in (HEADER, FOLIO)] for k in again]
        for k, label in zip(again, model.label([seen[k] for k in again], [false[k] + o for k, o in zip(again, open_lines)])):
            labels[k] = label
    return rows, texts, labels


def _facts(model: LineModel, frequent: frozenset[str]):
    """For mapInArrow over the scanned blocks: one row a damage, or a word or division that remains to be judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows, texts, labels = _labelled(batch, model)
            for (doc, block, *_), lines, label in zip(rows, texts, labels):
                if HEADER in label:
                    out.append((doc, block, "header", None, None))
                if FOLIO in label:
                    out.append((doc, block, "folio", None, None))
                for _, _, mark, left, right in divisions(lines, label):
                    if mark == "-":
                        out.append((doc, block, "hyphen?", (left + right).lower(), f"{left}-{right}".lower()))
                    else:
                        out.append((doc, block, "hyphen", None, None))
                whole, _ = rejoined(lines, label, frozenset())
                words = {w for line in whole for w in _TOKEN.findall(line)}
                for w in {w.lower() for w in words}:
                    if w not in frequent and not _NUMERIC.match(w) and not w.isdigit():
                        out.append((doc, block, "word?", w, w.translate(_STROKE_TABLE)))
            names = [f.split()[0] for f in _FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 5, names)

    return run


@dataclass(frozen=True)
class Scans:
    """damage: (document_id, block_id, damage); blocks: the scanned blocks as labelled; fixes: (document_id, block_id, bad, good)."""

    damage: DataFrame
    blocks: DataFrame
    fixes: DataFrame
    compounds: DataFrame
    model: LineModel


def line_marks(scanned: DataFrame, heads: DataFrame, config: ScanConfig) -> DataFrame:
    """(document_id, block_id, marks) of the blocks with a line that is a head of its document, recurs in it, or has the page's number.

    Lines are compared by the strokes of their letters, however they end. A document's own way of numbering
    is a difference to page_number that several of its pages share.
    """
    form = _once(head_form(F.col("line")), lambda f: F.when(F.length(f) >= 4, F.xxhash64(f)))
    digits = F.when(F.length("line") <= 16, F.regexp_extract("line", r"^\W*(?:[pP](?:age|\.)?\s*)?(\d{1,5})\W*$", 1))
    lines = (
        scanned.select("document_id", "block_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        # no filter on these: it would compute them once more
        .select(
            "document_id", "block_id", "page", (F.col("pos") + 1).alias("line_no"), F.when(F.length("line") > 3, form).alias("h"),
            F.try_to_number(F.nullif(digits, F.lit("")), F.lit("99999")).cast("int").alias("number"),
        )
    )
    lines = write_table(lines, "lines")
    again = lines.where("h is not null").groupBy("document_id", "h").agg(F.min("block_id").alias("a"), F.max("block_id").alias("b")).where("a <> b")
    flags = (
        heads.select("document_id", F.xxhash64("form").alias("h"), F.lit(KNOWN).alias("bits"))
        .unionByName(again.select("document_id", "h", F.lit(AGAIN).alias("bits")))
        .groupBy("document_id", "h").agg(F.bit_or("bits").alias("bits"))
    )
    offsets = lines.where("number is not null").select("document_id", "page", (F.col("number") - F.col("page")).alias("offset")).distinct()
    offsets = offsets.groupBy("document_id", "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= config.offset_pages)
    paged = lines.withColumn("offset", F.col("number") - F.col("page")).join(offsets, ["document_id", "offset"], "left_semi")
    found = lines.join(flags, ["document_id", "h"]).select("document_id", "block_id", "line_no", "bits").unionByName(paged.select("document_id", "block_id", "line_no", F.lit(PAGED).alias("bits")))
    return found.groupBy("document_id", "block_id").agg(F.collect_set((F.col("line_no") * 8 + F.col("bits")).cast("int")).alias("marks"))


def scan_damage(blocks: DataFrame, documents: DataFrame, pages: DataFrame | None = None, config: ScanConfig = ScanConfig()) -> Scans:
    """Damaged blocks of scanned pages (extraction_method OCR), one row a block and kind of damage.

    hyphen: a word divided between lines by a mark that isn't part of its spelling; chars: a misread word;
    header: a line that is the document's title or a heading, outside TITLE and HEADING blocks; folio: a
    line that is a page number. Null and empty texts have no damage; repeated rows count once; a document
    unknown to `documents` has its own headings only. `pages` (document_id, page_number, height) may give
    page heights for the edge feature; 842 is taken where it is missing.

    Candidate words and lines travel as slim rows; the only data held by every task are the line model
    and at most config.frequent words. Words are judged by joins, so nothing grows with the corpus.
    """
    text = blocks.where((F.col("extraction_method") == "OCR") & (F.length("text") > 0))
    if pages is None:
        height = text.withColumn("height", F.lit(842.0))
    else:
        one = pages.groupBy("document_id", "page_number").agg(F.max("height").alias("height"))
        height = text.join(one, ["document_id", "page_number"], "left")
    top = F.coalesce("height", F.lit(842.0))
    edge = F.coalesce((F.col("bbox.y1") <= 0.08 * top) | (F.col("bbox.y0") >= 0.93 * top), F.lit(False)).cast("int")
    scanned = height.select("document_id", "block_id", F.coalesce("block_type", F.lit("UNKNOWN")).alias("kind"), "text", edge.alias("edge"), F.col("page_number").alias("page"), "reading_order")

    marks = write_table(line_marks(scanned, document_heads(blocks, documents), config), "marks")
    marked = scanned.join(marks, ["document_id", "block_id"], "left").select("document_id", "block_id", "kind", "text", "edge", "marks", "page")

    # fitted on a bounded sample, chosen by hash
    chosen = scanned.orderBy(F.xxhash64("document_id", "block_id"), "text").limit(config.sample)
    chosen = write_table(chosen.join(marks, ["document_id", "block_id"], "left"), "sample")
    behind = scanned.select("document_id", "page", F.col("reading_order").alias("place"), F.col("text").alias("next"))
    follower = (
        chosen.select("document_id", "block_id", "page", "reading_order").join(behind, ["document_id", "page"]).where("place > reading_order")
        .groupBy("document_id", "block_id").agg(F.min_by(F.substring("next", 1, 40), F.struct("place", "next")).alias("follower"))
    )
    sequences = []
    for r in chosen.join(follower, ["document_id", "block_id"], "left").select("text", "kind", "edge", "marks", "page", "follower").collect():
        lines = r.text.split("\n")
        labels = evident(lines, r.kind, _marked(r.marks, KNOWN), _marked(r.marks, PAGED), r.page, r.follower)
        sequences.append((observe(lines, r.kind, r.edge, _marked(r.marks, AGAIN)), labels))
    model = LineModel.fit(sequences, config.gain)

    lexicon = write_table(known_words(blocks, config), "lexicon")
    frequent = frozenset(r.word for r in lexicon.orderBy(F.desc("n"), "word").limit(config.frequent).select("word").collect())
    facts = write_table(marked.mapInArrow(_facts(model, frequent), _FACTS), "facts")

    # an unknown word with the strokes of a known one is misread
    words = facts.where(F.col("damage") == "word?").select("document_id", "block_id", "word", "form")
    unknown = words.select("word", "form").distinct().join(lexicon, "word", "left_anti")
    meant = lexicon.where(~F.contains("word", F.lit("-")) & (F.col("n_lower") >= config.min_count)).groupBy("form").agg(F.max_by("word", F.struct("n", "word")).alias("good"))
    misread = unknown.join(meant, "form").select("word", "good")
    fixes = words.join(misread, "word").select("document_id", "block_id", F.col("word").alias("bad"), "good")

    # a hyphen belongs to the word if its compound is used more often than the word without it
    divided = facts.where(F.col("damage") == "hyphen?").select(
        "document_id", "block_id", F.col("form").alias("compound"), strokes(F.col("word")).alias("joined"), strokes(F.col("form")).alias("spelled")
    )
    uses = lexicon.groupBy("form").agg(F.sum("n").alias("n"))
    judged = (
        divided.join(uses.select(F.col("form").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
        .join(uses.select(F.col("form").alias("spelled"), F.col("n").alias("n_compound")), "spelled", "left")
        .withColumn("own", F.coalesce("n_compound", F.lit(0)) > F.coalesce("n_joined", F.lit(0)))
    )
    damage = (
        facts.where(F.col("damage").isin("header", "folio", "hyphen")).select("document_id", "block_id", "damage")
        .unionByName(judged.where(~F.col("own")).select("document_id", "block_id", F.lit("hyphen").alias("damage")))
        .unionByName(fixes.select("document_id", "block_id", F.lit("chars").alias("damage")))
        .distinct()
    )
    compounds = judged.where("own").select("document_id", "block_id", "compound")
    return Scans(damage, marked, fixes, compounds, model)


def _cased(good: str, bad: str) -> str:
    letters = [c for c in bad if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return good.upper()
    return good.capitalize() if letters and bad[0].isupper() else good


def _repair(model: LineModel):
    """For mapInArrow over labelled blocks with their fixes: the paragraphs of each, and whether the last goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, labels = _labelled(pa.RecordBatch.from_arrays(batch.columns[:7], names=list("abcdefg")), model)
            bad, good, keep = (batch.column(k).to_pylist() for k in (7, 8, 9))
            out = []
            for r, lines, label, b, g, k in zip(rows, texts, labels, bad, good, keep):
                fix = dict(zip(b or (), g or ()))
                lines, label = rejoined(lines, label, frozenset(k or ()))
                pieces, closed = [], True
                for x, y in zip(lines, label):
                    if y in (HEADER, FOLIO) or not x.strip():
                        closed = closed or (y == BREAK and not x.strip())
                        continue
                    if closed:
                        pieces.append([])
                    pieces[-1].append(x.strip())
                    closed = y == BREAK
                done = []
                for piece in pieces:
                    text = " ".join(piece)
                    if fix:
                        text = _TOKEN.sub(lambda m: _cased(fix[w], m[0]) if (w := m[0].lower()) in fix else m[0], text)
                    done.append(re.sub(r"\s+", " ", text))
                out.append((r[0], r[1], done, not closed))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], ["document_id", "block_id", "pieces", "open"])

    return run


def repaired_pieces(scans: Scans) -> DataFrame:
    """(document_id, block_id, pieces, open) of each scanned block: its paragraphs, without heads and folios and with words rejoined and corrected, and whether the last isn't ended."""
    fix = scans.fixes.groupBy("document_id", "block_id").agg(F.collect_set(F.struct("bad", "good")).alias("fix"))
    keep = scans.compounds.groupBy("document_id", "block_id").agg(F.collect_set("compound").alias("keep"))
    ready = (
        scans.blocks.join(fix, ["document_id", "block_id"], "left").join(keep, ["document_id", "block_id"], "left")
        .select("document_id", "block_id", "kind", "text", "edge", "marks", "page", F.col("fix.bad").alias("bad"), F.col("fix.good").alias("good"), "keep")
    )
    return ready.mapInArrow(_repair(scans.model), "document_id string, block_id string, pieces array<string>, open boolean").dropDuplicates(["document_id", "block_id"])


def repaired_blocks(scans: Scans) -> DataFrame:
    """(document_id, block_id, text) of each scanned block, repaired, on one line."""
    return repaired_pieces(scans).select("document_id", "block_id", F.array_join("pieces", " ").alias("text"))


def paragraphs(scans: Scans, blocks: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Continuous paragraphs of the scanned text: document_id, paragraph_no, part_no, first_page, last_page, block_ids, text.

    A line labelled as a break ends a paragraph. One that isn't ended with its block goes on in the next
    body block of the document that begins in lower case, over page ends and the furniture between. Empty
    blocks and furniture types are left out; titles and headings stand alone. Of repeated rows of a block
    one is used. A paragraph over very many pages is given in parts of part_pages pages, so no row holds an
    unbounded text; order within a document is followed without a task that holds all of it.
    """
    place = (
        blocks.where(F.col("extraction_method") == "OCR")
        .groupBy("document_id", "block_id").agg(F.min(F.struct("page_number", "reading_order", "block_type")).alias("p"))
        .select("document_id", "block_id", "p.*")
    )
    body = (
        repaired_pieces(scans).where(F.size("pieces") > 0).join(place, ["document_id", "block_id"])
        .where(~F.coalesce(F.col("block_type").isin("HEADER", "FOOTER", "PAGE_NUMBER"), F.lit(False)))
        .withColumn("alone", F.coalesce(F.col("block_type").isin("TITLE", "HEADING", "LIST", "TABLE", "CAPTION", "FIGURE"), F.lit(False)))
        .select("document_id", "page_number", "reading_order", "block_id", "alone", "pieces", (F.col("open") & ~F.col("alone")).alias("open"))
    )
    order = ["page_number", "reading_order", "block_id"]
    body = running(body, ["document_id"], order, {"open_before": ("lag", F.col("open"))})
    goes_on = F.coalesce("open_before", F.lit(False)) & ~F.col("alone") & F.get("pieces", F.lit(0)).rlike(r"^\p{Ll}")
    begun = F.size("pieces") - goes_on.cast("int")  # paragraphs that begin in the block
    body = running(body.withColumn("goes_on", goes_on), ["document_id"], order, {"n": ("sum", begun)})
    first = F.col("n") - F.size("pieces") + 1
    pieces = body.select("document_id", "page_number", "reading_order", "block_id", first.alias("first"), F.posexplode("pieces").alias("k", "text"))
    return (
        pieces.withColumn("paragraph_no", F.col("first") + F.col("k"))
        .groupBy("document_id", "paragraph_no", F.floor(F.col("page_number") / config.part_pages).alias("part_no"))
        .agg(
            F.min("page_number").alias("first_page"),
            F.max("page_number").alias("last_page"),
            F.array_sort(F.collect_list(F.struct("page_number", "reading_order", "block_id", "text"))).alias("x"),
        )
        .select("document_id", "paragraph_no", "part_no", "first_page", "last_page", F.col("x.block_id").alias("block_ids"), F.array_join("x.text", " ").alias("text"))
    )
