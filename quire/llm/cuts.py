"""Problem 8: text cut off by field limits.

Method: near copies are found through min-hash banding over word shingles and verified; the ends of the
pairs are aligned, and the copy whose alignment ends early, inside a word or sentence of the other, was
cut. Records without such a copy are scored by the terminality of their closing word: a word with a full
stop closes a text unless it is an abbreviation that hardly ever closes a line, and a word without a stop
closes it as often as lines with that word in that place end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.lineage import write_table
from .minhash import LEADS, SHINGLED, BandConfig, lead_banding, shingling, word_hashes

#: Fixed patterns: a stop with closing marks behind it, and the units of a line's form.
STOP = r"[.!?…][\"'”’»)\]]*\s*$"
UNIT = r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*|\p{N}+|[^\s\p{L}\p{N}]"
_STOPPED = re.compile(r"[.!?…\"'”’»)\]]\s*$")
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class CutConfig:
    """similarity: share of the shorter text's five-word shingles that the longer must hold.

    bands: over the leading 8, 16, 32 ... shingles from least_lead and the whole set; a text cut short shares
    little of the union, but its leading part, so it meets the whole text at its own longest lead.
    tail: words before the close that are aligned. slack: most edits among them.
    form_units: a longer line is prose. closing: least terminality of a close. backoff: lines that the
    rate of a word's form counts as beside those that hold the word in that place. abbreviation: a word
    with a full stop that closes a smaller share of its lines is no close.
    """

    width: int = 5
    similarity: float = 0.8
    bands: BandConfig = BandConfig(rows=3, bands=12)
    least_lead: int = 8
    tail: int = 24
    slack: float = 0.35
    form_units: int = 14
    closing: float = 0.1
    min_forms: int = 3
    backoff: float = 100.0
    abbreviation: float = 0.02
    min_stops: int = 20


def _near(a: str, b: str) -> bool:
    """Whether two words differ by one edit at most: a letter changed, left out, added, or two adjacent ones swapped."""
    if a == b:
        return True
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def aligned_end(tail: list[str], text: list[str], expected: int) -> tuple[int, int]:
    """(edits, end): the part of `text` that differs from `tail` by the fewest word edits ends before text[end].

    Approximate matching by dynamic programming, a row at a time: the beginning in `text` is free. Of
    equally good ends the one nearest to `expected` is taken.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(text))}
    seen = np.array([number[w] for w in text], np.int64)
    step = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(tail):
        after = np.empty_like(row)
        after[0] = i + 1
        after[1:] = np.minimum(row[1:] + 1, row[:-1] + (seen != number.get(w, -1)))
        row = np.minimum.accumulate(after - step) + step
    best = np.flatnonzero(row == row.min())
    return int(row.min()), int(best[np.abs(best - expected).argmin()])


def _ends_early(short: str, long: str, tail: int = 24, slack: float = 0.35) -> bool:
    """Whether `short` stops inside a word or sentence of `long`, where that goes on.

    The words before the last are aligned with `long`, edits allowed; the last word is compared with what
    follows there, and the characters behind it tell how it goes on.
    """
    body = short.rstrip("\ufffd")
    if _STOPPED.search(body):
        return False
    ours, theirs = list(_WORD.finditer(body)), list(_WORD.finditer(long))
    if not ours or not theirs:
        return False
    last = ours[-1][0].lower()
    before = [m[0].lower() for m in ours[-tail - 1 : -1]]
    text = [m[0].lower() for m in theirs]
    edits, at = aligned_end(before, text, len(ours) - 1)
    if edits > slack * len(before) or at >= len(text):
        return False  # no place, or both end here
    there = text[at]
    inside = ours[-1].end() == len(body) and len(there) > len(last)  # the word itself may be cut
    if last != there:
        if inside and there.startswith(last):
            return True
        if len(last) < 4 or not _near(last, there):
            return inside and len(last) >= 4 and _near(last, there[: len(last)])
    rest = long[theirs[at].end() :].lstrip(" ")
    # it goes on in the same line without a stop
    return rest[:1] not in (".", "!", "?", "…", "\n", "")


def early_ends(texts: DataFrame, config: CutConfig = CutConfig()) -> DataFrame:
    """(tid) of the texts that end early beside a near copy; texts: tid long, text, all of them different.

    The shorter of two meets the longer at its longest lead or by the whole set, and is verified by the
    share of its shingles that the longer holds.
    """
    hashed = texts.select("tid", word_hashes(words(F.col("text"))).alias("w"))
    base = write_table(hashed.mapInArrow(shingling(config.width), SHINGLED).where(F.size("grams") >= config.least_lead), "shingles")
    own = base.mapInArrow(lead_banding(config.bands, config.least_lead, every=False), LEADS)
    all_leads = base.mapInArrow(lead_banding(config.bands, config.least_lead, every=True), LEADS)
    a, b = own.alias("a"), all_leads.alias("b")
    longer = (F.col("b.size") > F.col("a.size")) | ((F.col("b.size") == F.col("a.size")) & (F.col("a.tid") < F.col("b.tid")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & longer).select(F.col("a.tid").alias("x"), F.col("b.tid").alias("y")).distinct()
    left, right = base.select(F.col("tid").alias("x"), F.col("grams").alias("gx")), base.select(F.col("tid").alias("y"), F.col("grams").alias("gy"))
    held = F.size(F.array_intersect("gx", "gy")) >= config.similarity * F.size("gx")
    near = write_table(pairs.join(left, "x").join(right, "y").where(held).select("x", "y"), "copies")
    both = near.join(texts.select(F.col("tid").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("tid").alias("y"), F.col("text").alias("ty")), "y")
    both = both.select("x", "y", "tx", "ty")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            early = set()
            for x, y, tx, ty in zip(*[column.to_pylist() for column in batch.columns]):
                if _ends_early(tx, ty, config.tail, config.slack):
                    early.add(x)
                if _ends_early(ty, tx, config.tail, config.slack):
                    early.add(y)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(early), pa.int64())], ["tid"])

    return both.mapInArrow(align, "tid long").distinct()


def line_units(line: Column, units: int) -> Column:
    """The first units + 1 words, numbers and other characters of a line; the rest of a long line is not taken apart."""
    begin = F.regexp_extract(line, rf"^(?:\s*+(?:{UNIT})){{0,{units + 1}}}+", 0)
    return F.regexp_extract_all(begin, F.lit(UNIT), F.lit(0))


def line_form(line: Column, units: int) -> Column:
    """Up to units + 1 signs of a line: X an initial, A a capitalised word, a another word, 9 a number, else the character."""
    sign = lambda u: (
        F.when(u.rlike(r"^\p{N}"), "9").when(u.rlike(r"^\p{Lu}$"), "X").when(u.rlike(r"^\p{Lu}"), "A").when(u.rlike(r"^\p{L}"), "a").otherwise(u)
    )
    return F.transform(line_units(line, units), sign)


def closing_words(documents: DataFrame, asked: DataFrame, config: CutConfig = CutConfig()) -> DataFrame:
    """(form, word, n_begin, n_end): lines that begin with a form whose last unit is `word`, and how many of them end there.

    Forms and words are 64-bit hashes; only the forms in asked (form) are counted, over the lines of all documents.
    """
    units = F.lit(config.form_units)
    # the units are bound once and the line's beginnings are taken from them
    begin = lambda x: F.transform(
        F.filter(F.sequence(F.lit(1), units), lambda k: k <= F.size(x["form"])),
        lambda k: F.struct(
            F.xxhash64(F.slice(x["form"], 1, k)).alias("form"), F.xxhash64(F.element_at(x["units"], k)).alias("word"), (k == F.size(x["form"])).cast("long").alias("end")
        ),
    )
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line"))
    split = F.array(F.struct(line_form(F.col("line"), config.form_units).alias("form"), line_units(F.col("line"), config.form_units).alias("units")))
    begins = lines.select(F.explode(F.flatten(F.transform(split, begin))).alias("x")).select("x.*")
    return begins.join(asked, "form", "left_semi").groupBy("form", "word").agg(F.count(F.lit(1)).alias("n_begin"), F.sum("end").alias("n_end"))


def abbreviations(documents: DataFrame, config: CutConfig = CutConfig()) -> DataFrame:
    """(word, rate) of the words with a full stop behind that hardly ever close a line."""
    parts = documents.select(F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit("."))).select(F.split("line", r"\.").alias("parts"))
    # each part but the last has a stop behind it; the last stop closes the line if only closing marks follow
    word = lambda part, i: F.struct(
        F.regexp_extract(F.substring_index(part, " ", -1), r"(\p{L}+)$", 1).alias("word"),
        ((i == F.size("parts") - 2) & F.get("parts", i + 1).rlike(r"^[\"'”’»)\]]*\s*$")).cast("long").alias("close"),
    )
    stops = parts.select(F.explode(F.transform(F.slice("parts", 1, F.size("parts") - 1), word)).alias("x")).select("x.*").where("word <> ''")
    counted = stops.groupBy("word").agg(F.count(F.lit(1)).alias("n_stop"), F.sum("close").alias("n_close"))
    rated = counted.select("word", "n_stop", (F.col("n_close") / F.col("n_stop")).alias("rate"))
    return rated.where((F.col("n_stop") >= config.min_stops) & (F.col("rate") < config.abbreviation)).select("word", "rate")


def cut_documents(documents: DataFrame, config: CutConfig = CutConfig()) -> DataFrame:
    """Every document with is_cut, how ('copy' or 'close', null if whole), and the terminality of its close.

    documents: doc_id, text, source; other columns are not read. Columns: doc_id, source, is_cut, how,
    terminality in 0..1. Null and blank texts are whole (nothing was begun); repeated rows of a doc_id
    count once (the greatest text). Equal texts under several ids are one text, which is compared with
    the others once. If two copies stop at one place, their close decides. All statistics are taken over
    all documents, each different text once.
    """
    rows = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    # texts are shuffled only where an id is repeated
    repeated = write_table(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    one = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "source")).alias("x")).select("doc_id", "x.*")
    base = rows.join(repeated, "doc_id", "left_anti").unionByName(one).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    first = base.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    again = write_table(base.select("doc_id", "h1", "h2").join(first, ["h1", "h2"]).where("doc_id <> first").select("doc_id"), "again")
    different = base.join(again, "doc_id", "left_anti")
    early = early_ends(different.select(F.col("doc_id").alias("tid"), "text"), config)
    early = different.select(F.col("doc_id").alias("tid"), "h1", "h2").join(early, "tid").select("h1", "h2", F.lit(True).alias("early"))

    last = F.element_at(F.split(F.rtrim(F.regexp_replace("text", r"\s+$", "")), "\n"), -1)
    close = base.select("doc_id", "source", "h1", "h2", F.col("text").rlike(r"^\s*$").alias("blank"), F.col("text").rlike(STOP).alias("stop"), last.alias("last"))
    form = line_form(F.col("last"), config.form_units)
    close = write_table(
        close.select(
            "doc_id", "source", "h1", "h2", "blank", "stop",
            F.col("last").rlike(r"\x{FFFD}$").alias("broken"),
            # without a word before the stop each document has a key of its own, so that none is hot
            F.coalesce(F.when(F.col("stop"), F.regexp_extract("last", r"([\p{L}]+)\.[\"'”’»)\]]*\s*$", 1)), F.lit("")).alias("stopped"),
            F.when(~F.col("stop"), F.xxhash64(form)).alias("form"),
            F.when(~F.col("stop"), F.xxhash64(F.get(line_units(F.col("last"), config.form_units), F.size(form) - 1))).alias("word"),
        ),
        "closes",
    )
    keyed = close.where("stop").withColumn("key", F.when(F.col("stopped") != "", F.col("stopped")).otherwise(F.concat(F.lit("."), "doc_id")))
    stopped = keyed.join(abbreviations(base, config).withColumnRenamed("word", "key"), "key", "left").select("doc_id", "source", "h1", "h2", F.coalesce("rate", F.lit(1.0)).alias("terminality"))

    open_ = close.where("not stop")
    counted = write_table(closing_words(different, open_.select("form").distinct(), config), "closing")
    forms = counted.groupBy("form").agg(F.sum("n_begin").alias("f_begin"), F.sum("n_end").alias("f_end"))
    m = F.lit(config.backoff)
    # the record's own line is no evidence for itself
    rate = (F.col("n_end") - 1 + m * F.col("f_end") / F.col("f_begin")) / (F.col("n_begin") - 1 + m)
    score = F.when(F.col("blank"), 1.0).when(F.col("broken"), 0.0).when(F.col("f_end") >= config.min_forms, rate).otherwise(0.0)
    unstopped = open_.join(forms, "form", "left").join(counted, ["form", "word"], "left").select("doc_id", "source", "h1", "h2", score.alias("terminality"))

    scored = stopped.unionByName(unstopped).join(early, ["h1", "h2"], "left").withColumn("early", F.coalesce("early", F.lit(False)))
    cut = F.col("early") | (F.col("terminality") < config.closing)
    return scored.select(
        "doc_id", "source", cut.alias("is_cut"), F.when(F.col("early"), "copy").when(cut, "close").alias("how"), F.round("terminality", 6).alias("terminality")
    )


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, hyphens; 'unknown' for null or blank."""
    name = F.lower(F.trim(F.replace(source, F.lit("_"), F.lit("-"))))
    return F.coalesce(F.when(name != "", name), F.lit("unknown"))


def cut_rates(cut: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, rate) over the spellings of each source."""
    return (
        cut.groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("is_cut").alias("n_cut"))
        .withColumn("rate", F.round(F.col("n_cut") / F.col("n_documents"), 6))
    )
