"""Pages, blocks and sections: classification, reading order, layout, sections, token windows and chunk checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, one_line
from ..plans.ordered import running

FURNITURE = ("HEADER", "FOOTER", "PAGE_NUMBER")
ANCHORS = ("TITLE", "HEADING")
#: Fixed: marks of list lines, words of captions. The thresholds of the rules below are fixed values too.
BULLET = r"^\s*([-*•]|\d+[.)])\s+"
CAPTION = r"(?i)(figure|fig\.|plate|table)"


def page_class(length: Column, blocks: Column, images: Column, ratio: Column) -> Column:
    """Class of a page by its signals, the first rule that holds."""
    return (
        F.when((length == 0) & (images == 0), "EMPTY")
        .when((length < 20) & (images > 0), "OCR_REQUIRED")
        .when(length < 20, "EMPTY")
        .when(blocks == 0, "SUSPICIOUS")
        .when((images > 0) & (ratio > 0.1) & (length < 500), "HYBRID")
        .otherwise("NATIVE")
    )


def page_signals(blocks: DataFrame) -> DataFrame:
    """(document_id, page_number, text_length, n_blocks, avg_font_size): characters that are no white space, text blocks, mean font size."""
    return blocks.groupBy("document_id", "page_number").agg(
        F.coalesce(F.sum(F.length(F.regexp_replace("text", r"\s", ""))), F.lit(0)).alias("text_length"),
        F.count_if(F.length("text") > 0).alias("n_blocks"),
        F.round(F.avg("font_size"), 4).alias("avg_font_size"),
    )


def page_pictures(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, page_number, n_images, ratio): FIGURE blocks of a page and their share of its area, at most 1. pages: document_id, page_number, width, height."""
    box = F.col("bbox")
    area = F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))
    own = blocks.where(F.col("block_type") == "FIGURE").groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n_images"), F.sum(area).alias("area"))
    sized = own.join(pages, ["document_id", "page_number"], "left")
    ratio = F.coalesce(F.least(F.lit(1.0), F.col("area") / F.nullif(F.col("width") * F.col("height"), F.lit(0.0))), F.lit(0.0))
    return sized.select("document_id", "page_number", "n_images", ratio.alias("ratio"))


def block_evidence(text: Column, font: Column, body: Column, y0: Column, y1: Column, height: Column) -> dict[str, Column]:
    """What a block's type and grade are decided by; blank lines don't count as lines."""
    bare = F.trim(text, F.lit(" \n\t\r"))
    filled = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")) != "")
    return {
        "n": F.length(bare), "lines": F.size(filled), "bulleted": F.size(F.filter(filled, lambda x: x.rlike(BULLET))),
        "number": bare.rlike(r"(?i)^(page\s+)?\d+$") | (bare.rlike(r"(?i)^[ivxlcdm]+$") & (F.length(bare) <= 8)),
        "top": F.coalesce(y1 <= 0.08 * height, F.lit(False)), "bottom": F.coalesce(y0 >= 0.93 * height, F.lit(False)),
        "near_top": F.coalesce(y0 < 0.18 * height, F.lit(False)), "ratio": F.when((font > 0) & (body > 0), font / body),
        "caption": bare.rlike(CAPTION), "ended": bare.rlike(r"[.!?:;”’'\"]$"),
    }


def block_kind(text: Column, font: Column, body: Column, y0: Column, y1: Column, height: Column) -> Column:
    """Type of a block by place, size and form, the first rule that holds; UNKNOWN without enough evidence."""
    e = block_evidence(text, font, body, y0, y1, height)
    edge, n, lines, ratio = e["top"] | e["bottom"], e["n"], e["lines"], e["ratio"]
    return (
        F.when(edge & e["number"], "PAGE_NUMBER")
        .when(edge & (n <= 80), F.when(e["bottom"], "FOOTER").otherwise("HEADER"))
        .when(edge, "UNKNOWN")
        .when((e["bulleted"] >= 2) & (e["bulleted"] >= lines - 1), "LIST")
        .when((ratio >= 1.35) & (n <= 150) & (lines <= 3), F.when(e["near_top"], "TITLE").otherwise("HEADING"))
        .when((ratio >= 1.15) & (n <= 120) & (lines <= 2), "HEADING")
        .when((ratio <= 0.85) & (n <= 200) & (lines <= 2) & e["caption"], "CAPTION")
        .when((lines >= 2) | e["ended"] | (n >= 200), "PARAGRAPH")
        .when((n >= 40) & (ratio.isNull() | ((ratio > 0.85) & (ratio < 1.15))), "PARAGRAPH")
        .otherwise("UNKNOWN")
    )


def quality_score(kind: Column, text: Column, font: Column, body: Column, y0: Column, y1: Column, height: Column) -> Column:
    """Grade of the evidence for a block's type; null for UNKNOWN."""
    e = block_evidence(text, font, body, y0, y1, height)
    return (
        F.when(kind == "UNKNOWN", F.lit(None).cast("double"))
        .when(e["top"] | e["bottom"], 0.9)
        .when(kind.isin(*ANCHORS), F.when(e["ratio"] >= 1.35, 0.9).otherwise(0.7))
        .when(kind == "LIST", 0.85).when(kind == "CAPTION", 0.6)
        .when((kind == "PARAGRAPH") & ((e["lines"] >= 2) | (e["n"] >= 200)), 0.7)
        .otherwise(0.5)
    )


def upper_median_size(blocks: DataFrame) -> DataFrame:
    """(document_id, page_number, size): the upper median of the font sizes of each page's blocks."""
    sized = blocks.where(F.col("font_size").isNotNull())
    return sized.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list("font_size")).alias("x")).select(
        "document_id", "page_number", F.get("x", F.floor(F.size("x") / 2).cast("int")).alias("size")
    )


def line_rects(blocks: DataFrame) -> DataFrame:
    """(document_id, page_number, block_id, line_no, x0, y0, x1, y1): a block's box cut into its lines, of equal height."""
    lines = blocks.where(F.col("bbox").isNotNull() & (F.length("text") > 0)).select("document_id", "page_number", "block_id", "bbox", F.split("text", "\n").alias("l"))
    step = (F.col("bbox.y1") - F.col("bbox.y0")) / F.size("l")
    at = lambda k: F.round(F.col("bbox.y0") + step * k, 4)
    rects = lines.withColumn("line_no", F.explode(F.sequence(F.lit(1), F.size("l"))))
    return rects.select("document_id", "page_number", "block_id", "line_no", "bbox.x0", at(F.col("line_no") - 1).alias("y0"), "bbox.x1", at(F.col("line_no")).alias("y1"))


def median_body_size(blocks: DataFrame) -> DataFrame:
    """(document_id, body_size): median font size, each block counted once for every 100 characters, at least 1, at most 5 times."""
    weight = F.least(F.greatest(F.floor(F.length("text") / 100), F.lit(1)), F.lit(5)).cast("int")
    sizes = blocks.where(F.col("font_size").isNotNull() & F.col("text").isNotNull())
    return sizes.select("document_id", F.explode(F.array_repeat("font_size", weight)).alias("s")).groupBy("document_id").agg(F.median("s").alias("body_size"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Place of each block on its page by top, then left edge, both to one digit; blocks of two columns go left column first.

    blocks: document_id, page_number, block_id, bbox, layout, width.
    """
    middle = F.col("width") / 2
    left = (F.col("bbox.x1") <= middle) | ((F.col("bbox.x0") + F.col("bbox.x1")) / 2 < middle)
    side = F.when((F.col("layout") == "TWO_COLUMN") & ~left, 1).otherwise(0)
    order = Window.partitionBy("document_id", "page_number").orderBy(side, F.round("bbox.y0", 1), F.round("bbox.x0", 1), "block_id")
    return blocks.withColumn("place", F.row_number().over(order))


def sections(blocks: DataFrame) -> DataFrame:
    """Section number, heading and heading path of each content block: the latest title or heading before it in its document.

    blocks: document_id, page_number, reading_order, block_id, block_type, text. Furniture is left out;
    blocks before the first heading are in section 0, without a heading. heading_path has two levels: the
    latest title, and the latest heading since. Long documents are followed without a task that holds one.
    """
    anchor = F.coalesce(F.col("block_type").isin(*ANCHORS), F.lit(False))
    content = blocks.where(~F.coalesce(F.col("block_type").isin(*FURNITURE), F.lit(False)))
    title, name = F.col("block_type") == "TITLE", one_line(F.col("text"))
    level = F.when(title, F.struct(F.lit(None).cast("string").alias("h"))).when(F.col("block_type") == "HEADING", F.struct(name.alias("h")))
    out = running(
        content, ["document_id"], ["page_number", "reading_order", "block_id"],
        {"section_no": ("sum", anchor.cast("int")), "heading": ("last", F.when(anchor, name)), "__title": ("last", F.when(title, name)), "__level": ("last", level)},
    )
    return out.withColumn("heading_path", F.array_compact(F.array("__title", "__level.h"))).drop("__title", "__level")


def page_runs(blocks: DataFrame) -> DataFrame:
    """(document_id, run_no, page_number, n_blocks): runs of consecutive blocks of one page in reading order."""
    order = ["reading_order", "block_id"]
    rows = running(blocks.select("document_id", "page_number", *order), ["document_id"], order, {"before": ("lag", F.col("page_number"))})
    new = F.coalesce((F.col("before") != F.col("page_number")).cast("int"), F.lit(1))
    numbered = running(rows.withColumn("new", new), ["document_id"], order, {"run_no": ("sum", F.col("new"))})
    return numbered.groupBy("document_id", "run_no", "page_number").agg(F.count(F.lit(1)).alias("n_blocks"))


def token_windows(items: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """(id, window_no, n_tokens, text): windows of `size` tokens, each `overlap` into the last, until the end is covered."""
    step = max(1, size - overlap)
    tokens = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(TOKEN), F.lit(0))
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step, F.lit(step)))
    windows = F.transform(F.array(tokens), lambda t: F.coalesce(F.transform(starts(F.size(t)), lambda i: F.slice(t, i + 1, size)), F.array().cast("array<array<string>>")))
    flat = items.select(F.col(id_col).alias("id"), F.posexplode(F.element_at(windows, 1)).alias("window_no", "w"))
    return flat.select("id", "window_no", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("text"))


def text_area(blocks: DataFrame) -> DataFrame:
    """blocks with n, area_x0 and area_x1: number and extent of the boxes of each page; pages of under three boxes or no width are left out."""
    page = Window.partitionBy("document_id", "page_number")
    n, low, high = F.count("bbox").over(page), F.min("bbox.x0").over(page), F.max("bbox.x1").over(page)
    boxed = blocks.where(F.col("bbox").isNotNull()).withColumn("n", n).withColumn("area_x0", low).withColumn("area_x1", high)
    return boxed.where((F.col("n") >= 3) & (F.col("area_x1") - F.col("area_x0") > 1))


def occupancy(blocks: DataFrame, bins: int = 50) -> DataFrame:
    """(document_id, page_number, bin, coverage): share of a page's boxes that cover each vertical strip of its text area."""
    strip = lambda x: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("area_x0")) / (F.col("area_x1") - F.col("area_x0")) * bins))).cast("int")
    return (
        text_area(blocks).withColumn("low", strip("bbox.x0")).withColumn("high", F.greatest("low", strip("bbox.x1")))
        .select("document_id", "page_number", "n", F.explode(F.sequence("low", "high")).alias("bin"))
        .groupBy("document_id", "page_number", "bin").agg(F.round(F.count(F.lit(1)) / F.max("n"), 6).alias("coverage"))
    )


def gutters(covered: DataFrame, bins: int = 50) -> DataFrame:
    """Widest run of thinly covered strips of each page with well covered strips beside: document_id, page_number, first_bin, last_bin.

    covered: the result of `occupancy`; strips without a box count as 0. At most 0.25 of the boxes cross a
    gutter, at least 0.45 cover a strip within 10 on either side; the page's first and last strip are
    no gutter, and a gutter is at least two strips wide. The leftmost wins among equals.
    """
    pages = covered.select("document_id", "page_number").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = pages.join(covered, ["document_id", "page_number", "bin"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    page = Window.partitionBy("document_id", "page_number").orderBy("bin")
    before, after = F.max("coverage").over(page.rowsBetween(-10, -1)), F.max("coverage").over(page.rowsBetween(1, 10))
    thin = (
        full.withColumn("left", before).withColumn("right", after)
        .where((F.col("coverage") <= 0.25) & F.col("bin").between(1, bins - 2))
        .withColumn("island", F.col("bin") - F.row_number().over(page))
    )
    runs = thin.groupBy("document_id", "page_number", "island").agg(
        F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"),
        F.min_by("left", "bin").alias("left"), F.max_by("right", "bin").alias("right"),
    )
    good = runs.where((F.col("left") >= 0.45) & (F.col("right") >= 0.45) & (F.col("last_bin") > F.col("first_bin")))
    best = Window.partitionBy("document_id", "page_number").orderBy(F.desc(F.col("last_bin") - F.col("first_bin")), "first_bin")
    return good.withColumn("r", F.row_number().over(best)).where("r = 1").select("document_id", "page_number", "first_bin", "last_bin")


def layouts(blocks: DataFrame, bins: int = 50) -> DataFrame:
    """(document_id, page_number, layout, layout_confidence, first_bin, last_bin) of every page with blocks.

    Without a gutter a page is SINGLE_COLUMN. With one it is MIXED if under 0.15 of the boxes lie on either
    side or at least 0.25 lie on neither, else TWO_COLUMN. The gutter is taken from the left edge of its
    first strip to that of its last. Pages too bare for `text_area` are UNKNOWN.
    """
    key = ["document_id", "page_number"]
    covered = occupancy(blocks, bins)
    found = gutters(covered, bins)
    # strips without a box are absent and count as 0
    most = covered.join(found, key).where((F.col("bin") >= F.col("first_bin")) & (F.col("bin") < F.col("last_bin"))).groupBy(*key).agg(F.max("coverage").alias("most"))
    edge = lambda b: F.col("area_x0") + F.col(b) * (F.col("area_x1") - F.col("area_x0")) / bins
    left, right = F.col("bbox.x1") <= edge("first_bin"), F.col("bbox.x0") >= edge("last_bin")
    share = lambda test: F.count_if(test) / F.count(F.lit(1))
    sides = (
        text_area(blocks).join(found, key, "left").groupBy(*key, "first_bin", "last_bin")
        .agg(share(left).alias("left"), share(right).alias("right"), share(~(left | right)).alias("crossing"))
    )
    calm = F.round(F.least(F.lit(0.95), 0.6 + (1 - F.coalesce("most", F.lit(0.0))) * 0.35), 2)
    uneven, crossed = (F.col("left") < 0.15) | (F.col("right") < 0.15), F.col("crossing") >= 0.25
    kind = lambda bare, single, lone, mixed, two: (
        F.when(F.col("crossing").isNull(), bare).when(F.col("first_bin").isNull(), single).when(uneven, lone).when(crossed, mixed).otherwise(two)
    )
    pages = blocks.groupBy(*key).agg(F.count("bbox").alias("n_boxes"))
    return pages.join(sides, key, "left").join(most, key, "left").select(
        *key, kind("UNKNOWN", "SINGLE_COLUMN", "MIXED", "MIXED", F.lit("TWO_COLUMN")).alias("layout"),
        kind(F.when(F.col("n_boxes") > 0, 0.3).otherwise(0.0), 0.85, 0.6, 0.7, calm).alias("layout_confidence"), "first_bin", "last_bin",
    )


def chunk_violations(chunks: DataFrame, blocks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(chunk_id, problem): what is wrong with a chunk's fields, provenance or order; empty when all is well.

    Problems: empty_text, no_blocks, no_pages, bad_span (first page after last), bad_count (token_count
    missing or wrong), unknown_block, repeated_block (a block whose id has several rows in its document),
    block_order (blocks of one page against their reading order), duplicate_id (different rows of one id),
    page_order, text_differs; with documents (document_id, page_count) also page_outside.
    """
    from ..functions.text import count_tokens

    one = chunks.select("chunk_id", "document_id", "text", "source_block_ids", "page_numbers", "start_page", "end_page", "token_count", "chunk_index").distinct()
    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, "empty_text"),
        F.when(F.coalesce(F.size("source_block_ids"), F.lit(0)) <= 0, "no_blocks"),
        F.when(F.coalesce(F.size("page_numbers"), F.lit(0)) <= 0, "no_pages"),
        F.when(F.col("start_page") > F.col("end_page"), "bad_span"),
        F.when(~F.col("token_count").eqNullSafe(count_tokens(F.col("text"))), "bad_count"),
    ))
    own = one.select("chunk_id", F.explode(problems).alias("problem"))
    used = one.select("chunk_id", "document_id", "text", "source_block_ids", F.posexplode("source_block_ids").alias("pos", "block_id"))
    known = blocks.groupBy("document_id", "block_id").agg(
        F.max(F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\t\r"))).alias("b"),
        F.max("page_number").alias("page"), F.max("reading_order").alias("at"), F.count(F.lit(1)).alias("n_rows"),
    )
    lost = used.join(known, ["document_id", "block_id"], "left_anti").select("chunk_id", F.lit("unknown_block").alias("problem"))
    twice = one.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("duplicate_id").alias("problem"))
    order = ["chunk_index", "chunk_id"]
    back = running(one.select("document_id", "start_page", *order), ["document_id"], order, {"prior": ("lag", F.col("start_page"))}).where(F.col("start_page") < F.col("prior")).select("chunk_id", F.lit("page_order").alias("problem"))
    rebuilt = (
        used.join(known, ["document_id", "block_id"]).groupBy("chunk_id", "text")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "b")))["b"], "\n\n").alias("again"))
        .where(~F.col("text").eqNullSafe(F.col("again"))).select("chunk_id", F.lit("text_differs").alias("problem"))
    )
    found = used.join(known, ["document_id", "block_id"])
    repeated = found.where(F.col("n_rows") > 1).select("chunk_id", F.lit("repeated_block").alias("problem"))
    listed = Window.partitionBy("chunk_id", "document_id", "text", "source_block_ids").orderBy("pos")
    before = lambda c: F.lag(c).over(listed)
    swapped = found.withColumn("swapped", (F.col("page") == before("page")) & ((F.col("at") < before("at")) | (F.col("block_id") == before("block_id"))))
    swapped = swapped.where("swapped").select("chunk_id", F.lit("block_order").alias("problem"))
    out = own.unionByName(lost).unionByName(repeated).unionByName(swapped).unionByName(twice).unionByName(back).unionByName(rebuilt)
    if documents is not None:
        counts = documents.groupBy("document_id").agg(F.max("page_count").alias("page_count"))
        pages = one.select("chunk_id", "document_id", F.explode("page_numbers").alias("page")).join(counts, "document_id", "left")
        outside = pages.where((F.col("page") < 1) | (F.col("page") > F.col("page_count")))
        out = out.unionByName(outside.select("chunk_id", F.lit("page_outside").alias("problem")))
    return out.distinct()


def derivation(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(chunk_id, contiguous, ordered): whether a chunk's normalised words are a run, or at least an ordered part, of its source blocks' words.

    Words are lower-cased and stripped of all but a-z and 0-9. Unknown blocks are passed over; a chunk
    without words is both.
    """
    bare = lambda c: F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")
    one = chunks.groupBy("chunk_id").agg(F.max(F.struct("text", "document_id", "source_block_ids")).alias("c")).select("chunk_id", "c.*")
    known = blocks.groupBy("document_id", "block_id").agg(F.max("text").alias("b"))
    used = one.select("chunk_id", "document_id", F.posexplode("source_block_ids").alias("pos", "block_id")).join(known, ["document_id", "block_id"])
    source = used.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b"))), lambda x: bare(x["b"]))).alias("source"))
    rows = one.select("chunk_id", bare(F.col("text")).alias("own")).join(source, "chunk_id", "left").withColumn("source", F.coalesce("source", F.array().cast("array<string>")))
    padded = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    # the source is passed once, with the place in the chunk's words that is waited for
    met = F.aggregate("source", F.lit(0), lambda at, w: F.when(F.get("own", at) == w, at + 1).otherwise(at))
    contiguous = (F.size("own") == 0) | F.contains(padded(F.col("source")), padded(F.col("own")))
    return rows.select("chunk_id", contiguous.alias("contiguous"), (contiguous | (met == F.size("own"))).alias("ordered"))


def require_none(violations: DataFrame, shown: int = 20) -> None:
    """Raises ValueError with the first violations if there are any."""
    first = violations.limit(shown).collect()
    if first:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in first))
