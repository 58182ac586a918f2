from quire.operators import structure

SCHEMA = "document_id string, page_number int, block_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
BINS, THIN, FLANK = 50, 0.25, 0.45


def page(name, spans):
    return [(name, 1, f"b{i}", dict(x0=float(a), y0=10.0 * i, x1=float(b), y1=10.0 * i + 8)) for i, (a, b) in enumerate(spans)]


def by_loops(spans):
    """(coverage, layout, confidence, gutter) of the boxes of one page."""
    if len(spans) < 3 or max(b for _, b in spans) - min(a for a, _ in spans) <= 1:
        return {}, "UNKNOWN", 0.3, None
    x0, x1, n = min(a for a, _ in spans), max(b for _, b in spans), len(spans)
    at = lambda x: max(0, min(BINS - 1, int((x - x0) / (x1 - x0) * BINS)))
    cover = [sum(at(a) <= k <= at(b) for a, b in spans) / n for k in range(BINS)]
    best, i = None, 1
    while i < BINS - 1:
        j = i
        while cover[i] <= THIN and j + 1 < BINS - 1 and cover[j + 1] <= THIN:
            j += 1
        flanked = max(cover[max(0, i - 10) : i]) >= FLANK and max(cover[j + 1 : j + 11]) >= FLANK
        if cover[i] <= THIN and j > i and flanked and (best is None or j - i > best[1] - best[0]):
            best = (i, j)
        i = j + 1
    shown = {k: round(c, 6) for k, c in enumerate(cover) if c}
    if best is None:
        return shown, "SINGLE_COLUMN", 0.85, None
    low, high = (x0 + k * (x1 - x0) / BINS for k in best)
    left, right = sum(b <= low for _, b in spans) / n, sum(a >= high for a, _ in spans) / n
    crossing = sum(b > low and a < high for a, b in spans) / n
    if min(left, right) < 0.15:
        return shown, "MIXED", 0.6, best
    if crossing >= 0.25:
        return shown, "MIXED", 0.7, best
    return shown, "TWO_COLUMN", round(min(0.95, 0.6 + (1 - max(cover[best[0] : best[1]])) * 0.35), 2), best


def test_layout_follows_the_text_area(spark):
    pages = {
        "wide": [(62, 290), (322, 550)] * 4, "narrow": [(100, 190), (206, 300)] * 4, "one": [(50, 545)] * 5, "few": [(50, 240), (345, 545)],
        "flat": [(50, 50.5)] * 4, "head": [(50, 250), (345, 545)] * 4 + [(50, 545)], "broad": [(612, 900), (940, 1200)] * 5,
        "lone": [(50, 250)] * 7 + [(240, 545)] * 6 + [(400, 545)] * 2, "crossed": [(50, 250), (345, 545)] * 3 + [(230, 300), (300, 360)],
    }
    df = spark.createDataFrame([r for name, spans in pages.items() for r in page(name, spans)] + [("bare", 1, "b", None)], SCHEMA)
    want = {name: by_loops(spans) for name, spans in pages.items()}
    covered = {name: {} for name in pages}
    for r in structure.occupancy(df).collect():
        covered[r.document_id][r.bin] = r.coverage
    assert covered == {name: w[0] for name, w in want.items()}
    got = {r.document_id: (r.layout, r.layout_confidence, None if r.first_bin is None else (r.first_bin, r.last_bin)) for r in structure.layouts(df).collect()}
    assert got == {name: w[1:] for name, w in want.items()} | {"bare": ("UNKNOWN", 0.0, None)}
    assert {got[name][0] for name in pages} == {"UNKNOWN", "SINGLE_COLUMN", "MIXED", "TWO_COLUMN"}
    assert got["narrow"][0] == "TWO_COLUMN"
