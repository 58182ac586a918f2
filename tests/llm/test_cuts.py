import random

from pyspark.sql import functions as F

from quire.llm.cuts import early_ends, _ends_early, cut_documents, cut_rates

SCHEMA = "doc_id long, text string, source string, is_cut string, terminality double"
NOUNS = [f"{a}{b}" for a in ("gar", "lan", "mir", "sto", "val", "win") for b in ("den", "tern", "ror", "ne", "ley", "ter", "low")]


def sentence(rng):
    return f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} explains a {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} (cf. vol. {rng.randrange(9)}, p. {rng.randrange(99)})."


def whole(rng, n=8):
    return " ".join(sentence(rng) for _ in range(n))


def corpus():
    rng = random.Random(6)
    rows, cut = [], set()
    add = lambda text: rows.append((len(rows), text, ["north", "North ", None][len(rows) % 3], "clash", 0.0))
    for i in range(240):
        text = whole(rng)
        if i % 4 == 1:
            text += f"\n\n— {rng.choice('ABCDE')}. {rng.choice(NOUNS).title()}"
        elif i % 4 == 2:
            text += "\n\nKeywords: " + ", ".join(rng.sample(NOUNS, 3))
        add(text)
    for i in range(40):
        cut.add(len(rows))
        text = whole(rng)
        k = rng.randrange(60, len(text) - 30)
        while not text[k - 1].isalpha() or text[k - 2] in " .(":
            k += 1
        add(text[:k])
    for i in range(3):
        cut.add(len(rows))
        add(whole(rng) + " One may compare (cf. vol.")
    cut.add(len(rows))
    add(whole(rng) + " The gard�")
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus()
    rows += rows[:3] + [(990, None, None, None, None), (991, "", "x", None, None), (992, "  \n", "x", None, None), (None, "lost te", "x", None, None)]
    out = {r.doc_id: r for r in cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d for d, r in out.items() if r.is_cut} == cut
    assert len(out) == len({r[0] for r in rows if r[0] is not None}) and not out[990].is_cut and not out[991].is_cut


def test_copy_tells_that_a_name_was_cut(spark):
    rows, _ = corpus()
    full = rows[1][1]
    rows.append((2000, full[:-3], "north", "", 0.0))
    out = {r.doc_id: r for r in cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2000].is_cut and out[2000].how == "copy" and not out[1].is_cut


def test_alignment():
    text = whole(random.Random(2))
    assert _ends_early(text[:200].rstrip() if text[199] != "." else text[:198], text)
    assert not _ends_early(text, text) and not _ends_early("", text)
    assert not _ends_early(text[: text.index(").") + 2], text)


def test_rates_and_empty_tables(spark):
    rows, cut = corpus()
    rates = {r.source: r for r in cut_rates(cut_documents(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(rates) == {"north", "unknown"} and sum(r.n_cut for r in rates.values()) == len(cut)
    assert cut_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    rows, _ = corpus()
    long = whole(random.Random(9), 8000)
    rows += [(3000, long, "x", "", 0.0), (3001, long + " The garden of", "x", "", 0.0)]
    out = {r.doc_id: r.is_cut for r in cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not out[3000] and out[3001]


def edited(rng, w, share):
    """Words with a share of them replaced, dropped or doubled."""
    out = []
    for x in w:
        r = rng.random()
        out += [x + "q"] if r < share / 3 else [] if r < 2 * share / 3 else [x, "so"] if r < share else [x]
    return out


def test_cut_and_edited_copies_are_found(spark):
    rng = random.Random(3)
    rows, cut = [], {}
    for i in range(60):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(200, 400))]
        rows.append((i, " ".join(w) + "."))
        for share in (0.1, 0.3, 0.5, 0.8):
            for edits in (0.0, 0.02):
                rows.append((len(cut) + 1000, " ".join(edited(rng, w[: int(len(w) * share)], edits))))
                cut[rows[-1][0]] = (share, edits)
    df = spark.createDataFrame(rows, "tid long, text string")
    found = {r.tid for r in early_ends(df).collect()}
    assert found <= set(cut)
    for kind in set(cut.values()):
        mine = {i for i, k in cut.items() if k == kind}
        # of short parts, two edits leave less than the similarity
        assert len(mine & found) >= (1.0 if kind[1] == 0 else 0.9 if kind[0] > 0.1 else 0.7) * len(mine), kind


def test_alignment_survives_edits():
    text = whole(random.Random(2))
    k = text.rindex(" explains") - 1
    short = text[:k]
    assert _ends_early(short, text)
    swapped = short[:-2] + short[-1] + short[-2]
    assert _ends_early(swapped, text) and not _ends_early(text, swapped)
    # both stop at one place, or the longer only lacks the stop
    assert not _ends_early(text[:-1], text) and not _ends_early(short, short)


def test_the_closing_word_decides(spark):
    nouns = NOUNS[:30]
    line = lambda i, w: f"The {nouns[i % 30]} says\n\nsee {w}"
    rows = [(i, line(i, "also") + " the garden.") for i in range(60)] + [(100 + i, line(i, "below")) for i in range(60)]
    rows = [(d, t + f"\n\nNo. {d}.") for d, t in rows] + [(900, "An odd text\n\nsee also"), (901, "An odd text\n\nsee below")]
    out = {r.doc_id: r for r in cut_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("x"))).collect()}
    # one form of line, but only one of the words closes it
    assert out[901].terminality > 2 * out[900].terminality


def test_many_copies_of_one_text(spark):
    text = whole(random.Random(5))
    cut = text[: text.rindex(" explains") - 1]
    rows = [(i, text, "x", "", 0.0) for i in range(3000)] + [(5000 + i, cut, "x", "", 0.0) for i in range(2000)]
    out = cut_documents(spark.createDataFrame(rows, SCHEMA)).where("is_cut").select("doc_id", "how").collect()
    assert {r.doc_id for r in out} == set(range(5000, 7000)) and {r.how for r in out} == {"copy"}
