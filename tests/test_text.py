import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import scoring, text
from quire.operators import evidence, graph


def values(spark, rows, column, schema="text string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_tokens_and_words_follow_python(spark):
    rows = ["Mass-mindedness, isn't it?", "naïve façade _x_ 12.5", "a b c", "", None, "Ähren—日本 x́"]
    assert values(spark, rows, text.words(F.col("text"))) == [re.findall(r"[^\W_]+", (r or "").lower()) for r in rows]
    assert values(spark, rows, text.count_tokens(F.col("text"))) == [len(re.findall(r"\w+|[^\w\s]", r or "")) for r in rows]
    assert values(spark, ["Mass-mindedness isn't X-1"], text.lex_tokens(F.col("text"))) == [["mass-mindedness", "isn't", "x-1"]]


def test_preview_collapses_white_space(spark):
    assert values(spark, ["  a \n\n b c  ", None], text.preview(F.col("text"))) == ["a b c", None]


def test_folios_and_running_heads(spark):
    lines = ["12", "- iv -", "39 the test book", "The Test  Book", "in 1894", "the test book and more", ""]
    assert values(spark, lines, evidence.is_folio(F.col("text"))) == [True, True, False, False, False, False, False]
    heads = evidence.is_running_head(F.col("text"), F.lit("The Test Book"), F.array(F.lit("Chapter One")))
    assert values(spark, [*lines, "chapter one 7", "the test book chapter one"], heads) == [False, False, True, True, False, False, False, True, True]


def clean(spark, body, title="The Book", path=()):
    df = spark.createDataFrame([(body, title, list(path))], "text string, title string, path array<string>")
    return tuple(df.select(evidence.cleaned(F.col("text"), F.col("title"), F.col("path")).alias("c")).select("c.clean", "c.removed").collect()[0])


def test_cleanup(spark):
    assert clean(spark, "12\nThe Book\nBody one.\nBody two.\n- iv -\n\n") == ("Body one.\nBody two.", 5)
    assert clean(spark, "Body.\nThe Book\nMore.\nThe Book\nEnd.") == ("Body.\nThe Book\nMore.\n\nEnd.", 1)
    assert clean(spark, "The Book\nBody.\nThe Book\nEnd.") == ("Body.\n\nEnd.", 2)
    assert clean(spark, "12\nThe Book") == ("12\nThe Book", 0)
    assert clean(spark, None, None) == ("", 0)


def test_overlaps_and_vectors(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["b", "c", "d"], [3.0, 4.0], [4.0, 3.0])], "a array<string>, b array<string>, x array<double>, y array<double>")
    row = df.select(scoring.overlap_coefficient(F.col("a"), F.col("b")), scoring.cosine(F.col("x"), F.col("y")), scoring.l2_normalize(F.col("x"))).collect()[0]
    assert tuple(row) == (0.5, 0.96, [0.6, 0.8])


def test_relation_types(spark):
    rows = ["The persona is part of the Self.", "The persona contrasts with the shadow.", "It is a symbol of the ego.", "The ego meets the shadow.", None]
    assert values(spark, rows, graph.relation_type(F.col("text"))) == ["PART_OF", "CONTRASTS_WITH", "SYMBOLIZES", None, None]


def test_edge_confidence(spark):
    rows = [("pattern", 1, 1, False, True), ("sentence", 9, 3, True, True), ("block", 2, 1, False, False)]
    df = spark.createDataFrame(rows, "s string, c long, d long, i boolean, h boolean")
    got = df.select(graph.edge_confidence(*[F.col(c) for c in "scdih"]).alias("c")).select("c", graph.edge_status(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(0.65, "WEAK"), (0.89, "TRUSTED"), (0.35, "UNVERIFIED")]


def test_citations(spark):
    assert values(spark, ["[S1] and [s2], [S1] [S01] [S1, S3]", None], evidence.citations(F.col("text"))) == [["S1", "S2", "S01"], []]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab -", max_size=30))
def test_mentions_claim_longest_first(body):
    aliases = [("ab ab", "AA"), ("ab", "A"), ("b", "B")]
    found = graph._finder(aliases)(body)
    taken, want = [False] * len(body), []
    for alias, name in aliases:
        for at in range(len(body) - len(alias) + 1):
            end = at + len(alias)
            edge = (at and body[at - 1].isalnum()) or (end < len(body) and body[end].isalnum())
            if body[at:end] == alias and not edge and not any(taken[at:end]):
                taken[at:end] = [True] * len(alias)
                want.append((at, name))
    assert found == list(dict.fromkeys(n for _, n in sorted(want)))


def test_lexical_and_concept_forms_are_compatible(spark):
    texts = ["The waſte ﬁre", "Ｅｇｏ №7", "Straße İx", "plain Ego-X", None]
    lexical = [["the", "waste", "fire"], ["ego", "no7"], ["stra", "e", "i", "x"], ["plain", "ego-x"], []]
    assert values(spark, texts, text.lex_tokens(F.col("text"))) == lexical
    assert values(spark, texts, graph.concept_form(F.col("text"))) == ["the waste fire", "ego no7", "strasse i x", "plain ego-x", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sorted(r[0] for r in df.select(F.explode(text.lex_tokens(F.col("text")))).collect()) == sorted(sum(lexical, []))


def test_mentions_in_old_letters(spark):
    vocabulary = spark.createDataFrame([("self", "Self"), ("conflict", "Conflict")], "alias string, canonical string")
    df = spark.createDataFrame([("the ſelf in conﬂict",)], "text string")
    assert graph.mentions(df, "text", vocabulary).collect()[0].names == ["Self", "Conflict"]
