import pytest

from pyspark.sql import functions as F

from quire.operators import answering
from quire.plans import lineage
from quire.plans.bounded import TooLarge, bounded_rows


def test_answer_and_its_citations(spark):
    questions = spark.createDataFrame([("q1", "Who? "), ("q2", "What?")], "query_id string, query string")
    rendered = spark.createDataFrame([("q1", "[S1] Title, p. 3\nThe moon meets the sun. More.\n\n[S2] Other, p. 4\nText.")], "query_id string, evidence string")
    got = {r.query_id: r.answer for r in answering.answers(answering.prompts(questions, rendered)).collect()}
    assert got == {"q1": "The moon meets the sun [S1].", "q2": "The evidence is not enough."}


def test_citation_warnings(spark):
    packs = spark.createDataFrame([("q1", "S1"), ("q2", "S1"), ("q3", None)], "query_id string, evidence_id string")
    said = spark.createDataFrame([("q1", "see [S9] and [S1]"), ("q2", "nothing"), ("q3", "nothing")], "query_id string, answer string")
    got = {tuple(r) for r in answering.citation_warnings(said, packs).collect()}
    assert got == {("q1", "unknown citations: S9"), ("q2", "no citations although there is evidence")}


def test_coverage(spark):
    packs = spark.createDataFrame([("q", "a", "selected"), ("q", "b", "selected"), ("q", "c", "left_out")], "query_id string, id string, fate string")
    labels = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "c"), ("r", "z")], "query_id string, key string")
    assert {tuple(r) for r in answering.coverage(packs, labels).collect()} == {("q", 0.5, 0.5), ("r", 0.0, 0.0)}


def test_providers_are_checked(spark):
    class Doubles:
        dimension = 2

        def __call__(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.embedding for r in answering.embed(df, "t", Doubles()).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    wrong = lambda queries, texts: [1.0]
    with pytest.raises(Exception, match="another number of scores"):
        df.repartition(1).select(answering.scored(F.col("t"), F.col("t"), wrong)).collect()


def test_bounds_and_written_tables(spark):
    df = spark.range(5)
    assert len(bounded_rows(df, 5, "x")) == 5
    with pytest.raises(TooLarge):
        bounded_rows(df, 4, "x")
    table = lineage.write_table(df, "t")
    assert table.count() == 5 and lineage.write_table(df.limit(0), "t").dtypes == df.dtypes
