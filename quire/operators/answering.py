"""Answers from evidence packs: prompts, pluggable providers, citations and coverage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import checked_citations

INSTRUCTIONS = "Answer from the numbered evidence only. Cite each statement as [S1], [S2] and so on. Say so if the evidence is not enough."


class Embedder(Protocol):
    """Turns texts into vectors of one dimension; must raise, never invent a vector."""

    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    """Scores (query, text) pairs; must raise, never invent a score."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    """Answers prompts, one text a prompt."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def embed(df: DataFrame, text_col: str, embedder: Embedder) -> DataFrame:
    """df with `embedding`, computed a batch at a time; the provider is made once a worker by unpickling it."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = embedder([t or "" for t in texts])
            if any(len(v) != embedder.dimension for v in vectors):
                raise ValueError("the provider gave vectors of another dimension")
            yield pd.Series(vectors)

    return df.withColumn("embedding", run(F.col(text_col)))


def scored(query: Column, text: Column, scorer: Scorer) -> Column:
    """A score column for `retrieval.rerank` from a batch scorer."""

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        got = scorer([q or "" for q in queries], [t or "" for t in texts])
        if len(got) != len(queries):
            raise ValueError("the provider gave another number of scores")
        return pd.Series(got, dtype=float)

    return run(query, text)


def prompts(questions: DataFrame, rendered: DataFrame) -> DataFrame:
    """(query_id, prompt): instructions, evidence and question; questions without evidence say so."""
    evidence = F.coalesce("evidence", F.lit("(no evidence)"))
    prompt = F.concat(F.lit(INSTRUCTIONS + "\n\nEvidence:\n"), evidence, F.lit("\n\nQuestion: "), F.trim("query"))
    return questions.join(rendered, "query_id", "left").select("query_id", prompt.alias("prompt"))


def extractive(texts: list[str]) -> list[str]:
    """An offline generator: the first sentence of the first evidence item, cited; a fixed text without evidence."""
    out = []
    for prompt in texts:
        body = prompt.partition("Evidence:\n")[2].partition("\n\nQuestion: ")[0]
        if not body.startswith("[S1]"):
            out.append("The evidence is not enough.")
            continue
        lines = body.split("\n\n")[0].split("\n")[1:]
        out.append(" ".join(lines).split(". ")[0].strip().rstrip(".") + " [S1].")
    return out


def answers(prompted: DataFrame, generator: Generator = extractive) -> DataFrame:
    """(query_id, answer) of every prompt."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(generator(list(texts)))

    return prompted.select("query_id", run("prompt").alias("answer"))


def citation_warnings(answered: DataFrame, packs: DataFrame) -> DataFrame:
    """(query_id, warning): citations of items that the pack doesn't hold, or none although it holds some."""
    checked = checked_citations(answered, packs)
    unknown = checked.where("status = 'unknown'").groupBy("query_id").agg(F.concat(F.lit("unknown citations: "), F.array_join(F.array_sort(F.collect_list("evidence_id")), ", ")).alias("warning"))
    held = packs.where(F.col("evidence_id").isNotNull()).select("query_id").distinct()
    silent = answered.join(held, "query_id").join(checked.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("no citations although there is evidence").alias("warning"))
    return unknown.unionByName(silent)


def coverage(packs: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, accuracy, coverage): share of the selected items that are relevant, share of the relevant that are selected."""
    chosen = packs.where(F.col("fate") == "selected").select("query_id", F.col("id").alias("key"))
    hits = chosen.join(labels.distinct(), ["query_id", "key"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hit"))
    n = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_chosen"))
    all_ = labels.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = F.coalesce("n_hit", F.lit(0))
    return all_.join(n, "query_id", "left").join(hits, "query_id", "left").select(
        "query_id", F.round(F.coalesce(hit / F.col("n_chosen"), F.lit(0.0)), 4).alias("accuracy"), F.round(hit / F.col("n_relevant"), 4).alias("coverage"),
    )
