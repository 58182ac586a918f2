"""Problem 7: mixing sources to target weights.

Method: Pareto order sampling. Each source is given a number of tokens; whole copies of all its records
are certain, and the remainder is a fixed-size sample: records are ranked by random odds divided by their
inclusion odds, and taken in that order until the tokens are reached.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.bounded import bounded_rows
from ..plans.lineage import write_table
from .cuts import source_name

#: Fixed: how byte-level BPE splits text before merging.
BPE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class MixConfig:
    """total: tokens of the mixture, by default as many as the listed sources hold; seed: of the random odds.

    grain: steps into which the odds of a source are counted before its last step is ranked row by row.
    """

    tokenizer: str = TOKENIZER
    total: int | None = None
    seed: int = 1
    grain: int = 4096
    max_sources: int = 100_000


def _counter(path: str, data: bytes) -> Callable[[list[str]], list[int]]:
    """Counts tokens with the tokenizer file `data`, whose kind its path tells."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        encoding = tiktoken.Encoding("bpe", pat_str=BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def sized(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source, n_tokens); a null text has 0 tokens; repeated rows of a doc_id count once."""
    one = (
        documents.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.struct("text", "source")).alias("x"))
        .select("doc_id", source_name(F.col("x.source")).alias("source"), F.coalesce("x.text", F.lit("")).alias("text"))
    )
    kind = dict(documents.dtypes)["doc_id"]
    # the driver's file goes along, as executors need not have one
    shared = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer, shared.value)
        for batch in batches:
            n = counter(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return one.mapInArrow(count, f"doc_id {kind}, source string, n_tokens long")


def allocate(sources: list[tuple[str, float, int, int]], total: int | None = None) -> dict[str, float]:
    """Tokens of each (source, target share, max repeats, tokens held).

    A source that can't reach its share even with all repeats gives all it may; what it leaves is shared
    by the others in proportion to their targets, until all fit or all are exhausted.
    """
    wanted = {s: max(share, 0.0) for s, share, _, _ in sources}
    supply = {s: float(max(repeats, 0) * held) for s, _, repeats, held in sources}
    left = float(sum(held for *_, held in sources) if total is None else total)
    given, open_ = dict.fromkeys(wanted, 0.0), {s for s in wanted if wanted[s] > 0}
    while open_:
        weight = sum(wanted[s] for s in open_)
        full = {s for s in open_ if left * wanted[s] / weight >= supply[s]}
        if not full:
            for s in open_:
                given[s] = left * wanted[s] / weight
            break
        for s in full:
            given[s] = supply[s]
        left -= sum(supply[s] for s in full)
        open_ -= full
    return given


def _uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) that depends on seed and key only, so that lost tasks repeat it."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


@dataclass(frozen=True)
class Mixture:
    """chosen: (doc_id, source, n_tokens, copies) with copies >= 1; shares: what each source was to give and gives."""

    chosen: DataFrame
    shares: DataFrame


def mix(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig(), weight: Column | None = None) -> Mixture:
    """A mixture of the sources in `targets` (source, target_share, max_repeats).

    documents: doc_id, text, source. Sources are compared in one spelling; sources that are not listed
    stay out, listed sources without records give nothing, and null shares or repeats count as 0. weight
    (over doc_id, source, n_tokens) makes records more or less likely in the sampled remainder; by default
    all are equally likely. No record is used more than max_repeats times. Empty texts are never sampled.
    The sampled tokens of a source fall short of its remainder by less than one record.

    The order of a large source is not sorted in one task: its odds are counted in `grain` steps, whole
    steps are taken by comparison, and only the rows of the last step are ranked.
    """
    spark = documents.sparkSession
    base = write_table(sized(documents, config.tokenizer), "sized")
    listed = (
        targets.groupBy(source_name(F.col("source")).alias("source"))
        .agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("repeats"))
    )
    held = base.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    rows = bounded_rows(listed.join(held, "source", "left").select("source", "share", "repeats", F.coalesce("held", F.lit(0)).alias("held")), config.max_sources, "the table of targets")
    given = allocate([(r.source, r.share, r.repeats, r.held) for r in rows], config.total)
    plan = []
    for r in rows:
        ratio = given[r.source] / r.held if r.held else 0.0
        whole = min(int(ratio + 1e-9), r.repeats)
        rest = max(0.0, given[r.source] - whole * r.held) if whole < r.repeats else 0.0
        plan.append((r.source, float(r.share), int(r.repeats), int(r.held), whole, float(rest)))
    small = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, held long, whole int, rest double"))  # one row a listed source

    w = weight if weight is not None else F.lit(1.0)
    weighted = base.join(small.select("source", "whole", "rest", "held"), "source").withColumn("w", w.cast("double"))
    scale = weighted.groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens")).alias("scale"))
    p = F.least(F.greatest(F.col("rest") * F.col("w") / F.col("scale"), F.lit(1e-12)), F.lit(1 - 1e-9))
    u = _uniform(config.seed, F.col("doc_id"))
    odds = (u / (1 - u)) / (p / (1 - p))
    drawn = (
        weighted.join(F.broadcast(scale), "source")  # one row a listed source
        .where(F.col("n_tokens") > 0)
        .withColumn("odds", odds)
        .withColumn("step", F.floor(F.col("odds") / (1 + F.col("odds")) * config.grain))
    )
    steps = drawn.groupBy("source", "rest", "step").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source").orderBy("step")  # at most `grain` rows a source
    last = (
        steps.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") > 0))
        .groupBy("source").agg(F.max_by(F.struct("step", "before"), "step").alias("x"))
        .select("source", F.col("x.step").alias("last"), F.col("x.before").alias("before"))
    )
    reached = drawn.join(F.broadcast(last), "source").select("doc_id", "source", "n_tokens", "rest", "odds", "step", "last", "before")  # one row a listed source
    taken = reached.where(F.col("step") < F.col("last")).select("doc_id")
    within = Window.partitionBy("source").orderBy("odds", "doc_id")
    edge = (
        reached.where(F.col("step") == F.col("last"))
        .withColumn("sum", F.col("before") + F.sum("n_tokens").over(within))
        .where(F.col("sum") <= F.col("rest")).select("doc_id")
    )
    extra = taken.unionByName(edge).withColumn("extra", F.lit(1))
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    chosen = write_table(
        weighted.select("doc_id", "source", "n_tokens", "whole").join(extra, "doc_id", "left")
        .select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where(F.col("copies") > 0),
        "mixture",
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"))
    all_ = F.broadcast(got.agg(F.sum("tokens").alias("all")))  # one row
    zero = F.lit(0).cast("long")
    shares = (
        small.join(got, "source", "left").crossJoin(all_)
        .select(
            "source", "target_share", "max_repeats", F.col("held").alias("held_tokens"),
            F.coalesce("records", zero).alias("records"), F.coalesce("tokens", zero).alias("tokens"),
            F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"),
        )
    )
    return Mixture(chosen, shares)
