"""Problem 6: evaluation texts leaking into training text.

Method: a BM25 inverted index of the test items with block-max WAND; every passage of every training text
is a query, and all items whose score reaches their threshold are retrieved and verified word by word.
Passages consist of words that the index knows, as no run of an item holds another.

The thresholds lose nothing: an item's threshold is the least score that any run of `run` of its words
reaches by itself, so a passage that holds such a run scores at least as much. Scores are divided by the
item's threshold, which makes 1 the threshold of all. Passages are searched document at a time: the
cursors of a passage's terms are ordered by item, the pivot is the first item at which the maxima of the
terms before it add up to 1, and it is scored only if the maxima of its block do too; else the cursors
skip to the next block. Many passages take each step together, as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import words
from ..plans.lineage import write_table


#: Passages searched together; keeps the working arrays small.
SLICE = 4096
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class LeakConfig:
    """run: consecutive words that make a leak. passage: words of a query; passages overlap by run - 1 words.

    block: items of a block. group_words: words of the items that a task holds at once, about 30 bytes each;
    larger item tables are searched group by group, under statistics of all items.
    """

    run: int = 12
    passage: int = 24
    k1: float = 1.2
    b: float = 0.75
    block: int = 4
    group_words: int = 2_000_000


def postings(items: list[tuple[np.ndarray, np.ndarray]], n_items: int, mean_length: float, config: LeakConfig) -> dict[str, np.ndarray]:
    """The inverted index of items given by word hashes and each word's document frequency, as plain arrays.

    key: term * n + item of the postings in order, closed by a largest value, weight: their normalised scores; first: a term's first
    posting; top: a term's largest weight; block_key, block_top: the same of each block that holds the term;
    post_top: that of each posting's block.
    run_hash, run_item: the hashes of the items' runs in order.
    """
    n = max(len(items), 1)
    terms = np.unique(np.concatenate([w for w, _ in items] or [np.empty(0, np.int64)]))
    keys, weights = [], []
    for i, (w, df) in enumerate(items):
        own, at, tf = np.unique(w, return_inverse=True, return_counts=True)
        rarity = np.empty(len(own))
        rarity[at] = df
        idf = np.log(1 + (n_items - rarity + 0.5) / (rarity + 0.5))
        weight = idf * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * len(w) / mean_length))
        windows = np.sort(np.lib.stride_tricks.sliding_window_view(at, config.run), axis=1)
        once = np.diff(windows, axis=1, prepend=-1) > 0  # each term of a window counts once
        least = (weight[windows] * once).sum(axis=1).min()
        keys.append(np.searchsorted(terms, own) * n + i)
        weights.append(weight / (least * (1 - 1e-6)))  # sums in another order must not lose an exact hit
    key = np.concatenate(keys or [np.empty(0, np.int64)])
    weight = np.concatenate(weights or [np.empty(0)])
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.searchsorted(key, np.arange(len(terms) + 1) * n)
    blocks = -(-n // config.block)
    block_of = key // n * blocks + key % n // config.block
    block_key, begin = np.unique(block_of, return_index=True)
    runs = [np.unique(hash_runs(w, config.run)) for w, _ in items]
    hashes = np.concatenate(runs or [np.empty(0, np.uint64)])
    by_hash = np.argsort(hashes, kind="stable")
    return {
        "n": np.int64(n), "terms": terms, "key": np.append(key, _FAR), "weight": weight, "first": first,
        "top": np.maximum.reduceat(weight, first[:-1]) if len(terms) else weight,
        "post_top": np.maximum.reduceat(weight, begin)[np.searchsorted(block_key, block_of)] if len(begin) else weight,
        "block_key": block_key, "block_top": np.maximum.reduceat(weight, begin) if len(begin) else weight,
        "run_hash": hashes[by_hash], "run_item": np.repeat(np.arange(len(items)), [len(r) for r in runs])[by_hash],
    }


def _by_passage(passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each passage begins among its cursors, and how many it has."""
    starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    return starts, np.diff(np.append(starts, len(passage)))


def retrieve(index: dict[str, np.ndarray], flat: np.ndarray, begin: np.ndarray, end: np.ndarray, config: LeakConfig, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) of all scores of at least 1 by block-max WAND; passages are flat[begin:end].

    seen, if given, gets the numbers of pivots met, of pivots scored, and of passages searched.
    """
    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    terms, n = index["terms"], int(index["n"])
    if not len(terms) or not len(begin):
        return nothing
    blocks = -(-n // config.block)
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    known = terms[at] == flat
    position, _ = _ragged(begin, end)
    passage = np.repeat(np.arange(len(begin)), end - begin)[known[position]]
    code = np.unique(passage * len(terms) + at[position[known[position]]])
    if not len(code):
        return nothing
    passage, term = np.divmod(code, len(terms))
    # passages whose terms can't reach the threshold for any item have no pivot
    starts, sizes = _by_passage(passage)
    live = np.repeat(np.add.reduceat(index["top"][term], starts) >= 1, sizes)
    passage, term = passage[live], term[live]
    pos = index["first"][term]
    item = index["key"][pos] - term * n
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(passage):
        order = np.argsort(passage * n + item, kind="stable")  # most cursors are in order already
        passage, term, pos, item = passage[order], term[order], pos[order], item[order]
        starts, sizes = _by_passage(passage)
        top = index["top"][term]
        total = np.cumsum(top)
        reached = total - np.repeat(total[starts] - top[starts], sizes) >= 1
        pivot = np.minimum.reduceat(np.where(reached, np.arange(len(passage)), _FAR), starts)
        going = pivot < _FAR
        if not going.all():
            keep = np.repeat(going, sizes)
            passage, term, pos, item = passage[keep], term[keep], pos[keep], item[keep]
            if not len(passage):
                break
            pivot = pivot[going] - (np.cumsum(~keep))[pivot[going]]
            starts, sizes = _by_passage(passage)
        at_pivot = item[pivot]
        d = np.repeat(at_pivot, sizes)
        upto = item <= d
        # the block of the pivot: most cursors stand in it
        inside = upto & (item // config.block == d // config.block)
        tops = np.where(inside, index["post_top"][pos], 0.0)
        other = np.flatnonzero(upto & ~inside)
        block = term[other] * blocks + d[other] // config.block
        j = np.minimum(np.searchsorted(index["block_key"], block), len(index["block_key"]) - 1)
        tops[other] = np.where(index["block_key"][j] == block, index["block_top"][j], 0)
        promising = np.add.reduceat(tops, starts) >= 1
        scored = promising & (item[starts] == at_pivot)  # every cursor before the pivot has come to it
        if scored.any():
            score = np.add.reduceat(np.where(item == d, index["weight"][pos], 0), starts)
            hit = scored & (score >= 1)
            found.append((passage[starts[hit]], at_pivot[hit]))
        if seen is not None:
            seen[0] += len(starts)
            seen[1] += int(scored.sum())
        # behind a pivot that was scored, up to one that wasn't reached, or to the next block or cursor
        beyond = np.minimum.reduceat(np.where(upto, _FAR, item), starts)
        target = np.where(scored, at_pivot + 1, np.where(promising, at_pivot, np.minimum((at_pivot // config.block + 1) * config.block, beyond)))
        target = np.repeat(np.minimum(target, n), sizes)
        behind = np.flatnonzero(item < target)
        # often the next posting is the one; else the cursor skips to it
        wanted = term[behind] * n + target[behind]
        pos[behind] += 1
        far = np.flatnonzero(index["key"][pos[behind]] < wanted)
        pos[behind[far]] = np.searchsorted(index["key"], wanted[far])
        ended = pos[behind] >= index["first"][term[behind] + 1]
        item[behind] = index["key"][pos[behind]] - term[behind] * n
        if ended.any():
            passage, term, pos, item = (np.delete(x, behind[ended]) for x in (passage, term, pos, item))
    if seen is not None:
        seen[2] += len(begin)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else nothing


def _ragged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all ranges one after another, and where each range starts among them."""
    size = end - begin
    first = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(first - begin, size), first


def hash_runs(w: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of each run of `run` adjacent word hashes."""
    n = len(w) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = w.astype(np.int64).view(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
        out ^= out >> np.uint64(29)
    return out


def _stretches(index: dict[str, np.ndarray], flat: np.ndarray, offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the stretches of at least `run` words that are all in the index; no run of an item lies elsewhere."""
    terms = index["terms"]
    known = terms[np.minimum(np.searchsorted(terms, flat), len(terms) - 1)] == flat
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate(([False], known[:-1]))))
    end = np.flatnonzero(known & (edge[1:] | ~np.concatenate((known[1:], [False])))) + 1
    long = end - begin >= run
    begin, end = begin[long], end[long]
    return np.searchsorted(offsets, begin, "right") - 1, begin, end


def _passages(begin: np.ndarray, end: np.ndarray, config: LeakConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, begin and end of each passage; together they hold every run of a stretch in one piece."""
    step = config.passage - config.run + 1
    number = 1 + np.maximum(0, -(-(end - begin - config.passage) // step))
    of = np.repeat(np.arange(len(begin)), number)
    k = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    first = begin[of] + k * step
    return of, first, np.minimum(first + config.passage, end[of])


def _verified(index: dict[str, np.ndarray], flat: np.ndarray, begin: np.ndarray, end: np.ndarray, of: np.ndarray, passage: np.ndarray, item: np.ndarray, config: LeakConfig) -> list[tuple[int, int, int]]:
    """(stretch, item, hash of the shared run) of the retrieved pairs whose passage holds a run of the item."""
    if not len(passage):
        return []
    own = hash_runs(flat, config.run)
    low, high = np.searchsorted(index["run_hash"], own, "left"), np.searchsorted(index["run_hash"], own, "right")
    at = np.flatnonzero(high > low)
    # the stretch of each place, and the passage of that stretch that holds the run from there
    home = np.searchsorted(begin, at, "right") - 1
    inside = (home >= 0) & (at + config.run <= end[home])
    at, home = at[inside], home[inside]
    holder = np.searchsorted(of, home) + (at - begin[home]) // (config.passage - config.run + 1)
    which, _ = _ragged(low[at], high[at])
    times = high[at] - low[at]
    number = index["run_item"][which]
    n = int(index["n"])
    known = np.isin(np.repeat(holder, times) * n + number, passage * n + item)
    return list(zip(np.repeat(home, times)[known].tolist(), number[known].tolist(), np.repeat(own[at], times)[known].tolist()))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def indexed_items(items: DataFrame, config: LeakConfig = LeakConfig()) -> DataFrame:
    """(question_id, answer, question, df) of the items that hold a run: word hashes, and the document frequency of each word of the answer."""
    rows = (
        items.where(F.col("question_id").isNotNull()).groupBy("question_id").agg(F.max("reference_answer").alias("answer"), F.max("question").alias("question"))
        .select("question_id", word_hashes(F.col("answer")).alias("answer"), F.array_distinct(word_hashes(F.col("question"))).alias("question"))
        .where(F.size("answer") >= config.run)
    )
    base = write_table(rows, "items")
    uses = base.select("question_id", F.explode(F.array_distinct("answer")).alias("w"))
    counted = uses.join(uses.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w").groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("n"))
    return write_table(base.join(counted, "question_id").select("question_id", "answer", "question", F.transform("answer", lambda w: F.col("n")[w]).alias("df")), "index")


def leaked(documents: DataFrame, items: DataFrame, config: LeakConfig = LeakConfig(), id_col: str = "doc_id") -> DataFrame:
    """Each document that holds `run` consecutive words of an item's reference_answer.

    documents: id_col, text. items: question_id, question, reference_answer. Columns: id_col,
    question_id, answer_share (share of the answer's distinct runs found in the document) and
    question_share (share of the question's distinct words in the document, null without a question).
    Answers that are null or shorter than a run, and null or short texts, give no case. Items of one
    answer are reported each. Repeated rows of a document or an item count once. Whole texts are read.
    Any number of items is searched: the driver and the tasks hold one group of about group_words words
    at a time, and the documents are read once a group.
    """
    kind = dict(documents.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, question_id string, answer_share double, question_share double"
    spark = documents.sparkSession
    table = indexed_items(items, config)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("answer")), F.lit(0)).alias("words")).first()
    groups = -(-size.words // config.group_words)
    if not groups:
        return spark.createDataFrame([], schema)
    queries = documents.select(id_col, word_hashes(F.col("text")).alias("w"))
    if groups > 1:
        queries = write_table(queries, "passages")
    out = None
    for g in range(groups):
        own = table.where(F.pmod(F.xxhash64("question_id"), F.lit(groups)) == g).orderBy("question_id").collect()
        found = queries.mapInArrow(_search(spark, own, size.n, size.words / size.n, config, id_col), schema)
        out = found if out is None else out.unionByName(found)
    return out.groupBy(id_col, "question_id").agg(F.max("answer_share").alias("answer_share"), F.max("question_share").alias("question_share"))


def _search(spark, rows: list[Row], n_items: int, mean_length: float, config: LeakConfig, id_col: str):
    """For mapInArrow over (id, word hashes): the leaks of the items given by `rows`."""
    answers = [np.array(r.answer, np.int64) for r in rows]
    index = postings([(a, np.array(r.df, np.int64)) for a, r in zip(answers, rows)], n_items, mean_length, config)
    shared = spark.sparkContext.broadcast({
        "index": index, "names": [r.question_id for r in rows],
        "questions": [np.array(r.question or [], np.int64) for r in rows],
        "runs": [len(np.unique(hash_runs(a, config.run))) for a in answers],
    })

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names, questions, distinct_runs = (shared.value[k] for k in ("index", "names", "questions", "runs"))
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat = column.values.to_numpy()
            flat = flat[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            rows, first, last = _stretches(index, flat, offsets, config.run)
            of, begin, end = _passages(first, last, config)
            found = [retrieve(index, flat, begin[k : k + SLICE], end[k : k + SLICE], config) for k in range(0, len(begin), SLICE)]
            passage = np.concatenate([p + k * SLICE for k, (p, _) in enumerate(found)] or [np.empty(0, np.int64)])
            item = np.concatenate([i for _, i in found] or [np.empty(0, np.int64)])
            runs: dict[tuple[int, int], set[int]] = {}
            for k, i, h in _verified(index, flat, first, last, of, passage, item, config):
                runs.setdefault((int(rows[k]), i), set()).add(h)
            keys = sorted(runs)
            shares = []
            for r, i in keys:
                own = flat[offsets[r] : offsets[r + 1]]
                shares.append(float(np.isin(questions[i], own).mean()) if len(questions[i]) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())),
                    pa.array([names[i] for _, i in keys], pa.string()),
                    pa.array([len(runs[k]) / distinct_runs[k[1]] for k in keys], pa.float64()),
                    pa.array(shares, pa.float64()),
                ],
                [id_col, "question_id", "answer_share", "question_share"],
            )

    return search


def leak_report(found: DataFrame) -> DataFrame:
    """Of each leaked item: the documents that hold it, those that hold all of it, and the largest share."""
    return found.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("answer_share") >= 1).alias("n_whole"),
        F.round(F.max("answer_share"), 6).alias("max_share"),
    )
