"""The evidence-backed concept graph: mentions, relations, edges, their statistics, checks and neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import SPACE, folded, one_line
from ..plans.bounded import bounded_rows
from ..plans.lineage import write_table

#: Fixed: relation types by pattern, the first that matches.
RELATIONS = (
    ("PART_OF", r"(?i)\bpart of\b|\bcomponent of\b"),
    ("CONTRASTS_WITH", r"(?i)\bcontrast(s|ing)? (with|to)\b|\bunlike\b|\bopposed? to\b"),
    ("SYMBOLIZES", r"(?i)\bsymbol(ize|ize s|ises|ic)?\b|\bsymbol of\b"),
    ("DEVELOPS", r"(?i)\bdevelop(s|ment|ed)? (of|into|from)\b"),
    ("INTEGRATES", r"(?i)\bintegrat(e|es|ion) (of|with|into)\b"),
    ("INFLUENCES", r"(?i)\binfluence[sd]? by\b"),
)
#: Fixed: confidence of an edge by its strongest source.
WEIGHTS = {"pattern": 0.6, "sentence": 0.5, "block": 0.3}


def concept_form(name: Column) -> Column:
    """NFKC, case folded, all but a-z, 0-9, hyphen and white space as a blank, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(name), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def node_id(name: Column) -> Column:
    return F.concat(F.lit("concept:"), concept_form(name))


def relation_type(sentence: Column) -> Column:
    """Type of the first pattern found in a sentence, null if there is none."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(RELATIONS):
        kind = F.when(sentence.rlike(pattern), name).otherwise(kind)
    return kind


def edge_status(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "TRUSTED").when(confidence >= 0.4, "WEAK").otherwise("UNVERIFIED")


def edge_confidence(source: Column, n_chunks: Column, n_documents: Column, in_sentence: Column, under_heading: Column) -> Column:
    base = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        base = F.when(source == name, weight).otherwise(base)
    bonus = (
        0.05 * F.least(F.lit(4), n_chunks - 1) + F.when(in_sentence, 0.10).otherwise(0.0)
        + F.when(under_heading, 0.05).otherwise(0.0) + 0.02 * (n_documents - 1)
    )
    return F.round(F.least(F.lit(1.0), base + bonus), 4)


def sentences(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, sentence): sentences of at least four words of the text on one line."""
    parts = F.split(one_line(F.col(text_col)), r"(?<=[.!?])\s+")
    return (
        texts.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("pos", "sentence"))
        .withColumn("sentence", F.trim("sentence")).where(F.size(F.split("sentence", " ")) >= 4)
    )


def _finder(aliases: dict[str, str] | list[tuple[str, str]]):
    """Names in order of first mention: longer aliases claim their characters first, letters or digits may not adjoin; one pass of an automaton."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for alias, name in dict(aliases).items():
        automaton.add_word(alias, (-len(alias), alias, name))
    if aliases:
        automaton.make_automaton()

    def find(text: str) -> list[str]:
        if not aliases or not text:
            return []
        taken, hits = bytearray(len(text)), []
        for size, alias, at, name in sorted((size, alias, end + 1 + size, name) for end, (size, alias, name) in automaton.iter(text)):
            end = at - size
            if (at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()) or any(taken[at:end]):
                continue
            taken[at:end] = b"\1" * -size
            hits.append((at, name))
        return list(dict.fromkeys(name for _, name in sorted(hits)))

    return find


def mentions(texts: DataFrame, text_col: str, vocabulary: DataFrame, max_aliases: int = 100_000) -> DataFrame:
    """texts with `names`: distinct canonical names in order of first mention. The vocabulary's size is checked.

    Every column of texts is kept; a column called names is replaced. Null texts mention nothing.
    """
    rows = bounded_rows(
        vocabulary.select(concept_form(F.col("alias")).alias("alias"), "canonical").where(F.length("alias") > 0)
        .groupBy("alias").agg(F.min("canonical").alias("canonical")), max_aliases, "the vocabulary",
    )
    aliases = {r.alias: r.canonical for r in rows}
    kept = texts.drop("names").withColumn("__form", concept_form(F.coalesce(F.col(text_col), F.lit(""))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(aliases)
        for batch in batches:
            at = batch.schema.get_field_index("__form")
            names = pa.array([find(t) for t in batch.column(at).to_pylist()], pa.list_(pa.string()))
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), names], [*(batch.schema.names[i] for i in others), "names"])

    schema = kept.drop("__form").schema.add("names", ArrayType(StringType()))
    return kept.mapInArrow(run, schema)


def ordered_pairs(names: Column) -> Column:
    """ARRAY<STRUCT<a, b>> of all pairs of an array, the earlier first."""
    rest = lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(names, rest))


def relations(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Strongest relation of each pair of concepts in each chunk.

    Columns chunk_id, document_id, a, b (canonical names, the smaller first), source, relation, span,
    under_heading. Pairs of one sentence rank before pairs of the whole chunk, patterns before mere
    co-occurrence; among equals the earlier sentence counts.
    """
    one = chunks.groupBy("chunk_id").agg(F.max(F.struct("document_id", "text", "heading_path")).alias("c"))
    found = write_table(mentions(sentences(one, "chunk_id", "c.text"), "sentence", vocabulary), "mentions")
    kind = relation_type(F.col("sentence"))
    pair = lambda x: F.struct(F.least(x["a"], x["b"]).alias("a"), F.greatest(x["a"], x["b"]).alias("b"))
    inside = (
        found.where(F.size("names") > 1)
        .select("id", "pos", "sentence", kind.alias("kind"), F.explode(F.transform(ordered_pairs(F.col("names")), pair)).alias("p"))
        .select("id", "p.a", "p.b", F.when(F.col("kind").isNotNull(), 0).otherwise(1).alias("rank"), "pos", F.coalesce("kind", F.lit("RELATED_TO")).alias("relation"), F.col("sentence").alias("span"))
    )
    # a chunk names few concepts; its sentences are joined in order
    whole = found.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        F.substring(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "sentence")))["sentence"], " "), 1, 120).alias("span"),
    )
    across = whole.where(F.size("names") > 1).select(
        "id", F.explode(ordered_pairs(F.col("names"))).alias("p"), "span",
    ).select("id", "p.a", "p.b", F.lit(2).alias("rank"), F.lit(0).alias("pos"), F.lit("ASSOCIATED_WITH").alias("relation"), "span")
    best = inside.unionByName(across).groupBy("id", "a", "b").agg(F.min(F.struct("rank", "pos", "relation", "span")).alias("x"))
    source = F.element_at(F.array(*[F.lit(s) for s in WEIGHTS]), F.col("x.rank") + 1)
    home = one.select(F.col("chunk_id").alias("id"), "c.document_id", (F.coalesce(F.size("c.heading_path"), F.lit(0)) > 0).alias("under_heading"))
    return best.join(home, "id").select(F.col("id").alias("chunk_id"), "document_id", "a", "b", source.alias("source"), "x.relation", "x.span", "under_heading")


def edges(found: DataFrame) -> DataFrame:
    """One edge a pair of concepts, keyed by its ends: evidence spans are counted once by text and source.

    Columns source_node_id, target_node_id, relation, source, n_chunks, n_documents, evidence_count,
    confidence, status. The relation is that of the strongest source, of equals the smallest chunk's.
    """
    rank = F.when(F.col("source") == "pattern", 0).when(F.col("source") == "sentence", 1).otherwise(2)
    by = found.groupBy("a", "b").agg(
        F.min(F.struct(rank.alias("rank"), "chunk_id", "relation", "source")).alias("best"),
        F.count_distinct("chunk_id").alias("n_chunks"),
        F.count_distinct("document_id").alias("n_documents"),
        F.bool_or(F.col("source") == "sentence").alias("in_sentence"),
        F.bool_or("under_heading").alias("under_heading"),
        F.count_distinct(F.substring("span", 1, 400), "source").alias("evidence_count"),
    )
    confidence = edge_confidence(F.col("best.source"), F.col("n_chunks"), F.col("n_documents"), F.col("in_sentence"), F.col("under_heading"))
    return (
        by.withColumn("confidence", confidence)
        .select(
            node_id(F.col("a")).alias("source_node_id"), node_id(F.col("b")).alias("target_node_id"), F.col("best.relation").alias("relation"),
            F.col("best.source").alias("source"), "n_chunks", "n_documents", "evidence_count", "confidence", edge_status(F.col("confidence")).alias("status"),
        )
    )


def evidence_rows(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence of the relations, one row a pair, span and source: evidence_id, a, b, chunk_id, document_id, page_numbers, source_block_ids, heading_path, evidence_text, relation_source.

    The id is a hash of pair, span and source. A span belongs to the first chunk, by id, that holds it: spans
    are met with the chunks in which they were found, so no text is searched in all chunks.
    """
    span = F.substring(F.trim(F.regexp_replace("span", r"\s+", " ")), 1, 400)
    rows = found.select("a", "b", "chunk_id", span.alias("evidence_text"), F.col("source").alias("relation_source"))
    one = rows.groupBy("a", "b", "evidence_text", "relation_source").agg(F.min("chunk_id").alias("chunk_id"))
    key = F.concat(F.lit("('"), "a", F.lit("', '"), "b", F.lit("')"))
    digest = F.sha2(F.concat_ws("|", key, "evidence_text", "relation_source"), 256)
    home = chunks.groupBy("chunk_id").agg(F.max(F.struct("document_id", "page_numbers", "source_block_ids", "heading_path")).alias("c"))
    return one.join(home, "chunk_id").select(
        F.concat(F.lit("ge-"), F.substring(digest, 1, 16)).alias("evidence_id"), "a", "b", "chunk_id", "c.document_id", "c.page_numbers", "c.source_block_ids", "c.heading_path", "evidence_text", "relation_source"
    )


def edge_hashes(evidence: DataFrame) -> DataFrame:
    """(a, b, edge_hash, evidence_ids): a hash over the sorted ids of each pair's evidence."""
    by = evidence.groupBy("a", "b").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    return by.select("a", "b", F.concat(F.lit("edge-"), F.substring(F.sha2(F.array_join("evidence_ids", "|"), 256), 1, 12)).alias("edge_hash"), "evidence_ids")


def nodes(edge_rows: DataFrame, vocabulary: DataFrame, edge_documents: DataFrame | None = None) -> DataFrame:
    """(node_id, name, node_type, aliases, n_edges, evidence_count, n_documents) of the concepts; those without edges count 0.

    edge_rows: source_node_id, target_node_id, evidence_count. edge_documents: source_node_id, target_node_id,
    document_id of the evidence, for the distinct documents.
    """
    names = vocabulary.groupBy(F.col("canonical").alias("name")).agg(F.max("node_type").alias("node_type"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    counts = both_ends(edge_rows.select("source_node_id", "target_node_id", "evidence_count")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence_count"))
    out = names.withColumn("node_id", node_id(F.col("name"))).join(counts, "node_id", "left")
    if edge_documents is not None:
        spread = both_ends(edge_documents).groupBy("node_id").agg(F.count_distinct("document_id").alias("n_documents"))
        out = out.join(spread, "node_id", "left")
    else:
        out = out.withColumn("n_documents", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("node_id", "name", "node_type", "aliases", zero("n_edges"), zero("evidence_count"), zero("n_documents"))


def filter_nodes(vocabulary: DataFrame, node_type: str | None, text: str | None) -> DataFrame:
    """(node_id, name, node_type) by type, in any case, and by a part of the name or of any alias."""
    rows = vocabulary.groupBy(F.col("canonical").alias("name")).agg(F.max("node_type").alias("node_type"), F.collect_set("alias").alias("aliases"))
    if node_type:
        rows = rows.where(F.upper("node_type") == node_type.strip().upper())
    if text:
        q = F.lit(text.strip().lower())
        rows = rows.where(F.contains(F.lower("name"), q) | F.exists("aliases", lambda a: F.contains(F.lower(a), q)))
    return rows.select(node_id(F.col("name")).alias("node_id"), "name", "node_type")


def capped_neighbourhood(edge_rows: DataFrame, centre: str | None = None, rings: int = 2, max_nodes: int = 80, max_edges: int = 160) -> DataFrame:
    """(kind, id, place, n_hidden): the neighbourhood of a node as shown: at most max_nodes nodes by ring, evidence and id, and max_edges edges between them by status, evidence and id.

    n_hidden is the number of nodes, or edges between shown nodes, beyond the limit. Without a centre the node
    with most evidence is taken, of equals the smallest id. A top-k report: the caps are its feature.
    """
    weight = both_ends(edge_rows.select("source_node_id", "target_node_id", "evidence_count")).groupBy("node_id").agg(F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("evidence"))
    if centre is None:
        first = weight.orderBy(F.desc("evidence"), "node_id").limit(1).collect()
        if not first:
            return edge_rows.sparkSession.createDataFrame([], "kind string, id string, place int, n_hidden int")
        centre = first[0].node_id
    near = neighbourhood(edge_rows, centre, rings).join(weight, "node_id", "left")

    def shown(rows: DataFrame, kind: str, key: str, order: list, limit: int) -> DataFrame:
        """The first rows by a global top-k, and how many there are beyond."""
        ranked = rows.orderBy(*order).limit(limit)
        n = rows.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).cast("int").alias("n_hidden"))
        place = F.row_number().over(Window.orderBy(*order))  # at most `limit` rows
        return ranked.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), place.alias("place")).crossJoin(F.broadcast(n))  # one row

    kept = write_table(shown(near, "node", "node_id", ["ring", F.desc(F.coalesce("evidence", F.lit(0))), "node_id"], max_nodes), "shown")
    ids = kept.select(F.col("id").alias("node_id"))
    inside = edge_rows.join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi")
    rank = F.when(F.col("status") == "TRUSTED", 0).when(F.col("status") == "WEAK", 1).otherwise(2)
    return kept.unionByName(shown(inside, "edge", "edge_id", [rank, F.desc(F.coalesce("evidence_count", F.lit(0))), "edge_id"], max_edges))


def both_ends(edge_rows: DataFrame) -> DataFrame:
    """Each edge once from either end: node_id, other_id and the edge's other columns."""
    rest = [c for c in edge_rows.columns if c not in ("source_node_id", "target_node_id")]
    out = edge_rows.select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("other_id"), F.lit("out").alias("direction"), *rest)
    back = edge_rows.select(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("other_id"), F.lit("in").alias("direction"), *rest)
    return out.unionByName(back)


def graph_violations(edge_rows: DataFrame, evidence: DataFrame, vocabulary: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with edges and evidence; empty when all is well.

    Problems of edges: self_edge, bad_confidence, unknown_node, lost_evidence, trusted_without_evidence (a count
    of 0 or no ids), duplicate_edge (different rows of one id), unmerged_edge (several edges of one build join a
    pair, either way round, by one type). Of evidence: lost_chunk, duplicate_evidence (repeated rows of one id),
    no_document (document or chunk missing), no_pages, empty_span.
    """
    one = edge_rows.select("edge_id", "source_node_id", "target_node_id", "confidence", "evidence_ids", "evidence_count", "status", "build_id", "relationship_type").distinct()
    pair = [F.least("source_node_id", "target_node_id").alias("a"), F.greatest("source_node_id", "target_node_id").alias("b")]
    unmerged = one.groupBy("build_id", "relationship_type", *pair).agg(F.collect_set("edge_id").alias("ids")).where(F.size("ids") > 1)
    blank = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")) == ""
    nodes = vocabulary.select(node_id(F.col("canonical")).alias("other_id")).distinct()
    say = lambda df, key, problem: df.select(F.col(key).alias("id"), F.lit(problem).alias("problem"))
    known = evidence.select("evidence_id", "chunk_id").distinct()
    parts = [
        say(one.where(F.col("source_node_id") == F.col("target_node_id")), "edge_id", "self_edge"),
        say(one.where(~F.col("confidence").between(0, 1)), "edge_id", "bad_confidence"),
        say(both_ends(one).join(nodes, "other_id", "left_anti"), "edge_id", "unknown_node"),
        say(one.select("edge_id", F.explode("evidence_ids").alias("evidence_id")).join(known, "evidence_id", "left_anti"), "edge_id", "lost_evidence"),
        say(one.where((F.col("status") == "TRUSTED") & ((F.col("evidence_count") == 0) | (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0))), "edge_id", "trusted_without_evidence"),
        say(one.groupBy("edge_id").count().where("count > 1"), "edge_id", "duplicate_edge"),
        say(unmerged.select(F.explode("ids").alias("edge_id")), "edge_id", "unmerged_edge"),
        say(known.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti"), "evidence_id", "lost_chunk"),
        say(evidence.groupBy("evidence_id").count().where("count > 1"), "evidence_id", "duplicate_evidence"),
        say(evidence.where((F.coalesce("document_id", F.lit("")) == "") | (F.coalesce("chunk_id", F.lit("")) == "")), "evidence_id", "no_document"),
        say(evidence.where(F.coalesce(F.size("page_numbers"), F.lit(0)) <= 0), "evidence_id", "no_pages"),
        say(evidence.where(blank(F.col("evidence_text"))), "evidence_id", "empty_span"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def search_nodes(vocabulary: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Best names for a search text: 3 for the name itself, 2.5 for an alias, 1.5 for a part of the name, 1 for a part of an alias."""
    q = F.lit(text.strip().lower())
    score = (
        F.when(F.lower("canonical") == q, 3.0).when(F.lower("alias") == q, 2.5)
        .when(F.contains(F.lower("canonical"), q), 1.5).when(F.contains(F.lower("alias"), q), 1.0)
    )
    return vocabulary.withColumn("score", score).groupBy("canonical").agg(F.max("score").alias("score")).where(F.col("score") > 0).orderBy(F.desc("score"), "canonical").limit(limit)


def neighbourhood(edge_rows: DataFrame, centre: str, rings: int) -> DataFrame:
    """(node_id, ring): nodes within `rings` steps of the centre, by breadth-first rings; each ring is written before the next."""
    steps = both_ends(edge_rows.select("source_node_id", "target_node_id").distinct()).select("node_id", "other_id").distinct()
    seen = edge_rows.sparkSession.createDataFrame([(centre, 0)], "node_id string, ring int")
    for ring in range(1, rings + 1):
        last = seen.where(F.col("ring") == ring - 1).select("node_id")
        reached = steps.join(last, "node_id").select(F.col("other_id").alias("node_id")).distinct()
        new = reached.join(seen, "node_id", "left_anti").withColumn("ring", F.lit(ring))
        seen = write_table(seen.unionByName(new), "rings")
    return seen


def top_per_node(edge_rows: DataFrame, n: int) -> DataFrame:
    """The n best neighbours of each node by confidence, evidence and name: node_id, other_id, confidence, evidence_count, place."""
    order = Window.partitionBy("node_id").orderBy(F.desc("confidence"), F.desc("evidence_count"), "other_id")
    best = both_ends(edge_rows).withColumn("place", F.row_number().over(order))
    return best.where(F.col("place") <= n).select("node_id", "other_id", "confidence", "evidence_count", "place")
