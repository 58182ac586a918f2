"""Queries of the training-data problems over a data folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import cuts, leaks, lines, mix, neardup, pairs, scans, split

#: Fixed by the statement of problem 1.
P1 = neardup.NearConfig(width=2, similarity=0.6, min_words=20)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), F.col("chunk_id").alias("owner"), "text")
    spans = table(spark, folder, "graph_evidence").select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"), F.col("chunk_id").alias("owner"), F.col("evidence_text").alias("text"))
    return chunks.unionByName(spans)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_pairs(neardup.near_texts(_records(spark, folder), P1))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_classes(neardup.near_texts(_records(spark, folder), P1))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split.split_oversized(table(spark, folder, "chunks"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where(F.col("source_tokens") > split.SplitConfig().limit).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _repeats(spark: SparkSession, folder: str) -> lines.Repeats:
    return lines.repeated_lines(table(spark, folder, "blocks"), table(spark, folder, "source_documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _repeats(spark, folder).lines.select("document_id", "block_id", "line_no").distinct()


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    kept = table(spark, folder, "blocks").select("document_id", "block_id", "text").distinct()
    return lines.without_repeats(kept, _repeats(spark, folder))


def _scans(spark: SparkSession, folder: str) -> scans.Scans:
    return scans.scan_damage(table(spark, folder, "blocks"), table(spark, folder, "source_documents"), table(spark, folder, "page_inspections"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).damage


def p4_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return scans.paragraphs(_scans(spark, folder), table(spark, folder, "blocks"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.co_occurrence(table(spark, folder, "graph_evidence"), table(spark, folder, "vocabulary"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.associated(_pairs(spark, folder)).select("concept_a", "concept_b")


def p5_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p5_edges(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.stale_edges(table(spark, folder, "graph_edges"), table(spark, folder, "graph_evidence"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "bench_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "question_id")


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, folder))


def _mixture(spark: SparkSession, folder: str) -> mix.Mixture:
    # longer records are somewhat likelier in the sampled remainder
    weight = F.log2(F.col("n_tokens") + 2)
    return mix.mix(table(spark, folder, "documents"), table(spark, folder, "source_mix"), weight=weight)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).chosen


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).shares


def _cuts(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.cut_documents(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cuts(spark, folder).where("is_cut").select("doc_id")


def p8_sources(spark: SparkSession, folder: str) -> DataFrame:
    return cuts.cut_rates(_cuts(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_pieces, p3_found, p3_clean, p4_found, p4_paragraphs, p5_found, p5_pairs, p5_edges, p6_found, p6_items, p7_mix, p7_shares, p8_found, p8_sources)
}

_FORM = r"trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g'), '\p{N}+', '#', 'g'))"

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_LEAKS = r"""
        w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        a AS (SELECT question_id, regexp_extract_all(lower(max(reference_answer)), '[\p{L}\p{N}]+') AS w FROM bench_items WHERE reference_answer IS NOT NULL GROUP BY question_id),
        dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM w WHERE len(w) >= 12),
        ar AS (SELECT DISTINCT question_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM a WHERE len(w) >= 12),
        n AS (SELECT question_id, count(*) AS n FROM ar GROUP BY question_id)"""
# longer aliases are replaced by the number of their concept first, so shorter ones find no claimed characters
_PAIRS = rf"""
        va AS (SELECT {_NORM.format('alias')} AS alias, min(canonical) AS canonical FROM vocabulary WHERE {_NORM.format('alias')} <> '' GROUP BY 1),
        vn AS (SELECT canonical, row_number() OVER (ORDER BY canonical) AS no FROM (SELECT DISTINCT canonical FROM va)),
        vl AS (SELECT list(struct_pack(a := alias, r := '<' || no || '>') ORDER BY length(alias) DESC, alias) AS l FROM va JOIN vn USING (canonical)),
        e AS (SELECT DISTINCT chunk_id, evidence_text FROM graph_evidence),
        c AS (SELECT chunk_id, evidence_text, list_distinct(regexp_extract_all(list_reduce(list_prepend(struct_pack(a := coalesce({_NORM.format('evidence_text')}, ''), r := ''), l),
            lambda s, x: struct_pack(a := regexp_replace(s.a, '\b' || x.a || '\b', x.r, 'g'), r := '')).a, '<(\d+)>', 1)) AS k FROM e, vl),
        m AS (SELECT row_number() OVER () AS r, k FROM c), u AS (SELECT r, canonical AS x FROM (SELECT r, unnest(k) AS no FROM m) q JOIN vn ON vn.no = CAST(q.no AS BIGINT)),
        single AS (SELECT x, count(*) AS n FROM u GROUP BY x), total AS (SELECT count(*) AS n_records FROM e),
        ab AS (SELECT p.x AS concept_a, q.x AS concept_b, count(*) AS n_ab FROM u p JOIN u q ON p.r = q.r AND p.x < q.x GROUP BY ALL),
        pairs AS (SELECT concept_a, concept_b, n_ab, s.n AS n_a, t.n AS n_b, n_records FROM ab JOIN single s ON s.x = concept_a JOIN single t ON t.x = concept_b, total)"""

SQL: dict[str, str] = {
    "p1_found": rf"""
        WITH r AS (SELECT DISTINCT 'c' AS kind, chunk_id AS id, chunk_id AS owner, {_WORDS.format('text')} AS w FROM chunks UNION SELECT DISTINCT 'e', evidence_id, chunk_id, {_WORDS.format('evidence_text')} FROM graph_evidence),
        k AS (SELECT kind, id, owner, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM r WHERE len(w) >= 20),
        t AS (SELECT row_number() OVER () AS t, kind, g FROM (SELECT DISTINCT kind, list_sort(g) AS g FROM k)),
        x AS (SELECT t, kind, len(g) AS n, unnest(g) AS gram FROM t),
        s AS (SELECT a.t AS p, b.t AS q, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM x a JOIN x b ON a.gram = b.gram AND a.kind = b.kind AND a.t < b.t AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY a.t, b.t),
        l AS (SELECT p, q FROM s WHERE shared >= 0.6 * (n + m - shared) UNION ALL SELECT t, t FROM t),
        h AS (SELECT t, id, owner FROM k JOIN t ON t.kind = k.kind AND t.g = list_sort(k.g))
        SELECT DISTINCT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id FROM l JOIN h a ON a.t = l.p JOIN h b ON b.t = l.q WHERE a.id <> b.id AND a.owner <> b.owner""",
    "p5_found": f"WITH {_PAIRS} SELECT concept_a, concept_b FROM pairs WHERE n_ab >= 5 AND n_ab * n_records >= 2 * n_a * n_b",
    "p5_pairs": f"""WITH {_PAIRS} SELECT *, round(n_ab * n_records / (n_a * n_b), 6) AS lift,
        round(ln((n_ab + 0.5) * (n_records - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds FROM pairs""",
    "p6_items": f"""WITH {_LEAKS}, f AS (SELECT doc_id, question_id, count(*) AS k FROM dr JOIN ar USING (run) GROUP BY ALL)
        SELECT question_id, count(*) AS n_documents, count(*) FILTER (k = n) AS n_whole, round(max(k / n), 6) AS max_share FROM f JOIN n USING (question_id) GROUP BY question_id""",
    "p3_clean": rf"""
        WITH b AS (SELECT DISTINCT document_id, block_id, text FROM blocks), y AS (SELECT DISTINCT document_id, block_id, text FROM blocks WHERE text IS NOT NULL),
        l AS (SELECT document_id, block_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM y),
        f AS (SELECT document_id, block_id, line_no, {_FORM} AS form FROM l),
        s AS (SELECT DISTINCT document_id, section FROM source_documents WHERE section IS NOT NULL),
        n AS (SELECT section, count(DISTINCT document_id) AS n_docs FROM s SEMI JOIN blocks USING (document_id) GROUP BY section),
        c AS (SELECT section, form, count(DISTINCT document_id) AS n_with FROM f JOIN s USING (document_id) WHERE length(form) >= 25 GROUP BY section, form),
        z AS (SELECT document_id, block_id, list(DISTINCT line_no) AS d FROM f JOIN s USING (document_id) JOIN c USING (section, form) JOIN n USING (section) WHERE n_with >= 5 AND n_with * 125 >= n_docs GROUP BY ALL)
        SELECT document_id, block_id, CASE WHEN d IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(d, i)), chr(10)) END AS text,
            CAST(coalesce(len(d), 0) AS INTEGER) AS n_removed FROM b LEFT JOIN z USING (document_id, block_id)""",
    "p2_found": r"""
        SELECT DISTINCT chunk_id FROM chunks
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) > 300""",
    "p3_found": rf"""
        WITH b AS (SELECT DISTINCT document_id, block_id, text FROM blocks WHERE text IS NOT NULL),
        l AS (SELECT document_id, block_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM b),
        f AS (SELECT document_id, block_id, line_no, {_FORM} AS form FROM l),
        s AS (SELECT DISTINCT document_id, section FROM source_documents WHERE section IS NOT NULL),
        n AS (SELECT section, count(DISTINCT document_id) AS n_docs FROM s SEMI JOIN blocks USING (document_id) GROUP BY section),
        c AS (SELECT section, form, count(DISTINCT document_id) AS n_with FROM f JOIN s USING (document_id) WHERE length(form) >= 25 GROUP BY section, form)
        SELECT DISTINCT document_id, block_id, CAST(line_no AS INTEGER) AS line_no
        FROM f JOIN s USING (document_id) JOIN c USING (section, form) JOIN n USING (section)
        WHERE n_with >= 5 AND n_with * 125 >= n_docs""",
    "p5_edges": """
        WITH e AS (SELECT edge_id, max(evidence_count) AS evidence_count, max(evidence_ids) AS ids FROM graph_edges GROUP BY edge_id),
        x AS (SELECT edge_id, unnest(list_distinct(ids)) AS evidence_id FROM e),
        n AS (SELECT edge_id, count(*) AS n FROM x SEMI JOIN graph_evidence USING (evidence_id) GROUP BY edge_id)
        SELECT edge_id, evidence_count, coalesce(n, 0) AS n_evidence FROM e LEFT JOIN n USING (edge_id)
        WHERE evidence_count IS DISTINCT FROM coalesce(n, 0)""",
    "p6_found": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        a AS (SELECT question_id, regexp_extract_all(lower(reference_answer), '[\p{L}\p{N}]+') AS w FROM bench_items WHERE reference_answer IS NOT NULL),
        dr AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM w WHERE len(w) >= 12),
        ar AS (SELECT DISTINCT question_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM a WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, question_id FROM dr JOIN ar USING (run)""",
}
