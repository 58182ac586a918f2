"""SQL of the library's queries, for an independent engine over the same tables."""

from __future__ import annotations

from .oracles import SQL as _CATALOG
from .oracles import _BL, _CH, _DOC, _ED, _ENDS, _EV, _FORM, _FURNITURE, _METRICS, _Q, _TERMS, _bm25

_NODE = "'concept:' || " + _FORM
_ENTRIES = r"""en AS (SELECT DISTINCT document_id AS entry_no, source_sha256 AS sha, NULL::VARCHAR AS path, 'EXCLUDE' AS e_status, 'curator' AS e_author FROM source_documents WHERE index_status = 'REVIEW' AND source_sha256 IS NOT NULL
    UNION SELECT '~' || section, NULL, section || '\The_', 'INCLUDE', NULL FROM source_documents WHERE section IS NOT NULL)"""
_FOUND = _ENTRIES + r""", sd AS (SELECT document_id, max(source_sha256) AS sha, max(source_path) AS path FROM source_documents GROUP BY document_id),
    bs AS (SELECT sha, min(entry_no) AS own FROM en WHERE sha IS NOT NULL GROUP BY sha),
    bp AS (SELECT document_id, min(entry_no) AS near FROM sd JOIN en ON contains(lower(replace(sd.path, '\', '/')), lower(replace(en.path, '\', '/'))) GROUP BY document_id),
    fo AS (SELECT document_id, coalesce(own, near) AS entry_no, CASE WHEN own IS NOT NULL THEN 'sha' WHEN near IS NOT NULL THEN 'path' END AS matched_by
        FROM sd LEFT JOIN bs USING (sha) LEFT JOIN bp USING (document_id))"""
_SHA = "sh AS (SELECT document_id, any_value(source_sha256) AS sha256 FROM source_documents GROUP BY document_id)"
_STATE = f"""{_CH}, {_DOC}, {_SHA}, nc AS (SELECT document_id, count(*) AS n_chunks FROM ch GROUP BY document_id),
    st AS (SELECT document_id, CASE WHEN author IS NOT NULL THEN sha256 ELSE 'before' END AS sha256, CASE WHEN source_type = 'PRIMARY' THEN 'v1' ELSE 'v2' END AS config_version,
        CASE WHEN page_count > 2 THEN 'old' ELSE 'hash-64' END AS model_name FROM doc JOIN sh USING (document_id) JOIN nc USING (document_id))"""
_STAGES = f"""{_STATE}, fi AS (SELECT document_id, max(source_sha256) AS sha256, bool_or(source_path IS NULL) AS failed FROM source_documents GROUP BY document_id),
    sg AS (SELECT document_id, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN failed THEN 'ERROR' WHEN i AND p THEN 'INDEXED' WHEN i OR n_chunks > 0 THEN 'CHUNKED' WHEN p THEN 'PROCESSED' ELSE 'DISCOVERED' END AS stage
        FROM (SELECT fi.document_id, failed, n_chunks, fi.document_id IN (SELECT document_id FROM blocks) AS p, st.document_id IS NOT NULL AS i
            FROM fi LEFT JOIN nc ON nc.document_id = fi.document_id LEFT JOIN st ON st.document_id = fi.document_id AND st.sha256 = fi.sha256))"""
_REASONS = """re AS (SELECT sh.document_id, CASE WHEN st.document_id IS NULL THEN 'new' WHEN sh.sha256 IS DISTINCT FROM st.sha256 THEN 'source_changed' WHEN st.config_version <> 'v2' THEN 'config_changed'
    WHEN st.model_name <> 'hash-64' THEN 'model_changed' ELSE 'unchanged' END AS reason FROM sh LEFT JOIN st USING (document_id))"""
_HASH = """sha256(concat_ws('-', CAST(coalesce(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)), 0) AS VARCHAR), CAST(coalesce(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)), 0) AS VARCHAR),
    CAST(coalesce(sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)), 0) AS VARCHAR)))"""
_WORDS = r"list_filter(list_transform(regexp_split_to_array(lower(coalesce({0}, '')), '\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '')"

_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
#: Longer aliases are replaced by the number of their concept first, so shorter ones find no claimed characters.
_ALIASES = f"""va AS (SELECT {_NORM.format('alias')} AS alias, min(canonical) AS canonical FROM vocabulary WHERE {_NORM.format('alias')} <> '' GROUP BY 1),
    vn AS (SELECT canonical, row_number() OVER (ORDER BY canonical) AS no FROM (SELECT DISTINCT canonical FROM va)),
    vl AS (SELECT list(struct_pack(a := alias, r := '<' || no || '>') ORDER BY length(alias) DESC, alias) AS l, list(canonical ORDER BY canonical) FILTER (first) AS names
        FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY alias) = 1 AS first FROM va JOIN vn USING (canonical)))"""
_CLAIMED = r"list_reduce(list_prepend(struct_pack(a := {0}, r := ''), l), lambda s, x: struct_pack(a := regexp_replace(s.a, '\b' || x.a || '\b', x.r, 'g'), r := ''))"

SQL: dict[str, str] = {
    "find_mentions": f"""WITH {_ALIASES}, e AS (SELECT DISTINCT chunk_id, evidence_text FROM graph_evidence),
        c AS (SELECT chunk_id, evidence_text, regexp_extract_all(({_CLAIMED.format(_NORM.format('coalesce(translate(evidence_text, chr(383), chr(115)), chr(32))'))}).a, '<(\\d+)>', 1) AS k FROM e, vl),
        m AS (SELECT chunk_id, evidence_text, unnest(k) AS no, unnest(range(len(k))) AS i FROM c), f AS (SELECT chunk_id, evidence_text, no, min(i) AS i FROM m GROUP BY ALL),
        n AS (SELECT chunk_id, evidence_text, string_agg(canonical, '|' ORDER BY i) AS names FROM f JOIN vn ON vn.no = CAST(f.no AS BIGINT) GROUP BY ALL)
        SELECT chunk_id, sha256(coalesce(evidence_text, '')) AS span, coalesce(names, '') AS names FROM e LEFT JOIN n USING (chunk_id, evidence_text)""",
    "failure_counts": _CATALOG["failure_categories"].split("SELECT query_id, category, CAST(row_number")[0] + "SELECT category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY category",
    "page_metrics": f"""WITH {_CH}, {_Q}, {_TERMS}, {_bm25('bm25', 'query', 10)}, {_bm25('answers', 'reference_answer', 3)},
        labels AS (SELECT DISTINCT query_id, document_id || ':' || page AS key FROM (SELECT query_id, document_id, unnest(page_numbers) AS page FROM answers JOIN ch ON ch.chunk_id = answers.id)),
        x AS (SELECT query_id, rank, document_id, unnest(page_numbers) AS page, unnest(range(len(page_numbers))) AS pos FROM bm25 JOIN ch ON ch.chunk_id = bm25.id),
        y AS (SELECT query_id, document_id || ':' || page AS key, min(rank * 100000 + pos) AS seen FROM x GROUP BY ALL),
        runs AS (SELECT 'bm25' AS mode, query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY seen, key) AS rank FROM y),
        {_METRICS[_METRICS.index('ks AS'):]} SELECT * FROM per""",
    "latest_blocks": """WITH l AS (SELECT document_id, block_id, max(struct_pack(at := ingested_at, page := page_number)) AS x FROM blocks GROUP BY ALL)
        SELECT x.page AS page_number, count(*) AS n, CAST(max(x.at) AT TIME ZONE 'UTC' AS VARCHAR) AS last FROM l GROUP BY x.page""",
    "validate_graph": f"""WITH o AS (SELECT DISTINCT edge_id, source_node_id AS s, target_node_id AS t, confidence, evidence_ids, evidence_count, status, build_id, relationship_type FROM graph_edges),
        v AS (SELECT DISTINCT {_NODE.format('canonical')} AS node FROM vocabulary),
        u AS (SELECT build_id, relationship_type, least(s, t) AS a, greatest(s, t) AS b, list(DISTINCT edge_id) AS ids FROM o GROUP BY ALL HAVING count(DISTINCT edge_id) > 1)
        SELECT edge_id AS id, 'self_edge' AS problem FROM o WHERE s = t UNION SELECT edge_id, 'bad_confidence' FROM o WHERE confidence NOT BETWEEN 0 AND 1
        UNION SELECT edge_id, 'unknown_node' FROM o WHERE s NOT IN (SELECT node FROM v) OR t NOT IN (SELECT node FROM v)
        UNION SELECT edge_id, 'lost_evidence' FROM (SELECT edge_id, unnest(evidence_ids) AS evidence_id FROM o) ANTI JOIN graph_evidence USING (evidence_id)
        UNION SELECT edge_id, 'trusted_without_evidence' FROM o WHERE status = 'TRUSTED' AND (evidence_count = 0 OR coalesce(len(evidence_ids), 0) = 0)
        UNION SELECT edge_id, 'duplicate_edge' FROM o GROUP BY edge_id HAVING count(*) > 1 UNION SELECT unnest(ids), 'unmerged_edge' FROM u
        UNION SELECT evidence_id, 'lost_chunk' FROM graph_evidence WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks) OR chunk_id IS NULL
        UNION SELECT evidence_id, 'duplicate_evidence' FROM graph_evidence GROUP BY evidence_id HAVING count(*) > 1
        UNION SELECT evidence_id, 'no_document' FROM graph_evidence WHERE coalesce(document_id, '') = '' OR coalesce(chunk_id, '') = ''
        UNION SELECT evidence_id, 'no_pages' FROM graph_evidence WHERE coalesce(len(page_numbers), 0) = 0 UNION SELECT evidence_id, 'empty_span' FROM graph_evidence WHERE trim(coalesce(evidence_text, '')) = ''""",
    "read_registry": rf"WITH {_ENTRIES} SELECT entry_no, lower(sha) AS sha, NULL AS needle FROM en WHERE sha IS NOT NULL UNION ALL SELECT entry_no, NULL, lower(replace(path, '\', '/')) FROM en WHERE path IS NOT NULL",
    "registry_lookup": f"WITH {_FOUND} SELECT document_id, entry_no, matched_by FROM fo",
    "registry_apply": f"""WITH {_DOC}, {_FOUND} SELECT document_id, coalesce(e_status, 'REVIEW') AS index_status, title, coalesce(e_author, author) AS author
        FROM doc LEFT JOIN fo USING (document_id) LEFT JOIN en USING (entry_no)""",
    "status_join": f"WITH {_STAGES} SELECT * FROM sg",
    "reindex_reasons": f"WITH {_STATE}, {_REASONS} SELECT * FROM re",
    "ingest_batch": f"""WITH {_STAGES}, {_REASONS} SELECT document_id, CASE WHEN stage = 'ERROR' THEN 'failed' WHEN stage = 'DISCOVERED' OR reason = 'source_changed' THEN 'parse'
        WHEN stage = 'PROCESSED' OR reason = 'config_changed' THEN 'chunk' WHEN stage = 'CHUNKED' OR reason = 'model_changed' THEN 'index' ELSE 'reuse' END AS action FROM sg LEFT JOIN re USING (document_id)""",
    "batch_totals": f"""WITH {_STATE}, {_BL}, {_REASONS} SELECT (SELECT CAST(sum(page_count) AS BIGINT) FROM doc) AS n_pages, (SELECT count(*) FROM doc) AS n_documents, (SELECT count(*) FROM bl) AS n_blocks,
        (SELECT count(*) FROM ch) AS n_chunks, (SELECT count(*) FROM re WHERE reason = 'unchanged') AS n_unchanged""",
    "discovery_hash": f"""WITH r AS (SELECT DISTINCT source_path, source_sha256, page_count FROM source_documents), x AS (SELECT sha256(concat_ws(chr(1), coalesce(source_path, chr(0)), coalesce(source_sha256, chr(0)), coalesce(CAST(page_count AS VARCHAR), chr(0)))) AS h FROM r)
        SELECT count(*) AS n, {_HASH} AS fingerprint FROM x""",
    "dataset_fingerprint": f"""WITH {_Q}, x AS (SELECT sha256(concat_ws(chr(1), query_id, coalesce(query, chr(0)), coalesce(reference_answer, chr(0)))) AS h FROM q) SELECT count(*) AS n, {_HASH} AS fingerprint FROM x""",
    "graph_staleness": f"""WITH {_EV}, b AS (SELECT edge_id, any_value(build_id) AS build_id, any_value(evidence_ids) AS ids FROM graph_edges GROUP BY edge_id), x AS (SELECT build_id, unnest(ids) AS evidence_id FROM b),
        l AS (SELECT evidence_id, true AS live FROM ev WHERE chunk_id IN (SELECT chunk_id FROM chunks))
        SELECT build_id, count(*) AS n_evidence, count(*) FILTER (live IS NULL) AS n_stale, count(*) FILTER (live IS NULL) > 0 AS stale FROM x LEFT JOIN l USING (evidence_id) GROUP BY build_id""",
    "source_type_from_path": f"WITH {_DOC} SELECT document_id, CASE WHEN contains(lower(source_path), 'primary') THEN 'PRIMARY' ELSE 'SECONDARY' END AS type FROM doc",
    "embedded_metadata": f"WITH {_DOC} SELECT document_id, nullif(trim(title), '') AS title, nullif(trim(author), '') AS author FROM doc",
    "list_document_ids": "SELECT DISTINCT document_id FROM chunks",
    "discovered_summary": rf"""WITH {_STAGES} SELECT document_id, coalesce(nullif(trim(title), ''), regexp_extract(source_path, '([^/]+?)(?:\.[^./]*)?$', 1)) AS title, page_count, n_chunks, stage FROM doc JOIN sg USING (document_id)""",
    "filtered_search": f"""WITH {_CH}, {_Q}, {_DOC}, {_TERMS.replace('FROM t) GROUP BY id, term', "FROM t WHERE id IN (SELECT chunk_id FROM ch JOIN doc USING (document_id) WHERE source_type = 'PRIMARY')) GROUP BY id, term")}, {_bm25('bm25', 'query', 5)}
        SELECT query_id, id, score, rank FROM bm25""",
    "filter_blocks_page": f"WITH {_BL} SELECT document_id, block_id, block_type, reading_order FROM bl WHERE page_number = 1",
    "structure_filter": f"""WITH {_BL} SELECT document_id, block_id, block_type FROM bl WHERE coalesce(block_type NOT IN {_FURNITURE}, true) AND (contains(lower(text), 'garden') OR contains(lower(block_type), 'garden'))""",
    "filter_sections_paths": f"WITH {_DOC} SELECT document_id, source_path FROM doc WHERE section IN ('reading-room', 'clinic-files') AND index_status = 'INCLUDE'",
    "filter_graph_nodes": f"""SELECT {_NODE.format('canonical')} AS node_id, canonical AS name, max(node_type) AS node_type FROM vocabulary GROUP BY canonical
        HAVING upper(max(node_type)) = 'CONCEPT' AND (contains(lower(canonical), 'er') OR bool_or(contains(lower(alias), 'er')))""",
    "selected_blocks": f"""WITH {_CH}, {_BL}, u AS (SELECT document_id, unnest(source_block_ids) AS block_id FROM ch WHERE chunk_index = 0) SELECT document_id, page_number, block_id FROM bl SEMI JOIN u USING (document_id, block_id)""",
    "section_items": f"""WITH {_BL}, x AS (SELECT document_id, page_number, sum(CAST(coalesce(block_type IN ('TITLE', 'HEADING'), false) AS INTEGER)) OVER (PARTITION BY document_id ORDER BY page_number NULLS FIRST, reading_order NULLS FIRST, block_id ROWS UNBOUNDED PRECEDING) AS no
            FROM bl WHERE coalesce(block_type NOT IN {_FURNITURE}, true))
        SELECT document_id, CAST(no AS BIGINT) AS section_no, count(*) AS n_items, min(page_number) AS first_page FROM x GROUP BY document_id, no""",
    "graph_nodes": f"""WITH {_ED}, {_ENDS}, {_EV}, v AS (SELECT canonical AS name, max(node_type) AS node_type, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases, {_NODE.format('canonical')} AS node_id FROM vocabulary GROUP BY canonical),
        c AS (SELECT node_id, count(*) AS n_edges, CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS evidence_count FROM ends GROUP BY node_id),
        dd AS (SELECT node_id, count(DISTINCT document_id) AS n_documents FROM (SELECT node_id, unnest(evidence_ids) AS evidence_id FROM ends) JOIN ev USING (evidence_id) GROUP BY node_id)
        SELECT node_id, name, node_type, aliases, coalesce(n_edges, 0) AS n_edges, coalesce(evidence_count, 0) AS evidence_count, coalesce(n_documents, 0) AS n_documents FROM v LEFT JOIN c USING (node_id) LEFT JOIN dd USING (node_id)""",
    "graph_totals": f"""WITH {_ED}, {_ENDS}, v AS (SELECT DISTINCT {_NODE.format('canonical')} AS node_id FROM vocabulary)
        SELECT count(*) AS n_edges, count(*) FILTER (status = 'TRUSTED') AS n_trusted, round(avg(evidence_count) FILTER (status = 'TRUSTED'), 1) AS avg_trusted,
            round(avg(CAST(coalesce(len(evidence_ids), 0) > 0 AS INTEGER)), 3) AS backed_ratio, (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM v WHERE node_id NOT IN (SELECT node_id FROM ends)) AS n_orphans FROM ed""",
    "node_names": f"""WITH {_ED}, v AS (SELECT DISTINCT {_NODE.format('canonical')} AS node_id, canonical FROM vocabulary)
        SELECT edge_id, a.canonical AS source_name, b.canonical AS target_name FROM ed LEFT JOIN v a ON a.node_id = source_node_id LEFT JOIN v b ON b.node_id = target_node_id""",
    "evidence_detail": f"WITH {_EV} SELECT evidence_id, document_id, chunk_id, relation_source, length(evidence_text) AS n_chars FROM ev",
    "edge_sort": f"""WITH {_ED}, p AS (SELECT source_node_id AS a, target_node_id AS b, max(confidence) AS confidence, CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS evidence_count FROM ed GROUP BY ALL),
        e AS (SELECT a AS node_id, b AS other_id, confidence, evidence_count FROM p UNION ALL SELECT b, a, confidence, evidence_count FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, evidence_count DESC, other_id) AS place FROM e)
        SELECT node_id, other_id, confidence, evidence_count, CAST(place AS INTEGER) AS place FROM r WHERE place <= 12""",
    "dataset_integrity": """WITH l AS (SELECT DISTINCT evidence_id AS label_id, document_id, chunk_id, page_numbers FROM graph_evidence), h AS (SELECT chunk_id, min(document_id) AS home FROM chunks GROUP BY chunk_id),
        s AS (SELECT document_id, max(page_count) AS page_count FROM source_documents GROUP BY document_id),
        x AS (SELECT l.*, home, s.document_id AS known, page_count FROM l LEFT JOIN h USING (chunk_id) LEFT JOIN s ON s.document_id = l.document_id),
        pg AS (SELECT label_id, page_count, unnest(page_numbers) AS page FROM x)
        SELECT question_id AS key, 'duplicate_question' AS problem FROM (SELECT DISTINCT question_id, question FROM bench_items) GROUP BY question_id HAVING count(*) > 1
        UNION SELECT question_id, 'blank_question' FROM bench_items WHERE trim(coalesce(question, '')) = ''
        UNION SELECT label_id, 'unknown_chunk' FROM x WHERE home IS NULL UNION SELECT label_id, 'unknown_document' FROM x WHERE known IS NULL
        UNION SELECT label_id, 'other_document' FROM x WHERE home <> document_id UNION SELECT label_id, 'page_outside' FROM pg WHERE page < 1 OR page > page_count
        UNION SELECT label_id, 'duplicate_label' FROM l GROUP BY label_id HAVING count(*) > 1""",
    "derivation_check": f"""WITH one AS (SELECT chunk_id, max(struct_pack(text := text, document_id := document_id, ids := source_block_ids)) AS c FROM chunks GROUP BY chunk_id),
        o AS (SELECT chunk_id, c.document_id AS document_id, c.ids AS ids, {_WORDS.format('c.text')} AS own FROM one), u AS (SELECT chunk_id, document_id, unnest(ids) AS block_id, unnest(range(len(ids))) AS pos FROM o),
        k AS (SELECT document_id, block_id, max(text) AS b FROM blocks GROUP BY ALL), w AS (SELECT chunk_id, pos, {_WORDS.format('b')} AS ws FROM u JOIN k USING (document_id, block_id)),
        r AS (SELECT chunk_id, string_agg(array_to_string(ws, ' '), ' ' ORDER BY pos) FILTER (len(ws) > 0) AS src FROM w GROUP BY chunk_id)
        SELECT chunk_id, len(own) = 0 OR contains(' ' || coalesce(src, '') || ' ', ' ' || array_to_string(own, ' ') || ' ') AS contiguous FROM o LEFT JOIN r USING (chunk_id)""",
    "page_sizes": "SELECT document_id, page_number, max(width) AS width, max(height) AS height FROM page_inspections GROUP BY ALL",
}
