"""SQL of the core queries, for an independent engine over the same tables."""

from __future__ import annotations

_CH = """ch AS (SELECT chunk_id, any_value(document_id) AS document_id, any_value(text) AS text, any_value(source_block_ids) AS source_block_ids,
    any_value(page_numbers) AS page_numbers, any_value(heading_path) AS heading_path, any_value(token_count) AS token_count,
    any_value(chunk_index) AS chunk_index, any_value(start_page) AS start_page, any_value(end_page) AS end_page FROM chunks GROUP BY chunk_id)"""
_BL = """bl AS (SELECT document_id, block_id, any_value(page_number) AS page_number, any_value(block_type) AS block_type, any_value(text) AS text,
    any_value(bbox) AS bbox, any_value(reading_order) AS reading_order, any_value(extraction_method) AS extraction_method,
    any_value(confidence) AS confidence, any_value(font_size) AS font_size FROM blocks GROUP BY document_id, block_id)"""
_DOC = """doc AS (SELECT document_id, any_value(title) AS title, any_value(author) AS author, any_value(source_type) AS source_type,
    any_value(index_status) AS index_status, any_value(section) AS section, any_value(source_path) AS source_path,
    any_value(page_count) AS page_count FROM source_documents GROUP BY document_id)"""
_EV = """ev AS (SELECT evidence_id, any_value(document_id) AS document_id, any_value(chunk_id) AS chunk_id, any_value(evidence_text) AS evidence_text,
    any_value(relation_source) AS relation_source, any_value(heading_path) AS heading_path FROM graph_evidence GROUP BY evidence_id)"""
_ED = """ed AS (SELECT edge_id, any_value(source_node_id) AS source_node_id, any_value(target_node_id) AS target_node_id,
    any_value(relationship_type) AS relationship_type, any_value(confidence) AS confidence, any_value(evidence_ids) AS evidence_ids,
    any_value(evidence_count) AS evidence_count, any_value(status) AS status FROM graph_edges GROUP BY edge_id)"""
_ENDS = """ends AS (SELECT source_node_id AS node_id, target_node_id AS other_id, * FROM ed
    UNION ALL SELECT target_node_id, source_node_id, * FROM ed)"""
_Q = "q AS (SELECT question_id AS query_id, any_value(question) AS query, any_value(reference_answer) AS reference_answer FROM bench_items GROUP BY question_id)"

#: Fixed: compatibility characters of letters and digits that scanned text holds, and their plain forms.
_NFKC = "replace(replace(replace(replace(translate({0}, 'ſ²³¹ªº', 's231ao'), 'ﬃ', 'ffi'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
_LEX = "regexp_extract_all(lower(" + _NFKC + "), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"
_TOK = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
_LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_FOLIO = r"regexp_matches(line, '(?i)^\s*[-—–|.]?\s*(\d{1,4}|[ivxlcdm]{1,7})\s*[-—–|.]*\s*$') AND length(trim(line)) <= 12"
_PG = "pg AS (SELECT document_id, page_number, max(width) AS width, max(height) AS height FROM page_inspections GROUP BY ALL)"
_KIND = r"""e AS (SELECT document_id, block_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t, list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> '') AS ls,
        CASE WHEN font_size > 0 AND body_size > 0 THEN font_size / body_size END AS ratio, bbox.y0 AS y0, bbox.y1 AS y1, coalesce(height, 842) AS height
        FROM bl LEFT JOIN body USING (document_id) LEFT JOIN pg USING (document_id, page_number) WHERE text IS NOT NULL),
    f AS (SELECT *, length(t) AS n, len(ls) AS lines, len(list_filter(ls, lambda l: regexp_matches(l, '^\s*([-*•]|\d+[.)])\s+'))) AS bulleted,
        regexp_matches(t, '(?i)^(page\s+)?\d+$') OR (regexp_matches(t, '(?i)^[ivxlcdm]+$') AND length(t) <= 8) AS number,
        coalesce(y1 <= 0.08 * height, false) AS top, coalesce(y0 >= 0.93 * height, false) AS bottom FROM e),
    k AS (SELECT *, CASE WHEN (top OR bottom) AND number THEN 'PAGE_NUMBER' WHEN (top OR bottom) AND n <= 80 THEN CASE WHEN bottom THEN 'FOOTER' ELSE 'HEADER' END WHEN top OR bottom THEN 'UNKNOWN'
        WHEN bulleted >= 2 AND bulleted >= lines - 1 THEN 'LIST' WHEN ratio >= 1.35 AND n <= 150 AND lines <= 3 THEN CASE WHEN coalesce(y0 < 0.18 * height, false) THEN 'TITLE' ELSE 'HEADING' END
        WHEN ratio >= 1.15 AND n <= 120 AND lines <= 2 THEN 'HEADING' WHEN ratio <= 0.85 AND n <= 200 AND lines <= 2 AND regexp_matches(t, '(?i)(figure|fig\.|plate|table)') THEN 'CAPTION'
        WHEN lines >= 2 OR regexp_matches(t, '[.!?:;”’''"]$') OR n >= 200 THEN 'PARAGRAPH' WHEN n >= 40 AND (ratio IS NULL OR (ratio > 0.85 AND ratio < 1.15)) THEN 'PARAGRAPH' ELSE 'UNKNOWN' END AS kind FROM f)"""
_FURNITURE = "('HEADER', 'FOOTER', 'PAGE_NUMBER')"

_TERMS = f"""t AS (SELECT chunk_id AS id, {_LEX.format('text')} AS tokens FROM ch),
    n AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM t),
    df AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(tokens)) AS term FROM t) GROUP BY term),
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
    idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    p AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM t) GROUP BY id, term)"""


def _bm25(name: str, text: str, k: int) -> str:
    """CTEs of a lexical leg: name(query_id, id, score, rank)."""
    return f"""{name}_a AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_LEX.format(text)}) AS term FROM q WHERE {text} IS NOT NULL) GROUP BY query_id, term),
    {name}_s AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM p JOIN {name}_a USING (term) JOIN idf USING (term), n GROUP BY query_id, id),
    {name} AS (SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


def _features(name: str, key: str, text: str, source: str) -> str:
    place = "CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT) % 64"
    sign = "CASE WHEN CAST(concat('0x', substr(md5(token), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END"
    return f"""{name}_t AS (SELECT {key} AS id, unnest({_LEX.format(text)}) AS token FROM {source}),
    {name}_r AS (SELECT id, CAST({place} AS INTEGER) AS dim, CAST(sum({sign}) AS DOUBLE) AS w FROM {name}_t GROUP BY ALL),
    {name} AS (SELECT id, dim, w / norm AS weight FROM {name}_r JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_r GROUP BY id) USING (id) WHERE norm > 0)"""


def _dense(k: int) -> str:
    return f"""{_features('fq', 'query_id', 'query', 'q')}, {_features('fc', 'chunk_id', 'text', 'ch')},
    dp AS (SELECT a.id AS query_id, b.id AS id, sum(a.weight * b.weight) AS score FROM fq a JOIN fc b USING (dim) GROUP BY 1, 2),
    ds AS (SELECT query_id, id, round(coalesce(dp.score, 0), 6) AS score FROM (SELECT * FROM (SELECT DISTINCT id AS query_id FROM fq) CROSS JOIN (SELECT DISTINCT id FROM fc)) LEFT JOIN dp USING (query_id, id)),
    dense AS (SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ds) WHERE rank <= {k})"""


_LEGS = f"WITH {_CH}, {_Q}, {_TERMS}, {_bm25('bm25', 'query', 30)}, {_dense(30)}"
_FUSED = """f AS (SELECT query_id, id, d.rank AS dense_rank, d.score AS dense_score, b.rank AS bm25_rank, b.score AS bm25_score,
        round(coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + b.rank), 0), 6) AS fusion_score FROM dense d FULL JOIN bm25 b USING (query_id, id)),
    fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, id) AS INTEGER) AS fusion_rank FROM f QUALIFY fusion_rank <= 20)"""
_RERANKED = f"""k AS (SELECT query_id, id, fusion_rank, CAST(len(list_intersect({_LEX.format('query')}, {_LEX.format('text')})) AS DOUBLE) AS reranker_score
        FROM fused JOIN q USING (query_id) JOIN ch ON ch.chunk_id = fused.id),
    reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, id) AS INTEGER) AS reranker_rank FROM k QUALIFY reranker_rank <= 10)"""
_METRICS = f"""{_LEGS}, {_FUSED}, {_RERANKED}, {_bm25('answers', 'reference_answer', 3)},
    labels AS (SELECT query_id, id AS key FROM answers),
    runs AS (SELECT 'dense' AS mode, query_id, id AS key, rank FROM dense UNION ALL SELECT 'bm25', query_id, id, rank FROM bm25
        UNION ALL SELECT 'hybrid', query_id, id, fusion_rank FROM fused UNION ALL SELECT 'hybrid_rerank', query_id, id, reranker_rank FROM reranked),
    ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
    nrel AS (SELECT query_id, count(*) AS n_rel FROM labels GROUP BY query_id),
    sums AS (SELECT mode, r.query_id, k, count(*) FILTER (rank <= k AND l.key IS NOT NULL) AS hits, count(*) FILTER (rank <= k) AS returned,
        coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k AND l.key IS NOT NULL), 0) AS dcg, min(rank) FILTER (l.key IS NOT NULL) AS first_rank
        FROM runs r LEFT JOIN labels l ON r.query_id = l.query_id AND r.key = l.key, ks GROUP BY mode, r.query_id, k),
    grid AS (SELECT mode, query_id, k FROM (SELECT DISTINCT mode FROM runs), (SELECT query_id FROM q), ks),
    per AS (SELECT mode, query_id, k,
        CASE WHEN n_rel IS NULL THEN 0.0 ELSE CAST(coalesce(hits, 0) > 0 AS DOUBLE) END AS hit,
        round(CASE WHEN n_rel IS NULL THEN 0.0 ELSE coalesce(hits, 0) / n_rel END, 6) AS recall,
        round(CASE WHEN n_rel IS NULL THEN 0.0 ELSE coalesce(hits / greatest(1, least(k, returned)), 0) END, 6) AS precision,
        round(CASE WHEN n_rel IS NULL THEN 0.0 ELSE coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n_rel, k) AS INTEGER) + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg,
        round(CASE WHEN n_rel IS NULL THEN 0.0 ELSE coalesce(1 / first_rank, 0) END, 6) AS mrr,
        CASE WHEN n_rel IS NOT NULL THEN first_rank END AS first_rank
        FROM grid LEFT JOIN sums USING (mode, query_id, k) LEFT JOIN nrel USING (query_id))"""
_MEANS = """means AS (SELECT mode, k, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision,
    round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, count(*) AS n_questions FROM per GROUP BY mode, k)"""
_SIGNALS = r"""sig AS (SELECT document_id, page_number, CAST(coalesce(sum(length(regexp_replace(text, '\s', '', 'g'))), 0) AS BIGINT) AS text_length,
    count(*) FILTER (length(text) > 0) AS n_blocks, round(avg(font_size), 4) AS avg_font_size FROM bl GROUP BY document_id, page_number)"""
_BODY = """sizes AS (SELECT document_id, font_size, unnest(range(CAST(least(greatest(floor(length(text) / 100), 1), 5) AS INTEGER))) AS i
        FROM bl WHERE font_size IS NOT NULL AND text IS NOT NULL),
    body AS (SELECT document_id, median(font_size) AS body_size FROM sizes GROUP BY document_id)"""
_FORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
_PRINT = r"""SELECT document_id, count(*) AS n, sha256(concat_ws('-', CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR), CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR),
    CAST(sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)) AS VARCHAR))) AS fingerprint FROM (SELECT document_id,
    sha256(chr(0) || chunk_id || chr(1) || trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM ch {0}) GROUP BY document_id"""
_RELATION = r"""CASE WHEN regexp_matches(evidence_text, '(?i)\bpart of\b|\bcomponent of\b') THEN 'PART_OF'
    WHEN regexp_matches(evidence_text, '(?i)\bcontrast(s|ing)? (with|to)\b|\bunlike\b|\bopposed? to\b') THEN 'CONTRASTS_WITH'
    WHEN regexp_matches(evidence_text, '(?i)\bsymbol(ize|ize s|ises|ic)?\b|\bsymbol of\b') THEN 'SYMBOLIZES'
    WHEN regexp_matches(evidence_text, '(?i)\bdevelop(s|ment|ed)? (of|into|from)\b') THEN 'DEVELOPS'
    WHEN regexp_matches(evidence_text, '(?i)\bintegrat(e|es|ion) (of|with|into)\b') THEN 'INTEGRATES'
    WHEN regexp_matches(evidence_text, '(?i)\binfluence[sd]? by\b') THEN 'INFLUENCES' ELSE 'RELATED_TO' END"""
_LINES = "ln AS (SELECT document_id, block_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM bl WHERE length(text) > 0)"
_LOW = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
_BARE = r"trim(regexp_replace({0}, '^\s*\d{{1,4}}\s+|\s+\d{{1,4}}\s*$', ' ', 'g'))"

SQL: dict[str, str] = {
    "lex_tokens": f"WITH {_CH} SELECT chunk_id, array_to_string({_LEX.format('text')}, ' ') AS tokens FROM ch",
    "count_tokens": f"WITH {_CH} SELECT chunk_id, len({_TOK.format('text')}) AS n_tokens FROM ch",
    "truncate_tokens": rf"""WITH {_CH} SELECT chunk_id, trim(array_to_string(list_transform({_TOK.format('text')}[1:40],
        lambda t: CASE WHEN regexp_matches(t, '^[\p{{L}}\p{{N}}_]') THEN t || ' ' ELSE t END), '')) AS cut FROM ch""",
    "preview": f"WITH {_CH} SELECT chunk_id, substr({_LINE.format('text')}, 1, 160) AS preview FROM ch",
    "split_sentences_graph": rf"""WITH {_CH}, s AS (SELECT chunk_id, trim(unnest(string_split(regexp_replace({_LINE.format('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS sentence FROM ch)
        SELECT chunk_id, count(*) AS n_sentences, CAST(sum(length(sentence)) AS BIGINT) AS n_chars FROM s WHERE len(string_split(sentence, ' ')) >= 4 GROUP BY chunk_id""",
    "split_sentences_chunk": rf"WITH {_CH} SELECT chunk_id, len(string_split(regexp_replace(text, '([.!?:;”’])\s+', '\1' || chr(1), 'g'), chr(1))) AS n_sentences FROM ch",
    "norm_tokens": rf"""WITH {_CH} SELECT chunk_id, array_to_string(list_filter(list_transform(string_split({_LOW.format('text')}, ' '),
        lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> ''), ' ') AS tokens FROM ch""",
    "is_folio": f"WITH {_BL}, {_LINES} SELECT document_id, block_id, pos, trim(line) AS line FROM ln WHERE {_FOLIO}",
    "strip_edge_numbers": f"""WITH {_BL} SELECT document_id, block_id, {_LOW.format(_BARE.format('text'))} AS bare FROM bl WHERE block_type IN ('HEADER', 'FOOTER') AND length(text) > 0""",
    "running_head": f"""WITH {_BL}, {_DOC}, {_LINES} SELECT document_id, block_id, pos FROM ln JOIN doc USING (document_id)
        WHERE trim(line) <> '' AND length(trim(line)) <= 80 AND {_LOW.format('title')} IN ({_LOW.format('line')}, {_LOW.format(_BARE.format('line'))})""",
    "pages_display": f"""WITH {_CH} SELECT chunk_id, CASE WHEN list_min(page_numbers) IS NULL THEN '?' WHEN list_min(page_numbers) = list_max(page_numbers)
        THEN CAST(list_min(page_numbers) AS VARCHAR) ELSE list_min(page_numbers) || '-' || list_max(page_numbers) END AS pages FROM ch""",
    "page_region": f"WITH {_CH} SELECT chunk_id, CAST(floor(list_min(page_numbers) / 8) AS BIGINT) AS region FROM ch",
    "bbox_geometry": f"""WITH {_BL} SELECT document_id, block_id, round(bbox.x1 - bbox.x0, 4) AS width, round(bbox.y1 - bbox.y0, 4) AS height,
        round((bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0), 4) AS area FROM bl""",
    "document_id_hash": rf"WITH {_DOC} SELECT document_id, substr(sha256(source_path), 1, 12) AS path_key, regexp_extract(source_path, '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM doc",
    "concept_norm": f"SELECT DISTINCT alias, {_FORM.format('alias')} AS form, 'concept:' || {_FORM.format('canonical')} AS node_id FROM vocabulary",
    "citations": f"""WITH {_Q}, a AS (SELECT query_id, concat_ws(' ', 'See [S1] and [s3], then [S1]', reference_answer, '[S12].') AS answer FROM q),
        c AS (SELECT query_id, unnest(regexp_extract_all(answer, '(?i)\\[S(\\d+)\\]', 1)) AS n, unnest(range(len(regexp_extract_all(answer, '(?i)\\[S(\\d+)\\]', 1)))) AS i FROM a),
        f AS (SELECT query_id, 'S' || n AS c, min(i) AS i FROM c GROUP BY ALL) SELECT query_id, string_agg(c, ',' ORDER BY i) AS cited FROM f GROUP BY query_id""",
    "l2_normalize": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS l FROM v)
        SELECT id, round(e[1] / l, 6) AS first, round(list_dot_product(e, e) / (l * l), 6) AS square FROM n""",
    "dense_topk": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        s AS (SELECT a.id AS query_id, b.id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.id % 20 = 0)
        SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "hash_embed": f"WITH {_Q}, {_features('f', 'query_id', 'query', 'q')} SELECT id, dim, round(weight, 6) AS weight FROM f",
    "bm25_stats": f"WITH {_CH}, {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_CH}, {_Q}, {_TERMS}, {_bm25('bm25', 'query', 10)} SELECT * FROM bm25",
    "retrieve_dense": f"WITH {_CH}, {_Q}, {_dense(10)} SELECT * FROM dense",
    "retrieve_hybrid": f"{_LEGS}, {_FUSED} SELECT * FROM fused",
    "retrieve_rerank": f"{_LEGS}, {_FUSED}, {_RERANKED} SELECT query_id, id, fusion_rank, reranker_rank, reranker_score FROM reranked",
    "safe_pairs": f"""WITH {_CH}, {_Q}, {_TERMS}, {_bm25('bm25', 'query', 5)}, c AS (SELECT query_id, id, len({_TOK.format('query')}) AS nq, len({_TOK.format('text')}) AS nt
        FROM bm25 JOIN q USING (query_id) JOIN ch ON ch.chunk_id = bm25.id)
        SELECT query_id, id, least(nq, 93) AS query_kept, least(nt, greatest(32, 125 - least(nq, 93))) AS text_kept FROM c""",
    "level_metrics": f"{_METRICS} SELECT * FROM per",
    "mode_aggregate": f"{_METRICS}, {_MEANS} SELECT * FROM means",
    "comparison_table": f"{_METRICS}, {_MEANS} SELECT mode, " + ", ".join(f"max({m}) FILTER (k = {k}) AS {m}_at_{k}" for k in (1, 3, 5, 10) for m in ("hit", "recall", "ndcg")) + " FROM means GROUP BY mode",
    "run_deltas": f"{_METRICS}, {_MEANS} SELECT k, " + ", ".join(f"round(b.{c} - a.{c}, 3) AS {c}_delta" for c in ("hit", "recall", "ndcg", "mrr"))
    + " FROM means a JOIN means b USING (k) WHERE a.mode = 'hybrid' AND b.mode = 'hybrid_rerank'",
    "failure_categories": f"""{_METRICS}, w AS (SELECT query_id, """
    + ", ".join(f"max(hit) FILTER (mode = '{m}') > 0 AS {m}, max(first_rank) FILTER (mode = '{m}') AS {m}_rank" for m in ("dense", "bm25", "hybrid", "hybrid_rerank"))
    + """ FROM per WHERE k = 10 GROUP BY query_id),
        c AS (SELECT query_id, unnest([CASE WHEN dense AND NOT bm25 THEN 'dense_only_win' END, CASE WHEN bm25 AND NOT dense THEN 'bm25_only_win' END,
            CASE WHEN hybrid AND NOT dense AND NOT bm25 THEN 'hybrid_fixes_both' END, CASE WHEN hybrid_rerank_rank < hybrid_rank THEN 'reranker_improves_rank' END,
            CASE WHEN hybrid_rerank_rank > hybrid_rank THEN 'reranker_hurts_rank' END,
            CASE WHEN NOT dense AND NOT bm25 AND NOT hybrid AND NOT hybrid_rerank THEN 'all_methods_fail' END]) AS category FROM w)
        SELECT query_id, category, CAST(row_number() OVER (PARTITION BY category ORDER BY query_id) AS INTEGER) AS place FROM c WHERE category IS NOT NULL QUALIFY place <= 20""",
    "page_first_seen": f"""WITH {_CH}, {_Q}, {_TERMS}, {_bm25('bm25', 'query', 10)},
        x AS (SELECT query_id, rank, document_id, unnest(page_numbers) AS page, unnest(range(len(page_numbers))) AS pos FROM bm25 JOIN ch ON ch.chunk_id = bm25.id),
        y AS (SELECT query_id, document_id || ':' || page AS key, min(rank * 100000 + pos) AS seen FROM x GROUP BY ALL)
        SELECT 'bm25' AS mode, query_id, key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen, key) AS INTEGER) AS rank FROM y""",
    "page_signals": f"WITH {_BL}, {_SIGNALS} SELECT * FROM sig",
    "classify_page": f"""WITH {_BL}, {_SIGNALS}, {_PG}, f AS (SELECT document_id, page_number, count(*) AS n_images,
            coalesce(least(1.0, sum(greatest(bbox.x1 - bbox.x0, 0) * greatest(bbox.y1 - bbox.y0, 0)) / nullif(any_value(width) * any_value(height), 0)), 0) AS ratio
            FROM bl LEFT JOIN pg USING (document_id, page_number) WHERE block_type = 'FIGURE' GROUP BY ALL)
        SELECT document_id, page_number, CASE WHEN text_length = 0 AND coalesce(n_images, 0) = 0 THEN 'EMPTY' WHEN text_length < 20 AND n_images > 0 THEN 'OCR_REQUIRED'
            WHEN text_length < 20 THEN 'EMPTY' WHEN n_blocks = 0 THEN 'SUSPICIOUS' WHEN n_images > 0 AND ratio > 0.1 AND text_length < 500 THEN 'HYBRID' ELSE 'NATIVE' END AS class
        FROM sig LEFT JOIN f USING (document_id, page_number)""",
    "weighted_median": f"WITH {_BL}, {_BODY} SELECT document_id, round(body_size, 4) AS body_size FROM body",
    "classify_block": f"WITH {_BL}, {_BODY}, {_PG}, {_KIND} SELECT document_id, block_id, kind FROM k",
    "quality_score": f"""WITH {_BL}, {_BODY}, {_PG}, {_KIND} SELECT document_id, block_id, CAST(CASE WHEN kind = 'UNKNOWN' THEN NULL WHEN top OR bottom THEN 0.9
        WHEN kind IN ('TITLE', 'HEADING') THEN CASE WHEN ratio >= 1.35 THEN 0.9 ELSE 0.7 END WHEN kind = 'LIST' THEN 0.85 WHEN kind = 'CAPTION' THEN 0.6
        WHEN kind = 'PARAGRAPH' AND (lines >= 2 OR n >= 200) THEN 0.7 ELSE 0.5 END AS DOUBLE) AS score FROM k""",
    "upper_median_size": f"""WITH {_BL}, l AS (SELECT document_id, page_number, list_sort(list(font_size)) AS x FROM bl WHERE font_size IS NOT NULL GROUP BY ALL)
        SELECT document_id, page_number, x[len(x) // 2 + 1] AS size FROM l""",
    "line_rects": f"""WITH {_BL}, l AS (SELECT document_id, page_number, block_id, bbox, len(string_split(text, chr(10))) AS n FROM bl WHERE bbox IS NOT NULL AND length(text) > 0),
        r AS (SELECT *, (bbox.y1 - bbox.y0) / n AS step, unnest(range(1, n + 1)) AS line_no FROM l)
        SELECT document_id, page_number, block_id, CAST(line_no AS INTEGER) AS line_no, bbox.x0 AS x0, round(bbox.y0 + step * (line_no - 1), 4) AS y0, bbox.x1 AS x1, round(bbox.y0 + step * line_no, 4) AS y1 FROM r""",
    "reading_order": f"""WITH {_BL}, pg AS (SELECT document_id, page_number, max(layout) AS layout, max(width) AS width FROM page_inspections GROUP BY ALL)
        SELECT document_id, page_number, block_id, CAST(row_number() OVER (PARTITION BY document_id, page_number ORDER BY
            CASE WHEN layout = 'TWO_COLUMN' AND NOT (bbox.x1 <= width / 2 OR (bbox.x0 + bbox.x1) / 2 < width / 2) THEN 1 ELSE 0 END,
            round(bbox.y0, 1) NULLS FIRST, round(bbox.x0, 1) NULLS FIRST, block_id) AS INTEGER) AS place FROM bl JOIN pg USING (document_id, page_number)""",
    "section_fill": f"""WITH {_BL}, c AS (SELECT *, coalesce(block_type IN ('TITLE', 'HEADING'), false) AS anchor, {_LINE.format('text')} AS name FROM bl WHERE coalesce(block_type NOT IN {_FURNITURE}, true)),
        x AS (SELECT *, sum(CAST(anchor AS INTEGER)) OVER w AS section_no, last_value(CASE WHEN anchor THEN name END IGNORE NULLS) OVER w AS heading,
            last_value(CASE WHEN block_type = 'TITLE' THEN name END IGNORE NULLS) OVER w AS title,
            last_value(CASE WHEN block_type = 'TITLE' THEN struct_pack(h := NULL::VARCHAR) WHEN block_type = 'HEADING' THEN struct_pack(h := name) END IGNORE NULLS) OVER w AS level
            FROM c WINDOW w AS (PARTITION BY document_id ORDER BY page_number NULLS FIRST, reading_order NULLS FIRST, block_id ROWS UNBOUNDED PRECEDING))
        SELECT document_id, block_id, CAST(section_no AS BIGINT) AS section_no, heading, concat_ws(' / ', title, level.h) AS path FROM x""",
    "page_groups": f"""WITH {_BL}, o AS (SELECT document_id, block_id, page_number, page_number * 1000 + reading_order AS ro FROM bl),
        l AS (SELECT *, coalesce(CAST(lag(page_number) OVER w <> page_number AS INTEGER), 1) AS new FROM o WINDOW w AS (PARTITION BY document_id ORDER BY ro NULLS FIRST, block_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY ro NULLS FIRST, block_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
        SELECT document_id, CAST(run AS BIGINT) AS run_no, page_number, count(*) AS n_blocks FROM r GROUP BY document_id, run, page_number""",
    "token_windows": f"""WITH {_CH}, t AS (SELECT chunk_id, {_TOK.format('text')} AS t FROM ch),
        w AS (SELECT chunk_id, t, unnest(range(1 + CAST(greatest(0, ceil((len(t) - 120) / 100)) AS INTEGER))) AS window_no FROM t WHERE len(t) > 0)
        SELECT chunk_id, window_no, len(t[window_no * 100 + 1:window_no * 100 + 120]) AS n_tokens, array_to_string(t[window_no * 100 + 1:window_no * 100 + 120], ' ') AS text FROM w""",
    "x_occupancy": f"""WITH {_BL}, a AS (SELECT document_id, page_number, bbox, count(*) OVER w AS n, min(bbox.x0) OVER w AS lo, max(bbox.x1) OVER w AS hi
            FROM bl WHERE bbox IS NOT NULL WINDOW w AS (PARTITION BY document_id, page_number)),
        b AS (SELECT *, greatest(0, least(49, CAST(floor((bbox.x0 - lo) / (hi - lo) * 50) AS INTEGER))) AS first, greatest(0, least(49, CAST(floor((bbox.x1 - lo) / (hi - lo) * 50) AS INTEGER))) AS last
            FROM a WHERE n >= 3 AND hi - lo > 1),
        x AS (SELECT document_id, page_number, n, unnest(range(first, greatest(first, last) + 1)) AS bin FROM b)
        SELECT document_id, page_number, CAST(bin AS INTEGER) AS bin, round(count(*) / max(n), 6) AS coverage FROM x GROUP BY document_id, page_number, bin""",
    "drop_furniture": f"WITH {_BL} SELECT document_id, page_number, count(*) AS n_blocks FROM bl WHERE coalesce(block_type NOT IN {_FURNITURE}, true) GROUP BY ALL",
    "page_inspection": f"""WITH {_BL}, p AS (SELECT document_id, page_number, max(classification) AS classification FROM page_inspections GROUP BY ALL),
        m AS (SELECT document_id, page_number, count(*) AS n_blocks, round(avg(confidence), 9) AS mean_confidence FROM bl GROUP BY ALL)
        SELECT document_id, page_number, classification, coalesce(n_blocks, 0) AS n_blocks, mean_confidence FROM p LEFT JOIN m USING (document_id, page_number)""",
    "validate_chunks": rf"""WITH {_BL}, one AS (SELECT DISTINCT chunk_id, document_id, text, source_block_ids, page_numbers, start_page, end_page, token_count, chunk_index FROM chunks),
        u AS (SELECT chunk_id, document_id, text, unnest(source_block_ids) AS block_id, unnest(range(len(source_block_ids))) AS pos FROM one),
        r AS (SELECT chunk_id, u.text, string_agg(trim(coalesce(bl.text, ''), ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY pos) AS again FROM u JOIN bl USING (document_id, block_id) GROUP BY chunk_id, u.text),
        o AS (SELECT chunk_id, start_page, lag(start_page) OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS prior FROM one),
        rb AS (SELECT document_id, block_id, max(page_number) AS page, max(reading_order) AS ro, count(*) AS n_rows FROM blocks GROUP BY document_id, block_id),
        us AS (SELECT chunk_id, document_id, text, source_block_ids AS ids, unnest(source_block_ids) AS block_id, unnest(range(len(source_block_ids))) AS pos FROM one),
        sw AS (SELECT chunk_id, block_id, page, ro, lag(page) OVER w AS bp, lag(ro) OVER w AS ba, lag(block_id) OVER w AS bb FROM us JOIN rb USING (document_id, block_id)
            WINDOW w AS (PARTITION BY chunk_id, document_id, text, ids ORDER BY pos)),
        pc AS (SELECT document_id, max(page_count) AS page_count FROM source_documents GROUP BY document_id)
        SELECT chunk_id, 'empty_text' AS problem FROM one WHERE length(trim(coalesce(text, ''))) = 0
        UNION SELECT chunk_id, 'no_blocks' FROM one WHERE coalesce(len(source_block_ids), 0) = 0
        UNION SELECT chunk_id, 'no_pages' FROM one WHERE coalesce(len(page_numbers), 0) = 0
        UNION SELECT chunk_id, 'bad_span' FROM one WHERE start_page > end_page
        UNION SELECT chunk_id, 'bad_count' FROM one WHERE token_count IS DISTINCT FROM len({_TOK.format('text')})
        UNION SELECT chunk_id, 'unknown_block' FROM u ANTI JOIN bl USING (document_id, block_id)
        UNION SELECT chunk_id, 'duplicate_id' FROM one GROUP BY chunk_id HAVING count(*) > 1
        UNION SELECT chunk_id, 'page_order' FROM o WHERE start_page < prior
        UNION SELECT chunk_id, 'repeated_block' FROM u JOIN rb USING (document_id, block_id) WHERE n_rows > 1
        UNION SELECT chunk_id, 'block_order' FROM sw WHERE page = bp AND (ro < ba OR block_id = bb)
        UNION SELECT chunk_id, 'page_outside' FROM (SELECT chunk_id, document_id, unnest(page_numbers) AS page FROM one) LEFT JOIN pc USING (document_id) WHERE page < 1 OR page > page_count
        UNION SELECT chunk_id, 'text_differs' FROM r WHERE text IS DISTINCT FROM again""",
    "chunk_block_join": f"""WITH {_CH}, {_BL}, u AS (SELECT chunk_id, document_id, unnest(source_block_ids) AS block_id FROM ch)
        SELECT chunk_id, count(*) AS n_blocks, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars, min(page_number) AS first_page FROM u JOIN bl USING (document_id, block_id) GROUP BY chunk_id""",
    "source_loss_anti": f"""WITH {_CH}, {_BL}, u AS (SELECT document_id, unnest(source_block_ids) AS block_id FROM ch)
        SELECT block_type, count(*) AS n_lost FROM bl ANTI JOIN u USING (document_id, block_id) WHERE length(trim(text)) > 0 GROUP BY block_type""",
    "order_check": f"""WITH {_CH}, o AS (SELECT chunk_id, start_page, lag(start_page) OVER (PARTITION BY document_id ORDER BY chunk_index NULLS FIRST, chunk_id) AS prior FROM ch)
        SELECT * FROM o WHERE start_page < prior""",
    "corpus_report": """WITH d AS (SELECT document_id, max(section) AS section, max(index_status) AS index_status, max(page_count) AS page_count FROM source_documents GROUP BY document_id)
        SELECT CASE grouping_id(section, index_status) WHEN 1 THEN 'section' WHEN 2 THEN 'status' ELSE 'all' END AS level, coalesce(section, index_status) AS key,
        count(*) AS n_documents, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS n_pages FROM d GROUP BY GROUPING SETS ((section), (index_status), ())""",
    "diagnostics": f"WITH {_BL} SELECT block_type, count(*) AS n_blocks, count(confidence) AS n_measured, round(avg(confidence), 4) AS mean_confidence FROM bl GROUP BY block_type",
    "chunk_stats": f"""WITH {_CH}, p AS (SELECT document_id, count(DISTINCT p) AS n_pages FROM (SELECT document_id, unnest(page_numbers) AS p FROM ch) GROUP BY document_id)
        SELECT document_id, count(*) AS n_chunks, min(token_count) AS min_tokens, max(token_count) AS max_tokens, round(avg(token_count), 4) AS avg_tokens,
        count(*) FILTER (len(page_numbers) > 1) AS n_multi_page, coalesce(any_value(n_pages), 0) AS n_pages FROM ch LEFT JOIN p USING (document_id) GROUP BY document_id""",
    "corpus_fingerprint": f"WITH {_CH} " + _PRINT.format(""),
    "needs_reindex": f"WITH {_CH}, a AS ({_PRINT.format('WHERE chunk_index > 0')}), b AS ({_PRINT.format('')}) " + """SELECT document_id,
        CASE WHEN a.fingerprint IS NULL THEN 'new' WHEN b.fingerprint IS NULL THEN 'deleted' WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'changed' END AS action
        FROM a FULL JOIN b USING (document_id)""",
    "duplicate_ids": """SELECT kind, id, count(*) AS n FROM (SELECT 'evidence' AS kind, evidence_id AS id FROM graph_evidence UNION ALL SELECT 'edge', edge_id FROM graph_edges
        UNION ALL SELECT 'chunk', chunk_id FROM chunks) GROUP BY ALL HAVING count(*) > 1""",
    "author_title_filter": f"""WITH {_DOC} SELECT document_id, title, author FROM doc WHERE (lower(trim(author)) IN ('k. nugilumar', 't. notemolund') OR lower(trim(title)) LIKE 'the %')
        AND source_type IN ('PRIMARY', 'SECONDARY')""",
    "filter_chunks": f"WITH {_CH} SELECT chunk_id, start_page, end_page FROM ch WHERE list_contains(page_numbers, 2) AND contains(lower(array_to_string(heading_path, ' ')), 'and the')",
    "doc_summary": f"""WITH {_CH}, {_DOC}, n AS (SELECT document_id, count(*) AS n FROM ch GROUP BY document_id)
        SELECT document_id, coalesce(title, document_id) AS title, coalesce(author, 'unknown') AS author, coalesce(n, 0) AS n_chunks FROM doc LEFT JOIN n USING (document_id)""",
    "relation_type": f"SELECT {_RELATION} AS relation, count(*) AS n FROM (SELECT DISTINCT evidence_text FROM graph_evidence) GROUP BY 1",
    "node_stats": f"""WITH {_ED}, {_ENDS} SELECT node_id, count(*) AS n_edges, CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS n_evidence, count(DISTINCT other_id) AS n_neighbours,
        round(avg(confidence), 6) AS avg_confidence FROM ends GROUP BY node_id""",
    "graph_overview": f"""WITH {_ED} SELECT status, relationship_type, count(*) AS n_edges, count(*) FILTER (len(evidence_ids) > 0) AS n_backed,
        round(avg(evidence_count), 4) AS avg_evidence FROM ed GROUP BY status, relationship_type""",
    "edge_evidence": f"""WITH {_ED}, {_EV}, l AS (SELECT edge_id, unnest(evidence_ids) AS evidence_id, unnest(range(len(evidence_ids))) AS pos FROM ed)
        SELECT edge_id, CAST(pos AS INTEGER) AS pos, evidence_id, document_id, chunk_id FROM l JOIN ev USING (evidence_id)""",
    "neighbors": f"WITH {_ED}, {_ENDS} SELECT node_id, other_id, count(*) AS n_edges, max(confidence) AS confidence FROM ends WHERE confidence >= 0.7 GROUP BY ALL",
    "node_detail": """WITH ed AS (SELECT edge_id, any_value(source_node_id) AS source_node_id, any_value(target_node_id) AS target_node_id, any_value(confidence) AS confidence,
            any_value(evidence_count) AS evidence_count FROM graph_edges GROUP BY edge_id),
        p AS (SELECT source_node_id AS s, target_node_id AS t, max(confidence) AS confidence, CAST(coalesce(sum(evidence_count), 0) AS BIGINT) AS evidence_count FROM ed GROUP BY ALL),
        e AS (SELECT s AS node_id, t AS other_id, confidence, evidence_count FROM p UNION ALL SELECT t, s, confidence, evidence_count FROM p)
        SELECT *, CAST(row_number() OVER (PARTITION BY node_id ORDER BY confidence DESC, evidence_count DESC, other_id) AS INTEGER) AS place FROM e QUALIFY place <= 5""",
    "graph_search": """WITH s AS (SELECT canonical, max(CASE WHEN lower(canonical) = 'soul' THEN 3.0 WHEN lower(alias) = 'soul' THEN 2.5
            WHEN contains(lower(canonical), 'soul') THEN 1.5 WHEN contains(lower(alias), 'soul') THEN 1.0 END) AS score FROM vocabulary GROUP BY canonical)
        SELECT canonical, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, canonical LIMIT 10""",
    "graph_neighborhood": f"""WITH RECURSIVE {_ED}, st AS (SELECT DISTINCT source_node_id AS a, target_node_id AS b FROM ed WHERE status = 'TRUSTED'),
        n AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
        r AS (SELECT 'concept:exile' AS node_id, 0 AS ring UNION SELECT n.b, r.ring + 1 FROM r JOIN n ON n.a = r.node_id WHERE r.ring < 2)
        SELECT node_id, min(ring) AS ring FROM r GROUP BY node_id""",
    "edge_filter": f"WITH {_ED} SELECT edge_id, relationship_type, confidence, round(0.5 + sqrt(evidence_count) / 2.2, 6) AS size FROM ed WHERE status = 'TRUSTED' AND evidence_count >= 2",
    "pair_aggregate": f"""WITH {_EV}, s AS (SELECT chunk_id, evidence_text, count(*) AS n_rows, bool_or(relation_source = 'sentence') AS in_sentence, bool_or(coalesce(len(heading_path), 0) > 0) AS under_heading FROM ev GROUP BY ALL)
        SELECT n_rows, in_sentence, under_heading, count(*) AS n, count(DISTINCT chunk_id) AS n_chunks FROM s GROUP BY ALL""",
    "vector_get_by_ids": """WITH a AS (SELECT unnest([40, 20, 100000, 0]) AS id, unnest(range(4)) AS pos)
        SELECT CAST(pos AS INTEGER) AS pos, CAST(a.id AS BIGINT) AS id, label FROM a LEFT JOIN embeddings e ON e.vec_id = a.id""",
    "vector_count": "SELECT label, count(*) AS n, min(len(embedding)) AS dimension FROM embeddings GROUP BY label",
    "upsert_vectors": "SELECT vec_id AS id, CASE WHEN vec_id >= 200 THEN label + 100 ELSE label END AS label FROM embeddings",
    "stale_vector_anti": f"WITH {_CH}, {_EV} SELECT DISTINCT chunk_id FROM ev ANTI JOIN (SELECT chunk_id FROM ch WHERE chunk_index = 0) USING (chunk_id)",
    "json_or_default": "SELECT event_id, coalesce(len(json_keys(try_cast(props AS JSON))), 0) AS n_props FROM events",
    "distinct_types": f"WITH {_ED} SELECT 'node' AS kind, node_type AS type FROM vocabulary UNION SELECT 'edge', relationship_type FROM ed",
    "library_sort": f"""WITH {_DOC} SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY
        CASE index_status WHEN 'INCLUDE' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'EXCLUDE' THEN 3 ELSE 9 END, title NULLS FIRST, document_id) AS INTEGER) AS place, document_id FROM doc""",
    "library_union": f"""WITH {_CH}, {_DOC} SELECT origin, count(*) AS n FROM (SELECT document_id, 'registered' AS origin FROM doc
        UNION ALL SELECT document_id, 'chunks' FROM (SELECT DISTINCT document_id FROM ch) ANTI JOIN doc USING (document_id)) GROUP BY origin""",
    "corpus_lane": rf"""WITH {_DOC} SELECT CASE WHEN source_type IN ('PRIMARY', 'SECONDARY') THEN source_type
        ELSE coalesce(nullif(lower(regexp_extract(source_path, '^[^/\\]+[/\\]([^/\\]+)', 1)), ''), 'unknown') END AS lane, count(*) AS n FROM doc GROUP BY 1""",
    "bench_tags": "SELECT tag, count(DISTINCT question_id) AS n FROM (SELECT question_id, unnest(tags) AS tag FROM bench_items) GROUP BY tag",
    "enrich_author_title": f"""WITH {_CH}, {_Q}, {_TERMS}, {_bm25('bm25', 'query', 3)}, {_DOC}
        SELECT query_id, rank, id, title, author FROM bm25 JOIN ch ON ch.chunk_id = bm25.id LEFT JOIN doc USING (document_id)""",
}
