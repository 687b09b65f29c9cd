"""SQL for DuckDB of the problems' queries, where SQL can say them; written from the problems' definitions."""

from __future__ import annotations

TOKENS = "regexp_extract_all(lower({}), '[A-Za-zА-Яа-яЁё0-9-]+')"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_MISSING = "('', 'unknown', 'not_found')"

_LANGUAGE = (
    "CASE regexp_extract(lower(trim(language)), '^([^-_]+)', 1) WHEN 'en' THEN 'en' WHEN 'eng' THEN 'en' WHEN 'english' THEN 'en' "
    "WHEN 'de' THEN 'de' WHEN 'deu' THEN 'de' WHEN 'ger' THEN 'de' WHEN 'german' THEN 'de' WHEN 'deutsch' THEN 'de' "
    "WHEN 'fr' THEN 'fr' WHEN 'fra' THEN 'fr' WHEN 'fre' THEN 'fr' WHEN 'french' THEN 'fr' WHEN 'français' THEN 'fr' "
    "WHEN 'es' THEN 'es' WHEN 'spa' THEN 'es' WHEN 'spanish' THEN 'es' WHEN 'español' THEN 'es' "
    "WHEN 'ru' THEN 'ru' WHEN 'rus' THEN 'ru' WHEN 'russian' THEN 'ru' WHEN 'русский' THEN 'ru' END"
)
_FACTS = (
    f"facts AS (SELECT doc_id, max(CASE WHEN lower(trim(platform)) NOT IN {_MISSING} THEN trim(regexp_replace(lower(platform), '[^a-z0-9]+', '-', 'g'), '-') END) AS p, "
    f"max({_LANGUAGE}) AS l, max(CASE WHEN lower(trim(doc_type)) NOT IN {_MISSING} THEN trim(regexp_replace(lower(doc_type), '[^a-z0-9]+', '_', 'g'), '_') END) AS t "
    "FROM documents_manifest GROUP BY doc_id), pages AS (SELECT DISTINCT doc_id, markdown FROM extracted_documents)"
)
_SLICES = (
    f"{_FACTS}, s AS (SELECT coalesce(p, 'unknown') AS platform_slug, coalesce(l, 'unknown') AS language, coalesce(t, 'unknown') AS doc_type, "
    "count(*) AS pages, CAST(sum(ceil(length(markdown) / 4.0)) AS BIGINT) AS tokens FROM pages LEFT JOIN facts USING (doc_id) GROUP BY ALL)"
)
_COUNTS = (
    f"t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents), "
    "c AS (SELECT token, count(*) AS count, count(DISTINCT doc_id) AS document_count FROM t GROUP BY token), "
    "m AS (SELECT *, CASE WHEN document_count < 3 THEN 'rare' WHEN document_count > 0.4 * (SELECT count(*) FROM documents) THEN 'common' END AS mark FROM c)"
)
_LINES = (
    f"{_FACTS}, n AS (SELECT doc_id, coalesce(p, 'unknown') AS platform_slug, string_split(markdown, chr(10)) AS ls FROM pages LEFT JOIN facts USING (doc_id)), "
    "l AS (SELECT doc_id, platform_slug, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM n), "
    r"k AS (SELECT doc_id, platform_slug, line_no, trim(regexp_replace(regexp_replace(lower(regexp_replace(line, '^[#>*\-\s]+', '')), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')) AS key "
    r"FROM l WHERE trim(line) <> '' AND line_no NOT IN (1, 3, 5) AND len(regexp_extract_all(line, '\p{L}+')) >= 4), "
    "r AS (SELECT platform_slug, key, count(DISTINCT doc_id) AS n_pages FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)"
)


#: Counts of each line over clusters of equal pages and their dates.
_CLUSTERS = (
    f"{_LINES}, q AS (SELECT doc_id, platform_slug, rtrim(array_to_string(list_transform(ls, lambda s, i: CASE WHEN trim(s) = '' OR i IN (1, 3, 5) THEN '' ELSE s END), chr(10)), chr(10)) AS body FROM n), "
    "pub AS (SELECT doc_id, min(TRY_CAST(last_updated AS DATE)) AS published FROM documents_manifest GROUP BY doc_id), "
    "c AS (SELECT platform_slug, body, count(*) AS n, min(published) AS published, min(doc_id) AS doc_id FROM q LEFT JOIN pub USING (doc_id) GROUP BY platform_slug, body), "
    "e AS (SELECT DISTINCT c.platform_slug, c.body, c.n, c.published, k.key FROM c JOIN k USING (doc_id)), "
    "v AS (SELECT platform_slug, key, CAST(sum(n) AS BIGINT) AS n_pages, count(*) AS n_clusters, count(DISTINCT published) AS n_dates FROM e GROUP BY platform_slug, key "
    "HAVING sum(n) >= 5 AND count(*) >= 5 AND count(DISTINCT published) >= 3)"
)


def oracle_sql() -> dict[str, str]:
    shingles = (
        f"w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents), g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 1), "
        "lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE len(ws) >= 60), z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)"
    )
    near = (
        f"{shingles}, j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), "
        "p AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)), "
        "ends AS (SELECT a AS doc_id, b AS other, c = na AND c = nb AS same FROM p UNION ALL SELECT b, a, c = na AND c = nb FROM p), "
        "k AS (SELECT doc_id, least(doc_id, coalesce(min(CASE WHEN same THEN other END), doc_id)) AS class_id, count(*) AS links FROM ends GROUP BY doc_id)"
    )
    spans = (
        "list_transform(range(1, len(ws) - 10), lambda i: array_to_string(list_slice(ws, i, i + 11), ' '))"
    )
    leaks = (
        f"d AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents), e AS (SELECT item_id, {WORDS.format('text')} AS ws FROM eval_items), "
        f"x AS (SELECT DISTINCT doc_id, unnest({spans}) AS s FROM d WHERE len(ws) >= 12), y AS (SELECT DISTINCT item_id, unnest({spans}) AS s FROM e WHERE len(ws) >= 12), "
        "h AS (SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (s))"
    )
    return {
        "p2_found": (
            f"WITH {shingles}, j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL) "
            "SELECT a AS doc_id_a, b AS doc_id_b FROM j JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)"
        ),
        "p2_classes": f"WITH {near} SELECT doc_id, class_id, links FROM k",
        "p2_links": (
            f"WITH {near} SELECT a, b, round(CAST(c AS DOUBLE) / (na + nb - c), 6) AS similarity FROM p JOIN k x ON x.doc_id = a AND x.class_id = a "
            "JOIN k y ON y.doc_id = b AND y.class_id = b"
        ),
        "p2_groups": (
            f"WITH RECURSIVE {near}, w2 AS (SELECT DISTINCT doc_id, doc_id AS seen FROM ends UNION SELECT w2.doc_id, ends.other FROM w2 JOIN ends ON ends.doc_id = w2.seen) "
            "SELECT doc_id AS id, min(seen) AS group_id FROM w2 GROUP BY doc_id"
        ),
        "p3_found": f"WITH {_COUNTS} SELECT token, mark FROM m WHERE mark IS NOT NULL",
        "p3_counts": f"WITH {_COUNTS} SELECT * FROM m",
        "p3_stored": (
            f"WITH {_COUNTS}, b AS (SELECT batch_id, lower(trim(token)) AS token, max(count) AS c, max(document_count) AS d FROM token_frequencies "
            "WHERE trim(token) <> '' GROUP BY ALL), s AS (SELECT token, CAST(sum(c) AS BIGINT) AS stored_count, CAST(sum(d) AS BIGINT) AS stored_document_count FROM b GROUP BY token) "
            "SELECT s.*, m.count, m.document_count, m.mark FROM s LEFT JOIN m USING (token)"
        ),
        "p4_found": f"WITH {_SLICES} SELECT platform_slug, language, doc_type FROM s WHERE tokens >= 0.005 * (SELECT sum(tokens) FROM s)",
        "p4_slices": f"WITH {_SLICES} SELECT * FROM s",
        "p5_found": f"WITH {_LINES} SELECT DISTINCT doc_id, line_no FROM k JOIN r USING (platform_slug, key)",
        "p5_lines": f"WITH {_CLUSTERS} SELECT DISTINCT k.doc_id, k.line_no, platform_slug, n_pages, n_clusters, n_dates FROM k JOIN v USING (platform_slug, key)",
        "p5_clean": (
            f"WITH {_CLUSTERS}, x AS (SELECT doc_id, list(DISTINCT line_no) AS gone FROM k JOIN v USING (platform_slug, key) GROUP BY doc_id) "
            "SELECT n.doc_id, array_to_string(list_filter(ls, lambda s, i: gone IS NULL OR NOT list_contains(gone, i)), chr(10)) AS markdown FROM n LEFT JOIN x USING (doc_id)"
        ),
        "p6_found": (
            f"WITH pages AS (SELECT DISTINCT doc_id, markdown FROM extracted_documents), t AS (SELECT doc_id, unnest({TOKENS.format('markdown')}) AS term FROM pages), "
            "c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS d FROM c GROUP BY term), "
            "s AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY c * ln(CAST((SELECT count(*) FROM pages) AS DOUBLE) / d) DESC, term) AS k FROM c JOIN d USING (term)) "
            "SELECT doc_id, term FROM s WHERE k = 1"
        ),
        "p8_found": f"WITH {leaks} SELECT doc_id, item_id FROM h",
        "p8_items": f"WITH {leaks} SELECT e.item_id, count(h.doc_id) AS documents FROM (SELECT DISTINCT item_id FROM eval_items) e LEFT JOIN h USING (item_id) GROUP BY e.item_id",
        "p8_clean": f"WITH {leaks} SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)",
        "p9_found": (
            "WITH t AS (SELECT source, sum(ceil(length(text) / 4.0)) AS n FROM documents GROUP BY source) SELECT s.source FROM source_targets s LEFT JOIN t USING (source) "
            "WHERE s.max_repeats * coalesce(t.n, 0) < s.target_share * (SELECT sum(n) FROM t)"
        ),
    }
