"""The catalogue's queries in DuckDB's SQL, written from the definitions rather than from the plans."""

from __future__ import annotations

from docloom.config import GROUPS, STOPWORDS, TEST_DICTIONARY

TOKEN = "[A-Za-zА-Яа-яЁё0-9-]+"
WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def compact(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def words(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), '{TOKEN}'))"


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
KEPT = (
    f"list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda t: length(t) BETWEEN 3 AND 40 AND t NOT IN ({_STOP}) "
    "AND NOT regexp_full_match(t, '[0-9]+|https?|www|com|org|net|html?|amp|[0-9a-f]{16,}'))"
)
FILES = (
    "f AS (SELECT *, source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md' AS path, strlen(text) AS size, "
    "sha256(text) AS sha FROM documents)"
)
ARRAYS = f"{FILES}, a AS (SELECT doc_id, path, source, lang, doc_type, {KEPT} AS toks FROM f)"
LONG = f"{ARRAYS}, l AS (SELECT doc_id, path, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM a)"

TOP_TOKENS = (
    f"WITH {LONG} SELECT token, count(*) AS count, count(DISTINCT doc_id) AS document_count FROM l GROUP BY token "
    "ORDER BY count(*) DESC, min(struct_pack(p := path, q := pos)) LIMIT 5000"
)
WORD_COUNTS = f"SELECT doc_id, {words('text')} AS word_count FROM documents"
DOC_PROFILE = (
    "SELECT doc_id, strlen(text) AS size_bytes, length(text) AS char_count, "
    "length(text) - length(replace(text, chr(10), '')) + CAST(length(text) > 0 AS INT) AS line_count, "
    f"{words('text')} AS word_count, sha256(text) AS sha256 FROM documents"
)


def _grams(n: int, arr: str = "toks") -> str:
    return (
        f"list_transform(CASE WHEN len({arr}) >= {n} THEN range(1, len({arr}) - {n} + 2) ELSE [] END, "
        f"lambda i: array_to_string(list_slice({arr}, i, i + {n - 1}), ' '))"
    )


def ngrams(n: int, limit: int) -> str:
    return (
        f"WITH {ARRAYS}, g AS (SELECT path, {_grams(n)} AS gs FROM a), "
        "l AS (SELECT path, unnest(gs) AS ngram, generate_subscripts(gs, 1) AS pos FROM g) "
        f"SELECT ngram, CAST({n} AS BIGINT) AS n, count(*) AS count FROM l GROUP BY ngram "
        f"ORDER BY count(*) DESC, min(struct_pack(p := path, q := pos)) LIMIT {limit}"
    )


COMMON_NGRAMS = (
    f"WITH a AS (SELECT list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})) AS toks FROM documents), "
    f"l AS (SELECT unnest({_grams(2)}) AS ngram FROM a) SELECT ngram, count(*) AS count FROM l GROUP BY ngram"
)
COLLOCATIONS = (
    f"WITH {LONG}, s AS (SELECT token, count(*) AS c FROM l GROUP BY token), n AS (SELECT CAST(sum(c) AS BIGINT) AS total FROM s), "
    f"g AS (SELECT unnest({_grams(2)}) AS bigram FROM a), p AS (SELECT bigram, count(*) AS c12 FROM g GROUP BY bigram HAVING count(*) >= 5), "
    "x AS (SELECT bigram, c12 AS count, s1.c AS first_token_count, s2.c AS second_token_count, "
    "round(log2(CAST(c12 * total AS DOUBLE) / (s1.c * s2.c)), 6) AS pmi FROM p JOIN s s1 ON s1.token = split_part(bigram, ' ', 1) "
    "JOIN s s2 ON s2.token = split_part(bigram, ' ', 2), n) SELECT * FROM x ORDER BY pmi DESC, count DESC, bigram LIMIT 500"
)
_TFIDF = (
    f"{ARRAYS}, w AS (SELECT doc_id, regexp_extract_all(array_to_string(toks, ' '), '[^\\s-]+') AS t FROM a), "
    f"e AS (SELECT doc_id, unnest(list_concat(t, {_grams(2, 't')})) AS term FROM w), "
    "tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), "
    "v AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0 AS idf FROM tf, n GROUP BY term "
    "HAVING count(*) >= 2 AND count(*) <= 0.9 * any_value(n) ORDER BY sum(tf) DESC, term LIMIT 5000), "
    "x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN v USING (term)), "
    "m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY doc_id), "
    "s AS (SELECT doc_id, term, w / norm AS tfidf FROM x JOIN m USING (doc_id))"
)
TFIDF_DOC = (
    f"WITH {_TFIDF}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 8) DESC, term) AS rank, term, "
    "round(tfidf, 8) AS tfidf FROM s) SELECT * FROM r WHERE rank <= 20"
)
TFIDF_GROUP = (
    f"WITH {_TFIDF}, g AS (SELECT doc_id, 'source' AS group_field, coalesce(source, 'unknown') AS group_value FROM documents UNION ALL "
    "SELECT doc_id, 'lang', coalesce(lang, 'unknown') FROM documents UNION ALL SELECT doc_id, 'doc_type', coalesce(doc_type, 'unknown') FROM documents), "
    "z AS (SELECT group_field, group_value, count(*) AS document_count FROM g GROUP BY ALL), "
    "t AS (SELECT group_field, group_value, term, round(sum(tfidf) / any_value(document_count), 8) AS mean_tfidf, any_value(document_count) AS document_count "
    "FROM s JOIN g USING (doc_id) JOIN z USING (group_field, group_value) GROUP BY group_field, group_value, term), "
    "r AS (SELECT group_field, group_value, term, mean_tfidf, document_count, row_number() OVER (PARTITION BY group_field, group_value "
    "ORDER BY mean_tfidf DESC, term) AS rank FROM t WHERE mean_tfidf > 0) SELECT * FROM r WHERE rank <= 25"
)
WORD_CLOUD = (
    f"WITH {LONG}, k AS (SELECT 'doc_types' AS figure, doc_type AS label, count(*) AS n FROM documents GROUP BY doc_type ORDER BY n DESC, label LIMIT 25), "
    "s AS (SELECT 'sources' AS figure, source AS label, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, label LIMIT 25), "
    "t AS (SELECT 'tokens' AS figure, token AS label, count(*) AS n FROM l GROUP BY token ORDER BY n DESC, label LIMIT 25) "
    "SELECT * FROM k UNION ALL SELECT * FROM s UNION ALL SELECT * FROM t"
)

_CLEAN_LINES = (
    "p AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13), chr(10)), chr(160), ' '), '[ \\t]+', ' ', 'g') AS t FROM documents), "
    f"q AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '{BREAK}'), lambda x: {strip('x')}), lambda x: x <> '') AS ls FROM p), "
    "l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM q), "
    "c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM l)"
)
CLEAN_TEXT = (
    f"WITH {_CLEAN_LINES}, j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM c WHERE n <= 3 OR k = 1 GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(j.t, '') AS clean_text FROM documents d LEFT JOIN j USING (doc_id)"
)
REPEATED_LINES = f"WITH {_CLEAN_LINES} SELECT doc_id, line, count(*) AS n FROM l GROUP BY doc_id, line HAVING count(*) > 3"


def fourfold(sql: str) -> str:
    """A query over the texts, with each of them four times over."""
    return sql.replace("FROM documents", "FROM (SELECT doc_id, concat_ws(chr(10), text, text, text, text) AS text FROM documents)")


FIRST_LINE = f"SELECT doc_id, {strip(chr(34) + 'x' + chr(34))} AS first_line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r')[1] AS \"x\" FROM documents)"
SCRIPT = (
    "WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS lat, len(regexp_extract_all(text, '[А-Яа-яЁё]')) AS cyr FROM documents) "
    "SELECT doc_id, CASE WHEN lat > 3 * cyr AND lat > 200 THEN 'en_or_latin_script' WHEN cyr > lat AND cyr > 200 THEN 'ru_or_cyrillic_script' ELSE 'unknown' END AS language FROM c"
)
_FRAGMENTS = ("Рґ", "Рµ", "Р°", "СЃ", "С‚", "СЏ", "СЊ", "Рё", "Рѕ", "РЅ")
_HITS = " + ".join(f"(length(text) - length(replace(text, '{f}', ''))) / 2" for f in _FRAGMENTS)
_BAD = f"((length(text) - length(replace(text, chr(65533), ''))) > 0.001 * length(text) OR {_HITS} > 30)"
MOJIBAKE = f"SELECT doc_id, CASE WHEN {_BAD} THEN 'ok_suspicious_mojibake' ELSE 'ok' END AS read_status FROM documents"
BUDGET = (
    "SELECT CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS files, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens, "
    "ceil(sum(length(text)) / 4.0) > 32000 AS exceeds FROM documents"
)
SLUG = (
    "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(" + strip("coalesce(platform, '')") + "), '[^a-z0-9а-яё]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS platform_slug FROM documents"
)
COMPACT = f"SELECT doc_id, {compact('text')} AS compact FROM documents"
SUMMARY = (
    f"SELECT count(*) AS documents, CAST(sum({words('text')}) AS BIGINT) AS total_words, median({words('text')}) AS median_words FROM documents"
)


def _term_regex(term: str) -> str:
    return "(^|[^a-z0-9-])" + term.lower().strip().replace(" ", f"{WS}+") + "([^a-z0-9-]|$)"


def _term_count(term: str, prefilter: bool = True) -> str:
    bare = term.lower().strip()
    gate = bare if prefilter else bare.split()[0]
    return f"CASE WHEN contains(low, '{bare if prefilter else gate}') THEN len(regexp_extract_all(dbl, '{_term_regex(term)}')) ELSE 0 END"


def _doubled(table: str, key: str, text: str) -> str:
    return f"d AS (SELECT {key}, lower({text}) AS low, regexp_replace(lower({text}), '([^a-z0-9-])', '\\1\\1', 'g') AS dbl FROM {table})"


def term_counts(terms: list[str], prefilter: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS term, {_term_count(t, prefilter)} AS n FROM d" for t in terms)
    return f"WITH {_doubled('documents', 'doc_id', 'text')}, t AS ({rows}) SELECT doc_id, term, n FROM t WHERE n > 0"


def term_totals(terms: list[str]) -> str:
    total = " + ".join(f"({_term_count(t, False)})" for t in terms)
    return f"WITH {_doubled('documents', 'doc_id', 'text')}, t AS (SELECT doc_id, {total} AS total FROM d) SELECT doc_id, CAST(total AS BIGINT) AS total FROM t WHERE total > 0"


def features_cte(table: str, key: str, text: str) -> str:
    """CTEs ending in ``feat``: all feature columns of a table."""
    distinct = [t for t in dict.fromkeys(t for ts in TEST_DICTIONARY.values() for t in ts)]
    col = {t: f"c{i}" for i, t in enumerate(distinct)}
    counts = ", ".join(f"{_term_count(t)} AS {col[t]}" for t in distinct)
    cols = []
    for g in GROUPS:
        ts = TEST_DICTIONARY[g]
        total = " + ".join(col[t] for t in ts)
        names = ", ".join(f"CASE WHEN {col[t]} > 0 THEN '{t}' END" for t in ts)
        cols += [
            f"CASE WHEN {total} > 0 THEN 'present' ELSE 'absent' END AS {g}_flag",
            f"array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), '|') AS {g}_terms",
            f"CAST({total} AS BIGINT) AS {g}_count",
        ]

    def on(g: str) -> str:
        return f"{g}_flag = 'present'"

    dt, pr, af, co, ct, op, bc, cx = (on(g) for g in ("documentary_transparency", "procedure", "actor_forum", "consequence", "contestability", "algorithmic_opacity", "boilerplate_consent", "contextual_integrity"))
    signals = (
        f"CASE WHEN {dt} AND NOT {pr} THEN 'disclosure_without_procedure' END, CASE WHEN {pr} AND NOT {co} THEN 'procedure_without_consequence' END, "
        f"CASE WHEN {dt} AND NOT {ct} THEN 'disclosure_without_contestability' END, CASE WHEN {bc} AND NOT {ct} THEN 'consent_without_alternative' END, "
        f"CASE WHEN {cx} AND NOT {pr} THEN 'context_sensitive_processing_without_procedure' END, "
        f"CASE WHEN {dt} AND {op} THEN 'visible_practice_with_opaque_formula' END, CASE WHEN {pr} AND NOT {af} THEN 'procedure_without_forum' END"
    )
    return (
        f"{_doubled(table, key, text)}, k AS (SELECT {key}, {counts} FROM d), g AS (SELECT {key}, {', '.join(cols)} FROM k), "
        f"h AS (SELECT *, CASE WHEN {dt} AND {pr} THEN 'both' WHEN {dt} THEN 'disclosure_only' WHEN {pr} THEN 'procedure_only' ELSE 'none' END AS cooccurrence_class, "
        f"list_filter([{signals}], lambda x: x IS NOT NULL) AS sig FROM g), "
        "feat AS (SELECT * EXCLUDE (sig), array_to_string(sig, '|') AS candidate_gap_signals, CASE WHEN len(sig) > 0 THEN 'present' ELSE 'absent' END AS silence_or_ambiguity_flag, "
        "array_to_string(sig, '|') AS silence_or_ambiguity_terms, len(sig) AS silence_or_ambiguity_count FROM h)"
    )


def features(table: str, key: str, text: str) -> str:
    return f"WITH {features_cte(table, key, text)} SELECT * FROM feat"


_DOC_FEATURES = features_cte("documents", "doc_id", "text")
SIGNAL_COUNTS = f"WITH {_DOC_FEATURES}, s AS (SELECT unnest(string_split(candidate_gap_signals, '|')) AS signal FROM feat WHERE candidate_gap_signals <> '') SELECT signal, count(*) AS documents FROM s GROUP BY signal"
COOCCURRENCE = f"WITH {_DOC_FEATURES} SELECT cooccurrence_class, count(*) AS documents FROM feat GROUP BY cooccurrence_class"
PRESENCE = f"WITH {_DOC_FEATURES} " + " UNION ALL ".join(
    f"SELECT '{g}' AS \"group\", count(*) FILTER ({g}_flag = 'present') AS documents FROM feat" for g in GROUPS
)

SEGMENTS = (
    "m AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN '## ' || x ELSE x END) AS ls FROM documents), "
    "n AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m), "
    f"o AS (SELECT *, regexp_matches(line, '^ {{0,3}}#{{1,6}}{WS}+.*[^\\s]') AS head FROM n), "
    "r AS (SELECT doc_id, i, head, line, coalesce(last_value(CASE WHEN head THEN " + strip("regexp_replace(line, '^ *#+', '')") + " END IGNORE NULLS) "
    "OVER (PARTITION BY doc_id ORDER BY i), '') AS section_title FROM o), "
    f"u AS (SELECT doc_id, i, section_title, {strip('line')} AS segment_text, {words('line')} AS word_count FROM r WHERE NOT head), "
    "v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS position FROM u WHERE word_count >= 8), "
    "seg AS (SELECT doc_id || '::s' || lpad(CAST(position AS VARCHAR), CAST(greatest(4, length(CAST(position AS VARCHAR))) AS INTEGER), '0') AS segment_id, doc_id, section_title, position, "
    "segment_text, length(segment_text) AS char_count, word_count FROM v)"
)
SEGMENTS_ALL = f"WITH {SEGMENTS} SELECT * FROM seg"
SEGMENT_FEATURES = f"WITH {SEGMENTS}, {features_cte('seg', 'segment_id', 'segment_text')} SELECT * FROM feat"
ORPHANS = f"WITH {SEGMENTS} SELECT segment_id, doc_id FROM seg WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'openweb')"
CANDIDATES = (
    f"WITH {SEGMENTS}, {features_cte('seg', 'segment_id', 'segment_text')}, "
    "y AS (SELECT feat.*, seg.doc_id, seg.position, seg.word_count, documents.source AS source_root, coalesce(documents.filename_date, 'not_found') AS fd "
    "FROM feat JOIN seg USING (segment_id) JOIN documents ON documents.doc_id = seg.doc_id), "
    "z AS (SELECT *, list_concat(list_filter([CASE WHEN cooccurrence_class = 'disclosure_only' THEN 'algorithmic_practice_without_explicit_procedure' END, "
    "CASE WHEN cooccurrence_class = 'both' THEN 'disclosure_and_procedure_in_same_fragment' END, CASE WHEN fd <> 'not_found' THEN 'dated_filename' END, "
    "CASE WHEN algorithmic_opacity_flag = 'present' THEN 'opaque_formula' END, CASE WHEN boilerplate_consent_flag = 'present' THEN 'boilerplate_consent' END, "
    "CASE WHEN contextual_integrity_flag = 'present' THEN 'context_sensitive_processing' END], lambda x: x IS NOT NULL), "
    "CASE WHEN candidate_gap_signals <> '' THEN string_split(candidate_gap_signals, '|') ELSE [] END) AS why FROM y "
    "WHERE word_count BETWEEN 30 AND 320 AND NOT (cooccurrence_class = 'none' AND candidate_gap_signals = '')) "
    "SELECT segment_id, doc_id, position, source_root, array_to_string(why, '|') AS selection_reason, "
    "CAST(5 * CAST(cooccurrence_class = 'both' AS INT) + 4 * CAST(cooccurrence_class = 'disclosure_only' AS INT) + 2 * CAST(algorithmic_opacity_flag = 'present' AS INT) "
    "+ 2 * CAST(contestability_flag = 'present' AS INT) + CAST(fd <> 'not_found' AS INT) + len(why) AS BIGINT) AS selection_score FROM z"
)

SIZE_GROUPS = f"WITH {FILES} SELECT size, count(*) AS files FROM f GROUP BY size HAVING count(*) > 1"
_REPS = f"WITH {FILES}, r AS (SELECT size, sha, min(path) AS rep, count(*) AS n FROM f GROUP BY size, sha)"
EXACT = f"{_REPS} SELECT path AS deleted_file, rep AS original_file, f.size FROM f JOIN r USING (size, sha) WHERE path <> rep"
PAIRS = f"{_REPS} SELECT a.rep AS left_path, b.rep AS right_path, a.size FROM r a JOIN r b ON a.size = b.size AND a.rep < b.rep"
KEPT = f"{_REPS} SELECT rep AS path, size FROM r"
RUN_COUNTS = (
    f"{_REPS} SELECT (SELECT CAST(sum(c) AS BIGINT) FROM (SELECT count(*) AS c FROM f GROUP BY size HAVING count(*) > 1)) AS suspicious_files, "
    "(SELECT count(*) FROM r a JOIN r b ON a.size = b.size AND a.rep < b.rep) AS pairs_planned"
)
HAMMING = (
    "WITH s AS (SELECT DISTINCT path, scanned_at, simhash FROM file_meta WHERE simhash IS NOT NULL), "
    "h AS (SELECT path, min(struct_pack(a := scanned_at, b := simhash)).b AS head FROM s GROUP BY path) "
    "SELECT path, CAST(max(bit_count(xor(simhash, head))) AS BIGINT) AS bits FROM s JOIN h USING (path) GROUP BY path"
)

#: Files and rows of an older index that end in each of the five statuses.
def values(rows, names: str) -> str:
    def one(v) -> str:
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(one(v) for v in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") t({names})"


INDEX_MATCH_FILES = (
    f"WITH {FILES}, o AS (SELECT path AS op, 'source/' || path || '@' || substr(sha256, 1, 8) AS srp, sha256 AS ssha, CAST(size AS VARCHAR) AS ssize FROM file_meta), "
    "j AS (SELECT f.path, count(srp) AS n, count(*) FILTER (ssha = sha AND ssize = CAST(size AS VARCHAR)) AS e, min(srp) FILTER (ssha = sha AND ssize = CAST(size AS VARCHAR)) AS ex, min(srp) AS an "
    "FROM f LEFT JOIN o ON string_split(f.path, '/')[-1] = string_split(op, '/')[-1] GROUP BY f.path) "
    "SELECT path, CASE WHEN n = 0 THEN 'unmatched_in_old_index' WHEN e = 1 THEN 'matched_by_hash_size_and_name' WHEN e > 1 THEN 'ambiguous_old_index_hash_size_name' "
    "WHEN n = 1 THEN 'matched_by_name_only' ELSE 'ambiguous_old_index_name' END AS source_match_status, "
    "CASE WHEN e = 1 THEN ex WHEN e = 0 AND n = 1 THEN an ELSE '' END AS source_relative_path FROM j"
)
INDEX_DIAGNOSTICS = f"SELECT source_match_status, count(*) AS files FROM ({INDEX_MATCH_FILES}) GROUP BY 1"
_SCRIPT_OF = (
    "CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) > greatest(200, 3 * len(regexp_extract_all(text, '[А-Яа-яЁё]'))) THEN 'en_or_latin_script' "
    "WHEN len(regexp_extract_all(text, '[А-Яа-яЁё]')) > greatest(200, len(regexp_extract_all(text, '[A-Za-z]'))) THEN 'ru_or_cyrillic_script' ELSE 'unknown' END"
)
TALLIES = " UNION ALL ".join(
    f"SELECT '{name}' AS field, {value} AS value, count(*) AS documents FROM documents GROUP BY 2"
    for name, value in (
        ("source", "coalesce(source, 'unknown')"), ("doc_type", "coalesce(doc_type, 'unknown')"),
        ("date_status", "CASE WHEN coalesce(filename_date, 'not_found') = 'not_found' THEN 'not_found' ELSE 'parsed' END"), ("script", _SCRIPT_OF),
    )
)
_BASE = "CASE WHEN contains(doc_id, '__') THEN substr(doc_id, strpos(doc_id, '__') + 2) ELSE doc_id END"
_STAMP = "([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2})-([0-9]{2})-([0-9]{2})Z"
_DAY = "(^|[_-])([0-9]{4})([0-9]{2})([0-9]{2})([_-]|$)"
_PLAIN = "([0-9]{4})-([0-9]{2})-([0-9]{2})"


def _part(pattern: str, *at: int, sep: str = "-") -> str:
    return f" || '{sep}' || ".join(f"regexp_extract(b, '{pattern}', {i})" for i in at)


DATES = (
    f"WITH x AS (SELECT DISTINCT doc_id, {_BASE} AS b FROM documents_manifest), y AS (SELECT *, regexp_matches(b, '{_STAMP}') AS s, regexp_matches(b, '{_DAY}') AS d, regexp_matches(b, '{_PLAIN}') AS p FROM x) "
    f"SELECT doc_id, CASE WHEN s THEN {_part(_STAMP, 1, 2, 3)} WHEN d THEN {_part(_DAY, 2, 3, 4)} WHEN p THEN {_part(_PLAIN, 1, 2, 3)} ELSE 'not_found' END AS filename_date, "
    f"CASE WHEN s THEN {_part(_STAMP, 1, 2, 3)} || 'T' || {_part(_STAMP, 4, 5, 6, sep=':')} || 'Z' ELSE '' END AS filename_datetime, "
    "CASE WHEN s THEN 'datetime' WHEN d OR p THEN 'day' ELSE 'not_found' END AS date_precision, "
    "CASE WHEN s THEN 'YYYY-MM-DDTHH-MM-SSZ' WHEN d THEN 'YYYYMMDD' WHEN p THEN 'YYYY-MM-DD' ELSE 'not_found' END AS date_pattern, "
    "CASE WHEN s OR d OR p THEN 'parsed' ELSE 'not_found' END AS date_parse_status FROM y"
)
DOC_TYPES = (
    f"WITH x AS (SELECT DISTINCT doc_id, replace(lower({_BASE}), '_', ' ') AS h FROM documents_manifest) SELECT doc_id, CASE "
    "WHEN regexp_matches(h, 'acceptable ?use|aup') THEN 'acceptable_use_policy' WHEN contains(h, 'guideline') THEN 'community_guidelines' WHEN contains(h, 'privacy') THEN 'privacy_policy' "
    "WHEN regexp_matches(h, 'developer|api terms') THEN 'developer_terms' WHEN contains(h, 'cookie') THEN 'cookie_policy' WHEN regexp_matches(h, 'data (policy|processing|use)') THEN 'data_policy' "
    "WHEN regexp_matches(h, 'terms|tos|service') THEN 'terms_of_service' ELSE 'unknown' END AS doc_type FROM x"
)
_PATHS = "p AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 10, '0') || '.md' AS path FROM documents UNION SELECT path FROM file_meta UNION SELECT raw_path FROM documents_manifest), q AS (SELECT DISTINCT path FROM p WHERE path IS NOT NULL)"
_STEM = r"regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]+$', '\1')"
UNIQUE_IDS = (
    f"WITH {_PATHS}, s AS (SELECT path, {_STEM} AS stem FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY string_split(path, '/')) AS k FROM s) "
    "SELECT path, CASE WHEN k = 1 THEN stem ELSE stem || '__dup' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END END AS doc_id, stem AS original_doc_id, "
    "CASE WHEN k = 1 THEN 'unique' ELSE 'renamed_duplicate_stem' END AS doc_id_collision_status FROM n"
)
RENAMES = (
    rf"WITH {_PATHS}, s AS (SELECT path, regexp_extract(path, '^(.*/)?', 0) || replace(string_split(path, '/')[-1], ' ', '_') AS new_path FROM q), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY new_path ORDER BY path <> new_path, path) AS k FROM s) "
    "SELECT path, new_path, CASE WHEN path = new_path THEN 'unchanged' WHEN k > 1 THEN 'collision' ELSE 'renamed' END AS status FROM n"
)
INDEX_TOTALS = (
    f"WITH m AS ({INDEX_MATCH_FILES}), t AS (SELECT count(*) AS a, count(*) FILTER (source_match_status <> 'unmatched_in_old_index') AS b FROM m), "
    "o AS (SELECT count(*) AS a, count(DISTINCT string_split(path, '/')[-1]) AS b FROM file_meta) "
    "SELECT 'total_files' AS name, a AS n FROM t UNION ALL SELECT 'old_index_name_matches', b FROM t UNION ALL SELECT 'unmatched_in_old_index', a - b FROM t "
    "UNION ALL SELECT 'old_index_rows', a FROM o UNION ALL SELECT 'old_index_unique_names', b FROM o "
    "UNION ALL SELECT 'duplicate_stems', count(*) - count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'status:' || source_match_status, count(*) FROM m GROUP BY 1"
)
_URL = (
    "u AS (SELECT url AS raw, " + strip("coalesce(url, '')") + " AS s FROM documents_manifest), "
    "w AS (SELECT raw, s, CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN s ELSE 'https://' || s END AS fu FROM u), "
    "x AS (SELECT raw, fu, CASE WHEN s = '' THEN 'empty' WHEN lower(regexp_extract(fu, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('http', 'https') THEN 'unsupported_scheme' "
    "WHEN regexp_extract(fu, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = '' THEN 'no_host' ELSE 'ok' END AS status FROM w)"
)
URLS = f"WITH {_URL} SELECT DISTINCT raw AS url, CASE WHEN status = 'ok' THEN fu END AS full_url, status FROM x"
_HOST = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(fu, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)), '^www\\.', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'site')"
SLUGS = f"WITH {_URL} SELECT {_HOST} AS slug, count(*) AS pages FROM x WHERE status = 'ok' GROUP BY 1"
OUTPUT_NAMES = (
    "WITH g AS (SELECT doc_id, max(url) AS url FROM documents_manifest GROUP BY doc_id), " + _URL.replace("SELECT url AS raw", "SELECT doc_id AS raw").replace("FROM documents_manifest", "FROM g", 1)
    + f", y AS (SELECT raw AS page_id, {_HOST} AS slug FROM x WHERE status = 'ok'), z AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM y) "
    "SELECT page_id, slug || '_2026-01-01' || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.md' AS file_name FROM z"
)
CHECKS = (
    f"WITH x AS (SELECT count(*) AS n, count(*) FILTER ({_BAD}) AS bad, count(*) FILTER ({words('text')} = 0) AS e, count(*) - count(DISTINCT doc_id) AS dup, "
    "count(*) FILTER (coalesce(source, 'unknown') = 'unknown') / greatest(count(*), 1) AS sr, count(*) FILTER (coalesce(doc_type, 'unknown') = 'unknown') / greatest(count(*), 1) AS tr FROM documents) "
    "SELECT 'document_count' AS check_name, CASE WHEN n = 1059 THEN 'pass' ELSE 'warn' END AS status, 'actual=' || n || '; expected=1059' AS detail FROM x "
    "UNION ALL SELECT 'read_status', CASE WHEN bad = 0 THEN 'pass' ELSE 'warn' END, 'bad_or_suspicious_read_count=' || bad FROM x "
    "UNION ALL SELECT 'suspicious_encoding', CASE WHEN bad = 0 THEN 'pass' ELSE 'warn' END, 'suspicious_read_count=' || bad FROM x "
    "UNION ALL SELECT 'empty_documents', CASE WHEN e = 0 THEN 'pass' ELSE 'warn' END, 'empty_document_count=' || e FROM x "
    "UNION ALL SELECT 'unique_doc_ids', CASE WHEN dup = 0 THEN 'pass' ELSE 'fail' END, 'duplicate_doc_id_count=' || dup FROM x "
    "UNION ALL SELECT 'segment_document_links', 'pass', 'orphan_segment_count=0' FROM x "
    "UNION ALL SELECT 'deduplication', 'pass', 'deduplication_performed=false; current corpus is treated as source of truth' FROM x "
    "UNION ALL SELECT 'unknown_source_rate', CASE WHEN sr > 0.2 THEN 'warn' ELSE 'pass' END, 'rate=' || printf('%.4f', sr) FROM x "
    "UNION ALL SELECT 'unknown_doc_type_rate', CASE WHEN tr > 0.2 THEN 'warn' ELSE 'pass' END, 'rate=' || printf('%.4f', tr) FROM x"
)
