"""Named queries over the test tables, each with the SQL that says the same for DuckDB."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import GROUPS, STOPWORDS, TEST_DICTIONARY, CorpusConfig
from docloom.functions import text as T
from docloom.functions.html import extract_pages
from docloom.functions.similarity import simhash_udf
from docloom.functions.terms import evidence_phrase, hit_array
from docloom.operators import dedup, features, index, quality, segments, selection, tokenstats
from docloom.plans import oracle as O
from docloom.shared import exploded, spread

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
CFG = CorpusConfig()
#: A vocabulary file of a public tokenizer, for counts that aren't estimates; the environment may name another.
TOKENIZER = os.environ.get("DOCLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
TERMS = features.distinct_terms(TEST_DICTIONARY)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The corpus: documents with the path of their file."""
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".md"))
    return spread(spark.read.parquet(f"{d}/documents.parquet")).withColumn("path", path)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(
        "doc_id", "path", F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        T.first_line(F.col("text")).alias("first_line"), "text",
    )


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as Markdown: every line a paragraph, every fourth a heading."""
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return _docs(spark, d).withColumn("text", F.array_join(parts, "\n\n"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segments(_markdown(spark, d), min_words=CFG.min_segment_words)


def _featured(spark: SparkSession, d: str) -> DataFrame:
    segs = features.features(_segments(spark, d), TEST_DICTIONARY, "segment_text")
    facts = _docs(spark, d).select("doc_id", F.col("source").alias("source_root"), F.coalesce("filename_date", F.lit("not_found")).alias("filename_date"))
    return segs.join(facts, "doc_id")


# ---- tokens ----


@query(O.TOP_TOKENS)
def top_tokens(spark, d):
    return tokenstats.top_tokens(_docs(spark, d), CFG.token_limit)


@query(O.WORD_COUNTS)
def token_count_by_doc(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("word_count"))


@query(O.DOC_PROFILE)
def doc_profile(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", F.octet_length(t).cast("long").alias("size_bytes"), F.length(t).cast("long").alias("char_count"),
        T.line_count(t).alias("line_count"), T.word_count(t).alias("word_count"), F.sha2(t.cast("binary"), 256).alias("sha256"),
    )


@query(O.ngrams(2, CFG.ngram_limit))
def bigrams(spark, d):
    return tokenstats.top_ngrams(_docs(spark, d), 2, CFG.ngram_limit)


@query(O.ngrams(3, CFG.ngram_limit))
def trigrams(spark, d):
    return tokenstats.top_ngrams(_docs(spark, d), 3, CFG.ngram_limit)


@query(O.COMMON_NGRAMS)
def common_ngrams(spark, d):
    return tokenstats.plain_ngrams(_docs(spark, d), STOPWORDS, 2)


@query(O.COLLOCATIONS)
def collocations_pmi(spark, d):
    return tokenstats.collocations(_docs(spark, d), CFG.collocation_min_count, CFG.collocation_limit)


def _tfidf(spark, d):
    return tokenstats.tfidf(_docs(spark, d), CFG.tfidf_features, CFG.tfidf_min_df, CFG.tfidf_max_df)


@query(O.TFIDF_DOC)
def tfidf_by_document(spark, d):
    return tokenstats.top_by_document(_tfidf(spark, d), CFG.tfidf_per_document)


@query(O.TFIDF_GROUP)
def tfidf_by_group(spark, d):
    docs = _docs(spark, d).withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("source", "lang", "doc_type")})
    return tokenstats.top_by_group(_tfidf(spark, d), docs, ("source", "lang", "doc_type"), CFG.tfidf_per_group)


@query(O.WORD_CLOUD)
def figure_data(spark, d):
    """The frames of the figures: document types, sources and most frequent tokens."""
    docs = _docs(spark, d)

    def top(df, what, key, n, limit):
        return df.orderBy(F.desc(n), key).limit(limit).select(F.lit(what).alias("figure"), F.col(key).alias("label"), F.col(n).alias("n"))

    kinds = top(docs.groupBy("doc_type").agg(F.count("*").alias("n")), "doc_types", "doc_type", "n", 25)
    sources = top(docs.groupBy("source").agg(F.count("*").alias("n")), "sources", "source", "n", 25)
    words = tokenstats.token_counts(docs).select("token", F.col("count").alias("n"))
    return kinds.unionByName(sources).unionByName(top(words, "tokens", "token", "n", 25))


# ---- texts ----


@query(O.CLEAN_TEXT)
def clean_text(spark, d):
    return segments.clean_text(_docs(spark, d))


@query(O.REPEATED_LINES)
def repeated_lines(spark, d):
    return segments.repeated_lines(_docs(spark, d))


def _fourfold(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with every text four times over, so that each of its lines stands too often."""
    return _docs(spark, d).withColumn("text", F.concat_ws("\n", *[F.col("text")] * 4))


@query(O.fourfold(O.CLEAN_TEXT))
def clean_text_repeated(spark, d):
    return segments.clean_text(_fourfold(spark, d))


@query(O.fourfold(O.REPEATED_LINES))
def repeated_lines_fourfold(spark, d):
    return segments.repeated_lines(_fourfold(spark, d))


@query(O.FIRST_LINE)
def first_line(spark, d):
    return _docs(spark, d).select("doc_id", T.first_line(F.col("text")).alias("first_line"))


@query(O.SCRIPT)
def script_language(spark, d):
    return _docs(spark, d).select("doc_id", T.script_language(F.col("path"), F.col("text")).alias("language"))


@query(O.MOJIBAKE)
def mojibake_status(spark, d):
    return _docs(spark, d).select("doc_id", F.when(T.looks_mojibake(F.col("text")), "ok_suspicious_mojibake").otherwise("ok").alias("read_status"))


@query(O.BUDGET)
def token_budget(spark, d):
    return quality.token_budget(_docs(spark, d), CFG.token_budget)


@query()
def token_budget_exact(spark, d):
    return quality.token_budget(_docs(spark, d), CFG.token_budget, TOKENIZER)


@query(O.SLUG)
def slugify_platform(spark, d):
    return _docs(spark, d).select("doc_id", T.slugify(F.coalesce("platform", F.lit(""))).alias("platform_slug"))


@query(O.COMPACT)
def compact_text(spark, d):
    return _docs(spark, d).select("doc_id", T.compact(F.col("text")).alias("compact"))


@query(O.SUMMARY)
def corpus_summary(spark, d):
    return quality.summary(_docs(spark, d).select(T.word_count(F.col("text")).alias("word_count")))


# ---- terms and features ----


def _terms(spark, d, prefilter: bool):
    hits = hit_array(F.col("text"), TERMS, prefilter)
    pairs = F.arrays_zip(F.lit(TERMS).alias("term"), hits.alias("n"))
    rows = exploded(_docs(spark, d), ["doc_id"], pairs, "t")
    return rows.select("doc_id", F.col("t.term").alias("term"), F.col("t.n").alias("n")).filter("n > 0")


@query(O.term_counts(TERMS, True))
def terms_found_prefilter(spark, d):
    return _terms(spark, d, True)


@query(O.term_counts(TERMS, False))
def terms_found(spark, d):
    return _terms(spark, d, False)


@query(O.term_totals(TERMS))
def term_counts(spark, d):
    return _terms(spark, d, False).groupBy("doc_id").agg(F.sum("n").alias("total"))


@query(O.features("documents", "doc_id", "text"))
def doc_features(spark, d):
    out = features.features(_docs(spark, d).select("doc_id", "text"), TEST_DICTIONARY)
    return out.drop("text")


@query(O.SIGNAL_COUNTS)
def gap_signals(spark, d):
    out = features.features(_docs(spark, d).select("doc_id", "text"), TEST_DICTIONARY)
    split = F.explode(F.split("candidate_gap_signals", r"\|"))
    return out.filter("candidate_gap_signals != ''").select(split.alias("signal")).groupBy("signal").agg(F.count("*").alias("documents"))


@query(O.COOCCURRENCE)
def cooccurrence_counts(spark, d):
    out = features.features(_docs(spark, d).select("doc_id", "text"), TEST_DICTIONARY)
    return out.groupBy("cooccurrence_class").agg(F.count("*").alias("documents"))


@query(O.PRESENCE)
def feature_presence(spark, d):
    out = features.features(_docs(spark, d).select("doc_id", "text"), TEST_DICTIONARY)
    return features.group_presence(out, GROUPS)


@query()
def evidence_phrases(spark, d):
    return _docs(spark, d).select("doc_id", evidence_phrase(F.col("text"), TERMS).alias("evidence_phrase"))


@query(O.SEGMENTS_ALL)
def segment_table(spark, d):
    return _segments(spark, d)


@query(O.SEGMENT_FEATURES)
def segment_features(spark, d):
    out = features.features(_segments(spark, d).select("segment_id", "segment_text"), TEST_DICTIONARY, "segment_text")
    return out.drop("segment_text")


@query(O.ORPHANS)
def orphan_segments(spark, d):
    """Segments without a document, after the documents of one source are taken away."""
    return segments.orphan_segments(_segments(spark, d), _docs(spark, d).filter("source != 'openweb'")).select("segment_id", "doc_id")


@query(O.CANDIDATES)
def candidates_scored(spark, d):
    scored = features.candidates(_featured(spark, d), CFG.close_reading_min_words, CFG.close_reading_max_words)
    return scored.select("segment_id", "doc_id", "position", "source_root", "selection_reason", "selection_score")


@query()
def candidates_selected(spark, d):
    scored = features.candidates(_featured(spark, d), CFG.close_reading_min_words, CFG.close_reading_max_words)
    return selection.select_balanced(scored, CFG.candidate_limit)


# ---- duplicates ----


@query(O.SIZE_GROUPS)
def size_groups(spark, d):
    return dedup.size_groups(_files(spark, d))


@query(O.EXACT)
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(dedup.file_facts(_files(spark, d), counts=False))


@query(O.PAIRS)
def candidate_pairs(spark, d):
    return dedup.candidate_pairs(dedup.file_facts(_files(spark, d), counts=False))


@query(O.KEPT)
def kept_documents(spark, d):
    files = dedup.file_facts(_files(spark, d), counts=False)
    return dedup.kept_files(files, dedup.exact_duplicates(files)).select("path", "size")


@query(O.RUN_COUNTS)
def dedup_run_counts(spark, d):
    return dedup.run_counts(_files(spark, d)).drop("pairs_compared")


@query()
def dedup_pairs_compared(spark, d):
    """Files and pairs of a run, with the pairs that are left after the filters."""
    return dedup.run_counts(_files(spark, d), max_distance=24)


@query()
def fuzzy_duplicates(spark, d):
    return dedup.fuzzy_pairs(_files(spark, d))


@query()
def duplicate_report(spark, d):
    return dedup.duplicates(_files(spark, d))


@query()
def simhash_pairs(spark, d):
    return dedup.fuzzy_pairs(_files(spark, d), max_distance=24)


@query()
def simhashes(spark, d):
    return _docs(spark, d).select("doc_id", simhash_udf("text").alias("simhash"))


@query(O.HAMMING)
def simhash_distance(spark, d):
    """Bits in which the stored SimHash of a file's scans differ from that of the first scan."""
    files = spark.read.parquet(f"{d}/file_meta.parquet").filter("simhash is not null").select("path", "scanned_at", "simhash").distinct()
    first = files.groupBy("path").agg(F.min(F.struct("scanned_at", "simhash")).alias("f")).select("path", F.col("f.simhash").alias("head"))
    return files.join(first, "path").groupBy("path").agg(
        F.max(F.bit_count(F.col("simhash").bitwiseXOR(F.col("head")))).cast("long").alias("bits")
    )


# ---- index ----


def _old_index(spark: SparkSession, d: str) -> DataFrame:
    """The table of scanned files as an older index, superseded scans and all."""
    return spark.read.parquet(f"{d}/file_meta.parquet").select(
        F.lit("md").alias("file_group"), F.concat(F.lit("copy/"), "path").alias("copied_relative_path"),
        F.concat(F.lit("source/"), "path", F.lit("@"), F.substring("sha256", 1, 8)).alias("source_relative_path"),
        F.col("sha256").alias("source_sha256"), F.col("size").cast("string").alias("source_size_bytes"),
    )


@query(O.INDEX_MATCH_FILES)
def index_match(spark, d):
    """The corpus against the older index."""
    return index.match_index(_files(spark, d).select("path", "sha256", "size"), _old_index(spark, d))


@query(O.INDEX_TOTALS)
def index_totals(spark, d):
    ids = dedup.unique_ids(_docs(spark, d).select("path"))
    return index.diagnostics(index_match(spark, d), _old_index(spark, d), ids)


@query(O.INDEX_DIAGNOSTICS)
def index_diagnostics(spark, d):
    """How many files the older index knows, by status."""
    return index_match(spark, d).groupBy("source_match_status").agg(F.count("*").alias("files"))


@query(O.TALLIES)
def corpus_tallies(spark, d):
    """Documents by source, type, date status and script, in one pass."""
    docs = _docs(spark, d).select(
        F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"),
        F.when(F.coalesce("filename_date", F.lit("not_found")) == "not_found", "not_found").otherwise("parsed").alias("date_status"),
        T.script_language(F.col("path"), F.col("text")).alias("script"),
    )
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in docs.columns)))
    return docs.select(pairs.alias("p")).select("p.*").groupBy("field", "value").agg(F.count("*").alias("documents"))


@query(O.DATES)
def filename_dates(spark, d):
    rows = spark.read.parquet(f"{d}/documents_manifest.parquet").select("doc_id").distinct()
    return rows.select("doc_id", T.filename_date(F.concat("doc_id", F.lit(".md"))).alias("x")).select("doc_id", "x.*")


@query(O.DOC_TYPES)
def doc_types(spark, d):
    rows = spark.read.parquet(f"{d}/documents_manifest.parquet").select("doc_id").distinct()
    return rows.select("doc_id", T.doc_type(F.concat("doc_id", F.lit(".md")), F.lit("")).alias("doc_type"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Every path of the tables once: of the corpus, of the scanned files and of the pages' raw files."""
    scanned = spark.read.parquet(f"{d}/file_meta.parquet").select("path")
    raw = spark.read.parquet(f"{d}/documents_manifest.parquet").select(F.col("raw_path").alias("path"))
    return _docs(spark, d).select("path").unionByName(scanned).unionByName(raw).filter("path is not null").distinct()


@query()
def source_layer(spark, d):
    """Source, layer, role, type and platform of every path of the tables."""
    layer, role = T.layer_and_role(F.col("source_root"))
    rows = _paths(spark, d).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("source_path"))
    return rows.withColumn("source_root", T.source_root(F.col("source_path"))).select(
        "file_name", "source_path", "source_root", layer.alias("dataset_layer"), role.alias("dataset_role"),
        T.doc_type(F.col("file_name"), F.col("source_path")).alias("doc_type"),
        T.platform(F.col("file_name"), F.col("source_path")).alias("platform"),
    )


@query(O.UNIQUE_IDS)
def doc_ids(spark, d):
    return dedup.unique_ids(_paths(spark, d))


@query(O.RENAMES)
def rename_plan(spark, d):
    return index.rename_plan(_paths(spark, d))


@query(O.URLS)
def url_normalize(spark, d):
    rows = spark.read.parquet(f"{d}/documents_manifest.parquet").select("url").distinct()
    return rows.select("url", T.normalize_url(F.col("url")).alias("x")).select("url", F.col("x.url").alias("full_url"), F.col("x.status").alias("status"))


@query(O.SLUGS)
def domain_slug(spark, d):
    rows = spark.read.parquet(f"{d}/documents_manifest.parquet").select(T.normalize_url(F.col("url")).alias("x")).filter("x.status = 'ok'")
    return rows.select(T.domain_slug(F.col("x.url")).alias("slug")).groupBy("slug").agg(F.count("*").alias("pages"))


@query(O.OUTPUT_NAMES)
def output_names(spark, d):
    rows = (
        spark.read.parquet(f"{d}/documents_manifest.parquet").groupBy("doc_id").agg(F.max("url").alias("url"))
        .select(F.col("doc_id").alias("page_id"), T.normalize_url(F.col("url")).alias("x")).filter("x.status = 'ok'")
    )
    return index.output_names(rows.select("page_id", T.domain_slug(F.col("x.url")).alias("slug")), "2026-01-01")


@query()
def page_extract(spark, d):
    """Pages made of the corpus: navigation, a main part with headings and paragraphs, a footer."""
    rows = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i == 0, F.concat(F.lit("<h1>"), x, F.lit("</h1>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>")))), "")
    html = F.concat(F.lit("<html><head><title>"), T.first_line(F.col("text")), F.lit("</title></head><body><nav>Home Menu</nav><main>"), rows, F.lit("</main><footer>End</footer></body></html>"))
    pages = _docs(spark, d).select("doc_id", html.alias("html"), F.concat(F.lit("https://www.example.org/"), "path").alias("url"))
    return extract_pages(pages, "2026-01-01").select("doc_id", "title", "char_count", "word_count", "status", "markdown")


# ---- quality ----


@query(O.CHECKS)
def qc_checks(spark, d):
    docs = _docs(spark, d).select(
        "doc_id", F.when(T.looks_mojibake(F.col("text")), "ok_suspicious_mojibake").otherwise("ok").alias("read_status"),
        T.word_count(F.col("text")).alias("word_count"), F.coalesce("source", F.lit("unknown")).alias("source_root"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"),
    )
    return quality.checks(docs, 0, CFG.expected_documents)
