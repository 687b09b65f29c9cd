"""The two pipelines end to end: corpus analysis of a folder of Markdown, and its duplicates."""

from __future__ import annotations

import os
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import GROUPS, TEST_DICTIONARY, CorpusConfig, DuplicateConfig
from docloom.functions import text as T
from docloom.operators import dedup, features, index, quality, segments, selection, tokenstats
from docloom.shared import cut, release, written
from docloom.sources import fetch
from docloom.sources import files as S
from docloom.sources import sinks

OLD_INDEX_COLUMNS = ["file_group", "copied_relative_path", "source_relative_path", "source_sha256", "source_size_bytes"]


def read_dictionary(table: DataFrame) -> dict[str, list[str]]:
    """Groups of terms from a table (group, ord, term), in order; it is a parameter and small by nature."""
    groups: dict[str, list[str]] = {g: [] for g in GROUPS}
    for r in table.orderBy("group", "ord").collect():
        groups.setdefault(r["group"], []).append(r["term"])
    return groups


def combined(groups: dict[str, list[str]], name: str, *parts: str) -> dict[str, list[str]]:
    """The dictionary with a group made of others, one after the other."""
    return groups | {name: [t for p in parts for t in groups.get(p, [])]}


def without(groups: dict[str, list[str]], name: str, whole: str, part: str) -> dict[str, list[str]]:
    """The dictionary with a group made of one's terms that another lacks, in order."""
    gone = set(groups.get(part, []))
    return groups | {name: [t for t in groups.get(whole, []) if t not in gone]}


def corpus_tables(files: DataFrame, old: DataFrame, groups: dict[str, list[str]] | None = None, config: CorpusConfig = CorpusConfig()) -> dict[str, DataFrame]:
    """The result tables for decoded files (path, size, sha256, text, read_status) and an older index."""
    groups = groups or TEST_DICTIONARY
    ids = dedup.unique_ids(files.select("path"))
    rows = index.index_rows(files, index.match_index(files.select("path", "sha256", "size"), old), ids)
    corpus = cut(rows, "index")
    texts = files.select("path", "text").join(corpus.select("path", "doc_id"), "path")
    facts = ["doc_id", "file_name", "source_root", "dataset_layer", "platform", "doc_type", "filename_date"]
    segs = cut(segments.segments(texts, min_words=config.min_segment_words).join(corpus.select(*facts), "doc_id"), "segments")
    hits = cut(features.features(segs, groups, "segment_text", evidence=True), "hits")
    documents = features.features(texts.select("doc_id", "text"), groups, evidence=True).drop("text").join(corpus.select(*facts, "word_count"), "doc_id")
    scored = features.candidates(hits, config.close_reading_min_words, config.close_reading_max_words)
    chosen = selection.select_balanced(scored, config.candidate_limit)
    docs = texts.select("doc_id", "path", "text")
    scores = cut(tokenstats.tfidf(docs, config.tfidf_features, config.tfidf_min_df, config.tfidf_max_df), "tfidf")
    grams = [tokenstats.top_ngrams(docs, n, config.ngram_limit) for n in (2, 3)]
    return {
        "corpus_index": corpus,
        "document_metadata": corpus.select(*facts, "dataset_role", "platform_slug", "language", "date_precision", "source_match_status", "source_relative_path"),
        "segments": segs,
        "theory_feature_hits": hits,
        "document_feature_summary": documents,
        "token_frequencies": tokenstats.top_tokens(docs, config.token_limit),
        "ngrams": grams[0].unionByName(grams[1]),
        "collocations": tokenstats.collocations(docs, config.collocation_min_count, config.collocation_limit),
        "tfidf_terms_by_document": tokenstats.top_by_document(scores, config.tfidf_per_document),
        "tfidf_terms_by_group": tokenstats.top_by_group(scores, corpus, ("source_root", "dataset_layer", "doc_type"), config.tfidf_per_group),
        "candidate_fragments": scored.join(F.broadcast(chosen), "segment_id"),
        "quality_checks": quality.checks(corpus, segments.orphan_segments(segs, corpus).count(), config.expected_documents),
    }


def run_corpus(spark: SparkSession, folder: str, out: str, old_index: str = "", groups: dict[str, list[str]] | None = None, config: CorpusConfig = CorpusConfig(), hidden: bool = False, csv: bool = False) -> dict[str, str]:
    """Read, analyse and write everything below ``out``; the paths of the tables by name. Files whose path has a part that
    begins with ``_`` or ``.`` are read with ``hidden``, as the command line does; without, a check fails if there are any.
    ``csv`` writes each table as CSV too. Tables of the run's own in the shared folder are deleted at its end."""
    mark = written()
    files = cut(S.decoded((S.all_files if hidden else S.markdown_files)(spark, folder)), "files")
    old = S.read_csv(spark, old_index or f"{out}/no-index.csv", OLD_INDEX_COLUMNS)
    tables = corpus_tables(files, old, groups, config)
    if not hidden and (left_out := S.first_hidden(spark, folder)):
        row = [("hidden_files", "fail", f"left_out={left_out} and any others")]
        tables["quality_checks"] = tables["quality_checks"].unionByName(spark.createDataFrame(row, "check_name string, status string, detail string"))
    paths = {name: sinks.write_table(df, out, name) for name, df in tables.items()}
    stored = {name: spark.read.parquet(path) for name, path in paths.items()}
    counts = {name: df.count() for name, df in stored.items()}
    optional = quality.optional_dependencies()
    extra = quality.output_checks(spark, paths, sinks.code_modified()).unionByName(
        spark.createDataFrame(optional, "check_name string, status string, detail string")
    )
    index_totals = index.diagnostics(index.match_index(files.select("path", "sha256", "size"), old), old, stored["corpus_index"])
    diagnostics = {r["name"]: r["n"] for r in index_totals.collect()}
    if csv:
        for name, df in stored.items():
            sinks.write_csv(df, f"{out}/csv/{name}")
    paths["output_checks"] = sinks.write_table(extra, out, "output_checks")
    dependencies = {name.partition(":")[2]: detail for name, _, detail in optional}
    sinks.write_text(sinks.manifest_json(asdict(config), groups or TEST_DICTIONARY, counts, diagnostics, dependencies), f"{out}/run_manifest.json")
    report = sinks.corpus_report(stored["corpus_index"], stored["segments"], stored["document_feature_summary"], stored["token_frequencies"], stored["quality_checks"], counts["candidate_fragments"])
    sinks.write_text(report, f"{out}/report.md")
    release(spark, mark)
    return paths


def run_duplicates(spark: SparkSession, folder: str, out: str, config: DuplicateConfig = DuplicateConfig()) -> dict[str, str]:
    """Find duplicates below a folder; writes the records, the kept files and a report, which is no input if it lies below the
    folder. Nothing is deleted."""
    mark = written()
    report = os.path.relpath(os.path.abspath(f"{out}/duplicates.md"), os.path.abspath(folder.removeprefix("file://"))) if "://" not in out else ""
    raw = S.all_files(spark, folder, guarded=True).filter(F.col("path") != report).withColumn("text", S.utf8_text(F.col("content")))
    files = cut(raw.select("path", "size", "sha256", "text", T.first_line(F.col("text")).alias("first_line")), "files")
    records = cut(dedup.duplicates(files, config.threshold, config.simhash_max_distance if config.prefilter else None), "records")
    paths = {"duplicates": sinks.write_table(records, out, "duplicates"), "kept": sinks.write_table(dedup.kept_files(files, records).drop("text"), out, "kept")}
    run = dedup.run_counts(files, config.threshold, config.simhash_max_distance if config.prefilter else None).first().asDict()
    header = {"threshold": config.threshold, "prefilter": config.prefilter, "files": files.count(), "duplicates": records.count(), **run}
    sinks.write_text(sinks.duplicate_report(records, header), f"{out}/duplicates.md")
    release(spark, mark)
    return paths


def run_pages(spark: SparkSession, urls: DataFrame, out: str, day: str, get=fetch.fetch) -> DataFrame:
    """Fetch the pages (page_id, url), extract their text and write each as a file of ``out``, a folder all executors mount;
    ``page_id, url, file_name, char_count, word_count, status`` of all."""
    pages = cut(fetch.pages_of(urls, day, get), "pages")
    named = sinks.write_pages(pages.filter("status = 'ok'"), out, day)
    return pages.drop("markdown", "slug", "title").join(named, "page_id", "left").select("page_id", "url", "file_name", "char_count", "word_count", "status")


def run_conversion(spark: SparkSession, folder: str, out: str, convert=None) -> DataFrame:
    """Convert the PDF and DOCX files of a folder, not of those below it, to ``<stem>.md`` in ``out``, a folder all executors
    mount; ``path, status`` of each. A file that fails leaves the others alone."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,docx,PDF,DOCX}").load(folder)
    files = raw.select(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1).alias("path"), "content")
    done = cut(S.convert_documents(files, convert), "converted")
    texts = done.filter("status = 'ok'").select(F.col("path").alias("page_id"), F.regexp_replace("path", r"\.[^.]+$", ".md").alias("file_name"), "markdown")
    sinks.write_named(texts, out)
    return done.select("path", "status")
