"""The named queries of the problems, over the test tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import boilerplate, distinctive, leakage, markup, mixing, neardup, residue, sitelines, termfreq, tokenbudget
from docloom.shared import spread

#: A vocabulary file of a public tokenizer, for the counts that aren't estimates; the environment may name another.
TOKENIZER = os.environ.get("DOCLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


#: Tables of texts, whose rows cost far more than reading them.
TEXTS = ("documents", "extracted_documents")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in TEXTS else table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(_t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"))


def p1_decided(spark: SparkSession, d: str) -> DataFrame:
    """What decided each line: the wrapper, or an exemplar where the wrapper doesn't."""
    return boilerplate.decided_lines(_t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"))


def p1_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.wrappers(_t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"))


def p1_main_text(spark: SparkSession, d: str) -> DataFrame:
    pages = _t(spark, d, "extracted_documents")
    return sitelines.without_lines(pages, boilerplate.boilerplate_lines(pages, _t(spark, d, "documents_manifest")))


NEAR = {"shingle": 3, "min_words": 60, "threshold": 0.8}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.similar_pairs(_t(spark, d, "documents"), **NEAR)
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_t(spark, d, "documents"), **NEAR)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document that has a copy or a similar text, with its class and the number of its links."""
    return neardup.classes(_t(spark, d, "documents"), **NEAR).withColumnRenamed("id", "doc_id")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """The pairs between representatives of classes, with their similarity."""
    return neardup.similar_classes(_t(spark, d, "documents"), **NEAR)[1].withColumn("similarity", F.round("similarity", 6))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    return neardup.file_groups(
        _t(spark, d, "documents"), _t(spark, d, "file_meta"), _t(spark, d, "duplicates"), **NEAR
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marked_terms(_t(spark, d, "documents")).filter("mark is not null").select("token", "mark")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return termfreq.marked_terms(_t(spark, d, "documents")).drop("id")


def p3_stored(spark: SparkSession, d: str) -> DataFrame:
    """The figures an earlier run stored, beside the true ones."""
    return termfreq.against_stored(termfreq.marked_terms(_t(spark, d, "documents")), _t(spark, d, "token_frequencies"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    slices = tokenbudget.slice_budget(_t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"))
    return slices.filter("tokens * 200 >= total_tokens").select("platform_slug", "language", "doc_type")


def p4_slices(spark: SparkSession, d: str) -> DataFrame:
    slices = tokenbudget.slice_budget(_t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"))
    return slices.select("platform_slug", "language", "doc_type", "pages", "tokens")


def p4_tokenizer_slices(spark: SparkSession, d: str) -> DataFrame:
    slices = tokenbudget.slice_budget(
        _t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"), tokenizer=TOKENIZER
    )
    return slices.drop("total_tokens")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    lines = sitelines.repeated_lines(_t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"), min_pages=5, min_clusters=1, min_dates=0)
    return lines.select("doc_id", "line_no")


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """Stricter: lines of five distinct texts and three publication dates, so republished pages don't count."""
    return sitelines.repeated_lines(
        _t(spark, d, "extracted_documents"), _t(spark, d, "documents_manifest"), min_pages=5, min_clusters=5, min_dates=3
    )


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The pages without the lines of p5_lines."""
    pages = _t(spark, d, "extracted_documents")
    return sitelines.without_lines(pages, sitelines.repeated_lines(pages, _t(spark, d, "documents_manifest")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(_t(spark, d, "extracted_documents"), top_by="weight").select("doc_id", "term")


def p6_top_score(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(_t(spark, d, "extracted_documents"), top_by="score")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.term_scores(_t(spark, d, "extracted_documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_lines(_t(spark, d, "extracted_documents"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_pages(_t(spark, d, "extracted_documents"))


def p7_regions(spark: SparkSession, d: str) -> DataFrame:
    """What the regions of content and of markup of each page hold."""
    return markup.page_regions(_t(spark, d, "extracted_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(_t(spark, d, "documents"), _t(spark, d, "eval_items")).select("doc_id", "text")


def _mix(spark: SparkSession, d: str, tokenizer: str | None = None):
    documents = mixing.sized(_t(spark, d, "documents"), tokenizer=tokenizer)
    return documents, *mixing.plan(documents, _t(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].filter("short").select("source")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    documents, _, picks = _mix(spark, d)
    return mixing.select(documents, picks)


def p9_tokenizer_sources(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, TOKENIZER)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_t(spark, d, "documents")).select("doc_id").distinct()


def p10_labels(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_t(spark, d, "documents"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(_t(spark, d, "documents")).select("doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p1_found, p1_decided, p1_wrappers, p1_main_text, p2_found, p2_groups, p2_classes, p2_links, p2_files, p3_found, p3_counts, p3_stored, p4_found, p4_slices,
        p4_tokenizer_slices, p5_found, p5_lines, p5_clean, p6_found, p6_top_score, p6_scores, p7_found, p7_clean, p7_regions,
        p8_found, p8_items, p8_clean, p9_found, p9_sources, p9_mix, p9_tokenizer_sources, p10_found, p10_labels, p10_clean,
    )
    return {f.__name__: f for f in named}
