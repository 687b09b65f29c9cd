"""Lines repeated across one site's documents.

Pages of one platform with the same body are collapsed to a cluster first, so every line is counted over distinct
clusters, with the pages and the publication dates they stand for. The three counts are kept apart: which of them makes
a line boilerplate is the caller's threshold.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import hash_text
from docloom.llm.pages import with_facts
from docloom.shared import cut, small_side

#: Lines of the extractor's header: the first three that aren't empty.
HEADER_LINES = 3
_LEAD = re.compile(r"^[#>*\-\s]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTER_RUNS = r"(?:[^\W\d_]+[\W\d_]+){%d}[^\W\d_]"


def line_key(line: str) -> str:
    """What makes two lines the same: without leading marks, in lower case, digits as 0, blanks collapsed."""
    return " ".join(_DIGITS.sub("0", _LEAD.sub("", line).lower()).split())


def page_lines(pages: DataFrame, min_letter_runs: int = 4, text_col: str = "markdown") -> DataFrame:
    """``doc_id, body, line_nos, keys``: hashes of the body and of each line that can count."""
    enough = re.compile(_LETTER_RUNS % (min_letter_runs - 1))

    def lines(batches):
        for batch in batches:
            ids, bodies, numbers, keys = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                header, body, no, of = 0, [], [], []
                for i, line in enumerate((text or "").split("\n"), 1):
                    if not line or line.isspace():
                        continue
                    if header < HEADER_LINES:
                        header += 1
                        continue
                    body.append(f"{i} {line}")
                    if enough.search(line):
                        no.append(i)
                        of.append(hash_text(line_key(line)))
                ids.append(key)
                bodies.append(hash_text("\n".join(body)))
                numbers.append(no)
                keys.append(of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(bodies, pa.int64()),
                    pa.array(numbers, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "body", "line_nos", "keys"],
            )

    return (
        pages.filter("doc_id is not null").select("doc_id", F.col(text_col).cast("string"))
        .mapInArrow(lines, "doc_id string, body long, line_nos array<int>, keys array<long>")
        .groupBy("doc_id").agg(F.min(F.struct("body", "line_nos", "keys")).alias("p")).select("doc_id", "p.*")
    )


def repeated_lines(pages: DataFrame, manifest: DataFrame, *, min_pages: int = 5, min_clusters: int = 5, min_dates: int = 3,
                   min_letter_runs: int = 4, text_col: str = "markdown") -> DataFrame:
    """``doc_id, line_no, platform_slug, n_pages, n_clusters, n_dates`` of the lines that reach all three thresholds on
    their platform: pages, clusters of equal pages and dates of publication (the earliest ``last_updated`` that the
    manifest gives a page of the cluster; clusters without one have no date). With the defaults a line of articles that
    were republished, or all published on a day or two, isn't one.

    Repeated rows of a ``doc_id`` count once, the header and empty lines never; null texts have no lines; pages that no
    manifest row gives a platform form the platform ``unknown``.
    """
    clusters = cut(
        with_facts(page_lines(pages, min_letter_runs, text_col), manifest, dates=True)
        .select("doc_id", "platform_slug", "body", "published", "line_nos", "keys"),
        "pagelines",
    )
    site = ["platform_slug", "body"]
    distinct = clusters.groupBy(*site).agg(
        F.count("*").alias("n"), F.min("published").alias("published"),
        F.first(F.struct("line_nos", "keys")).alias("l"),
    )
    counts = (
        distinct.select("platform_slug", "n", "published", F.explode(F.array_distinct("l.keys")).alias("key"))
        .groupBy("platform_slug", "key", "published").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
        .groupBy("platform_slug", "key")
        .agg(F.sum("n").alias("n_pages"), F.sum("c").alias("n_clusters"), F.count("published").alias("n_dates"))
        .filter((F.col("n_pages") >= min_pages) & (F.col("n_clusters") >= min_clusters) & (F.col("n_dates") >= min_dates))
    )
    found = small_side(cut(counts, "repeated"))
    rows = clusters.select("doc_id", "platform_slug", F.explode(F.arrays_zip("line_nos", "keys")).alias("l")).select(
        "doc_id", "platform_slug", F.col("l.line_nos").cast("long").alias("line_no"), F.col("l.keys").alias("key")
    )
    return rows.join(found, ["platform_slug", "key"]).select(
        "doc_id", "line_no", "platform_slug", "n_pages", "n_clusters", "n_dates"
    )


def without_lines(pages: DataFrame, found: DataFrame, text_col: str = "markdown") -> DataFrame:
    """``doc_id`` and its text without the lines (``doc_id, line_no``) found; pages without any stay as they are."""
    drop = found.groupBy("doc_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("_drop"))
    kept = F.array_join(
        F.filter(F.split(text_col, "\n", -1), lambda line, i: ~F.array_contains("_drop", i + 1)), "\n"
    )
    return (
        pages.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text_col).alias(text_col))
        .join(drop, "doc_id", "left")
        .select("doc_id", F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(kept).alias(text_col))
    )
