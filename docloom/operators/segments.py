"""Section-aware segments of Markdown, and the cleaning of repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.functions.text import lines, strip, word_count
from docloom.rx import LINE_BREAK, WS, WS_INLINE
from docloom.shared import exploded

_HEAD = f"{WS_INLINE}{{0,3}}#{{1,6}}{WS_INLINE}+[^\\n]"


def segments(docs: DataFrame, text: str = "text", min_words: int = 8) -> DataFrame:
    """``segment_id, doc_id, section_title, position, segment_text, char_count, word_count``.

    A heading (up to three blanks, one to six ``#``) opens a section; paragraphs are parted by blank lines; those of
    fewer than ``min_words`` words are dropped before positions are given. Sections and paragraphs are split inside the
    row, so only the numbering looks at more than one of them, by document.
    """
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), LINE_BREAK, "\n")
    sections = docs.select(F.col("doc_id"), F.posexplode(F.split(body, f"(?md)^(?={_HEAD})", -1)).alias("section", "part"))
    head = f"(?d)^{WS_INLINE}{{0,3}}#{{1,6}}{WS_INLINE}+([^\\n]*)"
    headed = F.col("part").rlike(f"(?d)^{_HEAD}")
    title = F.when(headed, strip(F.regexp_extract("part", head, 1))).otherwise("")
    rest = F.when(headed, F.regexp_replace("part", r"(?d)^[^\n]*\n?", "")).otherwise(F.col("part"))
    paragraphs = sections.select(
        "doc_id", "section", title.alias("section_title"), F.posexplode(F.split(strip(rest), f"\\n{WS}*\\n", -1)).alias("paragraph", "raw")
    ).select("doc_id", "section", "section_title", "paragraph", strip(F.col("raw")).alias("segment_text"))
    kept = paragraphs.withColumn("word_count", word_count(F.col("segment_text"))).filter(
        (F.col("segment_text") != "") & (F.col("word_count") >= min_words)
    )
    order = Window.partitionBy("doc_id").orderBy("section", "paragraph")
    return kept.withColumn("position", F.row_number().over(order).cast("long")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("::s"), F.when(F.col("position") < 10_000, F.lpad(F.col("position").cast("string"), 4, "0")).otherwise(F.col("position").cast("string"))).alias("segment_id"),
        "doc_id", "section_title", "position", "segment_text",
        F.length("segment_text").cast("long").alias("char_count"), "word_count",
    )


def orphan_segments(segs: DataFrame, docs: DataFrame) -> DataFrame:
    return segs.join(docs.select("doc_id"), "doc_id", "left_anti")


def line_parts(text: Column) -> Column:
    """The lines a cleaned text keeps before repeats are looked at: blanks collapsed, ends stripped, none empty."""
    plain = F.replace(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit("\u00a0"), F.lit(" "))
    plain = F.regexp_replace(plain, "[ \\t]+", " ")
    return F.filter(F.transform(lines(plain), strip), lambda x: x != "")


def _often(parts: Column, max_repeats: int) -> Column:
    """The lines that stand more than ``max_repeats`` times: in the sorted array, those equal to the one so many further on."""
    ordered = F.array_sort(parts)
    later = F.slice(ordered, F.lit(max_repeats + 1), F.greatest(F.size(parts) - max_repeats, F.lit(0)))
    return F.array_distinct(F.filter(F.zip_with(ordered, later, lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()))


def with_repeats(docs: DataFrame, max_repeats: int) -> DataFrame:
    """``doc_id, parts, often``: the lines of each text and those that stand too often; nothing leaves its row."""
    parts = docs.select("doc_id", line_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    many = F.size("parts") - F.size(F.array_distinct("parts")) >= max_repeats
    return parts.withColumn("often", F.when(many, _often(F.col("parts"), max_repeats)).otherwise(F.array().cast("array<string>")))


def clean_text(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``doc_id, clean_text``: cleaned lines, of which one that stands more than ``max_repeats`` times keeps its first."""
    first = F.filter("parts", lambda x, i: ~F.array_contains("often", x) | (F.array_position("parts", x) == i + 1))
    kept = F.when(F.size("often") == 0, F.col("parts")).otherwise(first)
    return with_repeats(docs, max_repeats).select("doc_id", F.array_join(kept, "\n").alias("clean_text"))


def repeated_lines(docs: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``doc_id, line, n`` of the lines that stand more than ``max_repeats`` times in a document."""
    rows = exploded(with_repeats(docs, max_repeats), ["doc_id", "parts"], "often", "line")
    return rows.select("doc_id", "line", F.size(F.filter("parts", lambda x: x == F.col("line"))).cast("long").alias("n"))
