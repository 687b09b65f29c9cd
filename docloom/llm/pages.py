"""The manifest's view of a page: one clean platform, language and document type per ``doc_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.rx import WS

#: ISO codes and names of the five languages.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian"),
    "ru": ("ru", "rus", "russian", "русский"),
}
#: Fixed values that stand for a missing entry.
MISSING = ("", "unknown", "not_found")



def _given(c: Column) -> Column:
    """The value without outer blanks, null where it says nothing."""
    text = F.regexp_replace(c.cast("string"), f"^{WS}+|{WS}+$", "")
    return F.when(~F.lower(text).isin(*MISSING), text)


def slug(c: Column, mark: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", mark), f"^{mark}+|{mark}+$", "")


def language_code(c: Column) -> Column:
    """``en``, ``de``, ``fr``, ``es`` or ``ru`` for a code, region tag or name; null for anything else."""
    head = F.lower(c)
    stem = F.regexp_extract(head, r"^([^-_]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(head.isin(*names) | stem.isin(*names), code).otherwise(out)
    return out


def _none_if_empty(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def page_facts(manifest: DataFrame, dates: bool = False) -> DataFrame:
    """``doc_id, platform_slug, language, doc_type`` with one row per ``doc_id``; null where no row gives a value.

    Of contradicting rows the largest value wins. Rows without ``doc_id`` are left out. With ``dates`` also
    ``published``: the earliest date of ``last_updated``, null where no row has a possible date.
    """
    date = F.col("last_updated").cast("string").try_cast("date") if "last_updated" in manifest.columns else F.lit(None).cast("date")
    published = [F.min(F.col("published")).alias("published")] if dates else []
    return (
        manifest.filter(F.col("doc_id").isNotNull())
        .select(
            "doc_id",
            _none_if_empty(slug(_given(F.col("platform")), "-")).alias("platform_slug"),
            language_code(_given(F.col("language"))).alias("language"),
            _none_if_empty(slug(_given(F.col("doc_type")), "_")).alias("doc_type"),
            date.alias("published"),
        )
        .groupBy("doc_id")
        .agg(*(F.max(c).alias(c) for c in ("platform_slug", "language", "doc_type")), *published)
    )


def with_facts(pages: DataFrame, manifest: DataFrame, dates: bool = False) -> DataFrame:
    """Left-join the facts to pages by ``doc_id``; what no row gives is ``unknown``, a missing date null."""
    facts = ("platform_slug", "language", "doc_type")
    joined = pages.drop(*facts, "published").join(page_facts(manifest, dates), "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in facts})
