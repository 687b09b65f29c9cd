"""Dictionary terms as regular-expression counts, JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.rx import WS


def term_regex(term: str) -> str | None:
    """The term in lower case between boundaries (no Latin letter, digit or hyphen next to it); blanks in it match any
    white space. None for an empty term."""
    bare = term.lower().strip()
    if not bare:
        return None
    body = re.escape(bare).replace(r"\ ", f"{WS}+").replace(r"\-", "-")
    return f"(?<![a-z0-9-]){body}(?![a-z0-9-])"


def term_hits(text: Column, terms: list[str], prefilter: bool = True) -> dict[str, Column]:
    """Term -> non-overlapping matches in the lower-cased text. With ``prefilter`` a term whose literal form is missing
    counts 0, even if it stands across a line break; without it such a match counts."""
    low = F.lower(text)
    out = {}
    for term in dict.fromkeys(terms):
        pattern = term_regex(term)
        if pattern is None:
            continue
        bare = term.lower().strip()
        count = F.regexp_count(low, F.lit(pattern)).cast("long")
        gate = bare if prefilter else bare.split()[0]  # a match always holds the first word
        out[term] = F.when(low.contains(gate), count).otherwise(F.lit(0).cast("long"))
    return out


def hit_array(text: Column, terms: list[str], prefilter: bool = True) -> Column:
    """The counts of the distinct terms as one array, in dictionary order."""
    return F.array(*term_hits(text, terms, prefilter).values())


def found_terms(hits: Column, distinct: list[str], terms: list[str]) -> Column:
    """Terms of a group that occur, in the group's order; ``hits`` is :func:`hit_array` over ``distinct``."""
    at = {t: i for i, t in enumerate(distinct)}
    return F.array_compact(F.array(*(F.when(F.get(hits, F.lit(at[t])) > 0, F.lit(t)) for t in terms if t in at)))


def total_hits(hits: Column, distinct: list[str], terms: list[str]) -> Column:
    at = {t: i for i, t in enumerate(distinct)}
    parts = [F.get(hits, F.lit(at[t])) for t in terms if t in at]
    return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("long")


def evidence_phrase(text: Column, terms: list[str], prefilter: bool = True, longest: int = 280) -> Column:
    """Window around the first matches: 90 characters before the earliest, ``longest`` after the latest; compacted, with
    dots where it is cut, at most ``longest`` + 6 characters. Without any match the compacted beginning."""
    from docloom.functions.text import compact

    low = F.lower(text)
    starts, ends = [], []
    for term in dict.fromkeys(terms):
        pattern = term_regex(term)
        if pattern is None:
            continue
        bare = term.lower().strip()
        at = F.when(low.contains(bare if prefilter else bare.split()[0]), F.nullif(F.regexp_instr(low, F.lit(pattern)), F.lit(0)))
        starts.append(at)
        ends.append(at + F.length(F.regexp_substr(low, F.lit(pattern))))
    none = F.substring(compact(text), 1, longest)
    if not starts:
        return none
    low_at, high_at = F.array_min(F.array(*starts)) - 1, F.array_max(F.array(*ends)) - 1
    start = F.greatest(low_at - 90, F.lit(0))
    end = F.least(high_at + longest, F.length(text))
    phrase = compact(F.substring(text, start + 1, end - start))
    phrase = F.concat(F.when(start > 0, "...").otherwise(""), phrase, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(low_at.isNull(), none).otherwise(F.substring(phrase, 1, longest + 6))
