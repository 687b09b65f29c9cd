"""Dictionary features of texts: hits per group, co-occurrence classes, gap signals, candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.terms import evidence_phrase, found_terms, hit_array, total_hits

#: Which flags make a signal, and which must be missing. D disclosure, P procedure, A forum, C consequence,
#: K contestability, O opacity, B consent, X context.
SIGNALS = (
    ("D", "P", "disclosure_without_procedure"),
    ("P", "C", "procedure_without_consequence"),
    ("D", "K", "disclosure_without_contestability"),
    ("B", "K", "consent_without_alternative"),
    ("X", "P", "context_sensitive_processing_without_procedure"),
    ("DO", "", "visible_practice_with_opaque_formula"),
    ("P", "A", "procedure_without_forum"),
)
_FLAG = {
    "D": "documentary_transparency", "P": "procedure", "A": "actor_forum", "C": "consequence", "K": "contestability",
    "O": "algorithmic_opacity", "B": "boilerplate_consent", "X": "contextual_integrity",
}


def distinct_terms(groups: dict[str, list[str]]) -> list[str]:
    return [t for t in dict.fromkeys(t for terms in groups.values() for t in terms) if t.strip()]


def with_hits(df: DataFrame, groups: dict[str, list[str]], text: str = "text", prefilter: bool = True) -> DataFrame:
    """Adds ``hits``, the counts of the dictionary's distinct terms: a term that several groups hold is matched once."""
    return df.withColumn("hits", hit_array(F.coalesce(text, F.lit("")), distinct_terms(groups), prefilter))


def present(group: str) -> Column:
    return F.col(f"{group}_flag") == "present"


def cooccurrence() -> Column:
    d, p = present("documentary_transparency"), present("procedure")
    return F.when(d & p, "both").when(d, "disclosure_only").when(p, "procedure_only").otherwise("none")


def gap_signals() -> Column:
    """The signals whose conditions hold, in their fixed order, as an array."""

    def holds(have: str, lack: str) -> Column:
        out = F.lit(True)
        for f in have:
            out = out & present(_FLAG[f])
        for f in lack:
            out = out & ~present(_FLAG[f])
        return out

    return F.array_compact(F.array(*(F.when(holds(have, lack), F.lit(name)) for have, lack, name in SIGNALS)))


def features(df: DataFrame, groups: dict[str, list[str]], text: str = "text", evidence: bool = False) -> DataFrame:
    """Adds, per group, ``<g>_flag``, ``<g>_terms`` and ``<g>_count``, then the class, the signals and their count; with
    ``evidence`` the phrase around the hits."""
    distinct = distinct_terms(groups)
    hit = with_hits(df, groups, text)
    columns = {}
    for group, terms in groups.items():
        found = found_terms(F.col("hits"), distinct, terms)
        columns[f"{group}_flag"] = F.when(F.size(found) > 0, "present").otherwise("absent")
        columns[f"{group}_terms"] = F.array_join(found, "|")
        columns[f"{group}_count"] = total_hits(F.col("hits"), distinct, terms)
    out = hit.withColumns(columns).withColumns({"cooccurrence_class": cooccurrence(), "_signals": gap_signals()})
    out = out.withColumns(
        {
            "candidate_gap_signals": F.array_join("_signals", "|"),
            "silence_or_ambiguity_flag": F.when(F.size("_signals") > 0, "present").otherwise("absent"),
            "silence_or_ambiguity_terms": F.array_join("_signals", "|"),
            "silence_or_ambiguity_count": F.size("_signals").cast("long"),
        }
    )
    if evidence:
        out = out.withColumn("evidence_phrase", evidence_phrase(F.coalesce(text, F.lit("")), distinct))
    return out.drop("hits", "_signals")


def group_presence(featured: DataFrame, groups) -> DataFrame:
    """``group, documents``: how many rows have each group's flag, in one pass."""
    counts = featured.agg(*(F.count_if(present(g)).alias(g) for g in groups))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(g).alias("group"), F.col(g).alias("documents")) for g in groups))).alias("x")).select("x.*")


def candidates(featured: DataFrame, low: int = 30, high: int = 320) -> DataFrame:
    """Segments fit for close reading, with ``selection_reason``, ``main_reason`` and ``selection_score``."""
    signals = F.when(F.col("candidate_gap_signals") != "", F.split("candidate_gap_signals", r"\|")).otherwise(F.array().cast("array<string>"))
    kind, dated = F.col("cooccurrence_class"), F.col("filename_date") != "not_found"
    opaque = present("algorithmic_opacity")
    reasons = F.concat(
        F.array_compact(
            F.array(
                F.when(kind == "disclosure_only", "algorithmic_practice_without_explicit_procedure"),
                F.when(kind == "both", "disclosure_and_procedure_in_same_fragment"),
                F.when(dated, "dated_filename"),
                F.when(opaque, "opaque_formula"),
                F.when(present("boilerplate_consent"), "boilerplate_consent"),
                F.when(present("contextual_integrity"), "context_sensitive_processing"),
            )
        ),
        signals,
    )
    score = (
        F.when(kind == "both", 5).when(kind == "disclosure_only", 4).otherwise(0) + F.when(opaque, 2).otherwise(0)
        + F.when(present("contestability"), 2).otherwise(0) + F.when(dated, 1).otherwise(0) + F.size("_reasons")
    )
    eligible = F.col("word_count").between(low, high) & ~((kind == "none") & (F.col("candidate_gap_signals") == ""))
    return (
        featured.filter(eligible).withColumn("_reasons", reasons)
        .withColumns({"selection_score": score.cast("long"), "selection_reason": F.array_join(F.array_distinct("_reasons"), "|"),
                      "main_reason": F.coalesce(F.get("_reasons", F.lit(0)), F.lit("general"))})
        .drop("_reasons")
    )
