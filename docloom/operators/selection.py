"""Balanced choice of candidates: pruned relationally, then one ordered scan over a bounded pool."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Sources that are served first, in order.
SOURCE_ORDER = ("COMPARE-main", "pga-corpus-1.01", "pga-versions-actual", "genai-eu-2026-05-25", "unknown")
DOC_CAP, REASON_CAP = 3, 16


def choose(rows: pd.DataFrame, limit: int, source_order=SOURCE_ORDER) -> list[int]:
    """Positions of the chosen rows; ``rows`` in score order with doc_id, source_root, main_reason.

    First every known source up to its share, then all sources up to a wider cap, each with at most three rows of a
    document and 16 of a reason; what is still missing is filled with any row, up to four of a document.
    """
    doc, source, reason = (rows[c].tolist() for c in ("doc_id", "source_root", "main_reason"))
    known = [s for s in source_order if s in set(source)]
    share = max(6, limit // max(1, len(known)))
    taken: dict[int, None] = {}
    of_doc, of_source, of_reason = Counter(), Counter(), Counter()

    def scan(places, cap: float, doc_cap: int, reason_cap: float) -> None:
        for i in places:
            if len(taken) >= limit:
                return
            if i in taken or of_doc[doc[i]] >= doc_cap or of_source[source[i]] >= cap or of_reason[reason[i]] >= reason_cap:
                continue
            taken[i] = None
            of_doc[doc[i]] += 1
            of_source[source[i]] += 1
            of_reason[reason[i]] += 1

    everything = range(len(doc))
    for s in known:
        scan([i for i in everything if source[i] == s], share, DOC_CAP, REASON_CAP)
    scan(everything, max(share + 4, 14), DOC_CAP, REASON_CAP)
    scan(everything, math.inf, DOC_CAP + 1, math.inf)
    return list(taken)


def prune(scored: DataFrame, limit: int) -> DataFrame:
    """A pool that yields the same choice: the first four rows of a document and reason, and of those the first
    limit + 4 * ceil(limit / 3) of a source and reason. Its size depends on sources and reasons, not on the rows."""
    order = [F.desc("selection_score"), "doc_id", "position"]
    w1 = Window.partitionBy("doc_id", "main_reason").orderBy(*order)
    first = scored.withColumn("_n", F.row_number().over(w1)).filter("_n <= 4")
    w2 = Window.partitionBy("source_root", "main_reason").orderBy(*order)
    return first.withColumn("_n", F.row_number().over(w2)).filter(F.col("_n") <= limit + 4 * math.ceil(limit / 3)).drop("_n")


def select_balanced(scored: DataFrame, limit: int = 60, source_order=SOURCE_ORDER) -> DataFrame:
    """``segment_id, rank`` of the chosen candidates, rank in the order in which they were chosen."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_low=-rows.selection_score).sort_values(["_low", "doc_id", "position"], kind="stable").reset_index(drop=True)
        taken = choose(rows, limit, source_order)
        return pd.DataFrame({"segment_id": rows.segment_id.iloc[taken].tolist(), "rank": list(range(1, len(taken) + 1))})

    pool = prune(scored, limit).select("segment_id", "doc_id", "position", "source_root", "main_reason", "selection_score")
    return pool.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(scan, "segment_id string, rank long")
