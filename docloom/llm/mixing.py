"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths.

Documents are counted by source and exact length, which is all the plan needs. A source's budget is filled with whole
copies as far as it goes; the rest is fitted by taking the same fraction of every length, then single documents from
the longest down, then a bounded knapsack on the last tokens, which is widened until the fill is proven the best. How many documents of each length are taken is exact;
which ones is decided by a seeded hash, ranked within hash ranges so that one hot length needs no single task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.llm.tokenbudget import CHARS_PER_TOKEN, page_tokens
from docloom.shared import cut

#: Tokens of a budget that the dynamic programme fits.
KNAPSACK_TOKENS = 1 << 14
#: Tokens up to which the programme is widened where the fill isn't proven the best.
WIDEST_TOKENS = 1 << 20
#: Hash ranges in which documents of one length are ranked.
RANKS = 256

PICKS = "source string, tokens long, full int, extra long, proven boolean"


def bounded_knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that the lengths add up to as much of ``budget`` as they can.

    Reachable sums are the bits of one integer; a length with many documents goes in by powers of two.
    """
    if budget <= 0:
        return {}
    full = (1 << (budget + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= budget), reverse=True):
        left, size = min(counts[length], budget // length), 1
        while left > 0 and not reach >> budget & 1:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            size *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            taken[length] = taken.get(length, 0) + take
    return taken


def fit(counts: dict[int, int], budget: int, max_repeats: int) -> tuple[int, dict[int, int], bool]:
    """(copies of every document, further documents per length, is no fill nearer to the budget) for one source."""
    available = sum(length * n for length, n in counts.items())
    if available <= 0 or max_repeats <= 0:
        return 0, {}, True
    full = min(max_repeats, budget // available)
    rest = budget - full * available if full < max_repeats else 0
    step = math.gcd(*counts)
    window = KNAPSACK_TOKENS
    while True:
        extra = _fill(counts, available, rest, window)
        gap = rest - sum(length * n for length, n in extra.items())
        proven = gap < step or rest <= window  # every sum is a multiple of the step; or the programme saw all
        if proven or window >= WIDEST_TOKENS:
            return full, extra, proven
        window *= 4


def _fill(counts: dict[int, int], available: int, rest: int, window: int) -> dict[int, int]:
    """Documents per length that fill ``rest``, of which the programme fits the last ``window`` tokens."""
    if rest <= window:
        return bounded_knapsack(counts, rest)
    extra = {length: n * rest // available for length, n in counts.items()}
    rest -= sum(length * n for length, n in extra.items())
    for length in sorted(counts, reverse=True):
        if rest <= window:
            break
        if length > 0:
            more = min(counts[length] - extra[length], (rest - window + length - 1) // length, rest // length)
            extra[length] += more
            rest -= more * length
    left = {length: counts[length] - extra[length] for length in counts}
    for length, n in bounded_knapsack(left, min(rest, window)).items():
        extra[length] += n
    return {length: n for length, n in extra.items() if n}


def sized(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, source, tokens``: ceil(characters / 4), or exact tokens of a vocabulary file (each ``doc_id`` once)."""
    if tokenizer is None:
        chars = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))
        return docs.select("doc_id", "source", F.ceil(chars / F.lit(CHARS_PER_TOKEN)).cast("long").alias("tokens"))
    return docs.select("doc_id", "source").dropDuplicates(["doc_id"]).join(page_tokens(docs, text_col, tokenizer), "doc_id")


def plan(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, picks) for sized documents.

    sources: one row per target with ``docs, tokens`` available, ``target_tokens``, ``repeats`` (copies of every
    document), ``extra_docs`` and ``mixed_tokens`` taken, ``actual_share`` of the mix, ``short``: all
    repeats of the source stay below its target, ``gap_tokens``: what is missing to the target where it isn't short,
    ``exact``: no choice of documents comes nearer, and ``unmixed_tokens``: of all documents without source or without
    target, the same in each row. picks: ``source, tokens, full, extra`` per length. The total that
    shares refer to is the tokens of all documents, those without source or target included. Repeated targets of a
    source count once; null shares and repeats are 0. Empty tables give empty results.
    """
    lengths = cut(documents.groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    total = lengths.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0] or 0
    wanted = targets.filter("source is not null").groupBy("source").agg(
        F.max(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0))).alias("target_share"),
        F.max(F.coalesce(F.col("max_repeats").cast("int"), F.lit(0))).alias("max_repeats"),
    )

    def fill(of: pd.DataFrame) -> pd.DataFrame:
        counts = {int(t): int(n) for t, n in zip(of.tokens, of.n)}
        full, extra, proven = fit(counts, int(of.target_share.iloc[0] * total), int(of.max_repeats.iloc[0]))
        return pd.DataFrame(
            [(of.source.iloc[0], t, full, extra.get(t, 0), proven) for t in counts], columns=["source", "tokens", "full", "extra", "proven"]
        )

    picks = cut(lengths.join(wanted, "source").groupBy("source").applyInPandas(fill, PICKS), "picks")
    have = lengths.join(picks.hint("merge"), ["source", "tokens"]).groupBy("source").agg(
        F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.max("full").alias("repeats"),
        F.sum("extra").alias("extra_docs"), F.bool_and("proven").alias("exact"), F.sum((F.col("full") * F.col("n") + F.col("extra")) * F.col("tokens")).alias("mixed_tokens"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("docs", "tokens", "repeats", "extra_docs", "mixed_tokens")}
    sources = cut(wanted.join(have, "source", "left").withColumns(zero), "sources")
    mixed, mixable = (x or 0 for x in sources.agg(F.sum("mixed_tokens"), F.sum("tokens")).first())
    return sources.withColumns(
        {
            "target_tokens": F.col("target_share") * F.lit(total).cast("double"),
            "actual_share": F.col("mixed_tokens") / F.lit(max(mixed, 1)).cast("double"),
            "gap_tokens": F.when(F.col("max_repeats") * F.col("tokens") >= F.col("target_share") * F.lit(total).cast("double"),
                                 F.floor(F.col("target_share") * F.lit(total).cast("double")) - F.col("mixed_tokens")),
            "exact": F.coalesce("exact", F.lit(True)),
            "unmixed_tokens": F.lit(total - mixable).cast("long"),
            "short": F.col("max_repeats") * F.col("tokens") < F.col("target_share") * F.lit(total).cast("double"),
        }
    ), picks


def select(documents: DataFrame, picks: DataFrame, seed: int = 42) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the documents in the mix (copies > 0)."""
    hashed = (
        documents.join(picks.drop("proven"), ["source", "tokens"]).filter("full > 0 or extra > 0")
        .withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
        .withColumn("_range", F.pmod("_h", F.lit(RANKS)))
    )
    sizes = hashed.filter("extra > 0").groupBy("source", "tokens", "_range").agg(F.count("*").alias("_in"))
    before = sizes.withColumn(
        "_before",
        F.sum("_in").over(Window.partitionBy("source", "tokens").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("source", "tokens", "_range", "_in", F.coalesce("_before", F.lit(0)).alias("_before"))
    placed = hashed.join(before, ["source", "tokens", "_range"], "left")
    edge = placed.filter("_before < extra and _before + _in > extra").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("source", "tokens", "_range").orderBy("_h", "doc_id"))
    ).withColumn("copies", F.col("full") + (F.col("_rank") <= F.col("extra") - F.col("_before")).cast("int"))
    rest = placed.filter("_before is null or not (_before < extra and _before + _in > extra)").withColumn(
        "copies", F.col("full") + F.coalesce((F.col("_before") + F.col("_in") <= F.col("extra")).cast("int"), F.lit(0))
    )
    columns = ["doc_id", "source", "tokens", "copies"]
    return edge.select(*columns).unionByName(rest.select(*columns)).filter("copies > 0")
