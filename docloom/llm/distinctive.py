"""How distinctive a term is per record: hypergeometric enrichment.

A record's terms are a draw without replacement from all occurrences in the collection. The score of a term is the
negative logarithm of the exact upper-tail probability of its count, adjusted for the false-discovery rate over the
record's terms. Collection counts of terms in many records are few whatever the collection holds (records times terms
per record, divided by the records they need) and travel to the data; those of the others are joined by term, so the
frequent terms never meet in one task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import tokens
from docloom.shared import cut

#: A term in at least one of so many records is frequent.
FREQUENT_ONE_IN = 1000
#: Frequent terms that travel to the data at most; those of fewer records are joined instead.
FREQUENT_TERMS = 200_000

#: Records whose arrays are computed together.
SCORED_TOGETHER = 500

SCORES = "doc_id string, term string, count long, document_count long, score double, weight double"


def _stirling(y: np.ndarray) -> np.ndarray:
    """log(gamma(y)) for y >= 8."""
    r = 1.0 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680))) / y


#: log(n!) of small n: the logarithms of gamma(n + 1) by the series, of the first few by their product.
_SMALL = np.concatenate([np.cumsum(np.log(np.r_[1.0, 1:8])), _stirling(np.arange(9.0, (1 << 14) + 1))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """log(n!) for n >= 0, by log-gamma: from the table where all are small, else by the series."""
    n = np.asarray(n, dtype=np.float64)
    if not n.size or n.max() < len(_SMALL):
        return _SMALL[n.astype(np.int64)]
    small = n < len(_SMALL)
    if not small.any():
        return _stirling(n + 1)
    out = np.empty_like(n)
    out[small] = _SMALL[n[small].astype(np.int64)]
    out[~small] = _stirling(n[~small] + 1)
    return out


def upper_tail(c: np.ndarray, k: np.ndarray, n: np.ndarray, m: float, per_k: np.ndarray | None = None) -> np.ndarray:
    """log P(X >= c), X hypergeometric: n draws from m of which k count. Summed from the largest term on, until what
    remains is below the precision of a double. ``per_k``: log(k!) + log((m - k)!), where it is known."""
    c, k, n = (np.asarray(v, dtype=np.float64) for v in (c, k, n))
    if per_k is None:
        per_k = log_factorial(k) + log_factorial(m - k)
    of_n, place = np.unique(n, return_inverse=True)
    draws = (log_factorial(of_n) + log_factorial(m - of_n) - log_factorial(np.array([m])))[place]
    first = per_k + draws - log_factorial(c) - log_factorial(k - c) - log_factorial(n - c) - log_factorial(m - k - n + c)
    total = np.ones_like(first)
    scale = np.zeros_like(first)
    active = np.flatnonzero(c < np.minimum(k, n))
    a, kk, nn, t, s = c[active], k[active], n[active], np.ones(active.size), np.ones(active.size)
    rest = m - kk - nn + 1
    while active.size:
        t = t * ((kk - a) * (nn - a) / ((a + 1) * (rest + a)))
        s = s + t
        a = a + 1
        if (big := s > 1e200).any():
            scale[active[big]] += np.log(s[big])
            t[big] /= s[big]
            s[big] = 1.0
        more = (t > s * 1e-17) & (a < np.minimum(kk, nn))
        if not more.all():
            total[active[~more]] = s[~more]
            active, a, kk, nn, t, s, rest = (v[more] for v in (active, a, kk, nn, t, s, rest))
    return np.minimum(first + scale + np.log(total), 0.0)


def adjust(log_p: np.ndarray, record: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg within each record (a non-decreasing array of record numbers), on logarithms."""
    order = np.lexsort((log_p, record))
    p, r = log_p[order], record[order]
    start = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
    size = np.diff(np.r_[start, len(r)])
    rank = np.arange(len(r)) - np.repeat(start, size) + 1
    q = p + np.log(np.repeat(size, size) / rank)
    # running minimum from each record's end: offset records so that one pass over the whole array does it
    span = (q.max() - q.min() + 1.0) if len(q) else 1.0
    number = np.repeat(np.arange(len(start)), size)
    q = np.minimum.accumulate((q + number * span)[::-1])[::-1] - number * span
    out = np.empty_like(q)
    out[order] = np.minimum(q, 0.0)
    return out


def bags(pages: DataFrame, text_col: str = "markdown", split=tokens) -> DataFrame:
    """``doc_id, terms, counts``, one row per ``doc_id`` with a term; ``terms`` are joined by line feeds, which keeps the
    row small and no term can hold."""

    def count(batches):
        for batch in batches:
            ids, terms, counts, ends = [], [], [], [0]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bag := Counter(split(text)):
                    ids.append(key)
                    terms.append("\n".join(bag))
                    counts += bag.values()
                    ends.append(len(counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(terms, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32())),
                ],
                names=["doc_id", "terms", "counts"],
            )

    return (
        pages.filter("doc_id is not null").select("doc_id", F.col(text_col).cast("string"))
        .mapInArrow(count, "doc_id string, terms string, counts array<int>")
        .groupBy("doc_id").agg(F.min(F.struct("terms", "counts")).alias("b")).select("doc_id", "b.*")
    )


def _terms(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct terms of a column of bags, the place of each term among them, and each bag's length."""
    split = pc.split_pattern(column, "\n")
    flat = split.flatten().dictionary_encode()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), lengths


def term_scores(pages: DataFrame, text_col: str = "markdown", split=tokens, top_by: str | None = None) -> DataFrame:
    """``doc_id, term, count, document_count, score, weight`` of every term of every record.

    score: -ln of the adjusted probability; weight: count * ln(records / document_count). ``top_by`` keeps only the
    record's highest ``score`` or ``weight``, of equal ones the first term by code points. A ``doc_id`` counts once, as a
    record even if its text is null or empty, which has no terms; an empty table gives no rows.
    """
    n = pages.filter("doc_id is not null").select("doc_id").distinct().count()
    own = cut(bags(pages, text_col, split), "bags")
    pairs = own.select(F.explode(F.arrays_zip(F.split("terms", "\n").alias("term"), F.col("counts").alias("c"))).alias("t"))
    stats = cut(
        pairs.groupBy(F.col("t.term").alias("term"))
        .agg(F.sum(F.col("t.c").cast("long")).alias("total"), F.count("*").alias("d")),
        "terms",
    )
    m = float(stats.agg(F.sum("total")).first()[0] or 0)
    frequent = stats.filter(F.col("d") >= max(2, n // FREQUENT_ONE_IN)).orderBy(F.desc("d"), "term").limit(FREQUENT_TERMS)
    known = {t: (a, b) for t, a, b in zip(*frequent.toPandas()[["term", "total", "d"]].to_numpy().T)}

    def others(batches):
        for batch in batches:
            distinct, place, lengths = _terms(batch.column(1))
            rare = np.array([t not in known for t in distinct], dtype=bool)
            at = np.flatnonzero(rare[place]) if len(distinct) else np.empty(0, dtype=np.int64)
            row = np.repeat(np.arange(len(lengths)), lengths)[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(distinct, pa.string()).take(pa.array(place[at]))],
                names=["doc_id", "term"],
            )

    rest = (
        own.select("doc_id", "terms").mapInArrow(others, "doc_id string, term string").join(stats, "term")
        .groupBy("doc_id").agg(F.collect_list(F.struct("term", "total", "d")).alias("rest"))
    )

    def score(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, SCORED_TOGETHER):
                batch = whole.slice(start, SCORED_TOGETHER)
                distinct, place, lengths = _terms(batch.column(1))
                here = batch.column(3).flatten()
                facts = dict(zip(here.field(0).to_pylist(), zip(here.field(1).to_pylist(), here.field(2).to_pylist())))
                of = np.array([known[t] if t in known else facts[t] for t in distinct], dtype=np.int64).reshape(-1, 2)
                c = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.r_[0, np.cumsum(lengths)[:-1]]
                record = np.repeat(np.arange(len(lengths)), lengths)
                draws = np.repeat(np.add.reduceat(c, first), lengths)
                per_k = (log_factorial(of[:, 0]) + log_factorial(m - of[:, 0]))[place]
                k, d = of[place, 0], of[place, 1]
                points = -adjust(upper_tail(c, k, draws, m, per_k), record) + 0.0
                weight = c * np.log(n / d)
                keep = np.arange(len(place))
                if top_by:
                    value = weight if top_by == "weight" else points
                    best: dict[int, int] = {}
                    for j in np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, first), lengths)).tolist():
                        b = best.get(r := int(record[j]))
                        if b is None or distinct[place[j]] < distinct[place[b]]:
                            best[r] = j
                    keep = np.fromiter(best.values(), dtype=np.int64, count=len(best))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(record[keep])),
                        pa.array(distinct, pa.string()).take(pa.array(place[keep])),
                        pa.array(c[keep]), pa.array(d[keep]), pa.array(points[keep]), pa.array(weight[keep]),
                    ],
                    names=["doc_id", "term", "count", "document_count", "score", "weight"],
                )

    return own.join(rest, "doc_id", "left").select("doc_id", "terms", "counts", "rest").mapInArrow(score, SCORES)
