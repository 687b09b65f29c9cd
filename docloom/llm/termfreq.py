"""Frequency of every distinct term: blockwise count arrays, a global integer dictionary, sums by identifier range.

Each input block (part of a partition) numbers its own terms and counts them in two arrays, one for occurrences and
one for records. The distinct terms of all blocks, sorted by range, get 64-bit identifiers without any row leaving the
executors; a block's arrays are translated to them and added up range by range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import tokens
from docloom.shared import cut

#: Distinct terms at which a block is closed.
BLOCK_TERMS = 300_000
#: Identifiers in one range: the length of the arrays that are summed.
RANGE_BITS = 16
#: Ways in which the blocks of one range are first summed apart.
SALT = 16


def block_counts(texts: DataFrame, split=tokens) -> DataFrame:
    """(block, token, count, document_count) of a single text column, a row per term and block."""

    def count(batches):
        ids: dict[str, int] = {}
        total = np.zeros(0, dtype=np.int64)
        present = np.zeros(0, dtype=np.int64)

        def close():
            terms = list(ids)
            ids.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array(total), pa.array(present)],
                names=["token", "count", "document_count"],
            )

        for batch in batches:
            seen: list[int] = []
            once: list[int] = []
            for text in batch.column(0):
                numbers = [ids.setdefault(t, len(ids)) for t in split(text.as_py())]
                seen += numbers
                once += set(numbers)
            n = len(ids)
            total = np.pad(total, (0, n - len(total))) + np.bincount(np.array(seen, dtype=np.int64), minlength=n)
            present = np.pad(present, (0, n - len(present))) + np.bincount(np.array(once, dtype=np.int64), minlength=n)
            if n >= BLOCK_TERMS:
                yield close()
                total, present = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if ids:
            yield close()

    return texts.mapInArrow(count, "token string, count long, document_count long").withColumn(
        "block", F.spark_partition_id()
    )


def _sum_arrays(batches):
    """Add up (id, count, document_count) rows, sorted by identifier range, into the arrays of one range at a time."""
    size = 1 << RANGE_BITS
    held = None
    total = np.zeros(size, dtype=np.int64)
    present = np.zeros(size, dtype=np.int64)

    def close():
        low = np.flatnonzero(present)
        out = [pa.array((np.int64(held) << RANGE_BITS) + low), pa.array(total[low]), pa.array(present[low])]
        total[low] = 0
        present[low] = 0
        return pa.RecordBatch.from_arrays(out, names=["id", "count", "document_count"])

    for batch in batches:
        ids, n, d = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        high = ids >> RANGE_BITS
        starts = np.flatnonzero(np.diff(high, prepend=high[:1] - 1)) if len(high) else []
        for start, end in zip(starts, [*starts[1:], len(high)]):
            if held is not None and held != high[start]:
                yield close()
            held = high[start]
            low = ids[start:end] & (size - 1)
            np.add.at(total, low, n[start:end])
            np.add.at(present, low, d[start:end])
    if held is not None:
        yield close()


def term_counts(docs: DataFrame, text_col: str = "text", split=tokens) -> DataFrame:
    """``id, token, count, document_count`` of every distinct term of ``text_col``.

    Null and empty texts hold no term; a repeated row counts again; an empty table gives no rows. Only ``text_col`` is
    read, whatever other columns there are.
    """
    blocks = cut(block_counts(docs.select(F.col(text_col).cast("string")), split), "blocks")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dictionary = cut(
        blocks.select("token").distinct().repartitionByRange(parts, "token").sortWithinPartitions("token")
        .withColumn("id", F.monotonically_increasing_id()),
        "dictionary",
    )
    schema = "id long, count long, document_count long"
    encoded = blocks.join(dictionary, "token").select("id", "count", "document_count", "block")
    partial = (
        encoded.repartition(F.shiftright("id", RANGE_BITS), F.col("block") % SALT).sortWithinPartitions(F.shiftright("id", RANGE_BITS))
        .select("id", "count", "document_count").mapInArrow(_sum_arrays, schema)
    )
    total = partial.repartition(F.shiftright("id", RANGE_BITS)).sortWithinPartitions(F.shiftright("id", RANGE_BITS)).mapInArrow(_sum_arrays, schema)
    return dictionary.join(total, "id").select("id", "token", "count", "document_count")


def marked_terms(docs: DataFrame, text_col: str = "text", rare_below: int = 3, common_above: float = 0.4) -> DataFrame:
    """:func:`term_counts` with ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than the
    share ``common_above`` of all records (rows, null texts included), else null. Rare wins where both hold."""
    n = docs.count()
    share = round(common_above * 10_000)
    return term_counts(docs, text_col).withColumn(
        "mark",
        F.when(F.col("document_count") < rare_below, "rare").when(
            F.col("document_count") * 10_000 > F.lit(n).cast("long") * share, "common"
        ),
    )


def against_stored(terms: DataFrame, stored: DataFrame) -> DataFrame:
    """``token, stored_count, stored_document_count, count, document_count, mark`` of the tokens an earlier run has stored
    (batch_id, token, count, document_count): its figures and the true ones of :func:`marked_terms`.

    Spellings of a token are put together, trimmed and in lower case; of the rows of one batch the highest figures count,
    batches add up. Null and empty tokens are left out; null figures count nothing; tokens no record holds have null for
    the true figures. Empty tables give no rows.
    """
    token = F.lower(F.trim(F.col("token")))
    batches = stored.select("batch_id", token.alias("token"), "count", "document_count").filter("token is not null and token != ''").groupBy("batch_id", "token").agg(
        F.max("count").alias("c"), F.max("document_count").alias("d")
    )
    sums = batches.groupBy("token").agg(F.sum("c").alias("stored_count"), F.sum("d").alias("stored_document_count"))
    return sums.join(terms.select("token", "count", "document_count", "mark"), "token", "left")
