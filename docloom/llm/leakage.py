"""Evaluation texts inside training texts: winnowed k-gram fingerprints, joined and extended.

With k-grams and a window of w hashes, every run of w + k - 1 = ``span`` words shared by two texts holds a fingerprint
that both texts selected, so no shared span of that length is missed. A fingerprint travels with the few words around
it that can belong to a shortest span, and a match is extended word by word, so hash collisions are never reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.kernels import grams, hash_words, winnow, words
from docloom.shared import cut

#: Distinct fingerprints of the evaluation side up to which the corpus side drops others before the join (32 MB).
FILTER_PRINTS = 4_000_000


def fingerprints(texts: DataFrame, k: int, window: int, keep: np.ndarray | None = None) -> DataFrame:
    """(id, print, before, gram, after) of a table (id, text): the fingerprints with the words around them.

    ``keep``: sorted hashes; other fingerprints are dropped where the text is read.
    """
    reach = window - 1

    def select(batches):
        for batch in batches:
            ids, prints, before, middle, after = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                if key is None or len(found) < k + reach:
                    continue
                hashes = grams(hash_words(found), k)
                at = winnow(hashes, window)
                if keep is not None:
                    if not len(keep):
                        continue
                    near = keep[np.minimum(np.searchsorted(keep, hashes[at]), len(keep) - 1)]
                    at = at[near == hashes[at]]
                for p in at.tolist():
                    ids.append(key)
                    prints.append(hashes[p])
                    before.append(found[max(0, p - reach) : p])
                    middle.append(" ".join(found[p : p + k]))
                    after.append(found[p + k : p + k + reach])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                    pa.array(before, strings), pa.array(middle, pa.string()), pa.array(after, strings),
                ],
                names=["id", "print", "before", "gram", "after"],
            )

    return texts.mapInArrow(
        select, "id long, print long, before array<string>, gram string, after array<string>"
    )


def _same_run(x: str, y: str):
    """Length of the common prefix of two arrays of words."""
    pairs = F.zip_with(x, y, lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    return F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0).cast("long")) - 1,
                      F.size(pairs).cast("long"))


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
          item_id: str = "item_id", item_text: str = "text", span: int = 12, k: int = 8) -> DataFrame:
    """Distinct (``doc_id``, ``item_id``) of texts with at least ``span`` consecutive words in common.

    Texts that are null, empty or shorter than ``span`` words never match; repeated rows add nothing; two empty tables
    give an empty one. Only the four named columns are read, so other columns may clash.
    """
    window = span - k + 1
    wanted = cut(
        fingerprints(items.select(F.col(item_id).cast("long"), F.col(item_text).cast("string")), k, window), "prints"
    )
    distinct = wanted.select("print").distinct()
    keep = None
    if (head := distinct.limit(FILTER_PRINTS + 1).toPandas()["print"].to_numpy(dtype=np.int64)).size <= FILTER_PRINTS:
        keep = np.sort(head.view(np.uint64))
    found = fingerprints(docs.select(F.col(doc_id).cast("long"), F.col(doc_text).cast("string")), k, window, keep)
    d = found.select(F.col("id").alias("doc_id"), "print", "gram", F.reverse("before").alias("b1"),
                     F.col("after").alias("a1"))
    e = wanted.select(F.col("id").alias("item_id"), "print", "gram", F.reverse("before").alias("b2"),
                      F.col("after").alias("a2"))
    return (
        d.join(e, ["print", "gram"])
        .filter(_same_run("b1", "b2") + _same_run("a1", "a2") >= span - k)
        .select("doc_id", "item_id").distinct()
    )


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``item_id, documents``: in how many documents each item leaked; 0 for the others. An item's repeated rows are one,
    null ids none."""
    key = options.get("item_id", "item_id")
    hits = leaks(docs, items, **options).groupBy("item_id").agg(F.count("*").alias("documents"))
    every = items.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id")).distinct()
    return every.join(hits, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"))


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaked, all columns kept; documents with a null id stay."""
    hits = leaks(docs, items, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hits, F.col(options.get("doc_id", "doc_id")).cast("long") == F.col("_hit"), "left_anti")
