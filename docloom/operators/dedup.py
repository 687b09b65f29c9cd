"""Duplicate files: equal byte size, then equal content, then fuzzy ratio among representatives.

Files are (path, size, sha256, text); paths are compared in lower case, then as they are. One plan covers all sizes:
only representatives of distinct contents are paired. Their texts travel once, to the group of their size (to each group of
their part where a size is cut into parts), and are paired there, so no text travels per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.functions.similarity import char_places, indel_ratio, may_be_near, simhash64, simhash_udf
from docloom.shared import cut

#: Representatives of one size that are paired in one group.
PART = 500


def order_key(path: str = "path") -> Column:
    return F.struct(F.lower(path).alias("low"), F.col(path).alias("path"))


def file_facts(files: DataFrame, simhash: bool = False, counts: bool = True) -> DataFrame:
    """Path, size and hash of each file as a table of its own, with ``counts`` also its length and the counts of a few
    characters, and with ``simhash`` its SimHash: what pairs are judged by before texts travel. Texts are read for this once."""
    known = [c for c in ("len", "chars", "simhash") if c in files.columns]
    if "text" not in files.columns:
        return files.select("path", "size", "sha256", *known)
    text = F.col("text")
    more = [F.length(text).alias("len"), _letters(text).alias("chars")] if counts else []
    more += [simhash_udf("text").alias("simhash")] if simhash else []
    return cut(files.select("path", "size", "sha256", *more), "files")


def size_groups(files: DataFrame) -> DataFrame:
    """``size, files`` of the sizes that more than one file has."""
    return files.groupBy("size").agg(F.count("*").alias("files")).filter("files > 1")


def representatives(files: DataFrame) -> DataFrame:
    """``size, sha256, rep, n``: first path of every content whose size is shared, and the number of its files; what
    :func:`file_facts` knows of the content comes along."""
    shared = size_groups(files).select("size")
    known = [c for c in ("len", "chars", "simhash") if c in files.columns]
    return (
        files.join(shared, "size", "left_semi").groupBy("size", "sha256")
        .agg(F.min(order_key()).alias("k"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in known))
        .select("size", "sha256", F.col("k.path").alias("rep"), "n", *known)
    )


def exact_duplicates(files: DataFrame) -> DataFrame:
    """``deleted_file, original_file, size``: every later file of a content, with its representative."""
    reps = representatives(files).filter("n > 1")
    return files.join(reps, ["size", "sha256"]).filter("path != rep").select(
        F.col("path").alias("deleted_file"), F.col("rep").alias("original_file"), "size"
    )


def _placed(reps: DataFrame, v: Column) -> DataFrame:
    """``size, x, y, part, v``: the representatives of sizes that more than one has, a row for each group they are paired
    in. A size of more than PART of them is cut into parts, and every two parts meet in a group of their own, so no task
    holds a whole size."""
    sizes = reps.groupBy("size").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("reps")).filter("reps > 1")
    return (
        reps.withColumn("v", v).join(sizes.select("size", "parts"), "size")
        .withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("size", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "v")
    )


def _pairs(reps: DataFrame) -> DataFrame:
    """``size, l, r``: every two representatives of a size as structs, the first in order as ``l``."""
    known = [c for c in ("len", "chars", "simhash") if c in reps.columns]
    placed = _placed(reps, F.struct(order_key("rep").alias("k"), *known))
    one = placed.filter("part = x").select("size", "x", "y", F.col("v").alias("a"))
    two = placed.filter("part = y").select("size", "x", "y", F.col("v").alias("b"))
    return one.join(two, ["size", "x", "y"]).filter("x < y or a.k < b.k").select("size", F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"))


def candidate_pairs(files: DataFrame) -> DataFrame:
    """``left_path, right_path, size`` of representatives of equal size, left before right."""
    reps = representatives(files).select("size", "rep")
    return _pairs(reps).select(F.col("l.k.path").alias("left_path"), F.col("r.k.path").alias("right_path"), "size")


def _letters(c: Column) -> Column:
    """How often each of a few frequent characters occurs: enough to bound a common subsequence from above."""
    return F.array(*(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in " eationrsudlcmpgh"))


def possible_pairs(facts: DataFrame, threshold: float = 0.9, max_distance: int | None = None) -> DataFrame:
    """``left_path, right_path, size`` of the candidate pairs whose lengths and character counts don't rule a ratio above
    ``threshold`` out, which loses none. ``max_distance`` adds the lossy SimHash filter. No text is read."""
    pairs = _pairs(representatives(facts))
    common = F.aggregate(F.zip_with("l.chars", "r.chars", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    others = F.least(*(F.col(f"{side}.len") - F.aggregate(f"{side}.chars", F.lit(0), lambda s, x: s + x) for side in "lr"))
    possible = pairs.filter(2 * (common + others) > threshold * (F.col("l.len") + F.col("r.len")))
    if max_distance is not None:
        possible = possible.filter(F.bit_count(F.col("l.simhash").bitwiseXOR(F.col("r.simhash"))) <= max_distance)
    return possible.select(F.col("l.k.path").alias("left_path"), F.col("r.k.path").alias("right_path"), "size")


def _near(table: pa.Table, threshold: float, max_distance: int | None, first: bool) -> pa.Table:
    """Pairs above ``threshold`` among the texts of a group of :func:`_placed`; with ``first`` of each text only the first
    one before it, and what comes after that isn't compared."""
    table = table.filter(pc.is_valid(table["text"])).sort_by([("low", "ascending"), ("path", "ascending")])
    paths, texts, parts = (table[c].to_pylist() for c in ("path", "text", "part"))
    part = np.array(parts)
    across = table.num_rows and table["x"][0].as_py() != table["y"][0].as_py()
    left, right = may_be_near(texts, threshold, (lambda j: part[:j] != part[j]) if across else None)
    hashes: dict[int, int] = {}
    places: tuple = (None, None)
    rows: list[tuple[int, int, float]] = []
    for j, i in sorted(zip(right.tolist(), left.tolist())):
        if first and rows and rows[-1][1] == j:
            continue
        if max_distance is not None:
            for k in {i, j} - hashes.keys():
                hashes[k] = simhash64(texts[k])
            if ((hashes[i] ^ hashes[j]) & (1 << 64) - 1).bit_count() > max_distance:
                continue
        if places[0] != j:
            places = j, char_places(texts[j])
        ratio = indel_ratio(texts[j], texts[i], threshold, places[1])
        if ratio > threshold:
            rows.append((i, j, ratio))
    i, j, ratios = zip(*rows) if rows else ((), (), ())
    return pa.table({
        "left_path": pa.array([paths[k] for k in i], pa.string()), "right_path": pa.array([paths[k] for k in j], pa.string()),
        "size": table["size"].take(pa.array(j, pa.int64())), "ratio": pa.array(ratios, pa.float64()),
    })


def _compared(facts: DataFrame, files: DataFrame, threshold: float, max_distance: int | None, first: bool = False) -> DataFrame:
    reps = representatives(facts).select("size", "rep")
    placed = _placed(reps.join(files.select(F.col("path").alias("rep"), "text"), "rep"), F.struct(order_key("rep").alias("k"), "text"))
    return placed.select("size", "x", "y", "part", "v.k.low", "v.k.path", "v.text").groupBy("size", "x", "y").applyInArrow(
        lambda table: _near(table, threshold, max_distance, first),
        f"left_path string, right_path string, size {dict(files.dtypes)['size']}, ratio double",
    )


def fuzzy_pairs(files: DataFrame, threshold: float = 0.9, max_distance: int | None = None) -> DataFrame:
    """``left_path, right_path, size, ratio`` of the candidate pairs above ``threshold`` (strict). ``max_distance`` adds the
    lossy SimHash filter."""
    return _compared(file_facts(files, counts=False), files, threshold, max_distance)


def first_matches(facts: DataFrame, files: DataFrame, threshold: float, max_distance: int | None = None) -> DataFrame:
    """``right_path, left_path, size, ratio``: of each right file the first left one above ``threshold``."""
    found = _compared(facts, files, threshold, max_distance, True)
    best = F.min(F.struct(order_key("left_path").alias("k"), "size", "ratio")).alias("m")
    return found.groupBy("right_path").agg(best).select("right_path", F.col("m.k.path").alias("left_path"), "m.size", "m.ratio")


def duplicates(files: DataFrame, threshold: float = 0.9, max_distance: int | None = None) -> DataFrame:
    """``deleted_file, original_file, size, similarity, method`` and the first lines of both.

    A copy goes with its representative, a representative with the first earlier one above the threshold. A kept file
    may itself be reported; there is no closure.
    """
    facts = file_facts(files, counts=False)
    best = first_matches(facts, files, threshold, max_distance).select(
        F.col("right_path").alias("deleted_file"), F.col("left_path").alias("original_file"), "size",
        F.col("ratio").alias("similarity"), F.lit("fuzzy ratio").alias("method"),
    )
    exact = exact_duplicates(facts).withColumns({"similarity": F.lit(1.0), "method": F.lit("SHA-256 exact match")})
    heads = files.select("path", "first_line")
    return (
        exact.unionByName(best)
        .join(heads.withColumnsRenamed({"path": "deleted_file", "first_line": "deleted_first_line"}), "deleted_file")
        .join(heads.withColumnsRenamed({"path": "original_file", "first_line": "original_first_line"}), "original_file")
        .withColumn("actually_deleted", F.lit(False))
    )


def run_counts(files: DataFrame, threshold: float = 0.9, max_distance: int | None = None) -> DataFrame:
    """``suspicious_files, pairs_planned, pairs_compared``: files whose size is shared, pairs of representatives, and those
    that lengths, character counts and SimHash leave."""
    facts = file_facts(files, max_distance is not None)
    suspicious = size_groups(facts).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("suspicious_files"))
    planned = candidate_pairs(facts).agg(F.count("*").alias("pairs_planned"))
    left = possible_pairs(facts, threshold, max_distance).agg(F.count("*").alias("pairs_compared"))
    return suspicious.join(F.broadcast(planned)).join(F.broadcast(left))


def kept_files(files: DataFrame, removed: DataFrame, protected: tuple[str, ...] = ("clean.md",)) -> DataFrame:
    """The files that no record removes; protected names always stay. Nothing is deleted."""
    gone = removed.select(F.col("deleted_file").alias("path")).filter(
        ~F.lower(F.element_at(F.split("path", "/"), -1)).isin(*protected)
    ).distinct()
    return files.join(gone, "path", "left_anti")


def unique_ids(paths: DataFrame) -> DataFrame:
    """``path, doc_id, original_doc_id, doc_id_collision_status``: stems, the later of equal ones numbered in the order
    of path components."""
    from docloom.functions.text import path_parts, stem

    named = paths.select("path", stem(F.element_at(F.split("path", "/"), -1)).alias("original_doc_id"))
    nth = F.row_number().over(Window.partitionBy("original_doc_id").orderBy(path_parts(F.col("path"))))
    return named.withColumn("_n", nth).select(
        "path", F.when(F.col("_n") == 1, F.col("original_doc_id")).otherwise(F.format_string("%s__dup%03d", "original_doc_id", "_n")).alias("doc_id"),
        "original_doc_id", F.when(F.col("_n") == 1, "unique").otherwise("renamed_duplicate_stem").alias("doc_id_collision_status"),
    )
