"""Corpus index: metadata of files, matching with an older index, rename plans and output names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docloom.functions import text as T


def old_index_names(old: DataFrame) -> DataFrame:
    """Rows of Markdown copies with ``name``, the copy's file name; rows without one are dropped."""
    rows = old.filter(F.col("file_group") == "md").withColumn(
        "name", F.element_at(F.split(F.coalesce("copied_relative_path", F.lit("")), "/"), -1)
    )
    return rows.filter(F.col("name") != "")


def match_index(files: DataFrame, old: DataFrame) -> DataFrame:
    """``path, source_match_status, source_relative_path`` for files (path, sha256, size): one exact candidate, else a
    single candidate by name, else none; sizes are compared as text."""
    rows = old_index_names(old).select("name", "source_relative_path", "source_sha256", "source_size_bytes")
    joined = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(rows, "name", "left")
    exact = F.coalesce(
        (F.col("source_sha256") == F.col("sha256")) & (F.col("source_size_bytes") == F.col("size").cast("string")), F.lit(False)
    )
    found = F.col("source_relative_path")
    by = joined.groupBy("path").agg(
        F.count("source_relative_path").alias("n"), F.count_if(exact).alias("e"),
        F.min(F.when(exact, found)).alias("exact"), F.min(found).alias("any"),
    )
    return by.select(
        "path",
        F.when(F.col("n") == 0, "unmatched_in_old_index").when(F.col("e") == 1, "matched_by_hash_size_and_name")
        .when(F.col("e") > 1, "ambiguous_old_index_hash_size_name").when(F.col("n") == 1, "matched_by_name_only")
        .otherwise("ambiguous_old_index_name").alias("source_match_status"),
        F.when(F.col("e") == 1, F.col("exact")).when((F.col("e") == 0) & (F.col("n") == 1), F.col("any")).otherwise("").alias("source_relative_path"),
    )


def diagnostics(matched: DataFrame, old: DataFrame, ids: DataFrame) -> DataFrame:
    """``name, n``: totals of an index: files, rows and different names of the older index, matches by name, files without
    any, stems that several files share, and the files of each status as ``status:...``. Each side is one aggregate."""
    unmatched = F.col("source_match_status") == "unmatched_in_old_index"
    of_files = matched.agg(F.count("*").alias("total_files"), F.count_if(~unmatched).alias("old_index_name_matches"), F.count_if(unmatched).alias("unmatched_in_old_index"))
    of_old = old_index_names(old).agg(F.count("*").alias("old_index_rows"), F.count_distinct("name").alias("old_index_unique_names"))
    stems = ids.groupBy("original_doc_id").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("duplicate_stems"))

    def tall(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in df.columns))).alias("x")).select("x.*")

    status = matched.groupBy(F.concat(F.lit("status:"), "source_match_status").alias("name")).agg(F.count("*").alias("n"))
    return tall(of_files).unionByName(tall(of_old)).unionByName(tall(stems)).unionByName(status)


def index_rows(files: DataFrame, matched: DataFrame, ids: DataFrame) -> DataFrame:
    """The index table: one row per file with everything that its name, text and match tell."""
    name = F.element_at(F.split("path", "/"), -1)
    source = F.coalesce("source_relative_path", F.lit(""))
    layer, role = T.layer_and_role(F.col("source_root"))
    date = T.filename_date(F.col("file_name"))
    rows = (
        files.join(matched, "path", "left").join(ids, "path")
        .withColumns({"file_name": name, "source_root": T.source_root(source)})
        .withColumns(
            {
                "dataset_layer": layer, "dataset_role": role, "platform": T.platform(name, source),
                "doc_type": T.doc_type(name, source), "language": T.script_language(name, F.col("text")),
                "char_count": F.length("text").cast("long"), "word_count": T.word_count(F.col("text")),
                "line_count": T.line_count(F.col("text")), "_date": date,
                "read_status": F.coalesce("read_status", F.lit("ok")) if "read_status" in files.columns else F.lit("ok"),
            }
        )
        .withColumn("platform_slug", T.slugify(F.col("platform")))
    )
    return rows.select("*", "_date.*").drop("_date", "text")


def rename_plan(paths: DataFrame) -> DataFrame:
    """``path, new_path, status``: blanks of the file name as ``_``; unchanged, renamed, or collision where the name is
    taken by a file or by an earlier one of the plan."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    new = F.concat(folder, F.replace(F.element_at(F.split("path", "/"), -1), F.lit(" "), F.lit("_")))
    plan = paths.select("path", new.alias("new_path"))
    nth = F.row_number().over(Window.partitionBy("new_path").orderBy((F.col("path") != F.col("new_path")).cast("int"), "path"))
    return plan.withColumn("_n", nth).select(
        "path", "new_path",
        F.when(F.col("path") == F.col("new_path"), "unchanged").when(F.col("_n") > 1, "collision").otherwise("renamed").alias("status"),
    )


def output_names(pages: DataFrame, day: str) -> DataFrame:
    """``page_id, file_name`` for pages (page_id, slug): slug and day, numbered from ``_2`` on where they recur."""
    nth = F.row_number().over(Window.partitionBy("slug").orderBy("page_id"))
    return pages.withColumn("_n", nth).select(
        "page_id",
        F.concat("slug", F.lit(f"_{day}"), F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.lit(".md")).alias("file_name"),
    )
