"""Readers: Markdown trees with mixed encodings, CSV as text, pages."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docloom.functions import text as T

#: Encodings that are tried in this order; the last never fails.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1251", "latin-1")


def markdown_files(spark: SparkSession, root: str, pattern: str = "*.md", guarded: bool = False) -> DataFrame:
    """``path`` (relative), ``size``, ``sha256``, ``modified``, ``content`` of the files below a folder.

    Spark's own reader lists them and skips names that begin with ``_`` or ``.``; :func:`hidden_files` adds those.
    ``guarded`` leaves out ``clean.md`` and, of a local folder, links and what lies behind them, so nothing outside the
    folder is read. A local folder that is missing is an error.
    """
    local = root.removeprefix("file://")
    if "://" not in local and not os.path.isdir(local):
        raise FileNotFoundError(f"no such folder: {root}")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.lit(local.rstrip("/") + "/"), r"([\\.^$|()\[\]{}*+?])", r"\\$1")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(F.replace("path", F.lit("+"), F.lit("%2B")), "^file:(?://)?", "")), F.concat(F.lit("^"), base), "")
    files = raw.select(
        path.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), "content",
    )
    if not guarded:
        return files
    kept = files.filter(F.lower(F.element_at(F.split("path", "/"), -1)) != "clean.md")
    links = [] if "://" in local else find_links(local)
    if not links:
        return kept
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return kept.filter(~F.arrays_overlap(prefixes, F.array(*map(F.lit, links))))


#: Links a folder may hold; they become part of the plan.
MOST_LINKS = 10_000


def find_links(root: str) -> list[str]:
    """Relative paths of the links, to files or folders, in a local folder; what lies behind a link isn't looked at."""
    found = []
    for folder, folders, names in os.walk(root):
        found += [os.path.relpath(full, root) for name in folders + names for full in [os.path.join(folder, name)] if os.path.islink(full)]
        if len(found) > MOST_LINKS:
            raise ValueError(f"more than {MOST_LINKS} links below {root}")
    return found


def hidden_files(spark: SparkSession, root: str, suffix: str = ".md", links: bool = False) -> DataFrame:
    """The files Spark's reader skips, by a listing of a local folder: a part of a path begins with ``_`` or ``.``; links
    and what lies outside the folder are left out, unless ``links`` are wanted."""
    real = os.path.realpath(root)
    found = []
    for folder, _, names in os.walk(root):
        for name in names:
            full = os.path.join(folder, name)
            relative = os.path.relpath(full, root)
            inside = links and os.path.isfile(full) or not os.path.islink(full) and os.path.realpath(full).startswith(real + os.sep)
            if name.endswith(suffix) and inside and any(p[0] in "_." for p in relative.split(os.sep)):
                found.append((relative, full))
    paths = spark.createDataFrame(found, "path string, full string")

    def read(frames):
        for frame in frames:
            yield frame.assign(content=[open(p, "rb").read() for p in frame.full], modified=[pd.Timestamp(os.path.getmtime(p), unit="s").strftime("%Y-%m-%dT%H:%M:%S") for p in frame.full])[["path", "content", "modified"]]

    rows = paths.mapInPandas(read, "path string, content binary, modified string")
    return rows.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "modified", "content")


def all_files(spark: SparkSession, root: str, guarded: bool = False) -> DataFrame:
    """:func:`markdown_files` together with :func:`hidden_files`, which only a local folder can list; one elsewhere that has
    hidden files is an error. ``guarded`` leaves out ``clean.md``."""
    files = markdown_files(spark, root, guarded=guarded)
    local = root.removeprefix("file://")
    if "://" in local:
        if found := first_hidden(spark, root):
            raise ValueError(f"hidden files can be read from a local folder only: {found}")
        return files
    hidden = hidden_files(spark, local, links=not guarded)
    return files.unionByName(hidden.filter(F.lower(F.element_at(F.split("path", "/"), -1)) != "clean.md") if guarded else hidden)


def first_hidden(spark: SparkSession, root: str, suffix: str = ".md") -> str | None:
    """A file that Spark's reader skips, if there is one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    start = len(path.toUri().getPath().rstrip("/")) + 1
    while listed.hasNext():
        relative = listed.next().getPath().toUri().getPath()[start:]
        if relative.endswith(suffix) and any(p[0] in "_." for p in relative.split("/")):
            return relative
    return None


def decode_bytes(raw: bytes) -> tuple[str, str]:
    for name in ENCODINGS:
        try:
            return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n"), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes anything")


def decoded(files: DataFrame) -> DataFrame:
    """Adds ``text``, ``encoding`` and ``read_status``. Valid UTF-8 never leaves the JVM; only other files take the way
    through Python. Line ends become line feeds."""
    as_text = F.col("content").cast("string")
    valid = F.is_valid_utf8(as_text)

    @F.pandas_udf("text string, encoding string")
    def legacy(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(bytes(c)) for c in content], columns=["text", "encoding"])

    plain = F.regexp_replace(F.regexp_replace(as_text, "^﻿", ""), "\r\n?", "\n")
    good = files.filter(valid).withColumns({"text": plain, "encoding": F.lit("utf-8-sig")})
    bad = files.filter(~valid).withColumn("_d", legacy("content")).select("*", "_d.*").drop("_d")
    status = F.when(T.looks_mojibake(F.col("text")), "ok_suspicious_mojibake").otherwise("ok")
    return good.unionByName(bad).withColumn("read_status", status).drop("content")


def utf8_text(content: Column) -> Column:
    """Bytes as text, invalid parts replaced."""
    return F.make_valid_utf8(content.cast("string"))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with header, every value text, nothing null; a missing local file is an empty table of ``columns``."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns or ["_"]]))
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    clean = rows.toDF(*(c.lstrip("﻿") for c in rows.columns)).fillna("")
    return clean if columns is None else clean.select(*(F.col(c) if c in clean.columns else F.lit("").alias(c) for c in columns))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages (url, html): the table that stands for the network."""
    return spark.read.parquet(path)


def convert_documents(files: DataFrame, convert=None) -> DataFrame:
    """``path, markdown, status`` of PDF and DOCX files by ``convert(bytes, suffix) -> str``; without one the optional
    converter library is used if it is installed, else the status says so. Of files that share a stem DOCX wins."""
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    stem = F.regexp_replace("path", r"\.[^.]+$", "")
    chosen = files.filter(suffix.isin("pdf", "docx")).groupBy(stem.alias("stem")).agg(F.min_by(F.struct("path", "content"), suffix).alias("f"))

    def run(frames):
        function = convert or _library_converter()
        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content):
                try:
                    out.append((path, function(bytes(content), path.rsplit(".", 1)[-1].lower()), "ok") if function else (path, None, "converter_missing"))
                except Exception as error:  # noqa: BLE001  (one bad file must not fail the job)
                    out.append((path, None, f"error: {type(error).__name__}"))
            yield pd.DataFrame(out, columns=["path", "markdown", "status"])

    return chosen.select("f.*").mapInPandas(run, "path string, markdown string, status string")


def _library_converter():
    try:
        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter
    except ImportError:
        return None
    import io

    converter = DocumentConverter()
    return lambda raw, suffix: converter.convert(DocumentStream(name=f"x.{suffix}", stream=io.BytesIO(raw))).document.export_to_markdown()
