"""Writers: tables as Parquet, small tables as one CSV file, reports and manifests as text."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.index import output_names
from docloom.shared import cut, write_bytes


def write_table(df: DataFrame, folder: str, name: str) -> str:
    path = f"{folder.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """CSV with header, of the named columns only. ``single`` puts a small table into one file part."""
    out = df.select(*columns) if columns else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def dictionary_hash(groups: dict[str, list[str]]) -> str:
    return hashlib.sha256(json.dumps(groups, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def code_hashes() -> dict[str, str]:
    """SHA-256 of each module of this package, by its path: with what a run was made."""
    root = Path(__file__).resolve().parents[1]
    return {str(p.relative_to(root.parent)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}


def code_modified() -> float:
    """When the newest module of this package was changed, in seconds."""
    return max(p.stat().st_mtime for p in Path(__file__).resolve().parents[1].rglob("*.py"))


def manifest_json(parameters: dict, groups: dict[str, list[str]], counts: dict[str, int], diagnostics: dict | None = None, dependencies: dict | None = None) -> str:
    return json.dumps(
        {"parameters": parameters, "dictionary_sha256": dictionary_hash(groups), "dictionary_sizes": {g: len(t) for g, t in groups.items()},
         "counts": counts, "deduplication_performed": False, "code_sha256": code_hashes(), "diagnostics": diagnostics or {},
         "optional_dependencies": dependencies or {}},
        ensure_ascii=False, indent=2, sort_keys=True,
    )


def top_counts(df: DataFrame, column: str, limit: int = 12) -> str:
    """The most frequent values as one line of text."""
    rows = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit).collect()
    return ", ".join(f"`{r[0]}`: {r.n}" for r in rows) or "none"


def corpus_report(index: DataFrame, segments: DataFrame, features: DataFrame, tokens: DataFrame, checks: DataFrame, candidates: int) -> str:
    size = index.agg(F.count("*"), F.sum("word_count"), F.median("word_count")).first()
    words = ", ".join(f"{r.token} ({r['count']})" for r in tokens.orderBy(F.desc("count"), "token").limit(20).collect())
    lines = [
        "# Corpus report", "", f"- documents: {size[0]}", f"- segments: {segments.count()}", f"- words: {size[1] or 0}, median {size[2] or 0}",
        f"- candidates: {candidates}", "", "## Distribution", "",
        *(f"- {c}: {top_counts(index, c)}" for c in ("source_root", "dataset_layer", "doc_type", "date_parse_status")),
        f"- co-occurrence: {top_counts(features, 'cooccurrence_class')}", f"- checks: {top_counts(checks, 'status')}", "", "## Frequent tokens", "", words or "none", "",
    ]
    return "\n".join(lines)


def duplicate_report(records: DataFrame, header: dict[str, object], limit: int | None = None) -> str:
    """Header and one block per record, in the order of paths; ``limit`` bounds what the driver is sent."""
    ordered = records.orderBy(F.lower("deleted_file"), "deleted_file")
    rows = (ordered.limit(limit) if limit else ordered).collect()
    out = ["# Duplicate report", "", *(f"- {k}: {v}" for k, v in header.items()), ""]
    for i, r in enumerate(rows, 1):
        out += [f"## {i}. {r.deleted_file}", "", f"- kept: {r.original_file}", f"- bytes: {r.size}", f"- similarity: {100 * r.similarity:.2f} %", f"- method: {r.method}",
                f"- first line: {r.deleted_first_line}", f"- first line kept: {r.original_first_line}", ""]
    return "\n".join(out if rows else [*out, "No duplicates."]) + "\n"


def write_text(text: str, path: str) -> None:
    """Write a text through Hadoop's file system, so that a report lies where the tables lie."""
    write_bytes(SparkSession.getActiveSession(), path, text.encode("utf-8"))


def write_pages(pages: DataFrame, folder: str, day: str) -> DataFrame:
    """Write each page (page_id, slug, markdown) as a file of its own below a folder that all executors mount; the result is
    ``page_id, file_name``. Names are those of :func:`docloom.operators.index.output_names`, numbered where they recur; a page
    written again, as after a lost executor, replaces itself. Null texts are written as empty files."""
    return write_named(pages.select("page_id", "markdown").join(output_names(pages.select("page_id", "slug"), day), "page_id"), folder)


def write_named(named: DataFrame, folder: str) -> DataFrame:
    """Write rows (page_id, file_name, markdown) as files; see :func:`write_pages`."""
    local = folder.removeprefix("file://")
    if "://" in local:
        raise ValueError(f"pages are written to a mounted folder: {folder}")

    def write(frames):
        os.makedirs(local, exist_ok=True)
        for frame in frames:
            for name, text in zip(frame.file_name, frame.markdown):
                part = os.path.join(local, f".{name}.{uuid.uuid4().hex}")
                with open(part, "w", encoding="utf-8", newline="") as out:
                    out.write(text or "")
                os.replace(part, os.path.join(local, name))
            yield frame[["page_id", "file_name"]]

    kind = dict(named.dtypes)["page_id"]
    return cut(named.select("page_id", "file_name", "markdown").mapInPandas(write, f"page_id {kind}, file_name string"), "pages")
