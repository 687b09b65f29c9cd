"""Quality checks and summaries, each from one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checks(index: DataFrame, orphans: int, expected: int = 1059) -> DataFrame:
    """``check_name, status, detail`` for an index (doc_id, read_status, word_count, source_root, doc_type)."""
    n = F.count("*")
    facts = index.agg(
        n.alias("n"), F.count_if(~F.col("read_status").isin("ok", "replacement")).alias("bad"),
        F.count_if(F.col("read_status").contains("suspicious")).alias("suspicious"), F.count_if(F.col("word_count") == 0).alias("empty"),
        (n - F.count_distinct("doc_id")).alias("dup"),
        (F.count_if(F.col("source_root") == "unknown") / F.greatest(n, F.lit(1))).alias("source_rate"),
        (F.count_if(F.col("doc_type") == "unknown") / F.greatest(n, F.lit(1))).alias("type_rate"),
    )

    def row(name: str, ok, bad: str, *detail):
        return F.struct(F.lit(name).alias("check_name"), F.when(ok, "pass").otherwise(bad).alias("status"), F.concat(*(F.lit(d) if isinstance(d, str) else d for d in detail)).alias("detail"))

    def whole(c: str):
        return F.col(c).cast("string")

    rows = (
        row("document_count", F.col("n") == expected, "warn", "actual=", whole("n"), f"; expected={expected}"),
        row("read_status", F.col("bad") == 0, "warn", "bad_or_suspicious_read_count=", whole("bad")),
        row("suspicious_encoding", F.col("suspicious") == 0, "warn", "suspicious_read_count=", whole("suspicious")),
        row("empty_documents", F.col("empty") == 0, "warn", "empty_document_count=", whole("empty")),
        row("unique_doc_ids", F.col("dup") == 0, "fail", "duplicate_doc_id_count=", whole("dup")),
        row("segment_document_links", F.lit(orphans == 0), "fail", f"orphan_segment_count={orphans}"),
        row("deduplication", F.lit(True), "fail", "deduplication_performed=false; current corpus is treated as source of truth"),
        row("unknown_source_rate", F.col("source_rate") <= 0.2, "warn", "rate=", F.format_string("%.4f", F.col("source_rate"))),
        row("unknown_doc_type_rate", F.col("type_rate") <= 0.2, "warn", "rate=", F.format_string("%.4f", F.col("type_rate"))),
    )
    return facts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def output_checks(spark, paths: dict[str, str], code_modified: float = 0.0) -> DataFrame:
    """``check_name, status, detail`` of written tables: a missing one fails, an empty one or one older than the code warns."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name, place in paths.items():
        path = jvm.org.apache.hadoop.fs.Path(place)
        there = path.getFileSystem(conf).exists(path)
        out.append((f"output_exists:{name}", "pass" if there else "fail", place))
        if there:
            stale = path.getFileSystem(conf).getFileStatus(path).getModificationTime() < 1000 * code_modified
            out.append((f"output_fresh:{name}", "warn" if stale else "pass", f"stale={stale}"))
            n = spark.read.parquet(place).count()
            out.append((f"rows:{name}", "pass" if n else "warn", f"record_count={n}"))
    return spark.createDataFrame(out, "check_name string, status string, detail string")


def optional_dependencies(names: tuple[str, ...] = ("docling", "tiktoken", "spacy", "nltk", "matplotlib")) -> list[tuple[str, str, str]]:
    """Which optional libraries the driver finds, as check rows."""
    from importlib.util import find_spec

    return [(f"optional_dependency:{n}", "info", "available" if find_spec(n) else "unavailable") for n in names]


def summary(docs: DataFrame) -> DataFrame:
    """``documents, total_words, median_words`` for (word_count); the median is exact."""
    return docs.agg(F.count("*").alias("documents"), F.sum("word_count").alias("total_words"), F.median("word_count").alias("median_words"))


def token_budget(docs: DataFrame, limit: int = 32_000, tokenizer: str | None = None) -> DataFrame:
    """``characters, files, tokens, exceeds``: tokens are estimated on the total, or with a vocabulary file counted exactly
    per file and added up; no files give no row. Tokens that would span two files, were they run together, aren't looked
    for: one text of all files has no place on a cluster."""
    from docloom.functions.text import estimated_tokens
    from docloom.functions.tokenizer import token_count

    if tokenizer is not None:
        counted = docs.select(F.length("text").cast("long").alias("n"), token_count(tokenizer)("text").alias("t"))
        return counted.agg(F.sum("n").alias("characters"), F.count("*").alias("files"), F.sum("t").alias("tokens")).filter("files > 0").withColumn(
            "exceeds", F.col("tokens") > limit
        )
    return docs.agg(F.sum(F.length("text").cast("long")).alias("characters"), F.count("*").alias("files")).filter("files > 0").select(
        "characters", "files", estimated_tokens(F.col("characters")).alias("tokens"), (estimated_tokens(F.col("characters")) > limit).alias("exceeds")
    )
