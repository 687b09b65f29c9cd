"""Incremental indexing: new files of a folder or new rows of a table, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions import text as T

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*.md", per_batch: int = 1000) -> DataFrame:
    """Profiles of files as they arrive: path, size, hash, words and lines."""
    raw = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)
    )
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        "path", F.col("modificationTime").alias("seen_at"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"),
        T.word_count(text).alias("word_count"), T.line_count(text).alias("line_count"),
    )


def distinct_contents(profiles: DataFrame, late: str = "7 days") -> DataFrame:
    """The first file of every content; the watermark bounds the state that is kept for later copies."""
    return profiles.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["sha256"])


def words_per_window(profiles: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Files and words that arrived per window."""
    return (
        profiles.withWatermark("seen_at", late).groupBy(F.window("seen_at", window))
        .agg(F.count("*").alias("files"), F.sum("word_count").alias("words"))
        .select(F.col("window.start").alias("start"), "files", "words")
    )


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, as far as there is input; the checkpoint makes it exactly once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
