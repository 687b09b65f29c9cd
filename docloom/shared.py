"""Helpers that keep plans safe on a cluster: cutting lineage into shared storage, guarded broadcasts."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with a few fixed-width columns may be broadcast (about 64 MB as a hash relation).
BROADCAST_ROWS = 500_000

_local_dir: str | None = None
_written: list[str] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local master does without it and gets a temporary
    one; on a cluster a missing setting is an error, as no machine's own folder is seen by the others."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
    if _local_dir is None:
        keep = tempfile.TemporaryDirectory(prefix="docloom-")
        atexit.register(keep.cleanup)
        _local_dir = keep.name
    return _local_dir


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a file through Hadoop, where the tables go too: a local folder, HDFS or an object store."""
    system, place = file_system(spark, path)
    out = system.create(place, True)
    try:
        for at in range(0, len(content), 1 << 20):
            out.write(content[at : at + (1 << 20)])
    finally:
        out.close()


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later readers neither recompute it nor lose it with
    an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables :func:`cut` has written that aren't released: a mark for :func:`release`."""
    return len(_written)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that :func:`cut` has written since a mark; results that still read them must be stored before."""
    n = 0
    while len(_written) > since:
        system, place = file_system(spark, _written.pop())
        n += bool(system.delete(place, True))
    return n


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over all cores where it has far fewer splits than there are cores, as a small file has; a scan of
    many splits stays as it is and is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ship(spark: SparkSession) -> None:
    """Let the workers import this package where they can't yet: if its folder isn't on ``PYTHONPATH``, a zip of it in the
    shared folder, whatever its scheme, is added to the application, once."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _shipped:
        return
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for source in sorted((root / "docloom").rglob("*.py")):
            z.write(source, source.relative_to(root))
    target = f"{shared_dir(spark)}/docloom-{context.applicationId}.zip"
    write_bytes(spark, target, content.getvalue())
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def exploded(df: DataFrame, keep: list[str], array: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """``keep`` and a row per element of an array, with its place as ``pos``; null elements are dropped.

    The explode is an outer one: before a plain one the optimizer filters on the array's size and computes the array
    again for it, which costs several times the explode where the array comes from a pattern.
    """
    values = F.explode_outer(array).alias(name) if pos is None else F.posexplode_outer(array).alias(pos, name)
    return df.select(*keep, values).filter(F.col(name).isNotNull())


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a cut table for broadcast if its counted rows are few; else leave the shuffle join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df
