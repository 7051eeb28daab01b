"""Written intermediate tables of one run, in the session's shared checkpoint folder.

A written table cuts lineage (a lost executor re-reads files instead of
repeating the job) and keeps column pruning and file statistics for its
readers. Every run writes under a folder of its own.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from streakline.session import shared_path


class Scratch:
    """Names the tables of one run: ``keep(df, name)`` writes and rereads."""

    def __init__(self, spark: SparkSession, op: str):
        self.spark = spark
        self.path = shared_path(spark, "streakline-llm", f"{op}-{uuid.uuid4().hex}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again: all that was made from it must be written."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="streakline-zip-")) / "streakline_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def give_back() -> None:
    """Return memory that nothing uses to the system: Python workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(rows: Callable) -> Callable:
    """``rows``, with its memory given back when a task ends."""
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()
    return run


def map_arrow(df: DataFrame, rows: Callable, schema) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever they run, and keep no memory between tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(lean(rows), schema)
