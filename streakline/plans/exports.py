"""Sinks: versioned snapshots of the scoring outputs, fact snapshots by day, CSV rows (SK-1, SK-4, SK-6).

Nothing passes through the driver: every export is a DataFrame written by the
executors. The JSON and Markdown reports are in ``report.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import event as E
from ..versions import VersionedTables


def publish(store: VersionedTables, sources: dict[str, str], columns: dict[str, list[str]]) -> tuple[int, list[str]]:
    """SK-1: replace the store's tables by ``sources`` (name → parquet path), with the named columns in order.

    A source that is not there is skipped and its table stays as the last
    version has it. All tables change together: readers see the old version until
    every table is written. Returns the new version and the skipped names.
    """
    spark, frames, skipped = store.spark, {}, []
    for name, path in sources.items():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            frames[name] = spark.read.parquet(path).select(*columns[name])
        else:
            skipped.append(name)
    for name in columns:
        if name not in frames and (old := store.read(name)) is not None:
            frames[name] = old
    return store.commit(frames), skipped


def append_facts(df: DataFrame, path: str, snapshot_ts: str) -> None:
    """SK-6: a fact snapshot stamped ``snapshot_at``, partitioned by day; written again, it replaces its day."""
    at = F.to_timestamp(F.lit(snapshot_ts))
    (df.withColumn("snapshot_at", at).withColumn("snapshot_date", F.to_date(at))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path))


def report_csv_rows(g) -> DataFrame:
    """SK-4: leaderboard ⟕ completion matrix ⟕ hints used, spreadsheet-safe text cells."""
    board = g.leaderboard.select("event_id", "team_id", "rank", "total_points")
    matrix = g.completion_matrix().select("event_id", "team_id", "team_name", "completed_count", "completion_pct")
    hints = E.hint_usage(g.ledger, g.teams, g.tasks).groupBy("event_id", "team_id").agg(
        F.count(F.lit(1)).alias("hints_used"))
    j = matrix.join(board, ["event_id", "team_id"], "left").join(hints, ["event_id", "team_id"], "left")
    return j.select("event_id", "team_id", "rank", X.csv_safe("team_name").alias("team"),
                    F.coalesce(F.col("total_points"), F.lit(0)).cast("long").alias("total_points"),
                    "completed_count", "completion_pct",
                    F.coalesce(F.col("hints_used"), F.lit(0)).cast("long").alias("hints_used"))
