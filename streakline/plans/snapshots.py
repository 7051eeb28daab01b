"""Leaderboards over time (CO-25, SK-6): snapshots from the ledger, an append-only store and as-of reads.

A snapshot holds every scored team of every event as ranked at one moment. The
rows of all snapshot moments come out of one plan: points per team and month are
added up by a running sum over a team's months, so each ledger row is read once
however many snapshots there are. The store keeps one copy of a snapshot: adding
it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import event as E
from ..operators.keys import insert_absent
from ..operators.ranking import partition_rank

COLUMNS = ["event_id", "snapshot_at", "team_id", "total_points", "scoring_events", "last_scored_at", "rank"]


def monthly_snapshots(ledger: DataFrame, identity_map: DataFrame) -> DataFrame:
    """Boards at every month's end from the first to the last month of the ledger.

    A row counts for the first snapshot after it. Teams appear from their first
    score on and keep their place in later months without scores.
    """
    r = E.resolve_team(ledger, identity_map).filter(F.col("resolved_team_id").isNotNull())
    month = F.add_months(F.trunc("created_at", "MM"), 1)
    m = r.groupBy("event_id", F.col("resolved_team_id").alias("team_id"), month.alias("month")).agg(
        F.sum("points_delta").alias("points"), F.count(F.lit(1)).alias("n"), F.max("created_at").alias("at"))
    last = m.agg(F.max("month").alias("m")).first().m
    if last is None:
        last = F.lit(None).cast("date")
    # one row a team and month: as many as the calendar has since the team's first score
    grid = m.groupBy("event_id", "team_id").agg(F.min("month").alias("first")).select(
        "event_id", "team_id", F.explode(F.sequence("first", F.lit(last), F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("event_id", "team_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    run = grid.join(m, ["event_id", "team_id", "month"], "left").select(
        "event_id", "team_id", F.col("month").cast("timestamp").alias("snapshot_at"),
        F.sum(F.coalesce("points", F.lit(0))).over(w).alias("total_points"),
        F.sum(F.coalesce("n", F.lit(0))).over(w).alias("scoring_events"), F.max("at").over(w).alias("last_scored_at"))
    return partition_rank(run, ["event_id", "snapshot_at"],
                          [F.col("total_points").desc(), F.col("last_scored_at").asc_nulls_last()]).select(*COLUMNS)


def rank_changes(snapshots: DataFrame) -> DataFrame:
    """Each team's rank against its snapshot before; ``moved`` is positive for a climb, NULL for a newcomer."""
    w = Window.partitionBy("event_id", "team_id").orderBy("snapshot_at")
    j = snapshots.withColumn("previous_rank", F.lag("rank").over(w)).withColumn(
        "gained", F.col("total_points") - F.lag("total_points", 1, 0).over(w))
    return j.select("event_id", "snapshot_at", "team_id", "rank", "previous_rank",
                    (F.col("previous_rank") - F.col("rank")).alias("moved"), "gained")


def board_as_of(snapshots: DataFrame, at) -> DataFrame:
    """Of each event the last snapshot at or before ``at`` (none: no rows)."""
    seen = snapshots.filter(F.col("snapshot_at") <= at)
    last = seen.groupBy("event_id").agg(F.max("snapshot_at").alias("snapshot_at"))
    return seen.join(last, ["event_id", "snapshot_at"], "left_semi")


class SnapshotStore:
    """Append-only snapshots under ``path``, a folder a day of ``snapshot_at``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(self.path)

    def append(self, snapshots: DataFrame) -> None:
        """Add the (event, moment) snapshots that the store does not have."""
        old = self.read()
        if old is not None:
            snapshots = insert_absent(old.select("event_id", "snapshot_at").distinct(), snapshots,
                                      ["event_id", "snapshot_at"])
        (snapshots.withColumn("snapshot_date", F.to_date("snapshot_at"))
         .write.mode("append").partitionBy("snapshot_date").parquet(self.path))

    def as_of(self, at: str) -> DataFrame:
        """Of each event the last stored snapshot at or before ``at``; later days' folders are not read."""
        moment = F.lit(at).cast("timestamp")
        stored = self.read().filter(F.col("snapshot_date") <= F.to_date(moment))
        return board_as_of(stored, moment).drop("snapshot_date")
