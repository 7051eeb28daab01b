"""Gaps-and-islands activity streaks (WI-2, WI-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def streaks(user_days: DataFrame) -> DataFrame:
    """``(user_id, activity_date)`` → ``(user_id, max_streak, current_streak)``.

    An island is a run of consecutive dates; ``date - row_number`` is constant
    inside one. ``current_streak`` is the length of the user's latest island,
    however long ago it ended (the reference's semantics).

    The window is partitioned by user over one row per user-day, so a task
    holds at most one user's distinct active days (bounded by the look-back),
    never a user's raw events. The two reductions are one aggregation each.
    """
    d = user_days.select("user_id", "activity_date").distinct()
    w = Window.partitionBy("user_id").orderBy("activity_date")
    g = d.withColumn("grp", F.date_sub("activity_date", F.row_number().over(w).cast("int")))
    islands = g.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("len"),
                                              F.max("activity_date").alias("end"))
    return islands.groupBy("user_id").agg(
        F.max("len").cast("int").alias("max_streak"),
        F.max_by("len", "end").cast("int").alias("current_streak"),
    )
