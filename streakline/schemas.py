"""Explicit schemas of the scoring outputs (SC-8: create-if-absent targets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, I, L, TS, D = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType(), T.DateType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


MISSION_COMPLETIONS = _schema(("user_id", S), ("mission_id", S), ("mission_name", S), ("points_awarded", I),
                              ("completed_at", TS), ("period_start", D), ("period_end", D), ("scored_at", TS))
USER_POINTS_FACT = _schema(("user_id", S), ("event_type", S), ("mission_id", S), ("points", I), ("reason", S),
                           ("event_timestamp", TS), ("scored_at", TS))
USER_PROFILE = _schema(("user_id", S), ("display_name", S), ("total_points", I), ("level", S),
                       ("current_streak", I), ("max_streak", I), ("badge_count", I), ("missions_completed", I),
                       ("first_activity_date", D), ("last_activity_date", D), ("distinct_products_used", I),
                       ("updated_at", TS))
LEADERBOARD = _schema(("user_id", S), ("display_name", S), ("total_points", I), ("weekly_points", I),
                      ("monthly_points", I), ("level", S), ("all_time_rank", I), ("weekly_rank", I),
                      ("monthly_rank", I), ("updated_at", TS))
BADGES = _schema(("user_id", S), ("badge_id", S), ("badge_name", S), ("badge_icon", S), ("earned_at", TS))
NOTIFICATIONS = _schema(("user_id", S), ("notification_type", S), ("title", S), ("message", S),
                        ("mission_id", S), ("points", I), ("created_at", TS))

OUTPUTS = {
    "mission_completions": MISSION_COMPLETIONS,
    "user_points_fact": USER_POINTS_FACT,
    "user_profile_snapshot": USER_PROFILE,
    "leaderboard": LEADERBOARD,
    "badges": BADGES,
    "notifications": NOTIFICATIONS,
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], OUTPUTS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast ``df`` to the output's declared schema (by name)."""
    schema = OUTPUTS[name]
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
