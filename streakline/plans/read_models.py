"""Small read models of the event game and the pivots of its exports (TK-5, WI-9, JO-14, FI-14, SK-4, CO-26)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import event as E

ANNOUNCEMENTS = 20
TOP_MISSIONS = 8
NOW = "2001-12-31 12:00:00"        # the stand-in's clock for ages
MAX_PIVOT = 10_000                 # most columns that an export may get


def time_ago(at, now: Column) -> Column:
    """Age of a moment in rounded seconds, minutes, hours or days; none for null."""
    def half_up(x: Column) -> Column:
        return F.floor(x + 0.5).cast("long")

    at = F.col(at) if isinstance(at, str) else at
    secs = F.greatest(F.lit(0), half_up(now.cast("double") - at.cast("double")))
    mins = half_up(secs / 60)
    hours = half_up(mins / 60)
    age = (F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago")))
           .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
           .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
           .otherwise(F.concat(half_up(hours / 24).cast("string"), F.lit("d ago"))))
    return F.when(at.isNull(), F.lit("")).otherwise(age)


def host_teams(g) -> DataFrame:
    """WI-9: teams with members, score and rank; ranked ones first, then the higher score, then the id."""
    members = g.participants.groupBy("event_id", "team_id").agg(F.count(F.lit(1)).alias("members"))
    board = g.leaderboard.select("event_id", "team_id", "total_points", "rank")
    j = g.teams.select("event_id", "team_id", "display_name").join(members, ["event_id", "team_id"], "left").join(
        board, ["event_id", "team_id"], "left")
    j = j.select("event_id", "team_id", "display_name", F.coalesce("members", F.lit(0)).alias("members"),
                 F.coalesce("total_points", F.lit(0)).cast("long").alias("score"), "rank")
    w = Window.partitionBy("event_id").orderBy(F.col("rank").isNull(), F.coalesce("rank", F.lit(0)),
                                               F.col("score").desc(), "team_id")
    return j.withColumn("position", F.row_number().over(w).cast("long"))


def visible_events(competitions: DataFrame, versions: DataFrame, packs: DataFrame) -> DataFrame:
    """JO-14: visible events, with their pack's title where the version and its pack are known."""
    j = competitions.filter(F.col("status").isin(*E.VISIBLE_STATES)).join(versions, "pack_version_id", "left").join(
        packs, "pack_id", "left")
    return j.select("event_id", "slug", "title", "status", "pack_title")


def enabled_validators(validators: DataFrame, order: str) -> DataFrame:
    """FI-14: enabled validators, numbered within their task in authoring order."""
    w = Window.partitionBy("task_id").orderBy(order)
    return validators.filter(F.coalesce("enabled", F.lit(False))).withColumn("position", F.row_number().over(w).cast("long"))


def badges_by_time(badges: DataFrame) -> DataFrame:
    """TK-11: badges of each user, the latest first (a user has at most one of each)."""
    w = Window.partitionBy("user_id").orderBy(F.col("earned_at").desc(), "badge_id")
    return badges.select("user_id", "badge_id", "earned_at", F.row_number().over(w).cast("long").alias("position"))


def catalog_columns(catalog: DataFrame, name: str) -> list[str]:
    """Column names of a pivot: the distinct values of the catalog, in order; refused beyond ``MAX_PIVOT``."""
    found = [r[0] for r in catalog.select(name).filter(F.col(name).isNotNull()).distinct().orderBy(name)
             .limit(MAX_PIVOT + 1).collect()]
    if len(found) > MAX_PIVOT:
        raise ValueError(f"more than {MAX_PIVOT} values of {name}: too many columns for one table")
    return found


def team_export(g, by: str = "task") -> DataFrame:
    """SK-4: ranked teams with points, completion and hints, and a column a task (0/1) or a quest (tasks done)."""
    catalog = g.tasks.join(g.quests.select("quest_id", "quest_slug"), "quest_id", "left")
    name = {"task": "task_title", "quest": "quest_slug"}[by]
    columns = catalog_columns(catalog, name)
    done = g.pairs.join(catalog.select("task_id", name), "task_id")
    wide = done.groupBy("event_id", "team_id").pivot(name, columns).agg(F.count(F.lit(1)))
    totals = g.pairs.groupBy("event_id", "team_id").agg(F.count(F.lit(1)).alias("tasks_completed"))
    sizes = g.tasks.groupBy("pack_version_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    hints = E.hint_usage(g.ledger, g.teams, g.tasks).groupBy("event_id", "team_id").agg(F.count(F.lit(1)).alias("hints_used"))
    keys = ["event_id", "team_id"]
    j = (g.leaderboard.select("event_id", "team_id", "rank", "total_points")
         .join(E.team_names(g.teams).select("team_id", "team_name"), "team_id")
         .join(g.competitions.select("event_id", "pack_version_id"), "event_id").join(sizes, "pack_version_id", "left")
         .join(totals, keys, "left").join(hints, keys, "left").join(wide, keys, "left"))
    return j.select(*keys, "rank", X.csv_safe("team_name").alias("team"), "total_points",
                    F.coalesce("tasks_completed", F.lit(0)).alias("tasks_completed"),
                    F.coalesce("total_tasks", F.lit(0)).alias("total_tasks"),
                    F.coalesce("hints_used", F.lit(0)).alias("hints_used"),
                    *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns])


def capability_heatmap(g) -> DataFrame:
    """CO-26: for every user that tried a task the number of tasks passed, a column a quest."""
    catalog = g.tasks.join(g.quests.select("quest_id", "quest_slug"), "quest_id")
    columns = catalog_columns(catalog, "quest_slug")
    # tasks not passed count nothing: they are one row a user, so that groups are few beside the attempts
    done = F.col("status") == "passed"
    tried = g.attempts.join(catalog.select("task_id", "quest_slug"), "task_id").select(
        "event_id", "user_id", F.when(done, F.col("task_id")).alias("task_id"),
        F.when(done, F.col("quest_slug")).alias("quest_slug")).distinct()
    wide = tried.groupBy("event_id", "user_id").pivot("quest_slug", columns).agg(F.count("task_id"))
    return wide.select("event_id", "user_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in columns])


def write_team_export(g, path: str) -> dict[str, str]:
    """SK-4: CSV files of the team export (a column a task) and of the participant roster, a folder an event."""
    out = {"teams": f"{path}/teams", "roster": f"{path}/roster"}
    team_export(g).write.mode("overwrite").option("header", True).partitionBy("event_id").csv(out["teams"])
    roster = g.roster().select("event_id", *[X.csv_safe(c).alias(c) for c in ["user_id", "display_name", "role", "team_name"]],
                               "tasks_passed", "attempts_total")
    roster.write.mode("overwrite").option("header", True).partitionBy("event_id").csv(out["roster"])
    return out
