"""Further read models over the run and the event game.

Workspace health, quest progress and capability heatmap, quest-level and
frozen leaderboards, first-blood bonuses, level cohorts, admin statistics,
lifetime consumption milestones, declared badges, latest notifications, the
scoring feed, follow-up recommendations and team namespaces. Each is a
DataFrame function; the registered queries live in ``queries_extra``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import exprs as X
from ..operators import detect as D
from ..operators import event as E
from ..operators.ranking import partition_rank, top_k_per_group

# Fixed values
FIRST_BLOOD_BONUS = 50            # declared scoring field: first team to solve a task
FEED_SIZE = 20
NOTIFICATION_PAGE = 20
COHORT_TOP = 3
WEAK_TEAM_PCT = 50.0


def workspace_health(g) -> DataFrame:
    """AG-14: per (event, workspace): ledger rows and points, validations and passes.

    As in the original, the validation counts are per workspace across events.
    """
    ws = g.participants.filter(F.col("workspace_id").isNotNull()).select("event_id", "workspace_id").distinct()
    sc = (g.ledger.filter(F.col("workspace_id").isNotNull()).groupBy("event_id", "workspace_id")
          .agg(F.count(F.lit(1)).alias("scoring_events"), F.sum("points_delta").alias("points")))
    vc = (g.played.filter(F.col("workspace_id").isNotNull()).groupBy("workspace_id")
          .agg(F.sum("validations").alias("validations"), F.sum("validation_passes").alias("validation_passes")))
    j = ws.join(sc, ["event_id", "workspace_id"], "left").join(vc, "workspace_id", "left")
    cols = ["scoring_events", "points", "validations", "validation_passes"]
    return j.select("event_id", "workspace_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])


def quest_progress(g) -> DataFrame:
    """AG-23 / CO-26: per (event, team, quest) completed tasks, quest size, pct, complete flag."""
    k = g.tasks.select("task_id", "quest_id", "pack_version_id")
    sizes = k.groupBy("pack_version_id", "quest_id").agg(F.count(F.lit(1)).alias("task_count"))
    done = (g.pairs.join(k, "task_id").groupBy("event_id", "team_id", "pack_version_id", "quest_id")
            .agg(F.count(F.lit(1)).alias("completed")))
    j = done.join(sizes, ["pack_version_id", "quest_id"])
    pct = F.bround(F.lit(100.0) * F.col("completed") / F.col("task_count"), 1)
    return j.select("event_id", "team_id", "quest_id", "task_count", "completed", pct.alias("completion_pct"),
                    ((F.col("task_count") > 0) & (F.col("completed") == F.col("task_count"))).alias("complete"))


def quest_leaderboard(g) -> DataFrame:
    """CO-25: team ranks within each quest of each event."""
    r = E.resolve_team(g.ledger, g.identity_map).filter(F.col("resolved_team_id").isNotNull())
    j = r.join(g.tasks.select("task_id", "quest_id"), "task_id")
    s = j.groupBy("event_id", "quest_id", F.col("resolved_team_id").alias("team_id")).agg(
        F.sum("points_delta").alias("total_points"), F.max("created_at").alias("last_scored_at"))
    return partition_rank(s, ["event_id", "quest_id"],
                          [F.col("total_points").desc(), F.col("last_scored_at").asc_nulls_last()], "rank")


def frozen_leaderboard(g) -> DataFrame:
    """CO-25: the leaderboard as of each event's freeze moment; manual adjustments always count.

    An event without a freeze stamp is not cut.
    """
    cut = g.competitions.select("event_id", F.col("scoring_frozen_at").alias("_cut"))
    led = g.ledger.join(cut, "event_id").filter(
        F.col("_cut").isNull() | (F.col("created_at") <= F.col("_cut"))
        | (F.col("source_type") == "manual_adjustment")).drop("_cut")
    return E.event_leaderboard(E.team_scores(led, g.identity_map), g.teams)


def first_blood_bonus(g) -> DataFrame:
    """CO-23: bonus candidates for each task's first solver, keyed like any award."""
    fs = g.first_solves()
    return fs.select("event_id", X.base_points_key("event_id", "task_id", "team_id", F.lit(None).cast("string"),
                                                   "first_blood").alias("idempotency_key"),
                     "team_id", "task_id", F.lit(FIRST_BLOOD_BONUS).alias("points_delta"), "created_at")


def level_cohorts(board: DataFrame) -> DataFrame:
    """AG-21: per level: members, total, rounded average, top three users."""
    top = top_k_per_group(board, ["level"], [F.col("total_points").desc(), F.col("user_id").asc()], COHORT_TOP)
    names = top.groupBy("level").agg(F.array_sort(F.collect_list(F.struct("rn", "user_id"))).alias("_t")) \
        .select("level", F.array_join(F.transform("_t", lambda x: x["user_id"]), ",").alias("top_users"))
    agg = board.groupBy("level").agg(F.count(F.lit(1)).alias("members"),
                                     F.sum("total_points").alias("total_points"))
    return agg.join(names, "level").select(
        "level", "members", F.col("total_points").cast("long").alias("total_points"),
        F.floor(F.col("total_points") / F.col("members") + 0.5).cast("long").alias("avg_points"), "top_users")


def admin_stats(completions: DataFrame, profile: DataFrame) -> DataFrame:
    """AG-18 / AG-20 / TK-10: metric rows (metric, key, value)."""
    users = profile.agg(F.countDistinct("user_id").cast("double").alias("value")).select(
        F.lit("users").alias("metric"), F.lit(None).cast("string").alias("key"), "value")
    comps = completions.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("completions").alias("metric"), F.lit(None).cast("string").alias("key"), "value")
    by_mission = completions.groupBy(F.col("mission_id").alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("by_mission").alias("metric"), "key", "value")
    by_level = profile.groupBy(F.col("level").alias("key")).agg(
        F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("by_level").alias("metric"), "key", "value")
    non_bronze = profile.agg(F.count_if(F.col("level") != "Bronze").cast("double").alias("value")).select(
        F.lit("non_bronze").alias("metric"), F.lit(None).cast("string").alias("key"), "value")
    avg = (profile.agg(F.sum("missions_completed").alias("c"), F.count(F.lit(1)).alias("u"))
           .select(F.lit("avg_completions").alias("metric"), F.lit(None).cast("string").alias("key"),
                   F.when(F.col("u") > 0, F.round(F.col("c") / F.col("u"), 1)).otherwise(0.0).alias("value")))
    return users.unionByName(comps).unionByName(by_mission).unionByName(by_level).unionByName(non_bronze) \
        .unionByName(avg)


def usage_days(usage: DataFrame) -> DataFrame:
    """(user_id, usage_date, qty): positive consumption per user and day, of the whole log."""
    u = usage.select(F.col("identity_metadata.run_as").alias("user_id"), "usage_date", "usage_quantity")
    return (u.filter(D.nonblank("user_id") & (F.col("usage_quantity") > 0)).groupBy("user_id", "usage_date")
            .agg(F.sum(F.col("usage_quantity").cast("decimal(18,2)")).cast("decimal(28,2)").alias("qty")))


def lifetime_advance(totals: DataFrame | None, days: DataFrame, run_ts: str,
                     thresholds: R.Thresholds | None = None) -> tuple[DataFrame, DataFrame]:
    """MI-39: (milestones crossed, new totals) after the days that ``totals`` do not hold yet.

    ``totals`` (user_id, total, through): each user's consumption up to and with
    day ``through``, as a run before left it; None on the first run. Only later
    days of a user count, so a run adds each day once; a running sum over them,
    carried on from the stored total, passes each threshold on one day.
    """
    th = thresholds or R.Thresholds()
    if totals is None:
        totals = days.sparkSession.createDataFrame([], "user_id string, total decimal(38,2), through date")
    new = days.join(totals, "user_id", "left").filter(
        F.col("through").isNull() | (F.col("usage_date") > F.col("through")))
    # one row a user and new day: bounded by the days since the last run
    w = Window.partitionBy("user_id").orderBy("usage_date").rowsBetween(Window.unboundedPreceding, 0)
    run = new.select("user_id", "usage_date", "qty",
                     (F.coalesce("total", F.lit(0)) + F.sum("qty").over(w)).alias("reached"))
    rules = F.array(*[F.struct(F.lit(m).alias("mission_id"), F.lit(n).alias("mission_name"),
                               F.lit(th.lifetime[m]).cast("decimal(28,2)").alias("at"), F.lit(p).alias("points"))
                      for m, n, _, p in R.LIFETIME_MILESTONES])
    hit = run.select("user_id", "usage_date", F.explode(F.filter(
        rules, lambda x: (x["at"] <= F.col("reached")) & (x["at"] > F.col("reached") - F.col("qty")))).alias("m"))
    crossed = hit.select(
        "user_id", "m.mission_id", "m.mission_name", F.col("m.points").cast("int").alias("points_awarded"),
        F.col("usage_date").cast("timestamp").alias("completed_at"), F.col("usage_date").alias("period_start"),
        F.col("usage_date").alias("period_end"), D.run_ts_col(run_ts).alias("scored_at"))
    added = new.groupBy("user_id").agg(F.sum("qty").alias("total"), F.max("usage_date").alias("through"))
    after = totals.select("user_id", "total", "through").unionByName(added).groupBy("user_id").agg(
        F.sum("total").cast("decimal(38,2)").alias("total"), F.max("through").alias("through"))
    return crossed, after


def lifetime_run(store, usage: DataFrame, run_ts: str, thresholds: R.Thresholds | None = None) -> DataFrame:
    """One scheduled run: stored totals and milestones move on together, as one version of ``store``."""
    crossed, totals = lifetime_advance(store.read("totals"), usage_days(usage), run_ts, thresholds)
    before = store.read("milestones")
    store.commit({"totals": totals, "milestones": crossed if before is None else before.unionByName(crossed)})
    return store.read("milestones")


def latest_notifications(notes: DataFrame, k: int = NOTIFICATION_PAGE) -> DataFrame:
    """TK-2: each user's latest k notifications."""
    return top_k_per_group(notes, ["user_id"], [F.col("created_at").desc(), F.col("notification_type").asc(),
                                                F.col("mission_id").asc(), F.col("title").asc()], k, "position")


def recent_feed(g, k: int = FEED_SIZE) -> DataFrame:
    """TK-3 / JO-9: latest k ledger rows per event with team name and task title."""
    t = g.teams.select("team_id", F.col("display_name").alias("team_name"))
    tk = g.tasks.select("task_id", "task_title")
    f = g.ledger.join(t, "team_id", "left").join(tk, "task_id", "left").select(
        "event_id", "idempotency_key", "team_id", "team_name", "task_id", "task_title", "points_delta",
        "source_type", "created_at")
    return top_k_per_group(f, ["event_id"], [F.col("created_at").desc(), F.col("idempotency_key").asc()], k,
                           "position")


def follow_ups(g) -> DataFrame:
    """CO-19: recommended follow-ups per event as (event_id, rule, line) rows."""
    blocks = E.worst_blockers(g.blockers(), 1)
    n_teams = g.teams.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    worst = (blocks.join(n_teams, "event_id").filter(F.col("solved_teams") < F.greatest(F.col("n"), F.lit(1)))
             .select("event_id", F.lit("worst_blocker").alias("rule"),
                     F.format_string("Reinforce '%s' (%s): %d of %d teams completed it.", "task_title",
                                     "quest_title", "solved_teams", "total_teams").alias("line")))
    hints = (E.hint_usage(g.ledger, g.teams, g.tasks).groupBy("event_id")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("penalty").alias("total")).filter(F.col("total") < 0)
             .select("event_id", F.lit("hints").alias("rule"),
                     F.format_string("Hints were revealed %d times for %d points.", "n", "total").alias("line")))
    # One line per lower-completion team (not one joined line per event): the
    # number of teams in an event is not bounded, so names are not gathered.
    weak = (g.completion_matrix().filter(F.col("completion_pct") < WEAK_TEAM_PCT)
            .select("event_id", F.lit("weak_team").alias("rule"),
                    F.format_string("Follow up with lower-completion team %s (%.1f%%).", "team_name",
                                    "completion_pct").alias("line")))
    champs = E.champions(g.leaderboard, 3)
    champ = (champs.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("position", "display_name")))
                                            .alias("_c"))
             .select("event_id", F.lit("champions").alias("rule"),
                     F.concat(F.lit("Recognise top performers: "),
                              F.array_join(F.transform("_c", lambda x: x["display_name"]), ", "), F.lit("."))
                     .alias("line")))
    concerns = worst.select("event_id").unionByName(hints.select("event_id")).unionByName(weak.select("event_id")) \
        .distinct()
    calm = (g.competitions.select("event_id").join(concerns, "event_id", "left_anti")
            .select("event_id", F.lit("no_blockers").alias("rule"),
                    F.lit("No blockers detected: try a harder pack next time.").alias("line")))
    return worst.unionByName(hints).unionByName(weak).unionByName(champ).unionByName(calm)


def team_namespaces(g) -> DataFrame:
    """PR-17: default catalog / schema for each team: quest_<event slug>, team_<team name>."""
    c = g.competitions.select("event_id", "slug")
    return g.teams.join(c, "event_id").select(
        "event_id", "team_id", F.concat(F.lit("quest_"), X.sanitize_identifier("slug")).alias("team_catalog"),
        F.concat(F.lit("team_"), X.sanitize_identifier("name")).alias("team_schema"))


def team_members(g) -> DataFrame:
    """AG-29 / JO-10: teams with member counts (0 when empty)."""
    m = g.participants.groupBy("event_id", "team_id").agg(F.count(F.lit(1)).alias("members"))
    return g.teams.join(m, ["event_id", "team_id"], "left").select(
        "event_id", "team_id", "display_name", F.coalesce("members", F.lit(0)).cast("long").alias("members"))


def mission_progress(completions: DataFrame, catalog: DataFrame) -> DataFrame:
    """AG-22: per (user, track): missions completed, missions in track, pct, points earned."""
    cat = catalog.select("mission_id", F.coalesce("track", "category").alias("track"))
    sizes = cat.groupBy("track").agg(F.count(F.lit(1)).alias("total"))
    done = (completions.join(F.broadcast(cat), "mission_id").groupBy("user_id", "track")
            .agg(F.countDistinct("mission_id").alias("completed"), F.sum("points_awarded").alias("points_earned")))
    j = done.join(F.broadcast(sizes), "track")
    return j.select("user_id", "track", "completed", "total",
                    F.floor(F.lit(100.0) * F.col("completed") / F.col("total") + 0.5).cast("int").alias("pct"),
                    F.col("points_earned").cast("long").alias("points_earned"))
