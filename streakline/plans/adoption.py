"""The scheduled scoring run: detectors → facts → streaks → profile → leaderboard
→ badges → notifications, each step a DataFrame handed to the next.

``run`` takes the previous outputs (or none) and returns the new ones, so it is
idempotent by construction: a second run over the same logs adds no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from .. import schemas
from ..functions import exprs as X
from ..operators import detect as D
from ..operators.keys import insert_absent, update_changed, upsert
from ..operators.ranking import global_row_number
from ..operators.streaks import streaks as streaks_op
from ..sources import standins as S
from ..sources.tables import Tables
from ..session import materialize


@dataclass
class Logs:
    usage: DataFrame
    audit: DataFrame
    query_history: DataFrame
    query_text: DataFrame
    assistant: DataFrame
    jobs: DataFrame
    job_tasks: DataFrame
    job_runs: DataFrame
    pipelines: DataFrame
    pipeline_updates: DataFrame
    # Stand-in only: the joined rows the three job logs are projected from.
    job_rows: DataFrame | None = None


def _tolerant(build):
    """SC-6: a source that cannot be read (missing path, no access) yields None, not a failed run."""
    from pyspark.errors import AnalysisException
    try:
        return build()
    except AnalysisException:
        return None


def standin_logs(t: Tables) -> Logs:
    return Logs(
        usage=_tolerant(lambda: S.usage_log(t)), audit=_tolerant(lambda: S.audit_log(t)),
        query_history=_tolerant(lambda: S.query_history(t)),
        query_text=_tolerant(lambda: S.query_history(t, with_text=True)),
        assistant=_tolerant(lambda: S.assistant_events(t)),
        jobs=_tolerant(lambda: S.jobs_log(t)), job_tasks=_tolerant(lambda: S.job_tasks(t)),
        job_runs=_tolerant(lambda: S.job_runs(t)), pipelines=_tolerant(lambda: S.pipelines_log(t)),
        pipeline_updates=_tolerant(lambda: S.pipeline_updates(t)),
        job_rows=_tolerant(lambda: S.job_rows(t)),
    )


@dataclass(frozen=True)
class RunConfig:
    activity: D.Clock = D.Clock(S.ACTIVITY_AS_OF)
    jobs: D.Clock = D.Clock(S.JOBS_AS_OF, S.JOBS_LOOKBACK_DAYS)
    run_ts: str = S.RUN_TS
    consistent_window: int = S.JOBS_LOOKBACK_DAYS
    thresholds: R.Thresholds = R.Thresholds.standin()


def human(col="user_id"):
    """FI-3: a human principal has an '@'; NULL is not human."""
    return F.col(col).like("%@%")


# ----------------------------- detection ------------------------------------

def detector_plan(spark: SparkSession, logs: Logs, cfg: RunConfig, daily: DataFrame | None = None):
    """Every detector as (rule, sources it reads, builder)."""
    ts, th, act, jobs = cfg.run_ts, cfg.thresholds, cfg.activity, cfg.jobs

    def latest_recent():
        return D.latest_jobs(logs.jobs, jobs.since())

    shared = {}

    def once(key, fn):
        # The job log's latest versions feed three detectors: pick them once.
        if key not in shared:
            shared[key] = fn()
        return shared[key]

    return [
        ("first_steps", ["usage"], lambda: D.first_steps(daily, act, ts)),
        ("job_creator", ["jobs"], lambda: D.job_creator(logs.jobs, jobs, ts)),
        ("pipeline_builder", ["pipelines"], lambda: D.pipeline_builder(logs.pipelines, jobs, ts)),
        ("pipeline_runner", ["pipeline_updates"], lambda: D.pipeline_runner(logs.pipeline_updates, jobs, ts)),
        ("scheduler", ["jobs"], lambda: D.scheduler(logs.jobs, jobs, ts, once("recent", latest_recent))),
        ("auto_loader_pioneer", ["pipelines", "usage"],
         lambda: D.auto_loader_pioneer(logs.pipelines, logs.usage, act, ts)),
        ("consistent_operator", ["job_runs", "jobs", "pipeline_updates"],
         lambda: D.consistent_operator(logs.job_runs, logs.jobs, logs.pipeline_updates, jobs, ts,
                                       cfg.consistent_window, th, once("all", lambda: D.latest_jobs(logs.jobs)))),
        ("query_weekly", ["query_history"], lambda: D.query_weekly(logs.query_history, act, ts, th)),
        ("audit_missions", ["audit"], lambda: D.audit_missions(logs.audit, R.audit_rules_df(spark, th), act, ts)),
        ("genie_code_user", ["assistant"], lambda: D.assistant_user(logs.assistant, act, ts)),
        ("multi_task_orchestrator", ["jobs", "job_tasks"],
         lambda: D.multi_task_orchestrator(logs.jobs, logs.job_tasks, jobs, ts, th, once("recent", latest_recent))),
        ("ai_function_builder", ["query_text"], lambda: D.ai_function_builder(logs.query_text, ts)),
        ("product_monthly", ["usage"], lambda: D.product_monthly(daily, act, ts, th)),
        ("daily_driver", ["usage"], lambda: D.daily_driver(daily, act, ts, th)),
    ]


def detect_all(spark: SparkSession, logs: Logs, cfg: RunConfig, daily: DataFrame | None = None,
               skipped: list | None = None) -> DataFrame:
    """Every detector whose sources are readable, unioned into ``mission_completions`` rows.

    A rule whose source is missing is left out and reported in ``skipped``
    as (rule, missing sources); the run continues (SC-6).
    """
    if daily is None and logs.usage is not None:
        daily = D.usage_daily(logs.usage, cfg.activity)
    parts = []
    for rule, needs, build in detector_plan(spark, logs, cfg, daily):
        missing = [n for n in needs if getattr(logs, n) is None]
        if missing:
            if skipped is not None:
                skipped.append((rule, ",".join(missing)))
            continue
        parts.append(build())
    if not parts:
        return schemas.empty(spark, "mission_completions")
    return D._union(parts)


def merge_completions(previous: DataFrame, detected: DataFrame) -> DataFrame:
    """UP-1/UP-2: one-time missions key on (user, mission), repeatable ones add period_start."""
    repeatable = [m[0] for m in R.MISSIONS if m[5] == "repeatable"]
    rep = F.col("mission_id").isin(*repeatable)
    new_once = insert_absent(previous.filter(~rep), detected.filter(~rep), ["user_id", "mission_id"])
    new_rep = insert_absent(previous.filter(rep), detected.filter(rep), ["user_id", "mission_id", "period_start"])
    return new_once.unionByName(new_rep)


def completion_points(completions: DataFrame) -> DataFrame:
    """CO-1: completions → points-fact rows (deduplicated on the fact's key first)."""
    f = completions.select(
        "user_id", F.lit("mission_completion").alias("event_type"), "mission_id",
        F.col("points_awarded").alias("points"),
        F.concat(F.lit("Completed mission: "), F.col("mission_name")).alias("reason"),
        F.col("completed_at").alias("event_timestamp"), "scored_at")
    keys = ["user_id", "mission_id", "event_timestamp"]
    return f.groupBy(*keys).agg(*[F.min(c).alias(c) for c in ["event_type", "points", "reason", "scored_at"]]) \
        .select(*schemas.USER_POINTS_FACT.fieldNames())


# ----------------------------- per-user facts -------------------------------

def user_products(daily: DataFrame, clock: D.Clock) -> DataFrame:
    """AG-4: distinct products with positive usage in the look-back."""
    return (daily.filter((F.col("pos_rows") > 0) & (F.col("usage_date") >= clock.since()))
            .groupBy("user_id").agg(F.countDistinct("billing_origin_product").cast("int").alias("distinct_products")))


def activity_dates(daily: DataFrame, clock: D.Clock) -> DataFrame:
    """AG-1: first/last usage day in the look-back (any quantity)."""
    return (daily.filter(F.col("usage_date") >= clock.since())
            .groupBy("user_id").agg(F.min("usage_date").alias("first_activity_date"),
                                    F.max("usage_date").alias("last_activity_date")))


def user_streaks(daily: DataFrame, clock: D.Clock) -> DataFrame:
    d = (daily.filter((F.col("pos_rows") > 0) & (F.col("usage_date") >= clock.since()))
         .select("user_id", F.col("usage_date").alias("activity_date")))
    return streaks_op(d)


def point_totals(completions: DataFrame, fact: DataFrame, clock: D.Clock | None = None) -> DataFrame:
    """AG-26 / AG-6: mission + consumption totals (and weekly/monthly when a clock is given).

    One union and one aggregation instead of two aggregations and a full outer
    join; weeks start on Saturday, months on the 1st of ``clock.today()``.
    """
    m = completions.select("user_id", F.col("points_awarded").alias("pts"), F.col("completed_at").alias("at"),
                           F.lit(1).alias("is_mission"))
    c = fact.filter(F.col("event_type") == "consumption").select(
        "user_id", F.col("points").alias("pts"), F.col("event_timestamp").alias("at"), F.lit(0).alias("is_mission"))
    u = m.unionByName(c)
    aggs = [F.sum("pts").alias("total_points"), F.sum("is_mission").alias("missions_completed")]
    if clock is not None:
        wk = X.saturday_week_start(clock.today())
        mo = F.trunc(clock.today(), "MM")
        aggs += [F.sum(F.when(F.col("at") >= wk, F.col("pts")).otherwise(0)).alias("weekly_points"),
                 F.sum(F.when(F.col("at") >= mo, F.col("pts")).otherwise(0)).alias("monthly_points")]
    return u.groupBy("user_id").agg(*aggs)


def badge_counts(badges: DataFrame) -> DataFrame:
    return badges.groupBy("user_id").agg(F.count(F.lit(1)).cast("int").alias("badge_count"))


def build_profile(totals: DataFrame, streaks: DataFrame, dates: DataFrame, counts: DataFrame,
                  products: DataFrame, run_ts: str) -> DataFrame:
    """CO-2: left-join star keyed on user_id (all sides aggregated per user)."""
    p = (totals.join(streaks, "user_id", "left").join(dates, "user_id", "left")
         .join(counts, "user_id", "left").join(products, "user_id", "left"))
    return schemas.conform(p.select(
        "user_id", X.display_name("user_id").alias("display_name"),
        F.col("total_points").cast("int").alias("total_points"), X.tier("total_points").alias("level"),
        F.coalesce("current_streak", F.lit(0)).alias("current_streak"),
        F.coalesce("max_streak", F.lit(0)).alias("max_streak"),
        F.coalesce("badge_count", F.lit(0)).alias("badge_count"),
        F.col("missions_completed").cast("int").alias("missions_completed"),
        "first_activity_date", "last_activity_date",
        F.coalesce("distinct_products", F.lit(0)).alias("distinct_products_used"),
        D.run_ts_col(run_ts).alias("updated_at")), "user_profile_snapshot")


def build_leaderboard(totals: DataFrame, run_ts: str) -> DataFrame:
    """CO-3: three global rankings (user_id breaks ties), computed range-partitioned."""
    t = totals.select("user_id", F.col("total_points").cast("int").alias("total_points"),
                      F.col("weekly_points").cast("int").alias("weekly_points"),
                      F.col("monthly_points").cast("int").alias("monthly_points"))
    for col, name in [("total_points", "all_time_rank"), ("weekly_points", "weekly_rank"),
                      ("monthly_points", "monthly_rank")]:
        t = global_row_number(t, [F.col(col).desc(), F.col("user_id").asc()], name)
    return schemas.conform(t.select(
        "*", X.display_name("user_id").alias("display_name"), X.tier("total_points").alias("level"),
        D.run_ts_col(run_ts).alias("updated_at")), "leaderboard")


def detect_badges(products: DataFrame, streaks: DataFrame, completions: DataFrame, run_ts: str,
                  which: list[str] | None = None) -> DataFrame:
    """CO-4..7: badge rules over the per-user facts."""
    which = which or R.SCORED_BADGES
    out = []
    for badge_id, name, icon, kind, k, missions in R.BADGES:
        if badge_id not in which:
            continue
        if kind == "products":
            users = products.filter(F.col("distinct_products") >= k).select("user_id")
        elif kind == "streak":
            users = streaks.filter(F.col("max_streak") >= k).select("user_id")
        elif kind == "missions":
            users = (completions.filter(F.col("mission_id").isin(*missions)).groupBy("user_id")
                     .agg(F.countDistinct("mission_id").alias("_n")).filter(F.col("_n") >= k).select("user_id"))
        else:  # categories
            cat = F.broadcast(R.missions_df(completions.sparkSession).select("mission_id", "category"))
            users = (completions.join(cat, "mission_id").groupBy("user_id")
                     .agg(F.countDistinct("category").alias("_n")).filter(F.col("_n") >= k).select("user_id"))
        out.append(users.select("user_id", F.lit(badge_id).alias("badge_id"), F.lit(name).alias("badge_name"),
                                F.lit(icon).alias("badge_icon"), D.run_ts_col(run_ts).alias("earned_at")))
    return D._union(out)


def notifications(completions: DataFrame, badges: DataFrame, run_ts: str) -> DataFrame:
    """CO-8 / CO-9: notify about rows scored / earned in this run."""
    now = D.run_ts_col(run_ts)
    m = completions.filter(F.col("scored_at") == now).select(
        "user_id", F.lit("mission_complete").alias("notification_type"),
        F.concat(F.lit("Mission Complete: "), F.col("mission_name")).alias("title"),
        X.mission_message("points_awarded", "mission_name").alias("message"),
        "mission_id", F.col("points_awarded").alias("points"), F.col("scored_at").alias("created_at"))
    b = badges.filter(F.col("earned_at") == now).select(
        "user_id", F.lit("badge_earned").alias("notification_type"),
        F.concat(F.lit("Badge Unlocked: "), F.col("badge_name")).alias("title"),
        F.concat(F.lit("Congratulations! You have earned the "), F.col("badge_name"), F.lit(" badge!"))
         .alias("message"),
        F.col("badge_id").alias("mission_id"), F.lit(0).alias("points"), F.col("earned_at").alias("created_at"))
    return schemas.conform(m.unionByName(b), "notifications")


# ----------------------------- the run --------------------------------------

class ScoringRun:
    """One scoring run over ``logs``; each output is built (and written) on first use.

    Stages are cached properties, so a caller asking for the completions only
    does not build the leaderboard. Reuse points are checkpointed to the shared
    folder: every later stage reads written rows, not the upstream plan.
    """

    def __init__(self, spark: SparkSession, logs: Logs, cfg: RunConfig | None = None,
                 previous: dict[str, DataFrame] | None = None):
        self.spark, self.logs, self.cfg = spark, logs, cfg or RunConfig()
        prev = {n: (previous or {}).get(n) for n in schemas.OUTPUTS}
        self.prev = {n: (df if df is not None else schemas.empty(spark, n)) for n, df in prev.items()}

    @cached_property
    def daily(self) -> DataFrame:
        if self.logs.usage is None:
            return self.spark.createDataFrame([], "user_id string, usage_date date, billing_origin_product string, "
                                                  "pos_qty decimal(28,2), pos_rows long, all_rows long")
        return materialize(D.usage_daily(self.logs.usage, self.cfg.activity))

    @cached_property
    def skipped_rules(self) -> DataFrame:
        """SC-6: (rule, missing sources) for every detector left out of this run."""
        skipped: list = []
        detect_all(self.spark, self.run_logs, self.cfg, self.daily, skipped)
        return self.spark.createDataFrame(skipped, "rule string, missing_sources string")

    @cached_property
    def run_logs(self) -> Logs:
        """Logs as the detectors read them: the joined job rows feeding three
        logs (and five detectors) are written once instead of joined five times."""
        if self.logs.job_rows is None or self.logs.jobs is None:
            return self.logs
        rows = materialize(self.logs.job_rows)
        return replace(self.logs, jobs=S.jobs_log(None, rows), job_tasks=S.job_tasks(None, rows),
                       job_runs=S.job_runs(None, rows))

    @cached_property
    def completions_all(self) -> DataFrame:
        prev = self.prev["mission_completions"]
        detected = detect_all(self.spark, self.run_logs, self.cfg, self.daily)
        return materialize(prev.unionByName(schemas.conform(merge_completions(prev, detected),
                                                            "mission_completions")))

    @cached_property
    def fact_all(self) -> DataFrame:
        cfg, fact0 = self.cfg, self.prev["user_points_fact"]
        keys = ["user_id", "mission_id", "event_timestamp"]
        consumption = D.weekly_consumption_points(self.daily, cfg.activity, cfg.run_ts)
        fact1 = fact0.unionByName(schemas.conform(insert_absent(fact0, consumption, keys), "user_points_fact"))
        new_pts = insert_absent(fact1, completion_points(self.completions_all), keys)
        return materialize(fact1.unionByName(schemas.conform(new_pts, "user_points_fact")))

    # Non-human rows leave the facts before anything is ranked.
    @cached_property
    def completions(self) -> DataFrame:
        return self.completions_all.filter(human())

    @cached_property
    def fact(self) -> DataFrame:
        return self.fact_all.filter(human())

    @cached_property
    def streaks(self) -> DataFrame:
        return materialize(user_streaks(self.daily, self.cfg.activity))

    @cached_property
    def products(self) -> DataFrame:
        return user_products(self.daily, self.cfg.activity)

    @cached_property
    def totals(self) -> DataFrame:
        return materialize(point_totals(self.completions, self.fact, self.cfg.activity))

    @cached_property
    def badges(self) -> DataFrame:
        prev = self.prev["badges"]
        found = detect_badges(self.products, self.streaks, self.completions, self.cfg.run_ts)
        return prev.unionByName(schemas.conform(insert_absent(prev, found, ["user_id", "badge_id"]), "badges"))

    @cached_property
    def profile(self) -> DataFrame:
        cfg = self.cfg
        src = build_profile(self.totals, self.streaks, activity_dates(self.daily, cfg.activity),
                            badge_counts(self.prev["badges"]), self.products, cfg.run_ts)
        profile = upsert(self.prev["user_profile_snapshot"], src, ["user_id"])
        return update_changed(profile, badge_counts(self.badges), ["user_id"], ["badge_count"],
                              "updated_at", D.run_ts_col(cfg.run_ts))

    @cached_property
    def leaderboard(self) -> DataFrame:
        return upsert(self.prev["leaderboard"], build_leaderboard(self.totals, self.cfg.run_ts), ["user_id"])

    @cached_property
    def notifications(self) -> DataFrame:
        notes = notifications(self.completions, self.badges, self.cfg.run_ts)
        prev_n = self.prev["notifications"]
        is_badge = F.col("notification_type") == "badge_earned"
        new_m = insert_absent(prev_n, notes.filter(~is_badge),
                              ["user_id", "mission_id", "notification_type", "created_at"])
        new_b = insert_absent(prev_n, notes.filter(is_badge), ["user_id", "mission_id", "notification_type"])
        return prev_n.unionByName(new_m).unionByName(new_b)

    def final(self, name: str) -> DataFrame:
        """One output as the run leaves it: swept of non-human principals."""
        prop = {"mission_completions": "completions", "user_points_fact": "fact",
                "user_profile_snapshot": "profile"}.get(name, name)
        return getattr(self, prop).filter(human())

    def outputs(self) -> dict[str, DataFrame]:
        out = {"mission_completions": self.completions, "user_points_fact": self.fact,
               "user_profile_snapshot": self.profile, "leaderboard": self.leaderboard,
               "badges": self.badges, "notifications": self.notifications}
        # Final sweep: outputs of earlier runs may hold non-human rows.
        return {n: df.filter(human()) for n, df in out.items()}


def run(spark: SparkSession, logs: Logs, cfg: RunConfig | None = None,
        previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """One scoring run over ``logs``; returns the six output tables (full contents)."""
    return ScoringRun(spark, logs, cfg, previous).outputs()


def run_summary(outputs: dict[str, DataFrame]) -> DataFrame:
    """SK-2: users scored, completions, badges — (metric, value) rows computed on the executors."""
    users = outputs["user_profile_snapshot"].agg(F.countDistinct("user_id").alias("value")) \
        .select(F.lit("users_scored").alias("metric"), "value")
    comps = outputs["mission_completions"].agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("mission_completions").alias("metric"), "value")
    bdg = outputs["badges"].agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("badges_awarded").alias("metric"), "value")
    return users.unionByName(comps).unionByName(bdg)
