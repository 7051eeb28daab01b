"""Mission detectors: filter + group + threshold → ``mission_completions`` rows.

Every detector is a DataFrame → DataFrame function. Detectors over the same
log share one scan: the audit-log rules are a broadcast rule table joined to
the log once; the usage-log detectors all read one daily pre-aggregate
(:func:`usage_daily`), so the raw log is scanned and shuffled once per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import exprs as X

COMPLETION_COLS = ["user_id", "mission_id", "mission_name", "points_awarded", "completed_at",
                   "period_start", "period_end", "scored_at"]


@dataclass(frozen=True)
class Clock:
    """The run's notion of 'today' (replaces CURRENT_DATE) and its look-back."""

    as_of: str
    lookback_days: int = R.LOOKBACK_DAYS

    def today(self) -> Column:
        return F.to_date(F.lit(self.as_of))

    def since(self, days: int | None = None) -> Column:
        return F.date_sub(self.today(), self.lookback_days if days is None else days)


def run_ts_col(run_ts: str) -> Column:
    return F.to_timestamp(F.lit(run_ts))


def nonblank(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def _emit(df: DataFrame, mission_id: str, run_ts: str, completed_at: Column,
          period_start: Column, period_end: Column) -> DataFrame:
    _, name, points, *_ = R.mission_lookup()[mission_id]
    return df.select(
        F.col("user_id"),
        F.lit(mission_id).alias("mission_id"),
        F.lit(name).alias("mission_name"),
        F.lit(points).cast("int").alias("points_awarded"),
        completed_at.cast("timestamp").alias("completed_at"),
        period_start.cast("date").alias("period_start"),
        period_end.cast("date").alias("period_end"),
        run_ts_col(run_ts).alias("scored_at"),
    )


def _first_time(df: DataFrame, mission_id: str, ts: str, run_ts: str) -> DataFrame:
    """Shape A: first qualifying moment per user; the period is that day."""
    g = df.groupBy("user_id").agg(F.min(ts).alias("_first"))
    return _emit(g, mission_id, run_ts, F.col("_first"), F.col("_first"), F.col("_first"))


# ----------------------------- usage log ------------------------------------

def usage_daily(usage: DataFrame, clock: Clock, lookback_days: int | None = None) -> DataFrame:
    """One shared pre-aggregate of the usage log per (user, day, product).

    Carries positive-quantity sums (exact decimals, so thresholds do not depend
    on summation order), positive-row counts and all-row counts; every
    usage-log detector, the streaks and the profile read this instead of the
    raw log. Partial aggregation runs map-side, so a user holding a third of
    all rows still shuffles only one row per day and product.
    """
    days = max(lookback_days or 0, clock.lookback_days, R.CONSUMPTION_LOOKBACK_DAYS,
               R.MONTHLY_LOOKBACK_DAYS + 31)
    u = usage.select(
        F.col("identity_metadata.run_as").alias("user_id"),
        "usage_date", "usage_quantity", "billing_origin_product",
    ).filter(nonblank("user_id") & (F.col("usage_date") >= clock.since(days)))
    pos = F.col("usage_quantity") > 0
    return u.groupBy("user_id", "usage_date", "billing_origin_product").agg(
        F.sum(F.when(pos, F.col("usage_quantity").cast("decimal(18,2)"))).alias("pos_qty"),
        F.count(F.when(pos, 1)).alias("pos_rows"),
        F.count(F.lit(1)).alias("all_rows"),
    )


def first_steps(daily: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """MI-1: first positive usage in the look-back, service principals excluded."""
    d = daily.filter((F.col("pos_rows") > 0) & (F.col("usage_date") >= clock.since()))
    for pattern in R.SERVICE_PRINCIPAL_MARKERS:
        d = d.filter(~F.col("user_id").like(pattern))
    g = d.groupBy("user_id").agg(F.min("usage_date").alias("_d"))
    return _emit(g, "first_steps", run_ts, F.col("_d"), F.col("_d"), F.col("_d"))


def product_monthly(daily: DataFrame, clock: Clock, run_ts: str,
                    thresholds: R.Thresholds | None = None) -> DataFrame:
    """MI-31..34 (monthly product sums) and MI-36 (distinct products per month)."""
    th = thresholds or R.Thresholds()
    since = F.trunc(clock.since(R.MONTHLY_LOOKBACK_DAYS), "MM")
    m = (daily.filter((F.col("pos_rows") > 0) & (F.col("usage_date") >= since))
         .groupBy("user_id", X.month_start("usage_date").alias("month"), "billing_origin_product")
         .agg(F.sum("pos_qty").alias("qty"), F.max("usage_date").alias("last_day")))
    outs = []
    for mission_id, product, _ in R.PRODUCT_RULES:
        k = th.product[mission_id]
        p = m.filter((F.col("billing_origin_product") == product) & (F.col("qty") >= k))
        outs.append(_emit(p, mission_id, run_ts, F.col("last_day"), F.col("month"), F.last_day("month")))
    c = (m.groupBy("user_id", "month").agg(F.count(F.lit(1)).alias("n_products"),
                                          F.max("last_day").alias("last_day"))
         .filter(F.col("n_products") >= th.cross_product_min))
    outs.append(_emit(c, "cross_product_champion", run_ts, F.col("last_day"), F.col("month"),
                      F.last_day("month")))
    return _union(outs)


def daily_driver(daily: DataFrame, clock: Clock, run_ts: str,
                 thresholds: R.Thresholds | None = None) -> DataFrame:
    """MI-35: at least k distinct active days in the window; period = rolling window."""
    th = thresholds or R.Thresholds()
    g = (daily.filter((F.col("pos_rows") > 0) & (F.col("usage_date") >= clock.since(R.DAILY_DRIVER_WINDOW)))
         .groupBy("user_id").agg(F.countDistinct("usage_date").alias("_days"),
                                 F.max("usage_date").alias("_last"))
         .filter(F.col("_days") >= th.daily_driver_days))
    return _emit(g, "daily_driver", run_ts, F.col("_last"), clock.since(R.DAILY_DRIVER_WINDOW), clock.today())


def weekly_consumption_points(daily: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """MI-37: 1 point per 10 units per Monday week (sum >= 10), keyed on the week's last usage day."""
    w = (daily.filter((F.col("pos_rows") > 0) & (F.col("usage_date") >= clock.since(R.CONSUMPTION_LOOKBACK_DAYS)))
         .groupBy("user_id", X.monday_week("usage_date").alias("week"))
         .agg(F.sum("pos_qty").alias("qty"), F.max("usage_date").alias("last_day"))
         .filter(F.col("qty") >= R.CONSUMPTION_UNITS_PER_POINT))
    return w.select(
        "user_id",
        F.lit("consumption").alias("event_type"),
        F.lit("weekly_dbu").alias("mission_id"),
        F.floor(F.col("qty") / R.CONSUMPTION_UNITS_PER_POINT).cast("int").alias("points"),
        F.concat(F.lit("Weekly compute: "), F.round(F.col("qty"), 1).cast("string"), F.lit(" DBUs"))
         .alias("reason"),
        F.col("last_day").cast("timestamp").alias("event_timestamp"),
        run_ts_col(run_ts).alias("scored_at"),
    )


# ----------------------------- audit log ------------------------------------

def audit_missions(audit: DataFrame, rules_df: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """All audit-log missions from one scan joined to a broadcast rule table.

    The join is an equi-join on ``action_name`` (residual: the rule's service,
    if any); a row matching several rules fans out once per rule. One
    aggregation by (mission, user, week-or-null) then serves shapes A, B and E.
    """
    a = audit.select(
        F.col("user_identity.email").alias("user_id"), "service_name", "action_name",
        F.col("response.status_code").alias("status_code"), "event_time",
    ).filter((F.col("status_code") == 200) & nonblank("user_id") & (F.col("event_time") >= clock.since()))
    r = F.broadcast(rules_df)
    j = a.join(r, (a.action_name == r.rule_action)
               & (r.rule_service.isNull() | (a.service_name == r.rule_service)))
    week = F.when(F.col("shape") == "B", X.monday_week("event_time"))
    g = (j.groupBy("mission_id", "mission_name", "points_awarded", "shape", "threshold", "user_id",
                   week.alias("week"))
         .agg(F.min("event_time").alias("_first"), F.max("event_time").alias("_last"),
              F.count(F.lit(1)).alias("_n"))
         .filter(F.col("_n") >= F.col("threshold")))
    shape = F.col("shape")
    completed = F.when(shape == "A", F.col("_first")).otherwise(F.col("_last"))
    p_start = (F.when(shape == "A", F.col("_first").cast("date"))
               .when(shape == "B", F.col("week"))
               .otherwise(F.col("_first").cast("date")))
    p_end = (F.when(shape == "A", F.col("_first").cast("date"))
             .when(shape == "B", F.date_add(F.col("week"), 6))
             .otherwise(F.col("_last").cast("date")))
    return g.select(
        "user_id", "mission_id", "mission_name", F.col("points_awarded").cast("int").alias("points_awarded"),
        completed.cast("timestamp").alias("completed_at"), p_start.alias("period_start"),
        p_end.alias("period_end"), run_ts_col(run_ts).alias("scored_at"),
    )


def assistant_user(assistant: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """MI-13: first assistant use by a human (principal contains '@')."""
    a = (assistant.select(F.col("initiated_by").alias("user_id"), "event_time")
         .filter(F.col("user_id").like("%@%") & (F.col("event_time") >= clock.since())))
    return _first_time(a, "genie_code_user", "event_time", run_ts)


# ----------------------------- query history --------------------------------

def query_weekly(history: DataFrame, clock: Clock, run_ts: str,
                 thresholds: R.Thresholds | None = None) -> DataFrame:
    """MI-8 / MI-26: counted statements per Monday week; one aggregation, two thresholds."""
    th = thresholds or R.Thresholds()
    w = (history.select(F.col("executed_by").alias("user_id"), "statement_type", "start_time")
         .filter(nonblank("user_id") & F.col("statement_type").isin(*R.COUNTED_STATEMENT_TYPES)
                 & (F.col("start_time") >= clock.since()))
         .groupBy("user_id", X.monday_week("start_time").alias("week"))
         .agg(F.count(F.lit(1)).alias("_n"), F.max("start_time").alias("_last")))
    outs = []
    for mission_id, _ in R.QUERY_RULES:
        k = th.query[mission_id]
        outs.append(_emit(w.filter(F.col("_n") >= k), mission_id, run_ts, F.col("_last"),
                          F.col("week"), F.date_add(F.col("week"), 6)))
    return _union(outs)


def ai_function_builder(history: DataFrame, run_ts: str, pattern: str = R.AI_FUNCTION_PATTERN) -> DataFrame:
    """MI-29: first finished statement whose text matches the pattern (no look-back)."""
    q = (history.select(F.col("executed_by").alias("user_id"), "statement_text", "execution_status", "start_time")
         .filter(F.lower("statement_text").like(pattern) & nonblank("user_id")
                 & (F.col("execution_status") == "FINISHED")))
    return _first_time(q, "ai_function_builder", "start_time", run_ts)


# ----------------------------- jobs and pipelines ---------------------------

def latest_jobs(jobs: DataFrame, since: Column | None = None) -> DataFrame:
    """Latest version per (workspace_id, job_id) by change_time (version as tie-break)."""
    from .keys import latest_per_key
    j = jobs if since is None else jobs.filter(F.col("change_time") >= since)
    return latest_per_key(j, ["workspace_id", "job_id"], ["change_time", "version"])


def job_creator(jobs: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """MI-2: first non-deleted job version (raw change log) per creator."""
    j = (jobs.select(F.col("creator_user_name").alias("user_id"), "change_time", "delete_time")
         .filter(nonblank("user_id") & F.col("delete_time").isNull() & (F.col("change_time") >= clock.since())))
    return _first_time(j, "job_creator", "change_time", run_ts)


def scheduler(jobs: DataFrame, clock: Clock, run_ts: str, latest: DataFrame | None = None) -> DataFrame:
    """MI-5: latest version (within the look-back) is scheduled and not deleted."""
    j = latest if latest is not None else latest_jobs(jobs, clock.since())
    j = (j.filter(F.col("trigger_type").isin(*R.SCHEDULE_TRIGGERS) & F.col("delete_time").isNull()
                  & nonblank("creator_user_name"))
         .select(F.col("creator_user_name").alias("user_id"), "change_time"))
    return _first_time(j, "scheduler", "change_time", run_ts)


def multi_task_orchestrator(jobs: DataFrame, tasks: DataFrame, clock: Clock, run_ts: str,
                            thresholds: R.Thresholds | None = None, latest: DataFrame | None = None) -> DataFrame:
    """MI-25: >= k distinct task keys across a creator's latest, live jobs."""
    th = thresholds or R.Thresholds()
    j = (latest if latest is not None else latest_jobs(jobs, clock.since())).filter(F.col("delete_time").isNull() & nonblank("creator_user_name"))
    t = tasks.select("workspace_id", "job_id", "task_key").distinct()
    g = (j.join(t, ["workspace_id", "job_id"])
         .groupBy(F.col("creator_user_name").alias("user_id"))
         .agg(F.min("change_time").alias("_first"), F.countDistinct("task_key").alias("_k"))
         .filter(F.col("_k") >= th.multi_task_min))
    return _emit(g, "multi_task_orchestrator", run_ts, F.col("_first"), F.col("_first"), F.col("_first"))


def pipeline_builder(pipelines: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """MI-3: first live ETL pipeline per creator."""
    p = (pipelines.filter(F.col("pipeline_type").isin(*R.ETL_PIPELINE_TYPES) & F.col("delete_time").isNull()
                          & nonblank("created_by") & (F.col("change_time") >= clock.since()))
         .select(F.col("created_by").alias("user_id"), "change_time"))
    return _first_time(p, "pipeline_builder", "change_time", run_ts)


def pipeline_runner(updates: DataFrame, clock: Clock, run_ts: str) -> DataFrame:
    """MI-4: first completed pipeline update per runner."""
    u = (updates.filter((F.col("result_state") == "COMPLETED") & nonblank("run_as_user_name")
                        & (F.col("period_start_time") >= clock.since()))
         .select(F.col("run_as_user_name").alias("user_id"), "period_start_time"))
    return _first_time(u, "pipeline_runner", "period_start_time", run_ts)


def auto_loader_pioneer(pipelines: DataFrame, usage: DataFrame, usage_clock: Clock, run_ts: str) -> DataFrame:
    """MI-6: live ETL pipelines with recent DLT usage; semi-join (only the pipeline side is kept)."""
    used = (usage.select(F.col("usage_metadata.dlt_pipeline_id").alias("pipeline_id"),
                         "billing_origin_product", "usage_date")
            .filter((F.col("billing_origin_product") == R.DLT_PRODUCT)
                    & (F.col("usage_date") >= usage_clock.since()) & F.col("pipeline_id").isNotNull())
            .select("pipeline_id"))
    p = (pipelines.filter(F.col("pipeline_type").isin(*R.ETL_PIPELINE_TYPES) & F.col("delete_time").isNull()
                          & nonblank("created_by"))
         .join(used, "pipeline_id", "left_semi")
         .select(F.col("created_by").alias("user_id"), "change_time"))
    return _first_time(p, "auto_loader_pioneer", "change_time", run_ts)


def consistent_operator(job_runs: DataFrame, jobs: DataFrame, updates: DataFrame, clock: Clock,
                        run_ts: str, window_days: int = R.CONSISTENT_OPERATOR_WINDOW,
                        thresholds: R.Thresholds | None = None, latest_all: DataFrame | None = None) -> DataFrame:
    """MI-7: distinct run days (job runs of the latest job version ∪ pipeline updates) >= k."""
    th = thresholds or R.Thresholds()
    since = clock.since(window_days)
    latest = (latest_all if latest_all is not None else latest_jobs(jobs)).filter(nonblank("creator_user_name")) \
        .select("workspace_id", "job_id", F.col("creator_user_name").alias("user_id"))
    runs = (job_runs.filter(F.col("result_state").isNotNull() & (F.col("period_start_time") >= since))
            .join(latest, ["workspace_id", "job_id"])
            .select("user_id", F.col("period_start_time").cast("date").alias("run_date")))
    pl = (updates.filter(F.col("result_state").isNotNull() & nonblank("run_as_user_name")
                         & (F.col("period_start_time") >= since))
          .select(F.col("run_as_user_name").alias("user_id"),
                  F.col("period_start_time").cast("date").alias("run_date")))
    days = runs.unionByName(pl).distinct()
    g = (days.groupBy("user_id").agg(F.count(F.lit(1)).alias("_days"), F.max("run_date").alias("_last"))
         .filter(F.col("_days") >= th.consistent_operator_days))
    return _emit(g, "consistent_operator", run_ts, F.col("_last"), since, clock.today())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
