"""Registered queries of the scoring run (adoption side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions import exprs as X
from ..operators import detect as D
from ..sources.tables import Tables
from . import adoption as A
from . import oracle_adoption as O
from .registry import register

CFG = A.RunConfig()
_LOGS_SQL = O.ALL_LOGS


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _logs(spark, sf_dir):
    return A.standin_logs(Tables(spark, sf_dir))


def _daily(logs):
    return D.usage_daily(logs.usage, CFG.activity)


@register("mi_first_steps", _with(*_LOGS_SQL) + O.first_steps())
def q_first_steps(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return D.first_steps(_daily(logs), CFG.activity, CFG.run_ts)


@register("mi_daily_driver", _with(*_LOGS_SQL) + O.daily_driver())
def q_daily_driver(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return D.daily_driver(_daily(logs), CFG.activity, CFG.run_ts, CFG.thresholds)


@register("mi_product_monthly", _with(*_LOGS_SQL) + O.product_monthly())
def q_product_monthly(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return D.product_monthly(_daily(logs), CFG.activity, CFG.run_ts, CFG.thresholds)


@register("mi_weekly_consumption_points", _with(*_LOGS_SQL) + O.weekly_points())
def q_weekly_points(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return D.weekly_consumption_points(_daily(logs), CFG.activity, CFG.run_ts)


@register("mi_audit_missions", _with(*_LOGS_SQL) + O.audit_missions())
def q_audit(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return D.audit_missions(logs.audit, R.audit_rules_df(spark, CFG.thresholds), CFG.activity, CFG.run_ts)


@register("mi_assistant_user", _with(*_LOGS_SQL) + O.assistant_user())
def q_assistant(spark, sf_dir):
    return D.assistant_user(_logs(spark, sf_dir).assistant, CFG.activity, CFG.run_ts)


@register("mi_query_weekly", _with(*_LOGS_SQL) + O.query_weekly())
def q_query_weekly(spark, sf_dir):
    return D.query_weekly(_logs(spark, sf_dir).query_history, CFG.activity, CFG.run_ts, CFG.thresholds)


@register("mi_ai_function_builder", _with(*_LOGS_SQL) + O.ai_function_builder())
def q_ai_function(spark, sf_dir):
    return D.ai_function_builder(_logs(spark, sf_dir).query_text, CFG.run_ts)


@register("mi_job_missions", _with(*_LOGS_SQL) + O.job_missions())
def q_job_missions(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    j = CFG.jobs
    return D._union([
        D.job_creator(logs.jobs, j, CFG.run_ts),
        D.scheduler(logs.jobs, j, CFG.run_ts),
        D.multi_task_orchestrator(logs.jobs, logs.job_tasks, j, CFG.run_ts, CFG.thresholds),
    ])


@register("mi_pipeline_missions", _with(*_LOGS_SQL) + O.pipeline_missions())
def q_pipeline_missions(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    j = CFG.jobs
    return D._union([
        D.pipeline_builder(logs.pipelines, j, CFG.run_ts),
        D.pipeline_runner(logs.pipeline_updates, j, CFG.run_ts),
        D.auto_loader_pioneer(logs.pipelines, logs.usage, CFG.activity, CFG.run_ts),
    ])


@register("mi_consistent_operator", _with(*_LOGS_SQL) + O.consistent_operator())
def q_consistent(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return D.consistent_operator(logs.job_runs, logs.jobs, logs.pipeline_updates, CFG.jobs, CFG.run_ts,
                                 CFG.consistent_window, CFG.thresholds)


@register("latest_job_versions", _with(*_LOGS_SQL) + O._LATEST.format(where="").replace("SELECT * FROM", "SELECT workspace_id, job_id, creator_user_name, trigger_type, change_time, delete_time, version FROM", 1))
def q_latest_jobs(spark, sf_dir):
    return D.latest_jobs(_logs(spark, sf_dir).jobs)


def _run(spark, sf_dir) -> A.ScoringRun:
    return A.ScoringRun(spark, _logs(spark, sf_dir), CFG)


@register("mission_completions", _with(*O.run_ctes()) + "SELECT * FROM completions")
def q_completions(spark, sf_dir):
    return _run(spark, sf_dir).final("mission_completions")


@register("user_points_fact", _with(*O.run_ctes()) + "SELECT * FROM fact")
def q_points_fact(spark, sf_dir):
    return _run(spark, sf_dir).final("user_points_fact")


@register("user_streaks", _with(*O.run_ctes()) + "SELECT * FROM streaks")
def q_streaks(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    return A.user_streaks(_daily(logs), CFG.activity)


_PROFILE_SQL = _with(*O.run_ctes(), f"badges AS ({O.badges_sql()})") + f"""
SELECT t.user_id, split_part(t.user_id, '@', 1) AS display_name, CAST(t.total_points AS INTEGER) AS total_points,
  {O.tier_sql('t.total_points')} AS level,
  coalesce(s.current_streak, 0) AS current_streak, coalesce(s.max_streak, 0) AS max_streak,
  coalesce(b.badge_count, 0) AS badge_count, CAST(t.missions_completed AS INTEGER) AS missions_completed,
  d.first_activity_date, d.last_activity_date, coalesce(p.distinct_products, 0) AS distinct_products_used,
  {O.RUN_TS} AS updated_at
FROM totals t LEFT JOIN streaks s USING (user_id) LEFT JOIN dates d USING (user_id)
LEFT JOIN (SELECT user_id, CAST(count(*) AS INTEGER) AS badge_count FROM badges GROUP BY 1) b USING (user_id)
LEFT JOIN products p USING (user_id)
WHERE t.user_id LIKE '%@%'"""


@register("user_profile_snapshot", _PROFILE_SQL)
def q_profile(spark, sf_dir):
    return _run(spark, sf_dir).final("user_profile_snapshot")


_BOARD_SQL = _with(*O.run_ctes()) + f"""
SELECT user_id, split_part(user_id, '@', 1) AS display_name, CAST(total_points AS INTEGER) AS total_points,
  CAST(weekly_points AS INTEGER) AS weekly_points, CAST(monthly_points AS INTEGER) AS monthly_points,
  {O.tier_sql('total_points')} AS level,
  CAST(row_number() OVER (ORDER BY total_points DESC, user_id) AS INTEGER) AS all_time_rank,
  CAST(row_number() OVER (ORDER BY weekly_points DESC, user_id) AS INTEGER) AS weekly_rank,
  CAST(row_number() OVER (ORDER BY monthly_points DESC, user_id) AS INTEGER) AS monthly_rank,
  {O.RUN_TS} AS updated_at
FROM totals WHERE user_id LIKE '%@%'"""


@register("leaderboard", _BOARD_SQL)
def q_leaderboard(spark, sf_dir):
    return _run(spark, sf_dir).final("leaderboard")


@register("badges", _with(*O.run_ctes()) + O.badges_sql())
def q_badges(spark, sf_dir):
    return _run(spark, sf_dir).final("badges")


_NOTES_SQL = _with(*O.run_ctes(), f"badges AS ({O.badges_sql()})") + """
SELECT user_id, 'mission_complete' AS notification_type, 'Mission Complete: ' || mission_name AS title,
  'You earned ' || CAST(points_awarded AS VARCHAR) || ' points for completing ' || mission_name || '!' AS message,
  mission_id, points_awarded AS points, scored_at AS created_at
FROM (SELECT DISTINCT * FROM completions)
UNION ALL
SELECT user_id, 'badge_earned', 'Badge Unlocked: ' || badge_name,
  'Congratulations! You have earned the ' || badge_name || ' badge!', badge_id, 0, earned_at
FROM badges"""


@register("notifications", _NOTES_SQL)
def q_notifications(spark, sf_dir):
    return _run(spark, sf_dir).final("notifications")


@register("top10_leaderboard", _BOARD_SQL.replace("FROM totals WHERE user_id LIKE '%@%'",
                                                  "FROM totals WHERE user_id LIKE '%@%' ORDER BY all_time_rank LIMIT 10"))
def q_top10(spark, sf_dir):
    """TK-1: top 10 by all-time rank (a top-k report: the limit is the feature)."""
    b = _run(spark, sf_dir).final("leaderboard")
    return b.orderBy("all_time_rank").limit(10)


_PROGRESS_SQL = _with(*O.run_ctes()) + """
SELECT user_id, CAST(total_points AS INTEGER) AS total_points, level, level_floor, level_ceiling,
  CAST(least(100, trunc((total_points - level_floor) / greatest(1, level_ceiling - level_floor) * 100)) AS INTEGER) AS progress_pct,
  CASE WHEN total_points >= 5000 THEN 0 ELSE greatest(0, level_ceiling - total_points) END AS points_to_next,
  CASE WHEN total_points >= 5000 THEN 100 ELSE CAST(least(100, greatest(0, floor((total_points - level_floor) / (level_ceiling - level_floor) * 100 + 0.5))) AS INTEGER) END AS progress_pct_ui
FROM (SELECT user_id, total_points,
  CASE WHEN total_points >= 5000 THEN 'Elite' WHEN total_points >= 2000 THEN 'Platinum' WHEN total_points >= 800 THEN 'Gold' WHEN total_points >= 300 THEN 'Silver' ELSE 'Bronze' END AS level,
  CASE WHEN total_points >= 5000 THEN 5000 WHEN total_points >= 2000 THEN 2000 WHEN total_points >= 800 THEN 800 WHEN total_points >= 300 THEN 300 ELSE 0 END AS level_floor,
  CASE WHEN total_points >= 5000 THEN 6000 WHEN total_points >= 2000 THEN 5000 WHEN total_points >= 800 THEN 2000 WHEN total_points >= 300 THEN 800 ELSE 300 END AS level_ceiling
  FROM totals WHERE user_id LIKE '%@%')"""


@register("level_progress", _PROGRESS_SQL)
def q_level_progress(spark, sf_dir):
    """PR-4..6: tier, floor, ceiling, truncated and rounded progress."""
    p = _run(spark, sf_dir).final("user_profile_snapshot")
    tp = F.col("total_points")
    return p.select("user_id", "total_points", X.tier(tp).alias("level"), X.tier_floor(tp).alias("level_floor"),
                    X.tier_ceiling(tp).alias("level_ceiling"), X.tier_progress_pct(tp).alias("progress_pct"),
                    X.tier_points_to_next(tp).alias("points_to_next"),
                    X.tier_progress_pct_rounded(tp).alias("progress_pct_ui"))
