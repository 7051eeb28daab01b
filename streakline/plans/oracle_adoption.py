"""DuckDB SQL for the scoring run (the correctness oracle of the Spark plans).

Generated from the same rule tables and stand-in constants, so a threshold
changes in one place. Quantities are summed as DECIMAL(18,2) on both sides.
"""

from __future__ import annotations

import datetime as _dt

from .. import rules as R
from ..sources import standin_sql as Q
from .adoption import RunConfig

CFG = RunConfig()


def _date(s: str, minus_days: int = 0) -> str:
    d = _dt.date.fromisoformat(s) - _dt.timedelta(days=minus_days)
    return f"DATE '{d.isoformat()}'"


def _month_floor(s: str, minus_days: int) -> str:
    d = _dt.date.fromisoformat(s) - _dt.timedelta(days=minus_days)
    return f"DATE '{d.replace(day=1).isoformat()}'"


RUN_TS = f"TIMESTAMP '{CFG.run_ts}'"


def _emit(mission_id: str, completed: str, p_start: str, p_end: str) -> str:
    _, name, points, *_ = R.mission_lookup()[mission_id]
    name_sql = name.replace("'", "''")
    return (f"'{mission_id}' AS mission_id, '{name_sql}' AS mission_name, CAST({points} AS INTEGER) AS points_awarded, "
            f"CAST({completed} AS TIMESTAMP) AS completed_at, CAST({p_start} AS DATE) AS period_start, "
            f"CAST({p_end} AS DATE) AS period_end, {RUN_TS} AS scored_at")


def _nb(c: str) -> str:
    return f"{c} IS NOT NULL AND {c} <> ''"


def first_steps(cfg: RunConfig = CFG) -> str:
    a = cfg.activity
    sp = " ".join(f"AND run_as NOT LIKE '{p}'" for p in R.SERVICE_PRINCIPAL_MARKERS)
    return f"""SELECT run_as AS user_id, {_emit('first_steps', 'min(usage_date)', 'min(usage_date)', 'min(usage_date)')}
FROM usage WHERE {_nb('run_as')} {sp} AND usage_quantity > 0 AND usage_date >= {_date(a.as_of, a.lookback_days)}
GROUP BY run_as"""


def product_monthly(cfg: RunConfig = CFG) -> str:
    a, th = cfg.activity, cfg.thresholds
    base = f"""SELECT run_as AS user_id, CAST(date_trunc('month', usage_date) AS DATE) AS month, billing_origin_product,
  sum(CAST(usage_quantity AS DECIMAL(18,2))) AS qty, max(usage_date) AS last_day
FROM usage WHERE {_nb('run_as')} AND usage_quantity > 0 AND usage_date >= {_month_floor(a.as_of, R.MONTHLY_LOOKBACK_DAYS)}
GROUP BY 1, 2, 3"""
    parts = []
    for mission_id, product, _ in R.PRODUCT_RULES:
        parts.append(f"""SELECT user_id, {_emit(mission_id, 'last_day', 'month', 'last_day(month)')}
FROM ({base}) m WHERE billing_origin_product = '{product}' AND qty >= {th.product[mission_id]}""")
    parts.append(f"""SELECT user_id, {_emit('cross_product_champion', 'max(last_day)', 'month', 'last_day(month)')}
FROM ({base}) m GROUP BY user_id, month HAVING count(*) >= {th.cross_product_min}""")
    return "\nUNION ALL\n".join(parts)


def daily_driver(cfg: RunConfig = CFG) -> str:
    a, th = cfg.activity, cfg.thresholds
    return f"""SELECT run_as AS user_id, {_emit('daily_driver', 'max(usage_date)', _date(a.as_of, R.DAILY_DRIVER_WINDOW), _date(a.as_of))}
FROM usage WHERE {_nb('run_as')} AND usage_quantity > 0 AND usage_date >= {_date(a.as_of, R.DAILY_DRIVER_WINDOW)}
GROUP BY run_as HAVING count(DISTINCT usage_date) >= {th.daily_driver_days}"""


def weekly_points(cfg: RunConfig = CFG) -> str:
    a = cfg.activity
    return f"""SELECT run_as AS user_id, 'consumption' AS event_type, 'weekly_dbu' AS mission_id,
  CAST(floor(sum(CAST(usage_quantity AS DECIMAL(18,2))) / {R.CONSUMPTION_UNITS_PER_POINT}) AS INTEGER) AS points,
  concat('Weekly compute: ', CAST(round(sum(CAST(usage_quantity AS DECIMAL(18,2))), 1) AS VARCHAR), ' DBUs') AS reason,
  CAST(max(usage_date) AS TIMESTAMP) AS event_timestamp, {RUN_TS} AS scored_at
FROM usage WHERE {_nb('run_as')} AND usage_quantity > 0 AND usage_date >= {_date(a.as_of, R.CONSUMPTION_LOOKBACK_DAYS)}
GROUP BY run_as, date_trunc('week', usage_date)
HAVING sum(CAST(usage_quantity AS DECIMAL(18,2))) >= {R.CONSUMPTION_UNITS_PER_POINT}"""


def audit_missions(cfg: RunConfig = CFG) -> str:
    a, th = cfg.activity, cfg.thresholds
    parts = []
    for mission_id, services, actions, shape, _ in R.AUDIT_RULES:
        conds = [f"action_name IN ({', '.join(repr(x) for x in actions)})"]
        if services is not None:
            svc = services if isinstance(services, list) else [services]
            conds.append(f"service_name IN ({', '.join(repr(x) for x in svc)})")
        where = (" AND ".join(conds) + f" AND status_code = 200 AND {_nb('email')}"
                 f" AND event_time >= {_date(a.as_of, a.lookback_days)}")
        k = th.audit[mission_id]
        if shape == "A":
            parts.append(f"""SELECT email AS user_id, {_emit(mission_id, 'min(event_time)', 'min(event_time)', 'min(event_time)')}
FROM audit WHERE {where} GROUP BY email HAVING count(*) >= {k}""")
        elif shape == "B":
            wk = "CAST(date_trunc('week', event_time) AS DATE)"
            parts.append(f"""SELECT email AS user_id, {_emit(mission_id, 'max(event_time)', wk, wk + ' + 6')}
FROM audit WHERE {where} GROUP BY email, {wk} HAVING count(*) >= {k}""")
        else:
            parts.append(f"""SELECT email AS user_id, {_emit(mission_id, 'max(event_time)', 'min(event_time)', 'max(event_time)')}
FROM audit WHERE {where} GROUP BY email HAVING count(*) >= {k}""")
    return "\nUNION ALL\n".join(parts)


def assistant_user(cfg: RunConfig = CFG) -> str:
    a = cfg.activity
    return f"""SELECT initiated_by AS user_id, {_emit('genie_code_user', 'min(event_time)', 'min(event_time)', 'min(event_time)')}
FROM assistant_events WHERE initiated_by LIKE '%@%' AND event_time >= {_date(a.as_of, a.lookback_days)}
GROUP BY initiated_by"""


def query_weekly(cfg: RunConfig = CFG) -> str:
    a, th = cfg.activity, cfg.thresholds
    types = ", ".join(repr(t) for t in R.COUNTED_STATEMENT_TYPES)
    wk = "CAST(date_trunc('week', start_time) AS DATE)"
    parts = []
    for mission_id, _ in R.QUERY_RULES:
        parts.append(f"""SELECT executed_by AS user_id, {_emit(mission_id, 'max(start_time)', wk, wk + ' + 6')}
FROM query_history WHERE {_nb('executed_by')} AND statement_type IN ({types})
  AND start_time >= {_date(a.as_of, a.lookback_days)}
GROUP BY executed_by, {wk} HAVING count(*) >= {th.query[mission_id]}""")
    return "\nUNION ALL\n".join(parts)


def ai_function_builder(cfg: RunConfig = CFG) -> str:
    return f"""SELECT executed_by AS user_id, {_emit('ai_function_builder', 'min(start_time)', 'min(start_time)', 'min(start_time)')}
FROM query_history WHERE lower(statement_text) LIKE '{R.AI_FUNCTION_PATTERN}' AND {_nb('executed_by')}
  AND execution_status = 'FINISHED'
GROUP BY executed_by"""


_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, job_id
  ORDER BY change_time DESC, version DESC, creator_user_name DESC, trigger_type DESC, delete_time DESC NULLS LAST) AS rn
  FROM jobs {where}) WHERE rn = 1"""


def job_missions(cfg: RunConfig = CFG) -> str:
    j, th = cfg.jobs, cfg.thresholds
    since = _date(j.as_of, j.lookback_days)
    latest_recent = _LATEST.format(where=f"WHERE change_time >= {since}")
    return f"""SELECT creator_user_name AS user_id, {_emit('job_creator', 'min(change_time)', 'min(change_time)', 'min(change_time)')}
FROM jobs WHERE {_nb('creator_user_name')} AND delete_time IS NULL AND change_time >= {since}
GROUP BY creator_user_name
UNION ALL
SELECT creator_user_name AS user_id, {_emit('scheduler', 'min(change_time)', 'min(change_time)', 'min(change_time)')}
FROM ({latest_recent}) WHERE trigger_type IN ({', '.join(repr(t) for t in R.SCHEDULE_TRIGGERS)})
  AND delete_time IS NULL AND {_nb('creator_user_name')}
GROUP BY creator_user_name
UNION ALL
SELECT j.creator_user_name AS user_id, {_emit('multi_task_orchestrator', 'min(j.change_time)', 'min(j.change_time)', 'min(j.change_time)')}
FROM ({latest_recent}) j JOIN job_tasks t ON j.job_id = t.job_id AND j.workspace_id = t.workspace_id
WHERE j.delete_time IS NULL AND {_nb('j.creator_user_name')}
GROUP BY j.creator_user_name HAVING count(DISTINCT t.task_key) >= {th.multi_task_min}"""


def pipeline_missions(cfg: RunConfig = CFG) -> str:
    j, a = cfg.jobs, cfg.activity
    since = _date(j.as_of, j.lookback_days)
    etl = ", ".join(repr(t) for t in R.ETL_PIPELINE_TYPES)
    return f"""SELECT created_by AS user_id, {_emit('pipeline_builder', 'min(change_time)', 'min(change_time)', 'min(change_time)')}
FROM pipelines WHERE pipeline_type IN ({etl}) AND delete_time IS NULL AND {_nb('created_by')} AND change_time >= {since}
GROUP BY created_by
UNION ALL
SELECT run_as_user_name AS user_id, {_emit('pipeline_runner', 'min(period_start_time)', 'min(period_start_time)', 'min(period_start_time)')}
FROM pipeline_updates WHERE result_state = 'COMPLETED' AND {_nb('run_as_user_name')} AND period_start_time >= {since}
GROUP BY run_as_user_name
UNION ALL
SELECT p.created_by AS user_id, {_emit('auto_loader_pioneer', 'min(p.change_time)', 'min(p.change_time)', 'min(p.change_time)')}
FROM pipelines p WHERE p.pipeline_type IN ({etl}) AND p.delete_time IS NULL AND {_nb('p.created_by')}
  AND p.pipeline_id IN (SELECT dlt_pipeline_id FROM usage WHERE billing_origin_product = '{R.DLT_PRODUCT}'
                        AND usage_date >= {_date(a.as_of, a.lookback_days)} AND dlt_pipeline_id IS NOT NULL)
GROUP BY p.created_by"""


def consistent_operator(cfg: RunConfig = CFG) -> str:
    j, th = cfg.jobs, cfg.thresholds
    since = _date(j.as_of, cfg.consistent_window)
    latest_all = _LATEST.format(where="")
    return f"""SELECT user_id, {_emit('consistent_operator', 'max(run_date)', since, _date(j.as_of))}
FROM (
  SELECT j.creator_user_name AS user_id, CAST(r.period_start_time AS DATE) AS run_date
  FROM job_runs r JOIN ({latest_all}) j ON r.job_id = j.job_id AND r.workspace_id = j.workspace_id
  WHERE r.result_state IS NOT NULL AND {_nb('j.creator_user_name')} AND r.period_start_time >= {since}
  UNION
  SELECT run_as_user_name AS user_id, CAST(period_start_time AS DATE) AS run_date
  FROM pipeline_updates WHERE result_state IS NOT NULL AND {_nb('run_as_user_name')} AND period_start_time >= {since}
) d GROUP BY user_id HAVING count(DISTINCT run_date) >= {th.consistent_operator_days}"""


ALL_LOGS = [Q.USAGE, Q.AUDIT, Q.QUERY_HISTORY, Q.ASSISTANT, Q.JOBS, Q.JOB_TASKS, Q.JOB_RUNS, Q.PIPELINES,
            Q.PIPELINE_UPDATES]


def detected(cfg: RunConfig = CFG) -> str:
    parts = [first_steps(cfg), job_missions(cfg), pipeline_missions(cfg), consistent_operator(cfg),
             query_weekly(cfg), audit_missions(cfg), assistant_user(cfg), ai_function_builder(cfg),
             product_monthly(cfg), daily_driver(cfg)]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


def run_ctes(cfg: RunConfig = CFG) -> list[str]:
    """CTEs for one scoring run on an empty target, humans only (see T-10)."""
    a = cfg.activity
    since = _date(a.as_of, a.lookback_days)
    wk = f"({_date(a.as_of)} - CAST(((dayofweek({_date(a.as_of)}) + 1) % 7) AS INTEGER))"
    mo = f"CAST(date_trunc('month', {_date(a.as_of)}) AS DATE)"
    return ALL_LOGS + [
        f"completions AS (SELECT * FROM ({detected(cfg)}) WHERE user_id LIKE '%@%')",
        f"fact AS (SELECT * FROM ({weekly_points(cfg)}) WHERE user_id LIKE '%@%'"
        "  UNION ALL SELECT user_id, 'mission_completion', mission_id, min(points_awarded),"
        "  min('Completed mission: ' || mission_name), completed_at, min(scored_at)"
        "  FROM completions GROUP BY user_id, mission_id, completed_at)",
        f"""day_rows AS (SELECT run_as AS user_id, usage_date FROM usage
  WHERE {_nb('run_as')} AND usage_quantity > 0 AND usage_date >= {since} GROUP BY 1, 2)""",
        """islands AS (SELECT user_id, grp, count(*) AS len, max(usage_date) AS e FROM (
  SELECT user_id, usage_date, usage_date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY usage_date) AS INTEGER) AS grp
  FROM day_rows) GROUP BY 1, 2)""",
        "streaks AS (SELECT user_id, CAST(max(len) AS INTEGER) AS max_streak,"
        " CAST(arg_max(len, e) AS INTEGER) AS current_streak FROM islands GROUP BY 1)",
        f"""products AS (SELECT run_as AS user_id, CAST(count(DISTINCT billing_origin_product) AS INTEGER) AS distinct_products
  FROM usage WHERE {_nb('run_as')} AND usage_quantity > 0 AND usage_date >= {since} GROUP BY 1)""",
        f"""dates AS (SELECT run_as AS user_id, min(usage_date) AS first_activity_date, max(usage_date) AS last_activity_date
  FROM usage WHERE {_nb('run_as')} AND usage_date >= {since} GROUP BY 1)""",
        f"""totals AS (SELECT user_id, sum(pts) AS total_points, sum(is_m) AS missions_completed,
  sum(CASE WHEN ts_at >= {wk} THEN pts ELSE 0 END) AS weekly_points,
  sum(CASE WHEN ts_at >= {mo} THEN pts ELSE 0 END) AS monthly_points
  FROM (SELECT user_id, points_awarded AS pts, completed_at AS ts_at, 1 AS is_m FROM completions
        UNION ALL SELECT user_id, points, event_timestamp, 0 FROM fact WHERE event_type = 'consumption')
  GROUP BY user_id)""",
    ]


def tier_sql(col: str) -> str:
    from ..functions.exprs import LEVEL_TIERS
    whens = " ".join(f"WHEN {col} >= {floor} THEN '{name}'" for name, floor in LEVEL_TIERS[:-1])
    return f"CASE {whens} ELSE '{LEVEL_TIERS[-1][0]}' END"


def badges_sql(cfg: RunConfig = CFG) -> str:
    parts = []
    for badge_id, name, icon, kind, k, missions in R.BADGES:
        if badge_id not in R.SCORED_BADGES:
            continue
        sel = f"'{badge_id}' AS badge_id, '{name}' AS badge_name, '{icon}' AS badge_icon, {RUN_TS} AS earned_at"
        if kind == "products":
            parts.append(f"SELECT user_id, {sel} FROM products WHERE distinct_products >= {k}")
        elif kind == "streak":
            parts.append(f"SELECT user_id, {sel} FROM streaks WHERE max_streak >= {k}")
        elif kind == "missions":
            ms = ", ".join(repr(m) for m in missions)
            parts.append(f"SELECT user_id, {sel} FROM completions WHERE mission_id IN ({ms}) GROUP BY user_id"
                         f" HAVING count(DISTINCT mission_id) >= {k}")
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p}) WHERE user_id LIKE '%@%'" for p in parts)
