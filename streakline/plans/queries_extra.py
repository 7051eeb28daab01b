"""Registered queries of the further read models (see ``extras``), with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..operators import detect as D
from ..sources import standin_sql as Q
from . import extras as XT
from . import oracle_adoption as O
from .event_game import EventGame
from .queries_adoption import CFG, _daily, _logs, _run
from .queries_event import CTES as EV_CTES
from .registry import register


def _ev(*extra: str) -> str:
    return "WITH " + ",\n".join(EV_CTES + list(extra)) + "\n"


def _run_with(*extra: str) -> str:
    return "WITH " + ",\n".join(O.run_ctes() + list(extra)) + "\n"


def _g(spark, sf_dir) -> EventGame:
    return EventGame(spark, sf_dir)


def _sq(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


CATALOG_VALUES = ", ".join(f"({_sq(m[0])}, {_sq(m[4])}, {_sq(m[3])})" for m in R.MISSIONS)
CATALOG_CTE = f"catalog AS (SELECT * FROM (VALUES {CATALOG_VALUES}) c(mission_id, track, category))"


@register("ev_workspace_health", _ev() + """SELECT w.event_id, w.workspace_id,
  CAST(coalesce(sc.n, 0) AS BIGINT) AS scoring_events, CAST(coalesce(sc.p, 0) AS BIGINT) AS points,
  CAST(coalesce(vc.v, 0) AS BIGINT) AS validations, CAST(coalesce(vc.ps, 0) AS BIGINT) AS validation_passes
FROM (SELECT DISTINCT event_id, workspace_id FROM participants WHERE workspace_id IS NOT NULL) w
LEFT JOIN (SELECT event_id, workspace_id, count(*) AS n, sum(points_delta) AS p FROM ledger
           WHERE workspace_id IS NOT NULL GROUP BY 1, 2) sc USING (event_id, workspace_id)
LEFT JOIN (SELECT a.workspace_id, count(*) AS v, sum(CASE WHEN r.status = 'passed' THEN 1 ELSE 0 END) AS ps
           FROM validation_results r JOIN attempts a USING (attempt_id) WHERE a.workspace_id IS NOT NULL
           GROUP BY 1) vc USING (workspace_id)""")
def q_workspace_health(spark, sf_dir):
    return XT.workspace_health(_g(spark, sf_dir))


@register("ev_quest_progress", _ev() + """SELECT d.event_id, d.team_id, d.quest_id, z.task_count, d.completed,
  round_even(100.0 * d.completed / z.task_count, 1) AS completion_pct,
  (z.task_count > 0 AND d.completed = z.task_count) AS complete
FROM (SELECT p.event_id, p.team_id, k.pack_version_id, k.quest_id, count(*) AS completed
      FROM pairs p JOIN tasks k USING (task_id) GROUP BY 1, 2, 3, 4) d
JOIN (SELECT pack_version_id, quest_id, count(*) AS task_count FROM tasks GROUP BY 1, 2) z
  USING (pack_version_id, quest_id)""")
def q_quest_progress(spark, sf_dir):
    """AG-23 / CO-26 (capability heatmap): per team and quest."""
    return XT.quest_progress(_g(spark, sf_dir))


@register("ev_quest_leaderboard", _ev() + """SELECT *, CAST(rank() OVER (PARTITION BY event_id, quest_id
  ORDER BY total_points DESC, last_scored_at ASC NULLS LAST) AS INTEGER) AS rank
FROM (SELECT r.event_id, k.quest_id, r.resolved_team_id AS team_id, CAST(sum(r.points_delta) AS BIGINT) AS total_points,
             max(r.created_at) AS last_scored_at
      FROM resolved r JOIN tasks k USING (task_id) WHERE r.resolved_team_id IS NOT NULL GROUP BY 1, 2, 3)""")
def q_quest_leaderboard(spark, sf_dir):
    return XT.quest_leaderboard(_g(spark, sf_dir))


@register("ev_frozen_leaderboard", _ev(
    """frozen_ledger AS (SELECT l.* FROM ledger l JOIN competitions c USING (event_id)
  WHERE c.scoring_frozen_at IS NULL OR l.created_at <= c.scoring_frozen_at
     OR l.source_type = 'manual_adjustment')""",
    """frozen_scores AS (SELECT l.event_id, coalesce(l.team_id, m.team_id) AS team_id,
  CAST(sum(l.points_delta) AS BIGINT) AS total_points, count(*) AS scoring_events, max(l.created_at) AS last_scored_at
  FROM frozen_ledger l LEFT JOIN identity_map m
    ON m.event_id = l.event_id AND m.workspace_id = l.workspace_id AND m.lab_user_email = l.user_id
  WHERE coalesce(l.team_id, m.team_id) IS NOT NULL GROUP BY 1, 2)""") + """
SELECT s.event_id, s.team_id, t.display_name, s.total_points,
  CAST(rank() OVER (PARTITION BY s.event_id ORDER BY s.total_points DESC, s.last_scored_at ASC NULLS LAST) AS INTEGER) AS rank,
  s.last_scored_at FROM frozen_scores s JOIN teams t ON s.team_id = t.team_id""")
def q_frozen_leaderboard(spark, sf_dir):
    """CO-25: ranks as of the freeze moment."""
    return XT.frozen_leaderboard(_g(spark, sf_dir))


@register("ev_first_blood_bonus", _ev() + f"""SELECT event_id,
  concat_ws(':', 'team', coalesce(nullif(CAST(team_id AS VARCHAR), ''), 'noteam'), CAST(event_id AS VARCHAR),
            CAST(task_id AS VARCHAR), 'first_blood') AS idempotency_key,
  team_id, task_id, {XT.FIRST_BLOOD_BONUS} AS points_delta, created_at FROM first_solves""")
def q_first_blood(spark, sf_dir):
    return XT.first_blood_bonus(_g(spark, sf_dir))


_BOARD_CTE = (f"board AS (SELECT user_id, CAST(total_points AS INTEGER) AS total_points, "
              f"{O.tier_sql('total_points')} AS level FROM totals WHERE user_id LIKE '%@%')")


@register("level_cohorts", _run_with(_BOARD_CTE) + f"""SELECT a.level, a.members, a.total_points,
  CAST(floor(a.total_points / a.members + 0.5) AS BIGINT) AS avg_points, t.top_users
FROM (SELECT level, count(*) AS members, CAST(sum(total_points) AS BIGINT) AS total_points FROM board GROUP BY 1) a
JOIN (SELECT level, string_agg(user_id, ',' ORDER BY rn) AS top_users FROM (
        SELECT level, user_id, row_number() OVER (PARTITION BY level ORDER BY total_points DESC, user_id) AS rn
        FROM board) WHERE rn <= {XT.COHORT_TOP} GROUP BY 1) t USING (level)""")
def q_level_cohorts(spark, sf_dir):
    return XT.level_cohorts(_run(spark, sf_dir).final("leaderboard"))


_PROFILE_LITE = (f"prof AS (SELECT user_id, {O.tier_sql('total_points')} AS level, "
                 f"CAST(missions_completed AS INTEGER) AS missions_completed FROM totals WHERE user_id LIKE '%@%')")


@register("admin_stats", _run_with(_PROFILE_LITE) + """
SELECT 'users' AS metric, CAST(NULL AS VARCHAR) AS key, CAST(count(DISTINCT user_id) AS DOUBLE) AS value FROM prof
UNION ALL SELECT 'completions', NULL, CAST(count(*) AS DOUBLE) FROM completions
UNION ALL SELECT 'by_mission', mission_id, CAST(count(*) AS DOUBLE) FROM completions GROUP BY mission_id
UNION ALL SELECT 'by_level', level, CAST(count(*) AS DOUBLE) FROM prof GROUP BY level
UNION ALL SELECT 'non_bronze', NULL, CAST(count(*) FILTER (WHERE level <> 'Bronze') AS DOUBLE) FROM prof
UNION ALL SELECT 'avg_completions', NULL,
  CASE WHEN count(*) > 0 THEN round(sum(missions_completed) / count(*), 1) ELSE 0.0 END FROM prof""")
def q_admin_stats(spark, sf_dir):
    run = _run(spark, sf_dir)
    return XT.admin_stats(run.final("mission_completions"), run.final("user_profile_snapshot"))


_LIFETIME = [Q.USAGE,
             "daily AS (SELECT run_as AS user_id, usage_date, sum(CAST(usage_quantity AS DECIMAL(18,2))) AS qty "
             "FROM usage WHERE run_as IS NOT NULL AND run_as <> '' AND usage_quantity > 0 GROUP BY 1, 2)",
             "cum AS (SELECT *, sum(qty) OVER (PARTITION BY user_id ORDER BY usage_date "
             "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM daily)"]


def _milestones_sql() -> str:
    parts = [f"""SELECT user_id, '{m}' AS mission_id, '{n}' AS mission_name, CAST({p} AS INTEGER) AS points_awarded,
  CAST(min(usage_date) AS TIMESTAMP) AS completed_at, min(usage_date) AS period_start, min(usage_date) AS period_end,
  {O.RUN_TS} AS scored_at FROM cum WHERE cum >= {CFG.thresholds.lifetime[m]} GROUP BY user_id"""
             for m, n, _, p in R.LIFETIME_MILESTONES]
    return "WITH " + ",\n".join(_LIFETIME) + "\n" + "\nUNION ALL\n".join(parts)


@register("mi_lifetime_milestones", _milestones_sql())
def q_milestones(spark, sf_dir):
    """MI-39: lifetime consumption milestones from a running total over the whole log."""
    return XT.lifetime_advance(None, XT.usage_days(_logs(spark, sf_dir).usage), CFG.run_ts, CFG.thresholds)[0]


@register("user_lifetime_totals", "WITH " + ",\n".join(_LIFETIME) + """
SELECT user_id, CAST(sum(qty) AS DOUBLE) AS total, max(usage_date) AS through FROM daily GROUP BY user_id""")
def q_lifetime_totals(spark, sf_dir):
    """MI-39: the stored totals that the next run carries on from."""
    totals = XT.lifetime_advance(None, XT.usage_days(_logs(spark, sf_dir).usage), CFG.run_ts, CFG.thresholds)[1]
    return totals.select("user_id", F.col("total").cast("double").alias("total"), "through")


def _declared_badges_sql() -> str:
    out = []
    for badge_id, name, icon, kind, k, missions in R.BADGES:
        sel = f"'{badge_id}' AS badge_id, '{name}' AS badge_name, '{icon}' AS badge_icon, {O.RUN_TS} AS earned_at"
        if badge_id == "ai_pioneer":
            ms = ", ".join(repr(m) for m in missions)
            out.append(f"SELECT user_id, {sel} FROM completions WHERE mission_id IN ({ms}) GROUP BY user_id "
                       f"HAVING count(DISTINCT mission_id) >= {k}")
        elif badge_id == "full_stack":
            out.append(f"SELECT c.user_id, {sel} FROM completions c JOIN catalog m USING (mission_id) "
                       f"GROUP BY c.user_id HAVING count(DISTINCT m.category) >= {k}")
    return _run_with(CATALOG_CTE) + "\nUNION ALL\n".join(out)


@register("badges_declared", _declared_badges_sql())
def q_declared_badges(spark, sf_dir):
    """CO-7: the catalog-only badges (AI pioneer, full stack) from the same rule operator."""
    from .adoption import detect_badges
    run = _run(spark, sf_dir)
    return detect_badges(run.products, run.streaks, run.final("mission_completions"), CFG.run_ts,
                         which=["ai_pioneer", "full_stack"])


def _notes_cte() -> list[str]:
    from .queries_adoption import _NOTES_SQL
    body = _NOTES_SQL[_NOTES_SQL.index("\nSELECT user_id, 'mission_complete'"):]
    return [f"badges AS ({O.badges_sql()})", f"notes AS ({body})"]


@register("latest_notifications", _run_with(*_notes_cte()) + f"""SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY created_at DESC, notification_type, mission_id, title) AS position FROM notes)
WHERE position <= {XT.NOTIFICATION_PAGE}""")
def q_latest_notes(spark, sf_dir):
    """TK-2: each user's latest 20 notifications (a page: the limit is the feature)."""
    return XT.latest_notifications(_run(spark, sf_dir).final("notifications"))


@register("ev_recent_feed", _ev() + f"""SELECT * FROM (SELECT l.event_id, l.idempotency_key, l.team_id,
  t.display_name AS team_name, l.task_id, k.task_title, l.points_delta, l.source_type, l.created_at,
  row_number() OVER (PARTITION BY l.event_id ORDER BY l.created_at DESC, l.idempotency_key) AS position
  FROM ledger l LEFT JOIN teams t ON t.team_id = l.team_id LEFT JOIN tasks k ON k.task_id = l.task_id)
WHERE position <= {XT.FEED_SIZE}""")
def q_recent_feed(spark, sf_dir):
    """TK-3 / JO-9: latest 20 scoring rows per event with names."""
    return XT.recent_feed(_g(spark, sf_dir))


_MATRIX_CTE = """matrix AS (SELECT n.event_id, n.team_id, n.team_name,
  CASE WHEN coalesce(z.total_tasks, 0) > 0 THEN round_even(100.0 * coalesce(d.completed_count, 0) / z.total_tasks, 1)
       ELSE 0.0 END AS completion_pct
FROM team_names n JOIN competitions c ON c.event_id = n.event_id
LEFT JOIN (SELECT pack_version_id, count(*) AS total_tasks FROM tasks GROUP BY 1) z ON z.pack_version_id = c.pack_version_id
LEFT JOIN (SELECT p.event_id, p.team_id, count(*) AS completed_count FROM pairs p JOIN competitions c2 USING (event_id)
           WHERE EXISTS (SELECT 1 FROM tasks k WHERE k.pack_version_id = c2.pack_version_id AND k.task_id = p.task_id)
           GROUP BY 1, 2) d ON d.event_id = n.event_id AND d.team_id = n.team_id)"""

_FOLLOW_SQL = _ev(_MATRIX_CTE,
                  """worst AS (SELECT b.event_id, 'worst_blocker' AS rule,
  'Reinforce ''' || b.task_title || ''' (' || b.quest_title || '): ' || CAST(b.solved_teams AS VARCHAR) || ' of '
    || CAST(b.total_teams AS VARCHAR) || ' teams completed it.' AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY solved_teams, failed_attempts DESC, task_id) AS pos
        FROM blockers) b
  JOIN (SELECT event_id, count(*) AS n FROM teams GROUP BY 1) n USING (event_id)
  WHERE b.pos = 1 AND b.solved_teams < greatest(n.n, 1))""",
                  """hints AS (SELECT event_id, 'hints' AS rule,
  'Hints were revealed ' || CAST(count(*) AS VARCHAR) || ' times for ' || CAST(sum(points_delta) AS VARCHAR) || ' points.' AS line
  FROM ledger WHERE source_type = 'hint_penalty' GROUP BY event_id HAVING sum(points_delta) < 0)""",
                  """weak AS (SELECT event_id, 'weak_team' AS rule,
  'Follow up with lower-completion team ' || team_name || ' (' || printf('%.1f', completion_pct) || '%).' AS line
  FROM matrix WHERE completion_pct < 50.0)""",
                  """champ AS (SELECT event_id, 'champions' AS rule,
  'Recognise top performers: ' || string_agg(display_name, ', ' ORDER BY position) || '.' AS line
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rank ASC NULLS LAST, team_id) AS position
        FROM leaderboard) WHERE position <= 3 GROUP BY event_id)""") + """
SELECT * FROM worst UNION ALL SELECT * FROM hints UNION ALL SELECT * FROM weak UNION ALL SELECT * FROM champ
UNION ALL SELECT event_id, 'no_blockers', 'No blockers detected: try a harder pack next time.' FROM competitions
  WHERE event_id NOT IN (SELECT event_id FROM worst UNION SELECT event_id FROM hints UNION SELECT event_id FROM weak)"""


@register("ev_follow_ups", _FOLLOW_SQL)
def q_follow_ups(spark, sf_dir):
    """CO-19: recommended follow-ups per event."""
    return XT.follow_ups(_g(spark, sf_dir))


def _san(x: str) -> str:
    s = f"regexp_replace(lower(trim(coalesce({x}, ''))), '[^a-z0-9]+', '_', 'g')"
    return f"coalesce(nullif(regexp_replace({s}, '^_+|_+$', '', 'g'), ''), 'x')"


@register("ev_team_namespaces", _ev() + f"""SELECT t.event_id, t.team_id, 'quest_' || {_san('c.slug')} AS team_catalog,
  'team_' || {_san('t.name')} AS team_schema FROM teams t JOIN competitions c USING (event_id)""")
def q_namespaces(spark, sf_dir):
    return XT.team_namespaces(_g(spark, sf_dir))


@register("ev_team_members", _ev() + """SELECT t.event_id, t.team_id, t.display_name,
  CAST(coalesce(m.n, 0) AS BIGINT) AS members
FROM teams t LEFT JOIN (SELECT event_id, team_id, count(*) AS n FROM participants GROUP BY 1, 2) m
  ON m.event_id = t.event_id AND m.team_id = t.team_id""")
def q_team_members(spark, sf_dir):
    return XT.team_members(_g(spark, sf_dir))


@register("mission_progress", _run_with(CATALOG_CTE) + """SELECT d.user_id, d.track, d.completed, z.total,
  CAST(floor(100.0 * d.completed / z.total + 0.5) AS INTEGER) AS pct, CAST(d.points_earned AS BIGINT) AS points_earned
FROM (SELECT c.user_id, coalesce(m.track, m.category) AS track, count(DISTINCT c.mission_id) AS completed,
             sum(c.points_awarded) AS points_earned
      FROM completions c JOIN catalog m USING (mission_id) GROUP BY 1, 2) d
JOIN (SELECT coalesce(track, category) AS track, count(*) AS total FROM catalog GROUP BY 1) z USING (track)""")
def q_mission_progress(spark, sf_dir):
    """AG-22: per user and track."""
    from .. import rules as RR
    return XT.mission_progress(_run(spark, sf_dir).final("mission_completions"), RR.missions_df(spark))


# ----------------------------- roster import (SC-7, UP-9) -------------------
LAB_HOST_SUFFIX = ".lab.example.com"
REAL_EMAIL_ABOVE = 5000.0
NEW_TEAM_BELOW = 0.0
BLANK_EMAIL_RANGE = (9000.0, 9100.0)


def write_standin_roster(spark, sf_dir) -> str:
    """Render the federated customers as a roster CSV (alias headers) in the shared folder."""
    import uuid

    from ..session import shared_path
    from ..sources import standins as S
    from ..sources.tables import Tables
    t = Tables(spark, sf_dir)
    c = t.get("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = t.get("nation", ["n_nationkey", "n_name", "n_regionkey"])
    j = c.join(n, c.c_nationkey == n.n_nationkey).filter(F.col("c_mktsegment").isin(*S.FEDERATED_SEGMENTS))
    bal = F.col("c_acctbal")
    roster = j.select(
        F.col("n_regionkey").cast("string").alias("event_id"),
        F.concat(F.lower("c_mktsegment"), F.lit(LAB_HOST_SUFFIX)).alias("workspace_host"),
        F.when(~bal.between(*BLANK_EMAIL_RANGE), S.principal("c_custkey")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(bal > REAL_EMAIL_ABOVE, F.concat(F.lit("real"), F.col("c_custkey").cast("string"),
                                                 F.lit("@corp.example.com"))).alias("real_email"),
        F.when(bal < NEW_TEAM_BELOW, F.concat(F.col("n_name"), F.lit("-LAB"))).otherwise(F.col("n_name"))
         .alias("team"))
    path = shared_path(spark, "roster", uuid.uuid4().hex)
    roster.write.option("header", True).mode("overwrite").csv(path)
    return path


_ROSTER_SQL = "WITH " + ",\n".join([Q.PARTICIPANTS, f"""roster AS (
  SELECT n.n_regionkey AS event_id, lower(c.c_mktsegment) || '{LAB_HOST_SUFFIX}' AS workspace_id,
         {Q.principal('c.c_custkey')} AS lab_user_email,
         CASE WHEN c.c_acctbal > {REAL_EMAIL_ABOVE} THEN 'real' || CAST(c.c_custkey AS VARCHAR) || '@corp.example.com' END
           AS real_email,
         CASE WHEN c.c_acctbal < {NEW_TEAM_BELOW} THEN n.n_name || '-LAB' ELSE n.n_name END AS team_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE c.c_mktsegment IN ({', '.join(repr(s) for s in ('HOUSEHOLD', 'MACHINERY'))})
    AND NOT (c.c_acctbal BETWEEN {BLANK_EMAIL_RANGE[0]} AND {BLANK_EMAIL_RANGE[1]}))"""]) + """
SELECT r.event_id, CAST(r.n AS BIGINT) AS rows, CAST(coalesce(t.n, 0) AS BIGINT) AS teams_created,
  CAST(coalesce(p.n, 0) AS BIGINT) AS participants_created, CAST(coalesce(m.n, 0) AS BIGINT) AS mappings
FROM (SELECT event_id, count(*) AS n FROM roster GROUP BY 1) r
LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, team_name FROM roster) x
           WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = x.event_id AND n_name = x.team_name)
           GROUP BY 1) t USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, coalesce(real_email, lab_user_email) AS u
           FROM roster) x WHERE NOT EXISTS (SELECT 1 FROM participants p WHERE p.workspace_id IS NULL
           AND p.event_id = x.event_id AND p.user_id = x.u) GROUP BY 1) p USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, workspace_id, lab_user_email FROM roster)
           GROUP BY 1) m USING (event_id)"""


@register("roster_import_summary", _ROSTER_SQL)
def q_roster_import(spark, sf_dir):
    """SC-7 / UP-9: a roster CSV (alias headers, blanks) imported idempotently; counts per event."""
    from ..sources import roster as RO
    from ..sources import standins as S
    from ..sources.tables import Tables
    t = Tables(spark, sf_dir)
    roster = RO.read_roster(spark, write_standin_roster(spark, sf_dir))
    teams = S.teams(t).withColumn("team_id", F.col("team_id").cast("string"))
    parts = S.participants(t).filter(F.col("workspace_id").isNull()).select(
        "event_id", "user_id", "display_name", "workspace_id", F.col("team_id").cast("string").alias("team_id"))
    imap = S.identity_map(t).withColumn("team_id", F.col("team_id").cast("string"))
    _, _, _, summary = RO.import_roster(roster, teams, parts, imap)
    return summary


@register("ev_report_csv_rows", _ev(_MATRIX_CTE.replace("n.team_name,", "n.team_name, coalesce(d.completed_count, 0) AS completed_count,"))
          + """SELECT m.event_id, m.team_id, l.rank,
  CASE WHEN substr(coalesce(m.team_name, ''), 1, 1) IN ('=', '+', '-', '@') THEN '''' || m.team_name
       ELSE coalesce(m.team_name, '') END AS team,
  CAST(coalesce(l.total_points, 0) AS BIGINT) AS total_points, m.completed_count, m.completion_pct,
  CAST(coalesce(h.n, 0) AS BIGINT) AS hints_used
FROM matrix m LEFT JOIN leaderboard l ON l.event_id = m.event_id AND l.team_id = m.team_id
LEFT JOIN (SELECT event_id, team_id, count(*) AS n FROM ledger WHERE source_type = 'hint_penalty' GROUP BY 1, 2) h
  ON h.event_id = m.event_id AND h.team_id = m.team_id""")
def q_report_csv(spark, sf_dir):
    """SK-4: the CSV export's rows."""
    from .exports import report_csv_rows
    return report_csv_rows(_g(spark, sf_dir))


@register("ev_revealed_hints", _ev() + """SELECT DISTINCT l.event_id, l.team_id, l.source_id AS hint_id, l.task_id,
  'Hint for ' || k.task_title AS body
FROM ledger l JOIN tasks k ON k.task_id = l.task_id
WHERE l.source_type = 'hint_penalty' AND l.team_id IS NOT NULL""")
def q_revealed_hints(spark, sf_dir):
    """CO-22: hint bodies are visible to a team only once revealed (charged)."""
    g = _g(spark, sf_dir)
    h = g.ledger.filter((F.col("source_type") == "hint_penalty") & F.col("team_id").isNotNull())
    return h.join(g.tasks.select("task_id", "task_title"), "task_id").select(
        "event_id", "team_id", F.col("source_id").alias("hint_id"), "task_id",
        F.concat(F.lit("Hint for "), F.col("task_title")).alias("body")).distinct()


ATTEMPT_PAGE = 100


def clamp_limit(n: int | None) -> int:
    """FI-11: page size 0/None → 100, else clamped to 1..500."""
    return ATTEMPT_PAGE if not n else max(1, min(int(n), 500))


@register("ev_latest_attempts", _ev() + f"""SELECT * FROM (SELECT a.attempt_id, a.event_id, a.team_id, a.task_id,
  a.status, a.created_at, t.display_name AS team_name, k.task_title,
  row_number() OVER (PARTITION BY a.event_id ORDER BY a.created_at DESC, a.attempt_id) AS position
  FROM attempt_status a LEFT JOIN teams t ON t.team_id = a.team_id LEFT JOIN tasks k ON k.task_id = a.task_id
  WHERE a.status IN ('failed', 'error')) WHERE position <= {ATTEMPT_PAGE}""")
def q_latest_attempts(spark, sf_dir):
    """FI-11 / TK-4: newest failed or errored attempts per event with names (a page: the limit is the feature)."""
    from ..operators.ranking import top_k_per_group
    g = _g(spark, sf_dir)
    a = g.attempts.filter(F.col("status").isin("failed", "error")).select(
        "attempt_id", "event_id", "team_id", "task_id", "status", "created_at")
    a = a.join(g.teams.select("team_id", F.col("display_name").alias("team_name")), "team_id", "left") \
        .join(g.tasks.select("task_id", "task_title"), "task_id", "left")
    return top_k_per_group(a, ["event_id"], [F.col("created_at").desc(), F.col("attempt_id").asc()],
                           clamp_limit(ATTEMPT_PAGE), "position")


@register("pipeline_status", _run_with() + """SELECT max(scored_at) AS last_run, count(*) AS fact_rows,
  count(*) > 0 AS healthy FROM fact""")
def q_pipeline_status(spark, sf_dir):
    """AG-19: last scoring run, points-fact size, healthy flag (one row)."""
    f = _run(spark, sf_dir).final("user_points_fact")
    return f.agg(F.max("scored_at").alias("last_run"), F.count(F.lit(1)).alias("fact_rows")) \
        .withColumn("healthy", F.col("fact_rows") > 0)


@register("ev_event_flags", _ev() + f"""SELECT event_id, slug, status,
  (status IN ('frozen', 'completed', 'archived') OR scoring_frozen_at IS NOT NULL) AS scoring_frozen,
  status IN ('active') AS attempts_open, status IN ('ready', 'active', 'paused') AS joinable,
  status IN ('active', 'paused', 'frozen') AS visible,
  (SELECT count(*) FROM teams t WHERE t.event_id = c.event_id) AS team_count
FROM competitions c""")
def q_event_flags(spark, sf_dir):
    """FI-12 / FI-15 / FI-16 / JO-15: event predicates and the per-event team count (decorrelated)."""
    g = _g(spark, sf_dir)
    from ..operators import event as EV
    c = g.competitions
    counts = g.teams.groupBy("event_id").agg(F.count(F.lit(1)).alias("team_count"))
    return c.join(counts, "event_id", "left").select(
        "event_id", "slug", "status", EV.frozen(c).alias("scoring_frozen"),
        F.col("status").isin(*EV.OPEN_STATES).alias("attempts_open"),
        F.col("status").isin(*EV.JOINABLE_STATES).alias("joinable"),
        F.col("status").isin(*EV.VISIBLE_STATES).alias("visible"),
        F.coalesce("team_count", F.lit(0)).alias("team_count"))


@register("ev_quest_unlocks", _ev(Q.CATALOG_QUESTS) + """SELECT p.event_id, p.team_id, q.quest_id, q.unlock_quest_slug,
  (q.unlock_quest_slug IS NULL OR coalesce(pre.complete, false)) AS unlocked
FROM (SELECT DISTINCT p.event_id, p.team_id, k.quest_id FROM pairs p JOIN tasks k USING (task_id)) p
JOIN catalog_quests q ON q.quest_id = p.quest_id
LEFT JOIN catalog_quests pq ON pq.quest_slug = q.unlock_quest_slug AND pq.pack_version_id = q.pack_version_id
LEFT JOIN (SELECT d.event_id, d.team_id, d.quest_id, d.completed = z.task_count AS complete
           FROM (SELECT p.event_id, p.team_id, k.pack_version_id, k.quest_id, count(*) AS completed
                 FROM pairs p JOIN tasks k USING (task_id) GROUP BY 1, 2, 3, 4) d
           JOIN (SELECT pack_version_id, quest_id, count(*) AS task_count FROM tasks GROUP BY 1, 2) z
             USING (pack_version_id, quest_id)) pre
  ON pre.event_id = p.event_id AND pre.team_id = p.team_id AND pre.quest_id = pq.quest_id""")
def q_quest_unlocks(spark, sf_dir):
    """CO-24: a quest gated on another is unlocked once the team completed the prerequisite.

    Evaluated for the (team, quest) pairs a team is active in — joins only,
    no team × quest product.
    """
    from ..sources import standins as S
    g = _g(spark, sf_dir)
    quests = S.catalog_quests(g.t)
    prog = XT.quest_progress(g).select("event_id", "team_id", "quest_id", "complete")
    active = g.pairs.join(g.tasks.select("task_id", "quest_id"), "task_id").select(
        "event_id", "team_id", "quest_id").distinct()
    q = active.join(quests.select("quest_id", "pack_version_id", "unlock_quest_slug"), "quest_id")
    pre_id = quests.select("pack_version_id", F.col("quest_slug").alias("unlock_quest_slug"),
                           F.col("quest_id").alias("_pre"))
    q = q.join(pre_id, ["pack_version_id", "unlock_quest_slug"], "left")
    pre = prog.select("event_id", "team_id", F.col("quest_id").alias("_pre"), F.col("complete").alias("_done"))
    q = q.join(pre, ["event_id", "team_id", "_pre"], "left")
    return q.select("event_id", "team_id", "quest_id", "unlock_quest_slug",
                    (F.col("unlock_quest_slug").isNull() | F.coalesce("_done", F.lit(False))).alias("unlocked"))


TEAM_RECENT = 10


@register("ev_team_recent", _ev() + f"""SELECT * FROM (SELECT event_id, team_id, idempotency_key, task_id, points_delta,
  source_type, created_at,
  row_number() OVER (PARTITION BY event_id, team_id ORDER BY created_at DESC, idempotency_key) AS position
  FROM ledger WHERE team_id IS NOT NULL) WHERE position <= {TEAM_RECENT}""")
def q_team_recent(spark, sf_dir):
    """AG-24: each team's latest 10 scoring rows for its dashboard (a page: the limit is the feature)."""
    from ..operators.ranking import top_k_per_group
    g = _g(spark, sf_dir)
    led = g.ledger.filter(F.col("team_id").isNotNull()).select(
        "event_id", "team_id", "idempotency_key", "task_id", "points_delta", "source_type", "created_at")
    return top_k_per_group(led, ["event_id", "team_id"], [F.col("created_at").desc(), F.col("idempotency_key").asc()],
                           TEAM_RECENT, "position")


@register("ev_task_catalog", _ev() + """SELECT q.quest_id, q.quest_slug, q.quest_title, k.task_id, k.task_slug,
  k.task_title, k.points,
  CAST(row_number() OVER (ORDER BY q.quest_sort, k.task_sort, k.task_id) AS INTEGER) AS play_order
FROM quests q JOIN tasks k ON k.quest_id = q.quest_id""")
def q_task_catalog(spark, sf_dir):
    """JO-13 / TK-12: the catalog in play order (quest order, then task order), numbered without a
    single-partition sort."""
    from ..operators.ranking import global_row_number
    g = _g(spark, sf_dir)
    j = g.quests.join(g.tasks.select("quest_id", "task_id", "task_slug", "task_title", "points", "task_sort"),
                      "quest_id")
    out = global_row_number(j, [F.col("quest_sort").asc(), F.col("task_sort").asc(), F.col("task_id").asc()],
                            "play_order")
    return out.select("quest_id", "quest_slug", "quest_title", "task_id", "task_slug", "task_title", "points",
                      "play_order")


_DIFF_SQL = "CASE " + " ".join(f"WHEN points_awarded >= {f} THEN '{n}'" for n, f in __import__(
    "streakline.functions.exprs", fromlist=["DIFFICULTY_TIERS"]).DIFFICULTY_TIERS[:-1]) + " ELSE 'Starter' END"


@register("user_mission_status", _run_with(CATALOG_CTE) + f"""SELECT c.user_id, c.mission_id, c.mission_name,
  m.category, coalesce(m.track, m.category) AS track, 'completed' AS status, {_DIFF_SQL} AS difficulty,
  max(c.completed_at) AS last_completed_at, count(*) AS times_completed
FROM completions c JOIN catalog m USING (mission_id)
GROUP BY c.user_id, c.mission_id, c.mission_name, m.category, coalesce(m.track, m.category), {_DIFF_SQL}""")
def q_user_mission_status(spark, sf_dir):
    """PR-11 / PR-7: each user's completed missions decorated with catalog fields and difficulty
    (missions not listed are 'available'; their count is in mission_progress)."""
    from ..functions import exprs as X
    from .. import rules as RR
    c = _run(spark, sf_dir).final("mission_completions")
    cat = F.broadcast(RR.missions_df(spark).select("mission_id", "category", "track"))
    j = c.join(cat, "mission_id")
    return j.groupBy("user_id", "mission_id", "mission_name", "category",
                     F.coalesce("track", "category").alias("track"), F.lit("completed").alias("status"),
                     X.difficulty("points_awarded").alias("difficulty")).agg(
        F.max("completed_at").alias("last_completed_at"), F.count(F.lit(1)).alias("times_completed"))


_BADGE_CAT = ", ".join(f"('{b[0]}', '{b[1]}', '{b[2]}')" for b in R.BADGES)


@register("user_badge_progress", _run_with(f"badges AS ({O.badges_sql()})",
                                           f"badge_catalog AS (SELECT * FROM (VALUES {_BADGE_CAT}) b(id, name, icon))") + """
SELECT u.user_id, CAST(count(*) AS BIGINT) AS earned, CAST((SELECT count(*) FROM badge_catalog) AS BIGINT) AS total,
  CAST(floor(100.0 * count(*) / (SELECT count(*) FROM badge_catalog) + 0.5) AS INTEGER) AS pct
FROM (SELECT DISTINCT b.user_id, c.id FROM badges b JOIN badge_catalog c
        ON c.id = b.badge_id
        OR regexp_replace(regexp_replace(lower(c.name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')
         = regexp_replace(regexp_replace(lower(b.badge_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) u
GROUP BY u.user_id""")
def q_user_badge_progress(spark, sf_dir):
    """PR-12 / AG-25: earned badges matched to the catalog by id or slugified name; earned / total."""
    from ..functions import exprs as X
    b = _run(spark, sf_dir).final("badges")
    cat = spark.createDataFrame([(x[0], x[1], x[2]) for x in R.BADGES], "id string, name string, icon string")
    total = len(R.BADGES)
    j = b.join(F.broadcast(cat), (F.col("id") == F.col("badge_id")) | (X.slugify("name") == X.slugify("badge_name")))
    u = j.select("user_id", "id").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("earned"))
    return u.select("user_id", "earned", F.lit(total).cast("long").alias("total"),
                    F.floor(F.lit(100.0) * F.col("earned") / total + 0.5).cast("int").alias("pct"))


# Declared attempt-penalty scoring fields.
MAX_ATTEMPTS_WITHOUT_PENALTY = 3
ATTEMPT_PENALTY_AFTER_MAX = -5


@register("ev_attempt_penalties", _ev() + f"""SELECT a.event_id, a.team_id, a.task_id,
  count(*) FILTER (WHERE f.first_pass IS NULL OR a.created_at < f.first_pass) AS attempts_before_pass,
  CAST({ATTEMPT_PENALTY_AFTER_MAX} * greatest(0, count(*) FILTER (WHERE f.first_pass IS NULL OR a.created_at < f.first_pass)
       - {MAX_ATTEMPTS_WITHOUT_PENALTY}) AS BIGINT) AS penalty
FROM attempt_status a LEFT JOIN (SELECT event_id, team_id, task_id, min(created_at) AS first_pass FROM attempt_status
                                 WHERE status = 'passed' AND team_id IS NOT NULL GROUP BY 1, 2, 3) f
  ON f.event_id = a.event_id AND f.team_id = a.team_id AND f.task_id = a.task_id
WHERE a.team_id IS NOT NULL GROUP BY a.event_id, a.team_id, a.task_id""")
def q_attempt_penalties(spark, sf_dir):
    """CO-23 (declared): attempts before a team's first pass beyond the free allowance cost points.

    Aggregates and one join on the (event, team, task) key — no per-group
    window, so a task a team hammers a million times is counted, not sorted.
    """
    g = _g(spark, sf_dir)
    a = g.attempts.filter(F.col("team_id").isNotNull())
    keys = ["event_id", "team_id", "task_id"]
    first = a.filter(F.col("status") == "passed").groupBy(*keys).agg(F.min("created_at").alias("first_pass"))
    j = a.join(first, keys, "left")
    before = F.col("first_pass").isNull() | (F.col("created_at") < F.col("first_pass"))
    c = j.groupBy(*keys).agg(F.count_if(before).alias("attempts_before_pass"))
    return c.withColumn("penalty", (F.lit(ATTEMPT_PENALTY_AFTER_MAX) * F.greatest(
        F.lit(0), F.col("attempts_before_pass") - MAX_ATTEMPTS_WITHOUT_PENALTY)).cast("long"))
