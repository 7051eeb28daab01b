"""Registered queries of the membership import, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import membership as M
from ..sources import standin_sql as Q
from ..sources import standins as S
from ..sources.tables import Tables
from .registry import register

CTES = [Q.TEAMS, Q.PARTICIPANTS, Q.TEAM_MEMBERS, Q.IMPORT_ROWS,
        "people AS (SELECT * FROM participants WHERE c_acctbal >= 0)",
        """clean AS (SELECT event_id, line, uid AS user_id, CASE WHEN trim(display_name) <> '' THEN trim(display_name)
         ELSE split_part(uid, '@', 1) END AS display_name, trim(team_name) AS team_name
  FROM (SELECT *, trim(CASE WHEN coalesce(user_id, '') <> '' THEN user_id ELSE coalesce(email, '') END) AS uid
        FROM import_rows) WHERE uid <> '')""",
        """target AS (SELECT event_id, user_id, max_by(team_name, line) AS name, count(DISTINCT team_name) = 1 AS settled
  FROM clean WHERE team_name <> '' GROUP BY 1, 2)""",
        """held AS (SELECT t.event_id, p.user_id, t.name AS team_name, m.joined_at, g.name AS to_team,
         g.name IS NULL OR (g.name = t.name AND g.settled) AS stays
  FROM team_members m JOIN teams t ON t.team_id = m.team_id JOIN people p ON p.participant_id = m.participant_id
  LEFT JOIN target g ON g.event_id = t.event_id AND g.user_id = p.user_id)""",
        f"""after_import AS (SELECT event_id, user_id, team_name, joined_at FROM held WHERE stays
  UNION ALL SELECT event_id, user_id, name, TIMESTAMP '{S.IMPORTED_AT}' FROM target g
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.stays AND h.event_id = g.event_id AND h.user_id = g.user_id
                      AND h.team_name = g.name))"""]


def _sql(body: str) -> str:
    return "WITH " + ",\n".join(CTES) + "\n" + body


def _tables(spark, sf_dir):
    t = Tables(spark, sf_dir)
    teams = S.teams(t).withColumn("team_id", F.col("team_id").cast("string"))
    people = S.participants(t).filter(F.col("c_acctbal") >= 0).select(
        F.col("participant_id").cast("string").alias("participant_id"), "event_id", "user_id", "display_name",
        F.col("user_id").alias("email"))
    members = S.team_members(t).select(F.col("team_id").cast("string").alias("team_id"),
                                       F.col("participant_id").cast("string").alias("participant_id"), "joined_at")
    return t, teams, people, members


def _imported(spark, sf_dir):
    t, teams, people, members = _tables(spark, sf_dir)
    return M.import_participants(S.import_rows(t), teams, people, members, F.lit(S.IMPORTED_AT).cast("timestamp"))


@register("ev_import_memberships", _sql("SELECT * FROM after_import"))
def q_import_memberships(spark, sf_dir):
    """UP-10 / JO-16: memberships after the import, one team an event for everybody it names."""
    out = _imported(spark, sf_dir)
    return (out["members"].join(out["teams"].select("team_id", "event_id", F.col("name").alias("team_name")), "team_id")
            .join(out["participants"].select("participant_id", "user_id"), "participant_id")
            .select("event_id", "user_id", "team_name", "joined_at"))


@register("ev_import_participants", _sql("""SELECT event_id, user_id, display_name, user_id AS email FROM people
UNION ALL SELECT event_id, user_id, min_by(display_name, line), user_id FROM clean c
WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.event_id = c.event_id AND p.user_id = c.user_id) GROUP BY 1, 2"""))
def q_import_participants(spark, sf_dir):
    """UP-10: participants after the import; the first row of a new one describes it."""
    return _imported(spark, sf_dir)["participants"].select("event_id", "user_id", "display_name", "email")


@register("ev_import_counts", _sql("""SELECT r.event_id, r.rows, coalesce(p.n, 0) AS participants_created,
  coalesce(t.n, 0) AS teams_created, r.assignments, coalesce(g.n, 0) AS removed
FROM (SELECT event_id, count(*) AS rows, count(*) FILTER (WHERE team_name <> '') AS assignments FROM clean GROUP BY 1) r
LEFT JOIN (SELECT event_id, count(DISTINCT user_id) AS n FROM clean c WHERE NOT EXISTS (
             SELECT 1 FROM people p WHERE p.event_id = c.event_id AND p.user_id = c.user_id) GROUP BY 1) p USING (event_id)
LEFT JOIN (SELECT event_id, count(DISTINCT team_name) AS n FROM clean c WHERE team_name <> '' AND NOT EXISTS (
             SELECT 1 FROM teams t WHERE t.event_id = c.event_id AND t.name = c.team_name) GROUP BY 1) t USING (event_id)
LEFT JOIN (SELECT event_id, count(*) AS n FROM held WHERE to_team IS NOT NULL AND to_team <> team_name GROUP BY 1) g
  USING (event_id)"""))
def q_import_counts(spark, sf_dir):
    """UP-10: what the import did, per event."""
    return _imported(spark, sf_dir)["counts"]


@register("ev_user_team", _sql("""SELECT event_id, user_id, joined_at, CAST(team_id AS VARCHAR) AS team_id, team_name
FROM (SELECT p.event_id, p.user_id, m.joined_at, m.team_id, t.display_name AS team_name,
             row_number() OVER (PARTITION BY p.event_id, p.user_id ORDER BY m.joined_at, CAST(m.team_id AS VARCHAR)) AS rn
      FROM team_members m JOIN people p USING (participant_id) JOIN teams t ON t.team_id = m.team_id) WHERE rn = 1"""))
def q_user_team(spark, sf_dir):
    """TK-6 / JO-11: each user's team by earliest membership."""
    _, teams, people, members = _tables(spark, sf_dir)
    return M.user_team(members, teams, people)
