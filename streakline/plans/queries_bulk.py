"""Registered queries of bulk checks, evidence and small read models, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assertions as A
from ..operators import bulk_checks as B
from ..operators import event as E
from ..operators.ranking import top_k, top_k_per_group
from ..sources import standin_sql as Q
from ..sources import standins as S
from ..sources.tables import Tables
from . import oracle_adoption as O
from . import read_models as RM
from .queries_adoption import _run
from .queries_event import CTES, _g
from .registry import register

# ----------------------------- DQ-12 ----------------------------------------
# Variables of a team: one team has no schema yet, one has a name that is not safe in a statement.
NULL_TEAM, UNSAFE_TEAM = 23, 24

_SCHEMA = f"""CASE t.team_id WHEN {NULL_TEAM} THEN NULL WHEN {UNSAFE_TEAM} THEN 'x; drop ' || t.name
  ELSE 'team_' || lower(t.name) END"""


@register("dq_team_statements", "WITH " + ",\n".join([Q.TEAMS, Q.COMPETITIONS, Q.TASKS, Q.CATALOG_VALIDATORS]) + f""",
j AS (SELECT k.task_id, v.validator_id, t.event_id, t.team_id, v.statement, {_SCHEMA} AS s
  FROM catalog_validators v JOIN tasks k ON k.task_id = v.task_id JOIN competitions c ON c.pack_version_id = k.pack_version_id
  JOIN teams t ON t.event_id = c.event_id WHERE v.type = 'sql_assertion'),
r AS (SELECT *, CASE WHEN contains(statement, '${{run_day}}') THEN 'unresolved template variable(s): run_day'
    WHEN s IS NULL THEN 'template variable ''team_schema'' resolved to null'
    WHEN NOT regexp_matches(s, '^[A-Za-z0-9_.\\- ]*$') THEN 'template variable ''team_schema'' has an unsafe value' END AS reason
  FROM j)
SELECT task_id, validator_id, event_id, team_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN reason IS NULL THEN replace(statement, '${{team_schema}}', s) END AS statement, reason FROM r""")
def q_team_statements(spark, sf_dir):
    """DQ-12: every statement of the event's pack for every team."""
    t = Tables(spark, sf_dir)
    schema = (F.when(F.col("team_id") == NULL_TEAM, F.lit(None).cast("string"))
              .when(F.col("team_id") == UNSAFE_TEAM, F.concat(F.lit("x; drop "), F.col("name")))
              .otherwise(F.concat(F.lit("team_"), F.lower("name"))))
    contexts = S.teams(t).join(S.competitions(t).select("event_id", "slug", "pack_version_id"), "event_id").select(
        "pack_version_id", "event_id", "team_id", F.create_map(
            F.lit("team_schema"), schema, F.lit("team_id"), F.col("team_id").cast("string"),
            F.lit("event_slug"), F.col("slug")).alias("variables"))
    statements = S.catalog_validators(t).filter(F.col("type") == "sql_assertion").join(
        S.tasks(t).select("task_id", "pack_version_id"), "task_id").select(
        "pack_version_id", "task_id", "validator_id", F.col("statement").alias("template"))
    return B.resolve_templates(statements, contexts, ["pack_version_id"]).drop("pack_version_id")


# ----------------------------- DQ-11 ----------------------------------------
CHECKS = [("d1", "dashboard_exists_for_team", "RING"), ("d2", "dashboard_exists_for_team", None),
          ("d3", "dashboard_exists_for_team", "no such thing"), ("p1", "dashboard_published", "widget"),
          ("g1", "genie_space_exists", "supplier#00000000"), ("t1", "table_exists", "Brand#17.ECONOMY.1"),
          ("t2", "table_exists", "brand#17.economy.1"), ("j1", "job_exists_with_schedule", "customer"),
          ("j2", "job_exists_with_schedule", "9"), ("u1", "pipeline_update_completed", "urgent/"),
          ("u2", "pipeline_update_completed", "LOW/12")]
_CHECK_VALUES = ", ".join(f"('{i}', '{k}', " + ("NULL" if n is None else f"'{n}'") + f", '{B.CHECK_OBJECTS[k]}')" for i, k, n in CHECKS)


@register("dq_inventory_checks", "WITH " + Q.INVENTORY + f""",
checks AS (SELECT * FROM (VALUES {_CHECK_VALUES}) c(check_id, kind, needle, object_kind)),
hits AS (SELECT check_id, place, name, CASE kind WHEN 'dashboard_published' THEN upper(coalesce(state, '')) IN ('ACTIVE', 'PUBLISHED', '')
      WHEN 'pipeline_update_completed' THEN upper(coalesce(state, '')) IN ('COMPLETED', 'COMPLETE', '')
      WHEN 'job_exists_with_schedule' THEN coalesce(scheduled, false) ELSE true END AS f
  FROM inventory JOIN checks USING (object_kind)
  WHERE CASE WHEN kind = 'table_exists' THEN name = coalesce(needle, '') ELSE contains(lower(name), lower(coalesce(needle, ''))) END),
firsts AS (SELECT check_id, string_agg(name, ', ' ORDER BY rn) AS names FROM (
  SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY place, name) AS rn FROM hits WHERE f) WHERE rn <= {B.FIRST_NAMES} GROUP BY 1)
SELECT c.check_id, c.kind, coalesce(n.m, 0) AS n_matched, CAST(coalesce(n.f, 0) AS BIGINT) AS n_found, coalesce(n.f, 0) > 0 AS found,
  coalesce(firsts.names, '') AS names
FROM checks c LEFT JOIN (SELECT check_id, count(*) AS m, count(*) FILTER (WHERE f) AS f FROM hits GROUP BY 1) n USING (check_id)
LEFT JOIN firsts USING (check_id)""")
def q_inventory(spark, sf_dir):
    """DQ-11: checks of five kinds of objects in one pass over the inventory."""
    checks = spark.createDataFrame(CHECKS, "check_id string, kind string, needle string")
    return B.inventory_checks(S.inventory(Tables(spark, sf_dir)), F.broadcast(checks))


# ----------------------------- DQ-8 -----------------------------------------
# rule, table, violating rows, evidence columns (SQL of both engines), order
EVIDENCE = [
    ("few_pieces", "part", "p_size < 10", {"p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "p_brand"}, "p_partkey"),
    ("toxic", "labels", "toxic = 1", {"doc_id": "doc_id", "quality": "quality"}, "doc_id"),
    ("long_text", "documents", "length(text) > 1000",
     {"doc_id": "doc_id", "start": "text", "then": "substr(text, 201, 300)", "source": "source", "none": "nullif(source, source)",
      "last": "substr(text, 601, 300)"}, "doc_id"),
    ("nothing", "nation", "n_nationkey < 0", {"n_name": "n_name"}, "n_nationkey"),
]


def _evidence_sql() -> str:
    parts = []
    for rule, table, where, cols, order in EVIDENCE:
        vals = {n: f"left(coalesce(CAST({e} AS VARCHAR), 'None'), {A.EVIDENCE_CELL_CHARS})" for n, e in cols.items()}
        size = " + ".join(f"{len(n)} + length({v})" for n, v in vals.items())
        text = " || '; ' || ".join(f"'{n}=' || {v}" for n, v in vals.items())
        parts.append(f"SELECT '{rule}' AS rule_id, row_number() OVER (ORDER BY {order}) AS position, {text} AS evidence, "
                     f"{size} AS size FROM {table} WHERE {where}")
    return ("WITH s AS (" + "\nUNION ALL ".join(f"SELECT * FROM ({p}) WHERE position <= {A.EVIDENCE_ROWS}" for p in parts)
            + ")\nSELECT rule_id, position, evidence FROM (SELECT *, sum(size) OVER (PARTITION BY rule_id ORDER BY position) AS run "
              f"FROM s) WHERE run <= {A.EVIDENCE_TOTAL_CHARS}")


@register("dq_evidence", _evidence_sql())
def q_evidence(spark, sf_dir):
    """DQ-8: evidence of all rules in one plan; the row cap and the size cap both take effect."""
    t = Tables(spark, sf_dir)
    rows = None
    for rule, table, where, cols, order in EVIDENCE:
        v = A.violating(t.get(table), rule, where, cols, order)
        rows = v if rows is None else rows.unionByName(v)
    return A.evidence(rows, ["place"])


# ----------------------------- read models ----------------------------------

@register("ev_latest_announcements", "WITH " + Q.ANNOUNCEMENTS + f"""
SELECT event_id, position, announcement_id, title, severity, created_at,
  CASE WHEN secs < 60 THEN secs || 's ago' WHEN mins < 60 THEN mins || 'm ago' WHEN hrs < 24 THEN hrs || 'h ago'
       ELSE CAST(floor(hrs / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS age
FROM (SELECT *, CAST(floor(mins / 60.0 + 0.5) AS BIGINT) AS hrs FROM (SELECT *, CAST(floor(secs / 60.0 + 0.5) AS BIGINT) AS mins FROM (
  SELECT *, greatest(0, CAST(epoch(TIMESTAMP '{RM.NOW}') - epoch(created_at) AS BIGINT)) AS secs,
    row_number() OVER (PARTITION BY event_id ORDER BY created_at DESC, announcement_id) AS position FROM announcements)
  WHERE position <= {RM.ANNOUNCEMENTS})) ORDER BY 1, 2""")
def q_announcements(spark, sf_dir):
    """TK-5: the latest announcements of every event, with their age."""
    a = top_k_per_group(S.announcements(Tables(spark, sf_dir)), ["event_id"],
                        [F.col("created_at").desc(), F.col("announcement_id").asc()], RM.ANNOUNCEMENTS, "position")
    return a.withColumn("age", RM.time_ago("created_at", F.lit(RM.NOW).cast("timestamp")))


@register("ev_host_teams", "WITH " + ",\n".join(CTES) + """
SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rank IS NULL, coalesce(rank, 0), score DESC, team_id) AS position
FROM (SELECT t.event_id, t.team_id, t.display_name, coalesce(m.n, 0) AS members, CAST(coalesce(l.total_points, 0) AS BIGINT) AS score, l.rank
      FROM teams t LEFT JOIN (SELECT event_id, team_id, count(*) AS n FROM participants GROUP BY 1, 2) m
        ON m.event_id = t.event_id AND m.team_id = t.team_id
      LEFT JOIN leaderboard l ON l.event_id = t.event_id AND l.team_id = t.team_id)""")
def q_host_teams(spark, sf_dir):
    """WI-9: the host's table of teams: ranked ones first, then by score."""
    return RM.host_teams(_g(spark, sf_dir))


@register("ev_active_events", "WITH " + ",\n".join([Q.COMPETITIONS, Q.CATALOG_QUESTS]) + f"""
SELECT c.event_id, c.slug, c.title, c.status, lower(r.r_name) AS pack_title
FROM competitions c LEFT JOIN region r ON r.r_regionkey + {S.PACK_VERSION} = c.pack_version_id
WHERE c.status IN ('active', 'paused', 'frozen')""")
def q_active_events(spark, sf_dir):
    """JO-14: visible events with the title of the pack that their version belongs to."""
    t = Tables(spark, sf_dir)
    p = S.catalog_packs(t)
    return RM.visible_events(S.competitions(t), p.select("pack_version_id", F.col("pack_version_id").alias("pack_id")),
                             p.select(F.col("pack_version_id").alias("pack_id"), F.col("pack_slug").alias("pack_title")))


@register("ev_enabled_validators", "WITH " + ",\n".join([Q.CATALOG_VALIDATORS]) + """
SELECT task_id, validator_id, type, mode, row_number() OVER (PARTITION BY task_id ORDER BY validator_id) AS position
FROM catalog_validators WHERE mode <> 'batch'""")
def q_validators(spark, sf_dir):
    """FI-14: each task's enabled validators in authoring order (the stand-in's batch ones are switched off)."""
    v = S.catalog_validators(Tables(spark, sf_dir)).withColumn("enabled", F.col("mode") != "batch")
    return RM.enabled_validators(v, "validator_id").select("task_id", "validator_id", "type", "mode", "position")


@register("top_missions", "WITH " + ",\n".join(O.run_ctes()) + f"""
SELECT mission_id, count(*) AS completions FROM completions GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {RM.TOP_MISSIONS}""")
def q_top_missions(spark, sf_dir):
    """TK-10: the missions completed most."""
    c = _run(spark, sf_dir).final("mission_completions")
    return top_k(c.groupBy("mission_id").agg(F.count(F.lit(1)).alias("completions")),
                 [F.col("completions").desc(), F.col("mission_id").asc()], RM.TOP_MISSIONS)


_QUESTS = ["africa", "america", "asia", "europe", "middle-east"]


@register("ev_team_export", "WITH " + ",\n".join(CTES) + """,
done AS (SELECT p.event_id, p.team_id, q.quest_slug FROM pairs p JOIN tasks k USING (task_id) JOIN quests q USING (quest_id))
SELECT l.event_id, l.team_id, l.rank, n.team_name AS team, l.total_points, coalesce(d.c, 0) AS tasks_completed,
  (SELECT count(*) FROM tasks) AS total_tasks, coalesce(h.n, 0) AS hints_used, """
          + ", ".join(f"""coalesce(d."{q}", 0) AS "{q}\"""" for q in _QUESTS) + """
FROM leaderboard l JOIN team_names n ON n.team_id = l.team_id
LEFT JOIN (SELECT event_id, team_id, count(*) AS c, """
          + ", ".join(f"""count(*) FILTER (WHERE quest_slug = '{q}') AS "{q}\"""" for q in _QUESTS) + """
           FROM done GROUP BY 1, 2) d ON d.event_id = l.event_id AND d.team_id = l.team_id
LEFT JOIN (SELECT event_id, team_id, count(*) AS n FROM ledger WHERE source_type = 'hint_penalty' GROUP BY 1, 2) h
  ON h.event_id = l.event_id AND h.team_id = l.team_id""")
def q_team_export(spark, sf_dir):
    """SK-4: the team export with a column a quest (columns from the catalog)."""
    return RM.team_export(_g(spark, sf_dir), by="quest")


@register("ev_capability_heatmap", "WITH " + ",\n".join(CTES) + """
SELECT a.event_id, a.user_id, """ + ", ".join(
    f"""count(DISTINCT a.task_id) FILTER (WHERE q.quest_slug = '{q}' AND a.status = 'passed') AS "{q}\"""" for q in _QUESTS) + """
FROM attempt_status a JOIN tasks k USING (task_id) JOIN quests q USING (quest_id) GROUP BY 1, 2""")
def q_heatmap(spark, sf_dir):
    """CO-26: user by capability: distinct tasks passed in each quest."""
    return RM.capability_heatmap(_g(spark, sf_dir))


@register("user_badges_latest", "WITH " + ",\n".join([*O.run_ctes(), f"badges AS ({O.badges_sql()})"]) + """
SELECT user_id, badge_id, earned_at, row_number() OVER (PARTITION BY user_id ORDER BY earned_at DESC, badge_id) AS position
FROM badges""")
def q_user_badges(spark, sf_dir):
    """TK-11: each user's badges, the latest first."""
    return RM.badges_by_time(_run(spark, sf_dir).final("badges"))
