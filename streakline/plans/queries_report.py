"""Registered queries of the post-event report and of JSON parsing, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import standin_sql as Q
from ..sources.tables import Tables
from . import queries_event, queries_extra  # noqa: F401 (their SQL is the base of the sections)
from . import report as RP
from .queries_event import _g
from .registry import ORACLES, register

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_RULES = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(RP.RULE_ORDER, 1))

# section: (source SQL, place, key, fields other than plain columns)
_SOURCES = {
    "summary": (ORACLES["ev_summary"], "0", "''", {}),
    "leaderboard": (ORACLES["ev_leaderboard"], f"coalesce(rank, {RP.UNRANKED})", "team_id",
                    {"team_name": "display_name", "last_scored_at": _ISO.format("last_scored_at")}),
    "teams": (ORACLES["ev_team_members"], "team_id", "''", {"team_name": "display_name"}),
    "completion_matrix": (ORACLES["ev_completion_matrix"], "team_id", "''", {}),
    "roster": (ORACLES["ev_participant_roster"], "participant_id", "''", {}),
    "task_catalog": ("WITH " + ",\n".join(Q.EVENT_GAME) + """ SELECT c.event_id, k.*, q.quest_title FROM competitions c
      JOIN tasks k ON k.pack_version_id = c.pack_version_id LEFT JOIN quests q ON q.quest_id = k.quest_id""",
                     "task_id", "''", {}),
    "validation_failures": (ORACLES["ev_failure_summary"], "task_id", "status", {}),
    "hint_usage": (ORACLES["ev_hint_usage"], "epoch_us(created_at)", "concat_ws(':', hint_id, team_id)",
                   {"team_name": "coalesce(team_name, CAST(team_id AS VARCHAR))", "at_time": _ISO.format("created_at")}),
    "blockers": (ORACLES["ev_blockers"], f"solved_teams * {RP.WORST_FIRST} - failed_attempts", "task_id", {}),
    "champions": (ORACLES["ev_champions"], "position", "''", {"team_name": "display_name"}),
    "fastest_team": ("SELECT f.*, n.team_name FROM (" + ORACLES["ev_fastest_team"] + ") f LEFT JOIN ("
                     + queries_event._with() + " SELECT * FROM team_names) n USING (event_id, team_id)", "0", "''", {}),
    "recommended_follow_ups": (ORACLES["ev_follow_ups"], f"CASE rule {_RULES} END", "line", {}),
}


def _section_sql(name: str) -> str:
    source, at, key, other = _SOURCES[name]
    fields = [f.split()[0] for f in RP.FIELDS[name].split(", ")]
    cols = ", ".join(f"{other.get(f, f)} AS {f}" for f in fields)
    return f"s_{name} AS (SELECT event_id, CAST({at} AS BIGINT) AS place, CAST({key} AS VARCHAR) AS key, {cols} FROM (\n{source}))"


def _json_sql(name: str) -> str:
    fields = [f.split()[0] for f in RP.FIELDS[name].split(", ")]
    doc = ", ".join(f"'{f}': {f}" for f in fields)
    return f"SELECT event_id, '{name}' AS section, place, key, CAST(to_json({{{doc}}}) AS VARCHAR) AS doc FROM s_{name}"


_SECTIONS = "WITH " + ",\n".join(_section_sql(n) for n in RP.FIELDS)


@register("ev_report_json", _SECTIONS + "\n" + "\nUNION ALL ".join(_json_sql(n) for n in RP.FIELDS))
def q_report_json(spark, sf_dir):
    """SK-3: every item of every section of every event as JSON."""
    return RP.json_lines(RP.sections(_g(spark, sf_dir)))


def _head_sql(section: int, source: str, *lines: str) -> str:
    rows = [f"({i - len(lines)}, {x})" for i, x in enumerate(lines)] + [f"({RP.LAST}, '')"]
    return (f"SELECT event_id, {section} AS section, CAST(h.place AS BIGINT) AS place, '' AS key, h.line FROM {source}, "
            f"LATERAL (VALUES {', '.join(rows)}) h(place, line)")


def _cells(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(f"coalesce(CAST({c} AS VARCHAR), '—')" for c in cells) + " || ' |'"


def _body_sql(section: int, source: str, line: str, at: str = "place") -> str:
    return f"SELECT event_id, {section}, {at}, key, {line} FROM {source}"


_MARKDOWN = _SECTIONS + """,
hints AS (SELECT event_id, count(*) AS n, sum(penalty) AS p FROM s_hint_usage GROUP BY 1),
people AS (SELECT event_id, count(*) AS n FROM s_roster GROUP BY 1),
winners AS (SELECT DISTINCT event_id FROM s_champions), hard AS (SELECT DISTINCT event_id FROM s_blockers),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY solved_teams, failed_attempts DESC, task_id)
  AS pos FROM s_blockers) WHERE pos <= 10)
""" + "\nUNION ALL ".join([
    _head_sql(0, "s_summary", "'# Event report — ' || title", "''", "'- **Status:** ' || status",
              "'- **Teams:** ' || teams || '  •  **Participants:** ' || participants",
              "'- **Quests:** ' || quests || '  •  **Tasks:** ' || tasks",
              "'- **Attempts:** ' || attempts || ' (' || attempts_by_status || ')'"),
    _head_sql(1, "s_summary", "'## Leaderboard'", "''", "'| Rank | Team | Points |'", "'|---:|---|---:|'"),
    _body_sql(1, "s_leaderboard", _cells("rank", "team_name", "total_points")),
    _head_sql(2, "winners", "'## Champions / high performers'", "''"),
    _body_sql(2, "s_champions", "'- **#' || coalesce(CAST(rank AS VARCHAR), '—') || ' ' || team_name || '** — ' || total_points || ' pts'"),
    _body_sql(2, "s_fastest_team WHERE event_id IN (SELECT event_id FROM winners)",
              "'- **Fastest team:** ' || team_name || ' (' || first_solves || ' first solves)'", str(RP.LAST - 1)),
    _head_sql(3, "s_summary", "'## Quest completion'", "''", "'| Team | Completed | % |'", "'|---|---:|---:|'"),
    _body_sql(3, "s_completion_matrix", _cells("team_name", "(completed_count || '/' || total_tasks)", "(completion_pct || '%')")),
    _head_sql(4, "hard", "'## Blockers (hardest tasks)'", "''", "'| Task | Quest | Solved | Failed attempts |'", "'|---|---|---:|---:|'"),
    _body_sql(4, "worst", _cells("task_title", "quest_title", "(solved_teams || '/' || total_teams)", "failed_attempts")),
    _head_sql(5, "hints", "'## Hint usage (' || n || ' reveals, ' || p || ' pts)'", "''", "'| Team | Task | Penalty |'", "'|---|---|---:|'"),
    _body_sql(5, "s_hint_usage", _cells("team_name", "task_title", "penalty")),
    _head_sql(6, "people", "'## Participant roster (' || n || ')'", "''", "'| Participant | Role | Team | Tasks passed | Attempts |'",
              "'|---|---|---|---:|---:|'"),
    _body_sql(6, "s_roster", _cells("display_name", "role", "team_name", "tasks_passed", "attempts_total")),
    _head_sql(7, "s_summary", "'## Recommended follow-ups'", "''"),
    _body_sql(7, "s_recommended_follow_ups", "'- ' || line")])


@register("ev_report_markdown_lines", _MARKDOWN)
def q_report_markdown(spark, sf_dir):
    """SK-5: the lines of every event's Markdown report, all sections."""
    return RP.markdown_lines(RP.sections(_g(spark, sf_dir)))


@register("json_props_parsed", """WITH t AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN left(props, length(props) - 1)
    WHEN 1 THEN '[' || props || ']' WHEN 2 THEN NULL WHEN 3 THEN '  ' || props WHEN 4 THEN '"text"' ELSE props END AS body FROM events),
j AS (SELECT event_id, TRY_CAST(body AS JSON) AS j FROM t)
SELECT event_id, coalesce(json_type(j) = 'OBJECT', false) AS is_object,
  CASE WHEN json_type(j) = 'OBJECT' THEN CAST(j->>'k' AS BIGINT) END AS k FROM j""")
def q_json_props(spark, sf_dir):
    """JSON columns as structs: broken text, arrays and plain values give NULL (every case occurs)."""
    form = F.col("event_id") % 11
    body = (F.when(form == 0, F.expr("left(props, length(props) - 1)"))
            .when(form == 1, F.concat(F.lit("["), F.col("props"), F.lit("]")))
            .when(form == 2, F.lit(None)).when(form == 3, F.concat(F.lit("  "), F.col("props")))
            .when(form == 4, F.lit('"text"')).otherwise(F.col("props")))
    t = Tables(spark, sf_dir).get("events", ["event_id", "props"]).select("event_id", body.alias("body"))
    d = t.select("event_id", RP.parse_object("body", "k long").alias("d"))
    return d.select("event_id", F.col("d").isNotNull().alias("is_object"), F.col("d.k").alias("k"))
