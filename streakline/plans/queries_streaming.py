"""Registered queries of the streaming jobs; each drives its stream to the end
of the input (availableNow) and returns the resulting table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_path
from ..streaming import live as L
from . import oracle_adoption as O
from .event_game import EventGame
from .queries_adoption import CFG, _with
from .queries_event import LEDGER_COLS
from .queries_event import _with as _with_event
from .registry import register

@register("st_weekly_query_missions", _with(*O.ALL_LOGS) + O.query_weekly())
def q_st_weekly(spark, sf_dir):
    """ST-3: Monday-week tumbling windows with a watermark → weekly threshold missions."""
    return L.weekly_query_missions_stream(spark, sf_dir, CFG.activity, CFG.run_ts, CFG.thresholds)


@register("st_weekly_consumption_points", _with(*O.ALL_LOGS) + O.weekly_points())
def q_st_consumption(spark, sf_dir):
    """ST-4: weekly consumption points from the usage stream."""
    return L.weekly_consumption_stream(spark, sf_dir, CFG.activity, CFG.run_ts)


SESSIONS_SQL = """WITH e AS (SELECT concat('user', CAST(user_id AS VARCHAR),
    CASE WHEN user_id % 10 = 0 THEN '' ELSE '@example.com' END) AS user_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
l AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
        OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new_s FROM e),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 1 DAY AS session_end, count(*) AS events
FROM s GROUP BY user_id, sid"""
_LEDGER = ("stream_ledger AS (SELECT * FROM ranked_awards WHERE rn = 1)",)
_RANKED = """ranked_awards AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY created_at, candidate_id) AS rn
  FROM award_cands)"""


@register("st_award_ledger", _with_event(_RANKED, *_LEDGER) + f"SELECT {LEDGER_COLS} FROM stream_ledger")
def q_st_awards(spark, sf_dir):
    """ST-1: exactly-once awards from the attempt stream (one row per idempotency key), all columns."""
    return L.award_stream(spark, sf_dir)[0]


@register("st_team_totals", _with_event(_RANKED, *_LEDGER) + """SELECT *, CAST(rank() OVER (PARTITION BY event_id
  ORDER BY total_points DESC, last_scored_at ASC NULLS LAST) AS INTEGER) AS rank
FROM (SELECT l.event_id, coalesce(l.team_id, m.team_id) AS team_id, CAST(sum(l.points_delta) AS BIGINT) AS total_points,
             count(*) AS scoring_events, max(l.created_at) AS last_scored_at
      FROM stream_ledger l LEFT JOIN identity_map m
        ON m.event_id = l.event_id AND m.workspace_id = l.workspace_id AND m.lab_user_email = l.user_id
      WHERE coalesce(l.team_id, m.team_id) IS NOT NULL GROUP BY 1, 2)""")
def q_st_totals(spark, sf_dir):
    """ST-2: live team totals over the award ledger, federated awards with their mapped team."""
    _, path = L.award_stream(spark, sf_dir)
    return L.team_totals(spark, path, EventGame(spark, sf_dir).identity_map)


def _late_increments(spark, sf_dir):
    """A folder that the events come into in three steps, the latest days first: later steps are late."""
    folder = shared_path(spark, "late-events", uuid.uuid4().hex)
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.dayofmonth("ts")
    for cut in (day > 20, (day > 10) & (day <= 20), (day <= 10) | day.isNull()):
        ev.filter(cut).write.mode("append").parquet(folder)
        yield folder


@register("st_late_weekly_missions", _with(*O.ALL_LOGS) + O.query_weekly())
def q_st_late_weekly(spark, sf_dir):
    """ST-6: weekly missions after three runs of one stream, the last days first; equal to the batch rows."""
    state = L.StreamState(spark)
    for files in _late_increments(spark, sf_dir):
        out = L.weekly_query_missions_stream(spark, sf_dir, CFG.activity, CFG.run_ts, CFG.thresholds, state, files)
    return out


@register("st_late_sessions", SESSIONS_SQL)
def q_st_late_sessions(spark, sf_dir):
    """ST-6: sessions after three runs with late increments, folded in between; late events join sessions."""
    state = L.StreamState(spark)
    for files in _late_increments(spark, sf_dir):
        out = L.activity_sessions_stream(spark, sf_dir, state=state, files=files)
        state.compact(L.merge_sessions)
    return out


@register("st_activity_sessions", SESSIONS_SQL)
def q_st_sessions(spark, sf_dir):
    """ST-5: activity sessions with a one-day gap (session windows)."""
    return L.activity_sessions_stream(spark, sf_dir)
