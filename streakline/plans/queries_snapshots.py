"""Registered queries of leaderboards over time, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import snapshots as SN
from .event_game import EventGame
from .queries_event import CTES
from .registry import register

AS_OF = "1997-06-15 12:00:00"
SNAPSHOTS = ["""months AS (SELECT event_id, resolved_team_id AS team_id,
         date_trunc('month', created_at) + INTERVAL 1 MONTH AS month, points_delta, created_at
  FROM resolved WHERE resolved_team_id IS NOT NULL)""",
             """moments AS (SELECT unnest(generate_series((SELECT min(month) FROM months), (SELECT max(month) FROM months),
         INTERVAL 1 MONTH)) AS snapshot_at)""",
             """running AS (SELECT m.event_id, t.snapshot_at, m.team_id, CAST(sum(m.points_delta) AS BIGINT) AS total_points,
         count(*) AS scoring_events, max(m.created_at) AS last_scored_at
  FROM months m JOIN moments t ON m.month <= t.snapshot_at GROUP BY 1, 2, 3)""",
             """snaps AS (SELECT *, CAST(rank() OVER (PARTITION BY event_id, snapshot_at
         ORDER BY total_points DESC, last_scored_at ASC NULLS LAST) AS INTEGER) AS rank FROM running)"""]


def _sql(body: str) -> str:
    return "WITH " + ",\n".join(CTES + SNAPSHOTS) + "\n" + body


def _snapshots(spark, sf_dir):
    g = EventGame(spark, sf_dir)
    return SN.monthly_snapshots(g.ledger, g.identity_map)


@register("ev_leaderboard_snapshots", _sql("SELECT * FROM snaps"))
def q_snapshots(spark, sf_dir):
    """CO-25 / SK-6: the leaderboard at the end of every month."""
    return _snapshots(spark, sf_dir)


@register("ev_rank_changes", _sql("""SELECT event_id, snapshot_at, team_id, rank, previous_rank, previous_rank - rank AS moved,
  total_points - coalesce(before, 0) AS gained
FROM (SELECT *, lag(rank) OVER w AS previous_rank, lag(total_points) OVER w AS before FROM snaps
      WINDOW w AS (PARTITION BY event_id, team_id ORDER BY snapshot_at))"""))
def q_rank_changes(spark, sf_dir):
    """CO-25: ranks against the month before."""
    return SN.rank_changes(_snapshots(spark, sf_dir))


@register("ev_leaderboard_as_of", _sql(f"""SELECT * FROM snaps s WHERE snapshot_at = (
  SELECT max(snapshot_at) FROM snaps x WHERE x.event_id = s.event_id AND x.snapshot_at <= TIMESTAMP '{AS_OF}')"""))
def q_as_of(spark, sf_dir):
    """CO-25: the board as it stood at a moment: the last snapshot at or before it."""
    return SN.board_as_of(_snapshots(spark, sf_dir), F.lit(AS_OF).cast("timestamp"))
