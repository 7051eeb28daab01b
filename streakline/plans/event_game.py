"""The event game as one batch job: attempts → statuses → ledger → scores,
ranks and the post-event report sections, for every event at once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import event as E
from ..session import written
from ..sources import standins as S
from ..sources.tables import Tables

LEDGER_SCHEMA = ("event_id INT, idempotency_key STRING, team_id INT, workspace_id STRING, user_id STRING, "
                 "task_id BIGINT, points_delta INT, source_type STRING, source_id STRING, reason STRING, "
                 "created_at TIMESTAMP")


class EventGame:
    """Event tables rendered from the driver's tables; derived stages are cached."""

    def __init__(self, spark: SparkSession, sf_dir: str, previous_ledger: DataFrame | None = None):
        self.spark = spark
        self.t = Tables(spark, sf_dir)
        self.previous_ledger = previous_ledger

    # ---- inputs
    @cached_property
    def competitions(self) -> DataFrame:
        return S.competitions(self.t)

    @cached_property
    def teams(self) -> DataFrame:
        return S.teams(self.t)

    @cached_property
    def participants(self) -> DataFrame:
        return S.participants(self.t)

    @cached_property
    def identity_map(self) -> DataFrame:
        return S.identity_map(self.t)

    @cached_property
    def quests(self) -> DataFrame:
        return S.quests(self.t)

    @cached_property
    def tasks(self) -> DataFrame:
        return S.tasks(self.t)

    # ---- derived
    @cached_property
    def played(self) -> DataFrame:
        """Attempts with status, outcome counts and what reveals hints (written once: every section reads it).

        Lines are read, shuffled and sorted once, and resolved there (:func:`standins.attempt_lines`).
        """
        return written(S.attempts(self.t).drop("l_orderkey", "l_quantity", "l_tax"), "attempts")

    @cached_property
    def attempts(self) -> DataFrame:
        """Attempts with their resolved status."""
        return self.played.drop("validations", "validation_passes", "l_discount", "l_returnflag")

    @cached_property
    def candidates(self) -> DataFrame:
        awards = E.award_candidates(self.attempts, self.tasks)
        hints = E.hint_candidates(S.hint_reveals(self.t, self.played), self.tasks, self.competitions)
        return awards.unionByName(hints)

    @cached_property
    def _append(self) -> tuple[DataFrame, DataFrame]:
        prev = self.previous_ledger
        if prev is None:
            prev = self.spark.createDataFrame([], LEDGER_SCHEMA)
        return E.ledger_append(prev, self.candidates)

    @cached_property
    def ledger(self) -> DataFrame:
        new_rows, _ = self._append
        prev = self.previous_ledger
        out = new_rows if prev is None else prev.unionByName(new_rows)
        return written(out, "ledger")

    @cached_property
    def decisions(self) -> DataFrame:
        return self._append[1]

    @cached_property
    def team_scores(self) -> DataFrame:
        return E.team_scores(self.ledger, self.identity_map)

    @cached_property
    def leaderboard(self) -> DataFrame:
        return E.event_leaderboard(self.team_scores, self.teams)

    @cached_property
    def pairs(self) -> DataFrame:
        return E.completion_pairs(self.ledger)

    @cached_property
    def failures(self) -> DataFrame:
        return E.failure_summary(self.attempts, self.tasks)

    def completion_matrix(self) -> DataFrame:
        return E.completion_matrix(self.teams, self.tasks, self.competitions, self.pairs)

    def blockers(self) -> DataFrame:
        return E.blockers(self.teams, self.tasks, self.quests, self.competitions, self.pairs, self.failures)

    def first_solves(self) -> DataFrame:
        return E.first_solves(self.ledger)

    def roster(self) -> DataFrame:
        return E.participant_roster(self.participants, self.teams, self.attempts)

    def summary(self) -> DataFrame:
        """CO-18: per event: participants, teams, quests, tasks, attempts (sum of status counts)."""
        c = self.competitions.select("event_id", "title", "status", "pack_version_id")
        parts = self.participants.groupBy("event_id").agg(F.count(F.lit(1)).alias("participants"))
        teams = self.teams.groupBy("event_id").agg(F.count(F.lit(1)).alias("teams"))
        cat = self.tasks.groupBy("pack_version_id").agg(F.countDistinct("quest_id").alias("quests"),
                                                       F.count(F.lit(1)).alias("tasks"))
        # attempts = sum of the status counts; the status → count map is rendered
        # 'k: v' sorted by status (a handful of statuses per event).
        att = E.attempt_status_counts(self.attempts).groupBy("event_id").agg(
            F.sum("c").alias("attempts"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "c"))),
                                     lambda x: F.concat(x["status"], F.lit(": "), x["c"].cast("string"))),
                         ", ").alias("attempts_by_status"))
        j = (c.join(parts, "event_id", "left").join(teams, "event_id", "left")
             .join(cat, "pack_version_id", "left").join(att, "event_id", "left"))
        return j.select("event_id", "title", "status",
                        *[F.coalesce(x, F.lit(0)).cast("long").alias(x)
                          for x in ["participants", "teams", "quests", "tasks", "attempts"]],
                        F.coalesce("attempts_by_status", F.lit("")).alias("attempts_by_status"))
