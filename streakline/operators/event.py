"""Event-game operators: attempt resolution, the idempotent ledger, identity
resolution, team scores and ranks, report sections.

Inputs are DataFrames shaped like the game's tables (competitions, teams,
participants, identity map, tasks, attempts, validation results, ledger).
Everything is keyed by ``event_id`` so one job serves every event at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .keys import first_per_key
from .ranking import partition_rank, top_k_per_group

# Per-validator status precedence (highest wins).
STATUS_SEVERITY = [("error", 5), ("failed", 4), ("manual", 3), ("passed", 2), ("skipped", 1)]
# Event states in which scoring is frozen, attempts are open, teams may join.
FROZEN_STATES = ["frozen", "completed", "archived"]
OPEN_STATES = ["active"]
JOINABLE_STATES = ["ready", "active", "paused"]
VISIBLE_STATES = ["active", "paused", "frozen"]
LEDGER_COLS = ["event_id", "idempotency_key", "team_id", "workspace_id", "user_id", "task_id",
               "points_delta", "source_type", "source_id", "reason", "created_at"]


def _severity(status: Column) -> Column:
    expr = None
    for name, code in STATUS_SEVERITY:
        expr = F.when(status == name, F.lit(code)) if expr is None else expr.when(status == name, F.lit(code))
    return expr


def _status_of(code: Column) -> Column:
    expr = None
    for name, c in STATUS_SEVERITY:
        expr = F.when(code == c, F.lit(name)) if expr is None else expr.when(code == c, F.lit(name))
    return expr


def attempt_status(attempts: DataFrame, results: DataFrame | Column, near: tuple[str, ...] = ()) -> DataFrame:
    """CO-13: per-validator outcomes → task status; attempts with no outcome → error.

    error > failed > manual > passed > skipped, as a max over a severity code.
    ``results``: a table of outcomes, a row each (one aggregation per attempt,
    then a left join so missing results count), or a column of ``attempts`` that
    holds each row's own outcomes as an array. With a column, the outcomes of all
    rows of one ``attempt_id`` count; ``near`` names columns that the id
    determines, so that attempts partitioned by them are not shuffled again.
    """
    if isinstance(results, Column):
        sev = F.array_max(F.transform(results, lambda r: _severity(r["status"])))
        sev = F.when(F.col("attempt_id").isNotNull(), F.max(sev).over(_same_attempt(near)))
        a = attempts.withColumn("_sev", sev)
    else:
        sev = results.groupBy("attempt_id").agg(F.max(_severity(F.col("status"))).alias("_sev"))
        a = attempts.join(sev, "attempt_id", "left")
    return a.withColumn("status", F.coalesce(_status_of(F.col("_sev")), F.lit("error"))).drop("_sev")


def _same_attempt(near):
    return Window.partitionBy(*near, "attempt_id")


def outcome_counts(attempts: DataFrame, results: Column, near: tuple[str, ...] = ()) -> DataFrame:
    """AG-14: ``validations`` and ``validation_passes`` of each row's attempt, of all rows of its id.

    ``results`` and ``near`` as in :func:`attempt_status`.
    """
    passes = F.size(F.filter(results, lambda r: r["status"] == "passed"))
    known = F.col("attempt_id").isNotNull()
    return attempts.select(
        "*", F.when(known, F.sum(F.size(results)).over(_same_attempt(near))).alias("validations"),
        F.when(known, F.sum(passes).over(_same_attempt(near))).alias("validation_passes"))


def frozen(competitions: DataFrame) -> Column:
    """FI-15: scoring is frozen by state or by a freeze stamp."""
    return F.col("status").isin(*FROZEN_STATES) | F.col("scoring_frozen_at").isNotNull()


def award_candidates(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """CO-11: passed attempts → base-points ledger candidates (points > 0 and a scope)."""
    t = tasks.select("task_id", "points")
    a = attempts.filter(F.col("status") == "passed").join(t, "task_id")
    a = a.filter((F.col("points") > 0) & (F.col("team_id").isNotNull() | F.col("workspace_id").isNotNull()))
    return a.select(
        "event_id",
        X.base_points_key("event_id", "task_id", "team_id", "workspace_id").alias("idempotency_key"),
        "team_id", "workspace_id", "user_id", "task_id",
        F.col("points").alias("points_delta"), F.lit("validation").alias("source_type"),
        F.col("attempt_id").alias("source_id"), F.lit("task_passed").alias("reason"), "created_at",
        F.col("attempt_id").alias("candidate_id"))


def hint_candidates(reveals: DataFrame, tasks: DataFrame, competitions: DataFrame) -> DataFrame:
    """CO-12: hint reveals → penalty candidates (-|penalty|, only while scoring is open)."""
    t = tasks.select("task_id", "hint_penalty")
    open_events = competitions.filter(~frozen(competitions)).select("event_id")
    r = reveals.join(t, "task_id").join(open_events, "event_id", "left_semi")
    delta = -F.abs(F.coalesce(F.col("hint_penalty"), F.lit(0)))
    r = r.withColumn("points_delta", delta.cast("int"))
    r = r.filter((F.col("points_delta") != 0) & (F.col("team_id").isNotNull() | F.col("workspace_id").isNotNull()))
    return r.select(
        "event_id", X.hint_penalty_key("event_id", "hint_id", "team_id", "workspace_id").alias("idempotency_key"),
        "team_id", "workspace_id", "user_id", "task_id", "points_delta",
        F.lit("hint_penalty").alias("source_type"), F.col("hint_id").cast("string").alias("source_id"),
        F.lit("hint_revealed").alias("reason"), "created_at", F.col("source_id").alias("candidate_id"))


def ledger_append(ledger: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """UP-8: ``INSERT ... ON CONFLICT (idempotency_key) DO NOTHING`` for a batch.

    The first candidate per key (by created_at, then the unique
    ``candidate_id``) is the one a
    serial writer would have inserted; it is awarded unless the key is already
    in the ledger. Returns ``(new ledger rows, decisions)`` where decisions
    carry ``awarded`` for every candidate. The pick is an aggregate (combined
    map-side), so a key repeated a billion times is reduced before the shuffle.
    """
    c = candidates.select(*LEDGER_COLS, "candidate_id")
    firsts = first_per_key(c, ["idempotency_key"], ["created_at", "candidate_id"])
    new_rows = firsts.join(ledger.select("idempotency_key"), "idempotency_key", "left_anti")
    winners = new_rows.select("idempotency_key", F.col("candidate_id").alias("_win"))
    d = c.join(winners, "idempotency_key", "left")
    decisions = d.withColumn("awarded", F.coalesce(F.col("candidate_id") == F.col("_win"), F.lit(False))) \
        .drop("_win")
    return new_rows.select(*LEDGER_COLS), decisions


def resolve_team(ledger: DataFrame, identity_map: DataFrame) -> DataFrame:
    """JO-7: standalone rows keep their team; federated rows take the mapped one."""
    m = identity_map.select("event_id", "workspace_id", F.col("lab_user_email").alias("user_id"),
                            F.col("team_id").alias("_map_team"))
    j = ledger.join(m, ["event_id", "workspace_id", "user_id"], "left")
    return j.withColumn("resolved_team_id", F.coalesce(F.col("team_id"), F.col("_map_team"))).drop("_map_team")


def team_scores(ledger: DataFrame, identity_map: DataFrame) -> DataFrame:
    """AG-11: per (event, resolved team): total, row count, last scored."""
    r = resolve_team(ledger, identity_map).filter(F.col("resolved_team_id").isNotNull())
    return r.groupBy("event_id", F.col("resolved_team_id").alias("team_id")).agg(
        F.sum("points_delta").alias("total_points"), F.count(F.lit(1)).alias("scoring_events"),
        F.max("created_at").alias("last_scored_at"))


def event_leaderboard(scores: DataFrame, teams: DataFrame) -> DataFrame:
    """WI-4: rank teams per event by total desc, earlier last score first (NULLs last)."""
    t = teams.select("team_id", "display_name")
    j = scores.join(t, "team_id")
    return partition_rank(j, ["event_id"], [F.col("total_points").desc(), F.col("last_scored_at").asc_nulls_last()],
                          "rank").select("event_id", "team_id", "display_name", "total_points", "rank",
                                         "last_scored_at")


def unmapped_identities(ledger: DataFrame, identity_map: DataFrame) -> DataFrame:
    """AG-13 / JO-8: federated rows whose (event, workspace, user) maps to no team."""
    r = resolve_team(ledger, identity_map)
    u = r.filter(F.col("workspace_id").isNotNull() & F.col("team_id").isNull() & F.col("resolved_team_id").isNull())
    return u.groupBy("event_id", "workspace_id", F.col("user_id").alias("lab_user_email")).agg(
        F.count(F.lit(1)).alias("scoring_events"), F.sum("points_delta").alias("unattributed_points"),
        F.max("created_at").alias("last_seen_at"))


def task_completion_status(attempts: DataFrame) -> DataFrame:
    """AG-12: per (event, team, task): completed flag, attempts, last attempt."""
    return attempts.groupBy("event_id", "team_id", "task_id").agg(
        F.max(F.when(F.col("status") == "passed", 1).otherwise(0)).alias("completed"),
        F.count(F.lit(1)).alias("attempts"), F.max("created_at").alias("last_attempt_at"))


def completion_pairs(ledger: DataFrame) -> DataFrame:
    """AG-10: distinct (event, team, task) with a positive validation award."""
    return (ledger.filter((F.col("source_type") == "validation") & (F.col("points_delta") > 0)
                          & F.col("task_id").isNotNull() & F.col("team_id").isNotNull())
            .select("event_id", "team_id", "task_id").distinct())


def failure_summary(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """AG-15: failed / error attempts per (event, task, title, status)."""
    f = attempts.filter(F.col("status").isin("failed", "error"))
    j = f.join(tasks.select("task_id", "task_title"), "task_id", "left")
    return j.groupBy("event_id", "task_id", "task_title", "status").agg(F.count(F.lit(1)).alias("attempts"))


def attempt_status_counts(attempts: DataFrame) -> DataFrame:
    """AG-16: attempts per (event, status)."""
    return attempts.groupBy("event_id", "status").agg(F.count(F.lit(1)).alias("c"))


def first_solves(ledger: DataFrame) -> DataFrame:
    """WI-6: first team to complete each task (created_at, then team_id, breaks ties)."""
    v = (ledger.filter((F.col("source_type") == "validation") & (F.col("points_delta") > 0)
                       & F.col("task_id").isNotNull() & F.col("team_id").isNotNull())
         .select("event_id", "task_id", "team_id", "created_at"))
    return first_per_key(v, ["event_id", "task_id"], ["created_at", "team_id"])


def fastest_team(solves: DataFrame) -> DataFrame:
    """WI-8 / CO-21: team with the most first solves per event (team_id breaks ties)."""
    c = solves.groupBy("event_id", "team_id").agg(F.count(F.lit(1)).alias("first_solves"))
    return top_k_per_group(c, ["event_id"], [F.col("first_solves").desc(), F.col("team_id").asc()], 1).drop("rn")


def champions(board: DataFrame, k: int = 3) -> DataFrame:
    """TK-8: top k ranked teams per event (NULL rank last; team_id breaks ties)."""
    return top_k_per_group(board, ["event_id"], [F.col("rank").asc_nulls_last(), F.col("team_id").asc()], k,
                           "position")


def team_names(teams: DataFrame) -> DataFrame:
    """PR-16: display name → name → id, empty strings fall through."""
    return teams.select("team_id", "event_id",
                        X.first_nonblank("display_name", "name", "team_id").alias("team_name"))


def completion_matrix(teams: DataFrame, tasks: DataFrame, competitions: DataFrame, pairs: DataFrame) -> DataFrame:
    """CO-15: per team, catalog tasks completed, catalog size, pct (1 dp, half-even).

    Built from joins on the event's pack version — no team × task product.
    The per-team list of completed tasks is the (team, task) pairs frame
    itself (``completion_pairs``); it is not gathered into one cell, so a
    catalog of any size never lands in one group.
    """
    tv = team_names(teams).join(competitions.select("event_id", "pack_version_id"), "event_id")
    catalog = tasks.select("pack_version_id", "task_id")
    sizes = catalog.groupBy("pack_version_id").agg(F.count(F.lit(1)).alias("total_tasks"))
    done = (pairs.join(competitions.select("event_id", "pack_version_id"), "event_id")
            .join(catalog, ["pack_version_id", "task_id"], "left_semi")
            .groupBy("event_id", "team_id")
            .agg(F.count(F.lit(1)).alias("completed_count")))
    m = tv.join(sizes, "pack_version_id", "left").join(done, ["event_id", "team_id"], "left")
    total = F.coalesce(F.col("total_tasks"), F.lit(0))
    cnt = F.coalesce(F.col("completed_count"), F.lit(0))
    pct = F.when(total > 0, F.bround(F.lit(100.0) * cnt / total, 1)).otherwise(F.lit(0.0))
    return m.select("event_id", "team_id", "team_name", cnt.alias("completed_count"), total.alias("total_tasks"),
                    pct.alias("completion_pct"))


def blockers(teams: DataFrame, tasks: DataFrame, quests: DataFrame, competitions: DataFrame,
             pairs: DataFrame, failures: DataFrame) -> DataFrame:
    """CO-16: tasks solved by fewer than all teams, or with failed attempts."""
    n_teams = teams.groupBy("event_id").agg(F.count(F.lit(1)).alias("total_teams"))
    cat = (competitions.select("event_id", "pack_version_id")
           .join(tasks.select("pack_version_id", "task_id", "task_title", "quest_id"), "pack_version_id")
           .join(quests.select("quest_id", "quest_title"), "quest_id", "left"))
    solved = pairs.groupBy("event_id", "task_id").agg(F.count(F.lit(1)).alias("solved_teams"))
    failed = failures.groupBy("event_id", "task_id").agg(F.sum("attempts").alias("failed_attempts"))
    b = (cat.join(solved, ["event_id", "task_id"], "left").join(failed, ["event_id", "task_id"], "left")
         .join(n_teams, "event_id", "left"))
    b = b.select("event_id", "task_id", "task_title", "quest_title",
                 F.coalesce("solved_teams", F.lit(0)).alias("solved_teams"),
                 F.coalesce("total_teams", F.lit(0)).alias("total_teams"),
                 F.coalesce("failed_attempts", F.lit(0)).alias("failed_attempts"))
    floor_teams = F.greatest(F.col("total_teams"), F.lit(1))
    return b.filter((F.col("solved_teams") < floor_teams) | (F.col("failed_attempts") > 0))


def worst_blockers(blocks: DataFrame, k: int) -> DataFrame:
    """TK-9: least solved, then most failed (task_id breaks ties), top k per event."""
    return top_k_per_group(blocks, ["event_id"], [F.col("solved_teams").asc(), F.col("failed_attempts").desc(),
                                                  F.col("task_id").asc()], k, "position")


def hint_usage(ledger: DataFrame, teams: DataFrame, tasks: DataFrame) -> DataFrame:
    """CO-17: hint penalties with team and task names."""
    h = ledger.filter(F.col("source_type") == "hint_penalty")
    t = teams.select("team_id", F.col("display_name").alias("team_name"))
    k = tasks.select("task_id", "task_title")
    return h.join(t, "team_id", "left").join(k, "task_id", "left").select(
        "event_id", "team_id", "team_name", F.col("source_id").alias("hint_id"), "task_id", "task_title",
        F.col("points_delta").alias("penalty"), "created_at")


def participant_roster(participants: DataFrame, teams: DataFrame, attempts: DataFrame) -> DataFrame:
    """CO-20: every participant with team, attempts submitted, distinct tasks passed."""
    t = teams.select("team_id", "event_id", F.col("display_name").alias("team_name"), F.col("name").alias("team_slug"))
    per_user = attempts.groupBy("event_id", "user_id").agg(
        F.count(F.lit(1)).alias("attempts_total"),
        F.countDistinct(F.when(F.col("status") == "passed", F.col("task_id"))).alias("tasks_passed"))
    p = participants.select("participant_id", "user_id", "display_name", "event_id", "team_id")
    j = p.join(t, ["team_id", "event_id"], "left").join(per_user, ["event_id", "user_id"], "left")
    return j.select("event_id", "participant_id", "user_id",
                    X.first_nonblank("display_name", "user_id").alias("display_name"),
                    F.lit("player").alias("role"), "team_id",
                    F.coalesce(X.first_nonblank("team_name"), F.lit("—")).alias("team_name"),
                    F.coalesce("tasks_passed", F.lit(0)).alias("tasks_passed"),
                    F.coalesce("attempts_total", F.lit(0)).alias("attempts_total"))


def manual_adjustments(requests: DataFrame, teams: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """UP-14: host point adjustments → (audit rows, ledger rows, rejected rows).

    A request needs a reason, a non-zero delta and, when a team is named, a
    team of that event (semi-join). Accepted requests become one audit row and
    one ledger row keyed ``manual:{adjustment_id}`` so a replay adds nothing.
    """
    t = teams.select("event_id", "team_id").distinct()
    reason_ok = F.coalesce(F.trim(F.col("reason")), F.lit("")) != ""
    delta_ok = F.coalesce(F.col("points_delta"), F.lit(0)) != 0
    base = requests.filter(reason_ok & delta_ok)
    named = base.filter(F.col("team_id").isNotNull()).join(t, ["event_id", "team_id"], "left_semi")
    ok = named.unionByName(base.filter(F.col("team_id").isNull()))
    rejected = requests.join(ok.select("adjustment_id"), "adjustment_id", "left_anti").withColumn(
        "rejection", F.when(~reason_ok, F.lit("reason required")).when(~delta_ok, F.lit("delta must be non-zero"))
        .otherwise(F.lit("team not in event")))
    audit = ok.select("adjustment_id", "event_id", "team_id", "user_id", "task_id", "points_delta", "reason",
                      "created_by", "created_at")
    ledger = ok.select(
        "event_id", F.concat(F.lit("manual:"), F.col("adjustment_id")).alias("idempotency_key"), "team_id",
        F.lit(None).cast("string").alias("workspace_id"), "user_id", "task_id", "points_delta",
        F.lit("manual_adjustment").alias("source_type"), F.col("adjustment_id").alias("source_id"), "reason",
        "created_at")
    return audit, ledger, rejected
