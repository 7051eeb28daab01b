"""Report sections on the reference's golden event: 2 teams, 3 tasks, red solves all, blue one."""

import datetime as dt

from pyspark.sql import functions as F

from streakline.operators import event as E

TS = dt.datetime(2024, 5, 1, 10, 0)


def _world(spark):
    comps = spark.createDataFrame([("evt_1", "pv_1")], "event_id string, pack_version_id string")
    teams = spark.createDataFrame([("red", "evt_1", "red", "Red Team"), ("blue", "evt_1", "blue", "Blue Team")],
                                  "team_id string, event_id string, name string, display_name string")
    tasks = spark.createDataFrame([("pv_1", "t1", "q1", "Task 1"), ("pv_1", "t2", "q1", "Task 2"),
                                   ("pv_1", "t3", "q2", "Task 3")],
                                  "pack_version_id string, task_id string, quest_id string, task_title string")
    quests = spark.createDataFrame([("q1", "Quest 1"), ("q2", "Quest 2")], "quest_id string, quest_title string")
    pairs = spark.createDataFrame([("evt_1", "red", "t1"), ("evt_1", "red", "t2"), ("evt_1", "red", "t3"),
                                   ("evt_1", "blue", "t1")], "event_id string, team_id string, task_id string")
    failures = spark.createDataFrame([("evt_1", "t3", "Task 3", "failed", 4)],
                                     "event_id string, task_id string, task_title string, status string, attempts long")
    return comps, teams, tasks, quests, pairs, failures


def test_completion_matrix(spark):
    comps, teams, tasks, _, pairs, _ = _world(spark)
    m = {r.team_id: (r.completed_count, r.total_tasks, r.completion_pct)
         for r in E.completion_matrix(teams, tasks, comps, pairs).collect()}
    assert m == {"red": (3, 3, 100.0), "blue": (1, 3, 33.3)}


def test_blockers_worst_first(spark):
    comps, teams, tasks, quests, pairs, failures = _world(spark)
    b = E.blockers(teams, tasks, quests, comps, pairs, failures)
    worst = E.worst_blockers(b, 10).orderBy("position").collect()
    assert [(r.task_id, r.solved_teams, r.failed_attempts) for r in worst] == [("t3", 1, 4), ("t2", 1, 0)]


def test_champions_and_fastest(spark):
    board = spark.createDataFrame([("evt_1", "red", 120, 1), ("evt_1", "blue", 40, 2)],
                                  "event_id string, team_id string, total_points int, rank int")
    assert [r.team_id for r in E.champions(board).orderBy("position").collect()] == ["red", "blue"]
    solves = spark.createDataFrame([("evt_1", "t1", "red", TS), ("evt_1", "t2", "red", TS), ("evt_1", "t3", "red", TS)],
                                   "event_id string, task_id string, team_id string, created_at timestamp")
    f = E.fastest_team(solves).first()
    assert (f.team_id, f.first_solves) == ("red", 3)


def test_identity_resolution(spark):
    cols = "event_id string, team_id string, workspace_id string, user_id string, points_delta int, created_at timestamp"
    ledger = spark.createDataFrame([
        ("evt_1", "red", None, "a@x", 100, TS),            # standalone
        ("evt_1", None, "ws-01", "lab1", 50, TS),          # federated, mapped to blue
        ("evt_1", None, "ws-02", "lab9", 30, TS),          # federated, unmapped
    ], cols)
    imap = spark.createDataFrame([("evt_1", "ws-01", "lab1", "blue")],
                                 "event_id string, workspace_id string, lab_user_email string, team_id string")
    scores = {r.team_id: r.total_points for r in E.team_scores(ledger, imap).collect()}
    assert scores == {"red": 100, "blue": 50}
    un = E.unmapped_identities(ledger, imap).collect()
    assert [(r.workspace_id, r.lab_user_email, r.unattributed_points) for r in un] == [("ws-02", "lab9", 30)]


def test_event_rank_ties_and_nulls(spark):
    scores = spark.createDataFrame([
        ("e", "a", 10, TS), ("e", "b", 10, TS + dt.timedelta(hours=1)), ("e", "c", 5, None), ("e", "d", 5, TS)],
        "event_id string, team_id string, total_points long, last_scored_at timestamp")
    teams = spark.createDataFrame([(t, t) for t in "abcd"], "team_id string, display_name string")
    r = {x.team_id: x.rank for x in E.event_leaderboard(scores, teams).collect()}
    assert r == {"a": 1, "b": 2, "d": 3, "c": 4}
