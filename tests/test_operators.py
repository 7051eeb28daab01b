"""Operators on hand-made golden rows (streaks, keys, ranking, ledger, status, assertions)."""

import datetime as dt

from pyspark.sql import functions as F

from streakline.operators import assertions as A
from streakline.operators import event as E
from streakline.operators.keys import first_per_key, insert_absent, latest_per_key, update_changed, upsert
from streakline.operators.ranking import global_row_number, window_row_number
from streakline.operators.streaks import streaks


def d(s):
    return dt.date.fromisoformat(s)


def test_streaks_current_is_latest_island(spark):
    rows = [("u", d(x)) for x in ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-10", "2024-01-11"]]
    rows += [("v", d("2024-01-05")), ("v", d("2024-01-05"))]
    out = {r.user_id: (r.max_streak, r.current_streak)
           for r in streaks(spark.createDataFrame(rows, "user_id string, activity_date date")).collect()}
    assert out == {"u": (3, 2), "v": (1, 1)}


def test_latest_and_first_per_key(spark):
    df = spark.createDataFrame([("ws", 1, 10, "a"), ("ws", 1, 20, "b"), ("ws", 2, 5, "c"), ("ws", 1, 20, "a")],
                               "workspace_id string, job_id int, change_time int, name string")
    latest = {r.job_id: (r.change_time, r.name) for r in latest_per_key(df, ["workspace_id", "job_id"], ["change_time"]).collect()}
    assert latest == {1: (20, "b"), 2: (5, "c")}  # tie on change_time broken by the other columns
    first = {r.job_id: r.change_time for r in first_per_key(df, ["workspace_id", "job_id"], ["change_time"]).collect()}
    assert first == {1: 10, 2: 5}


def test_merge_family(spark):
    target = spark.createDataFrame([("u1", "m1", 1), ("u2", "m1", 2)], "user_id string, mission_id string, v int")
    source = spark.createDataFrame([("u1", "m1", 9), ("u3", "m1", 3), (None, "m1", 4)],
                                   "user_id string, mission_id string, v int")
    new = insert_absent(target, source, ["user_id", "mission_id"]).collect()
    assert sorted((r.user_id or "", r.v) for r in new) == [("", 4), ("u3", 3)]  # NULL keys never match
    up = {r.user_id: r.v for r in upsert(target, source.filter("user_id is not null"), ["user_id", "mission_id"]).collect()}
    assert up == {"u1": 9, "u2": 2, "u3": 3}
    changed = update_changed(target, spark.createDataFrame([("u1", "m1", 1), ("u2", "m1", 7)],
                                                           "user_id string, mission_id string, v int"),
                             ["user_id", "mission_id"], ["v"])
    assert {r.user_id: r.v for r in changed.collect()} == {"u1": 1, "u2": 7}


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("user_id"), (F.col("id") % 37).alias("pts"))
    order = [F.col("pts").desc(), F.col("user_id").asc()]
    a = {r.user_id: r.rk for r in global_row_number(df, order, "rk", partitions=7).collect()}
    b = {r.user_id: r.rk for r in window_row_number(df, order, "rk").collect()}
    assert a == b and sorted(a.values()) == list(range(1, 2001))


def test_ledger_append_awards_once(spark):
    ts = dt.datetime(2024, 1, 1)
    cols = ("event_id string, idempotency_key string, team_id string, workspace_id string, user_id string, "
            "task_id string, points_delta int, source_type string, source_id string, reason string, "
            "created_at timestamp, candidate_id string")
    cands = spark.createDataFrame([
        ("evt_1", "team:team_red:evt_1:tsk_1:base", "team_red", None, "u", "tsk_1", 200, "validation", "a1", "r", ts, "a1"),
        ("evt_1", "team:team_red:evt_1:tsk_1:base", "team_red", None, "u", "tsk_1", 200, "validation", "a2", "r",
         ts + dt.timedelta(seconds=1), "a2"),
        ("evt_1", "team:team_blue:evt_1:tsk_1:base", "team_blue", None, "u", "tsk_1", 200, "validation", "a3", "r", ts, "a3"),
    ], cols)
    empty = spark.createDataFrame([], cols).drop("candidate_id")
    new, decisions = E.ledger_append(empty, cands)
    assert new.count() == 2
    awarded = {r.candidate_id: r.awarded for r in decisions.collect()}
    assert awarded == {"a1": True, "a2": False, "a3": True}
    # a second batch with the same keys adds nothing
    new2, _ = E.ledger_append(new, cands)
    assert new2.count() == 0


def test_attempt_status_precedence(spark):
    att = spark.createDataFrame([(f"a{i}",) for i in range(7)], "attempt_id string")
    res = spark.createDataFrame([
        ("a0", "passed"), ("a0", "passed"), ("a1", "passed"), ("a1", "failed"), ("a2", "error"), ("a2", "failed"),
        ("a3", "manual"), ("a3", "passed"), ("a5", "passed"), ("a5", "skipped"), ("a6", "skipped")],
        "attempt_id string, status string")
    out = {r.attempt_id: r.status for r in E.attempt_status(att, res).collect()}
    assert out == {"a0": "passed", "a1": "failed", "a2": "error", "a3": "manual", "a4": "error",
                   "a5": "passed", "a6": "skipped"}


def test_expectations_truth_table(spark):
    t = spark.createDataFrame([(1500, "GOLD", "hello", 5)], "cnt int, tier string, word string, five int")
    rules = [
        A.Assertion("ge_pass", "t", "max(cnt)", ">=", "1000"), A.Assertion("ge_fail", "t", "max(cnt)", ">=", "5000"),
        A.Assertion("lt", "t", "max(five)", "<", "10"), A.Assertion("le", "t", "max(five)", "<=", "5"),
        A.Assertion("eq_num", "t", "42", "=", "42"), A.Assertion("eq_num_f", "t", "43", "=", "42"),
        A.Assertion("ne", "t", "1", "!=", "0"), A.Assertion("eq_str", "t", "max(tier)", "=", "GOLD"),
        A.Assertion("eq_str_f", "t", "'BRONZE'", "=", "GOLD"), A.Assertion("contains", "t", "max(word)", "contains", "ell"),
        A.Assertion("unknown", "t", "1", "~", "1"), A.Assertion("ge_text", "t", "max(tier)", ">=", "1"),
        A.Assertion("default", "t", None), A.Assertion("min_rows", "t", None, min_rows=2),
        A.Assertion("is_true", "t", "count(*) > 0", "is_true"), A.Assertion("is_false", "t", "0", "is_false"),
    ]
    out = {r.rule_id: r.status for r in A.run_assertions(spark, {"t": t}, rules).collect()}
    assert out == {"ge_pass": "passed", "ge_fail": "failed", "lt": "passed", "le": "passed", "eq_num": "passed",
                   "eq_num_f": "failed", "ne": "passed", "eq_str": "passed", "eq_str_f": "failed",
                   "contains": "passed", "unknown": "error", "ge_text": "error", "default": "passed",
                   "min_rows": "failed", "is_true": "passed", "is_false": "passed"}


def test_evidence_is_capped(spark):
    df = spark.createDataFrame([(i, "x" * 500) for i in range(20)], "id int, txt string")
    ev = A.evidence(df, F.col("id") >= 0).collect()
    assert len(ev) <= 5 and all(len(r.txt) == 200 for r in ev)
    assert sum(len("id") + len(r.id) + len("txt") + len(r.txt) for r in ev) <= 2000


def test_partial_upsert_keeps_old_values_for_nulls(spark):
    from streakline.operators.keys import partial_upsert
    target = spark.createDataFrame([("ws-1", "host-a", "v1")], "workspace_id string, host string, version string")
    source = spark.createDataFrame([("ws-1", None, "v2"), ("ws-2", "host-b", None)],
                                   "workspace_id string, host string, version string")
    out = {r.workspace_id: (r.host, r.version) for r in partial_upsert(target, source, ["workspace_id"]).collect()}
    assert out == {"ws-1": ("host-a", "v2"), "ws-2": ("host-b", None)}


def test_single_team_per_event(spark):
    from streakline.sources.roster import single_team_assignments
    a = spark.createDataFrame([("e", "p1", "red", 1), ("e", "p1", "blue", 2), ("e", "p2", "red", 1)],
                              "event_id string, participant_id string, team_id string, assigned_at int")
    out = {r.participant_id: r.team_id for r in single_team_assignments(a).collect()}
    assert out == {"p1": "blue", "p2": "red"}
