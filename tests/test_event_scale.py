"""Attempts are joined once for all that reads them, and resolved where their order's rows already are."""

import pytest
from pyspark.sql import functions as F

from streakline.operators import event as E
from streakline.plans import extras as XT
from streakline.plans import read_models as RM
from streakline.plans.event_game import EventGame
from streakline.sources import standins as S
from streakline.sources.tables import Tables

OUT = "array<struct<validator_id:int,status:string>>"


def _out(*statuses):
    return [(i, s) for i, s in enumerate(statuses, 1)]


def test_outcomes_as_a_column_equal_outcomes_as_a_table(spark):
    rows = [(1, "1-1", _out("passed", "passed")), (1, "1-1", _out("failed", "passed")), (1, "1-2", []), (2, "2-1", _out("skipped")),
            (2, "2-2", _out("manual", "error")), (3, None, _out("passed"))]
    a = spark.createDataFrame(rows, f"l_orderkey long, attempt_id string, outcomes {OUT}")
    table = a.select("attempt_id", F.explode("outcomes").alias("r")).select("attempt_id", "r.*")
    was = E.attempt_status(a, table)
    now = E.attempt_status(a, F.col("outcomes"), ("l_orderkey",))
    assert sorted(map(str, was.select(*now.columns).collect())) == sorted(map(str, now.collect()))
    joined = table.join(a.select("attempt_id", "l_orderkey"), "attempt_id").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "passed").alias("p"))
    counted = E.outcome_counts(a, F.col("outcomes"), ("l_orderkey",)).groupBy("l_orderkey").agg(
        F.sum("validations").alias("n"), F.sum("validation_passes").alias("p")).where("n > 0")
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in counted.collect()} == {(1, 8, 6), (2, 3, 0)}


@pytest.mark.parametrize("query", [XT.workspace_health, lambda g: g.ledger, lambda g: g.roster(), XT.follow_ups])
def test_attempts_are_joined_once(spark, monkeypatch, query):
    calls, real = [], S.attempts
    monkeypatch.setattr(S, "attempts", lambda t: calls.append(1) or real(t))
    query(EventGame(spark, "/root/testdata/sf0.001")).collect()
    assert len(calls) == 1


def test_lines_are_shuffled_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr("streakline.plans.event_game.written", lambda df, name: plans.append(df) or df)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        EventGame(spark, "/root/testdata/sf0.001").attempts  # noqa: B018
        text = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert text.count("l_shipdate") and text.count("Exchange hashpartitioning(l_orderkey") == 1
    assert "Exchange hashpartitioning(attempt_id" not in text


class _Game:
    def __init__(self, spark, attempts):
        self.attempts = spark.createDataFrame(attempts, "event_id int, user_id string, task_id long, status string")
        self.tasks = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 2), (4, 9)], "task_id long, quest_id int")
        self.quests = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (9, None)], "quest_id int, quest_slug string")


def test_heatmap_groups_passed_tasks_only(spark, monkeypatch):
    tried = [(1, "u", t, s) for t, s in [(1, "passed"), (1, "failed"), (1, "passed"), (2, "passed"), (3, "passed"), (4, "passed")]]
    tried += [(1, "v", t, "failed") for t in (1, 2, 3)] + [(2, "u", 3, "passed"), (2, None, 1, "error"), (2, "x", 7, "passed")]
    seen = []
    real = type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda df, *c: seen.append((c, df)) or real(df, *c))
    out = sorted(map(tuple, RM.capability_heatmap(_Game(spark, tried)).collect()), key=str)
    assert out == sorted([(1, "u", 2, 1), (1, "v", 0, 0), (2, "u", 0, 1), (2, None, 0, 0)], key=str)
    # what is grouped by user: passed tasks, and a row a user for all others (before: a row each task tried)
    cols, grouped = seen[-1]
    assert cols == ("event_id", "user_id") and grouped.where("user_id = 'v'").count() == 1


def _sorts_of_lines(spark, df):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return [x for x in plan.splitlines() if "Sort [l_orderkey" in x]


def test_lines_are_sorted_once_and_narrow(spark, monkeypatch):
    plans = []
    monkeypatch.setattr("streakline.plans.event_game.written", lambda df, name: plans.append(df) or df)
    EventGame(spark, "/root/testdata/sf0.001").attempts  # noqa: B018
    sorts = _sorts_of_lines(spark, lambda: plans[0].select("*"))
    # before: sorted for the join, then again with users, workspaces and outcome arrays for the window
    assert len(sorts) == 1 and "attempt_id" in sorts[0]
    text = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join Inner") < text.index("Window [")


def test_outcomes_count_over_all_rows_of_an_attempt(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    # order 1 comes twice and customer 7 twice; lines of one id differ, one id comes of different null parts
    table("nation", [(3, "N", 1)], "n_nationkey int, n_name string, n_regionkey int")
    table("customer", [(7, "c", 3, 1.0, "BUILDING"), (7, "c", 3, 2.0, "MACHINERY"), (8, "d", 3, 1.0, None), (9, "e", None, 1.0, "X")],
          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    orders = [(1, 7), (1, 8), (2, 8), (3, 9), (4, None), (None, 8)]
    table("orders", orders, "o_orderkey long, o_custkey long")
    q, bad = float(S.NO_RESULT_QUANTITY), S.ERROR_TAX
    lines = [(1, 1, 5, 5, q + 1, S.PASS_DISCOUNT, bad + 1, "A"), (1, 1, 5, 5, q + 1, 0.0, bad, "R"), (1, 2, 5, 5, q, 0.0, bad, "A"),
             (1, None, 2, 6, q + 1, S.PASS_DISCOUNT, bad + 1, "A"), (1, 2, None, 6, q + 1, -1.0, bad + 1, "A"),
             (2, 1, 5, None, q + 1, S.PASS_DISCOUNT, bad + 1, "A"), (2, 1, 5, None, None, None, None, None),
             (3, 1, 1, 1, q + 1, 0.0, bad, "A"), (None, 1, 1, 1, q + 1, 0.0, bad, "A"), (4, 1, 1, 1, q + 1, 0.0, bad, "A")]
    table("lineitem", [(*x, None) for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
          "l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp")
    t = Tables(spark, str(tmp_path))
    got = S.attempts(t)
    # the plain way: every joined row's outcomes, a row each
    r = S.validation_results(got.drop("status"))
    want = {x.attempt_id: (x.v, x.p) for x in r.groupBy("attempt_id").agg(
        F.count(F.lit(1)).alias("v"), F.count_if(F.col("status") == "passed").alias("p")).collect()}
    status = {x.attempt_id: x.status for x in E.attempt_status(got.drop("status").select("attempt_id").distinct(), r).collect()}
    rows = got.collect()
    assert len(rows) == 5 * 3 + 2 and {x.attempt_id for x in rows} == {"1-1-5-5", "1-2-5-5", "1-2-6", "2-1-5"}
    for x in rows:
        assert (x.validations, x.validation_passes) == want.get(x.attempt_id, (0, 0))
        assert x.status == status[x.attempt_id]
