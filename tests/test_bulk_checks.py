"""Templates for every team, inventory checks, evidence, pivots and small read models."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from streakline.operators import assertions as A
from streakline.operators import bulk_checks as B
from streakline.plans import read_models as RM


def test_every_template_error_fires(spark):
    st = spark.createDataFrame([
        (1, 1, "SELECT * FROM ${schema}.${tab}"), (1, 2, "SELECT 1"), (1, 3, "${zed} ${schema} ${abc} ${zed}"),
        (1, 4, "${empty}x${schema}"), (1, 5, "${bad}"), (1, 6, "${empty} ${bad}"), (1, 7, None), (1, 8, "$schema {tab} ${a b}"),
        (2, 9, "other pack")], "pack int, id int, template string")
    ctx = spark.createDataFrame([(1, "t", {"schema": "s.1-a b", "tab": "", "empty": None, "bad": "x;y"})],
                                "pack int, team string, variables map<string,string>")
    got = {r.id: (r.status, r.statement, r.reason) for r in B.resolve_templates(st, ctx, ["pack"]).collect()}
    assert got == {
        1: ("ok", "SELECT * FROM s.1-a b.", None), 2: ("ok", "SELECT 1", None),
        3: ("error", None, "unresolved template variable(s): abc, zed"),
        4: ("error", None, "template variable 'empty' resolved to null"),
        5: ("error", None, "template variable 'bad' has an unsafe value"),
        6: ("error", None, "template variable 'empty' resolved to null"),
        7: ("error", None, "empty template"), 8: ("ok", "$schema {tab} ${a b}", None)}


def test_inventory_checks(spark):
    inv = spark.createDataFrame([
        ("dashboard", 3, "Sales A", "draft", None), ("dashboard", 1, "sales b", "published", None),
        ("dashboard", 2, "Other", "", None), ("dashboard", 4, None, None, None), ("table", 1, "c.s.t", None, None),
        ("job", 1, "nightly", None, True), ("job", 2, "nightly too", None, None), ("pipeline", 1, "p", "Running", None),
        ("pipeline", 2, "p2", "complete", None)] + [("genie_space", i, f"g{i}", None, None) for i in range(9)],
        "object_kind string, place int, name string, state string, scheduled boolean")
    checks = spark.createDataFrame([
        ("a", "dashboard_exists_for_team", "SALES"), ("b", "dashboard_published", "sales"), ("c", "dashboard_published", None),
        ("d", "table_exists", "c.s.t"), ("e", "table_exists", "s.t"), ("f", "job_exists_with_schedule", "nightly"),
        ("g", "pipeline_update_completed", "p"), ("h", "genie_space_exists", ""), ("i", "unheard_of", "x")],
        "check_id string, kind string, needle string")
    got = {r.check_id: (r.n_matched, r.n_found, r.found, r.names) for r in B.inventory_checks(inv, checks).collect()}
    assert got == {"a": (2, 2, True, "sales b, Sales A"), "b": (2, 1, True, "sales b"), "c": (4, 3, True, "sales b, Other, "),
                   "d": (1, 1, True, "c.s.t"), "e": (0, 0, False, ""), "f": (2, 1, True, "nightly"), "g": (2, 1, True, "p2"),
                   "h": (9, 9, True, "g0, g1, g2, g3, g4"), "i": (0, 0, False, "")}


def test_evidence_caps(spark):
    t = spark.createDataFrame([(i, "x" * (150 * i)) for i in range(1, 30)], "id int, txt string")
    many = A.violating(t, "many", "id < 99", {"id": "id"}, "id")
    long = A.violating(t, "long", "id > 1", {"a": "txt", "b": "txt", "c": "txt"}, "id")
    none = A.violating(t, "none", "id = 3", {"n": "cast(null as string)"}, "-id")
    got = {}
    for r in A.evidence(many.unionByName(long).unionByName(none), ["place"]).collect():
        got.setdefault(r.rule_id, []).append((r.position, len(r.evidence)))
    assert [p for p, _ in got["many"]] == [1, 2, 3, 4, 5]          # rows
    assert [p for p, _ in got["long"]] == [1, 2, 3]                # 3 * 603 characters fit into 2000
    assert got["none"] == [(1, len("n=None"))]


def test_time_ago(spark):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    at = ["2024-01-10 12:00:05", "2024-01-10 11:59:01", "2024-01-10 11:58:31", "2024-01-10 11:00:31", "2024-01-10 10:29:00",
          "2024-01-09 12:31:00", "2024-01-09 12:00:00", "2024-01-01 00:00:00", None]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(a) if a else None,) for a in at], "at timestamp")
    assert [r[0] for r in df.select(RM.time_ago("at", now)).collect()] == [
        "0s ago", "59s ago", "1m ago", "59m ago", "2h ago", "23h ago", "1d ago", "10d ago", ""]


def test_team_export_reads_back(spark, tmp_path, monkeypatch):
    class G:
        teams = spark.createDataFrame([(1, 1, "=cmd", "=cmd"), (2, 1, "Blue", "Blue")],
                                      "team_id int, event_id int, name string, display_name string")
        competitions = spark.createDataFrame([(1, 7)], "event_id int, pack_version_id int")
        quests = spark.createDataFrame([(1, "q")], "quest_id int, quest_slug string")
        tasks = spark.createDataFrame([(1, 7, 1, "First task"), (2, 7, 1, "Second")],
                                      "task_id int, pack_version_id int, quest_id int, task_title string")
        leaderboard = spark.createDataFrame([(1, 1, 1, 30), (1, 2, 2, 10)], "event_id int, team_id int, rank int, total_points int")
        pairs = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 2)], "event_id int, team_id int, task_id int")
        ledger = spark.createDataFrame([(1, 2, "hint_penalty", "h1", 1, -5, None)],
                                       "event_id int, team_id int, source_type string, source_id string, task_id int, "
                                       "points_delta int, created_at timestamp")

        def roster(self):
            return spark.createDataFrame([(1, "@u", "U", "player", "Blue", 1, 2)],
                                         "event_id int, user_id string, display_name string, role string, team_name string, "
                                         "tasks_passed int, attempts_total int")
    out = RM.write_team_export(G(), str(tmp_path / "export"))
    back = spark.read.option("header", True).csv(out["teams"]).orderBy("rank").collect()
    assert [(r.team, r.tasks_completed, r.total_tasks, r.hints_used, r["First task"], r["Second"]) for r in back] == [
        ("'=cmd", "2", "2", "0", "1", "1"), ("Blue", "1", "2", "1", "0", "1")]
    assert [(r.user_id, r.attempts_total) for r in spark.read.option("header", True).csv(out["roster"]).collect()] == [("'@u", "2")]
    monkeypatch.setattr(RM, "MAX_PIVOT", 1)
    with pytest.raises(ValueError, match="too many columns"):
        RM.team_export(G())


def test_lint_of_packs_and_manual_tasks(spark):
    from streakline.operators import lint as L
    packs = spark.createDataFrame([(1, "good-slug", "1.0"), (2, "Bad slug", " "), (3, None, None)],
                                  "pack_version_id int, pack_slug string, version string")
    quests = spark.createDataFrame([(1, 1, "q", None, False)], "pack_version_id int, quest_id int, quest_slug string, "
                                   "unlock_quest_slug string, has_unlock_rule boolean")
    got = sorted((r.pack_version_id, r.loc) for r in L.lint_packs(packs, quests).collect())
    assert got == [(2, "pack.slug"), (2, "pack.version"), (2, "quests"), (3, "pack.slug"), (3, "pack.version"), (3, "quests")]
    tasks = spark.createDataFrame([(1, 1, 10, "by-hand", 5, True), (1, 1, 11, "bare", 5, False), (1, 1, 12, "unset", 5, None)],
                                  "pack_version_id int, quest_id int, task_id int, task_slug string, points int, "
                                  "manual_validation_required boolean")
    v = spark.createDataFrame([], "task_id int, validator_id int, type string, mode string, operator string, statement string")
    h = spark.createDataFrame([], "task_id int, hint_id int, penalty_points int")
    locs = [r.loc for r in L.lint(quests, tasks, v, h).collect()]
    assert len(locs) == 2 and not any("by-hand" in x for x in locs)
