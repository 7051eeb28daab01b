"""Catalog lint on a hand-made pack: every rule fires once where it should."""

from streakline.operators import lint as L


def test_lint_rules(spark):
    quests = spark.createDataFrame([
        (1, 1, "intro", None, False), (1, 2, "Bad Slug", "intro", True), (1, 3, "loop", "loop", True),
        (1, 4, "ghost", "nowhere", True), (1, 5, "empty", None, False)],
        "pack_version_id int, quest_id int, quest_slug string, unlock_quest_slug string, has_unlock_rule boolean")
    tasks = spark.createDataFrame([(1, 1, 10, "t-a", 5), (1, 1, 11, "t-a", -1), (1, 2, 12, "t-c", 1),
                                   (1, 3, 13, "t-d", 1), (1, 4, 14, "t-e", 1)],
                                  "pack_version_id int, quest_id int, task_id int, task_slug string, points int")
    validators = spark.createDataFrame([
        (10, 1, "sql_assertion", "sync", ">=", "SELECT 1 FROM ${team_schema}.t"),
        (10, 1, "sql_assertion", "sync", ">=", "SELECT 1"),
        (11, 1, "mystery", "sync", None, None),
        (12, 1, "sql_assertion", "later", "~", "SELECT ${nope}"),
        (13, 1, "sql_assertion", "async", None, ""),
    ], "task_id int, validator_id int, type string, mode string, operator string, statement string")
    hints = spark.createDataFrame([(10, 1, -5), (12, 2, 5)], "task_id int, hint_id int, penalty_points int")
    f = L.lint(quests, tasks, validators, hints).collect()
    msgs = sorted(r.message for r in f)
    expect_fragments = ["Invalid quest slug 'Bad Slug'", "Duplicate task slug 't-a'", "Duplicate validator id '1'",
                        "Each quest must define at least one task", "Task has no validators",
                        "points must be >= 0", "Unknown validator type 'mystery'", "got 'later'",
                        "requires a 'statement'", "no 'expect' block", "Unknown operator '~'",
                        "penalty_points is usually <= 0", "Unknown template variable '${nope}'",
                        "cannot be gated on completing itself", "references unknown quest 'nowhere'"]
    for frag in expect_fragments:
        assert any(frag in m for m in msgs), frag
    summary = L.lint_summary(spark.createDataFrame(f), quests, tasks, validators, hints).first()
    assert summary.ok is False and summary.errors > 0 and summary.warnings > 0 and summary.quests == 5
