"""Membership import: one team an event, one change for all tables, a second import changes nothing."""

import pytest
from pyspark.sql import functions as F

from streakline.operators import membership as M
from streakline.versions import VersionConflict, VersionedTables

TEAMS = "team_id string, event_id int, name string, display_name string"
PEOPLE = "participant_id string, event_id int, user_id string, display_name string, email string"
ROWS = "event_id int, line long, user_id string, email string, display_name string, team_name string"
def now():
    return F.lit("2024-05-05 00:00:00").cast("timestamp")


def _store(spark, path, teams=(), people=(), members=()):
    store = VersionedTables(spark, str(path))
    store.commit({"teams": spark.createDataFrame(list(teams), TEAMS),
                  "participants": spark.createDataFrame(list(people), PEOPLE),
                  "members": spark.createDataFrame(list(members), "team_id string, participant_id string, joined_at string")
                  .withColumn("joined_at", F.col("joined_at").cast("timestamp"))})
    return store


def _members(store, version=None):
    j = store.read("members", version).join(store.read("teams", version).select("team_id", "name", "event_id"), "team_id") \
        .join(store.read("participants", version).select("participant_id", "user_id"), "participant_id")
    return sorted((r.event_id, r.user_id, r.name, str(r.joined_at)[:10]) for r in j.collect())


def test_creates_teams_people_and_assignments(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = [(1, 1, None, "ada@corp.com", "Ada", "Red"), (1, 2, None, "alan@corp.com", None, "Blue"),
            (1, 3, "", " grace@corp.com ", " ", None), (1, 4, " ", "x@corp.com", None, "Red"), (1, 5, None, None, "Z", "Red")]
    counts = M.run_import(store, spark.createDataFrame(rows, ROWS), now()).collect()
    assert [tuple(c) for c in counts] == [(1, 3, 3, 2, 2, 0)]
    people = {r.user_id: (r.display_name, r.email) for r in store.read("participants").collect()}
    assert people == {"ada@corp.com": ("Ada", "ada@corp.com"), "alan@corp.com": ("alan", "alan@corp.com"),
                      "grace@corp.com": ("grace", "grace@corp.com")}
    before = _members(store)
    assert before == [(1, "ada@corp.com", "Red", "2024-05-05"), (1, "alan@corp.com", "Blue", "2024-05-05")]
    again = M.run_import(store, spark.createDataFrame(rows, ROWS), F.lit("2025-01-01").cast("timestamp")).first()
    assert (again.participants_created, again.teams_created, again.removed) == (0, 0, 0)
    assert _members(store) == before and store.versions() == [1, 2, 3]


def test_a_move_leaves_one_team_an_event_and_other_events_alone(spark, tmp_path):
    store = _store(spark, tmp_path,
                   [("r", 1, "Red", "Red"), ("b", 1, "Blue", "Blue"), ("o", 2, "Red", "Red")],
                   [("p1", 1, "ada", "Ada", "ada"), ("p2", 1, "bob", "Bob", "bob")],
                   [("r", "p1", "2020-01-01"), ("o", "p1", "2020-01-01"), ("b", "p2", "2020-01-01"),
                    ("r", "p2", "2020-01-01")])
    rows = [(1, 1, "ada", None, None, "Red"), (1, 2, "ada", None, None, "Blue"), (1, 3, "bob", None, None, "Blue")]
    c = M.run_import(store, spark.createDataFrame(rows, ROWS), now()).first()
    assert (c.rows, c.assignments, c.removed) == (3, 3, 2)
    assert _members(store) == [(1, "ada", "Blue", "2024-05-05"), (1, "bob", "Blue", "2020-01-01"),
                               (2, "ada", "Red", "2020-01-01")]
    assert len(_members(store, 1)) == 4  # the version before is still readable
    moves = spark.createDataFrame([(1, "p1", "r"), (1, "p1", "gone")], "event_id int, participant_id string, team_id string")
    after = M.set_team(store.read("members"), store.read("teams"), moves, now())
    assert sorted((r.team_id, r.participant_id) for r in after.collect()) == [("b", "p2"), ("o", "p1"), ("r", "p1")]


def test_refused_failed_and_beaten_imports_change_nothing(spark, tmp_path):
    store = _store(spark, tmp_path, [("r", 1, "Red", "Red")], [("p1", 1, "ada", "Ada", "ada")], [("r", "p1", "2020-01-01")])
    with pytest.raises(M.ImportRefused):
        M.run_import(store, spark.createDataFrame([(1, 1, " ", None, "no id", "Blue")], ROWS), now())
    bad = spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("x"))
    with pytest.raises(Exception, match="stop"):
        store.commit({"teams": spark.range(3), "members": bad})
    assert store.versions() == [1] and _members(store) == [(1, "ada", "Red", "2020-01-01")]
    late = VersionedTables(spark, str(tmp_path))
    late.versions = lambda: []  # a writer that read before the first commit
    with pytest.raises(VersionConflict):
        late.commit({"teams": spark.range(1)})
    assert store.read("teams").count() == 1 and store.read("nothing") is None


def test_earliest_membership(spark):
    teams = spark.createDataFrame([("a", 1, "A", "A"), ("b", 1, "B", "B")], TEAMS)
    people = spark.createDataFrame([("p", 1, "u", "U", "u")], PEOPLE)
    m = spark.createDataFrame([("b", "p", 3), ("a", "p", 3), ("b", "p", 9)], "team_id string, participant_id string, joined_at int")
    assert [r.team_id for r in M.user_team(m, teams, people).collect()] == ["a"]
