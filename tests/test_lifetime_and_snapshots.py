"""Lifetime totals carried from run to run; leaderboards over time."""

import datetime as dt

from pyspark.sql import functions as F

from streakline import rules as R
from streakline.operators import event as E
from streakline.plans import extras as XT
from streakline.plans import snapshots as SN
from streakline.versions import VersionedTables

RUN = "2024-02-01 00:00:00"
TH = R.Thresholds()


def _usage(spark, rows):
    return spark.createDataFrame([(u, dt.date.fromisoformat(d), q) for u, d, q in rows],
                                 "user_id string, usage_date date, usage_quantity double").select(
        F.struct(F.col("user_id").alias("run_as")).alias("identity_metadata"), "usage_date", "usage_quantity")


ROWS = [("ann", "2024-01-01", 60.0), ("ann", "2024-01-01", 39.99), ("ann", "2024-01-02", 0.01), ("ann", "2024-01-03", 950.0),
        ("ann", "2024-01-05", 9000.0), ("ann", "2024-01-09", 200_000.0), ("bob", "2024-01-04", 15_000.0),
        ("bob", "2024-01-05", -50.0), ("eve", "2024-01-01", 99.99), (None, "2024-01-01", 500.0), ("", "2024-01-01", 500.0)]


def test_every_threshold_is_crossed_on_its_day(spark):
    crossed, totals = XT.lifetime_advance(None, XT.usage_days(_usage(spark, ROWS)), RUN, TH)
    assert sorted((r.user_id, r.mission_id, str(r.period_start)) for r in crossed.collect()) == [
        ("ann", "lifetime_100", "2024-01-02"), ("ann", "lifetime_100k", "2024-01-09"), ("ann", "lifetime_10k", "2024-01-05"),
        ("ann", "lifetime_1k", "2024-01-03"), ("bob", "lifetime_100", "2024-01-04"), ("bob", "lifetime_10k", "2024-01-04"),
        ("bob", "lifetime_1k", "2024-01-04")]
    assert {r.user_id: (float(r.total), str(r.through)) for r in totals.collect()} == {
        "ann": (210_050.0, "2024-01-09"), "bob": (15_000.0, "2024-01-04"), "eve": (99.99, "2024-01-01")}


def test_many_runs_equal_one(spark, tmp_path):
    one = VersionedTables(spark, str(tmp_path / "one"))
    XT.lifetime_run(one, _usage(spark, ROWS), RUN, TH)
    many = VersionedTables(spark, str(tmp_path / "many"))
    for until in ("2024-01-01", "2024-01-03", "2024-01-03", "2024-01-08", "2024-01-31"):  # the log grows between runs
        XT.lifetime_run(many, _usage(spark, [r for r in ROWS if r[1] <= until]), RUN, TH)
    XT.lifetime_run(many, _usage(spark, []), RUN, TH)  # and loses its old days
    for name in ("totals", "milestones"):
        assert sorted(map(str, many.read(name).collect())) == sorted(map(str, one.read(name).collect()))
    assert many.versions() == [1, 2, 3, 4, 5, 6]


def _ledger(spark, rows):
    return spark.createDataFrame(
        [(1, f"k{i}", t, None, "u", i, p, "validation", str(i), "task_passed", dt.datetime.fromisoformat(at))
         for i, (t, p, at) in enumerate(rows)],
        "event_id int, idempotency_key string, team_id int, workspace_id string, user_id string, task_id long, "
        "points_delta int, source_type string, source_id string, reason string, created_at timestamp")


def _no_map(spark):
    return spark.createDataFrame([], "event_id int, workspace_id string, lab_user_email string, team_id int")


def test_snapshots_equal_boards_cut_at_each_month(spark):
    led = _ledger(spark, [(1, 10, "2024-01-05"), (2, 30, "2024-01-31 23:59:59"), (1, 25, "2024-02-01"),
                          (3, 35, "2024-04-10"), (2, 5, "2024-04-30")])
    snaps = SN.monthly_snapshots(led, _no_map(spark))
    got = {}
    for r in snaps.collect():
        got.setdefault(str(r.snapshot_at)[:10], {})[r.team_id] = (r.total_points, r.rank)
    assert sorted(got) == ["2024-02-01", "2024-03-01", "2024-04-01", "2024-05-01"]
    for at, board in got.items():
        cut = E.team_scores(led.filter(F.col("created_at") < F.lit(at).cast("timestamp")), _no_map(spark))
        assert {k: v[0] for k, v in board.items()} == {r.team_id: r.total_points for r in cut.collect()}
    assert got["2024-03-01"] == {1: (35, 1), 2: (30, 2)}
    assert got["2024-05-01"] == {1: (35, 1), 3: (35, 2), 2: (35, 3)}  # ties: the earlier last score first
    moves = {(str(r.snapshot_at)[:10], r.team_id): (r.previous_rank, r.moved, r.gained) for r in SN.rank_changes(snaps).collect()}
    assert moves[("2024-02-01", 1)] == (None, None, 10) and moves[("2024-03-01", 1)] == (2, 1, 25)
    assert moves[("2024-05-01", 2)] == (2, -1, 5)
    assert SN.monthly_snapshots(led.filter("false"), _no_map(spark)).collect() == []


def test_store_keeps_one_copy_and_reads_as_of(spark, tmp_path):
    store = SN.SnapshotStore(spark, str(tmp_path / "boards"))
    assert store.read() is None
    jan = SN.monthly_snapshots(_ledger(spark, [(1, 10, "2024-01-05")]), _no_map(spark))
    more = SN.monthly_snapshots(_ledger(spark, [(1, 99, "2024-01-05"), (2, 7, "2024-02-09")]), _no_map(spark))
    store.append(jan)
    store.append(jan)
    store.append(more)  # a snapshot once taken stays as it was
    assert sorted((str(r.snapshot_at)[:10], r.team_id, r.total_points) for r in store.read().collect()) == [
        ("2024-02-01", 1, 10), ("2024-03-01", 1, 99), ("2024-03-01", 2, 7)]
    assert [(r.team_id, r.total_points) for r in store.as_of("2024-02-29 12:00:00").collect()] == [(1, 10)]
    assert store.as_of("2024-03-01 00:00:00").count() == 2 and store.as_of("2023-01-01").count() == 0


def test_frozen_board_cuts_only_stamped_events(spark):
    class G:
        ledger = _ledger(spark, [(1, 10, "2024-01-05"), (1, 20, "2024-03-05")]).unionByName(
            _ledger(spark, [(2, 10, "2024-01-05"), (2, 20, "2024-03-05")]).withColumn("event_id", F.lit(2)))
        identity_map = _no_map(spark)
        teams = spark.createDataFrame([(1, 1, "A", "A"), (2, 2, "B", "B")], "team_id int, event_id int, name string, display_name string")
        competitions = spark.createDataFrame([(1, dt.datetime(2024, 2, 1)), (2, None)], "event_id int, scoring_frozen_at timestamp")
    assert {r.team_id: r.total_points for r in XT.frozen_leaderboard(G).collect()} == {1: 10, 2: 30}
