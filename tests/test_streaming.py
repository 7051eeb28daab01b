"""Streams: exactly-once awards across two increments, windows equal to the batch result."""

import datetime as dt

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from streakline.plans.event_game import EventGame
from streakline.streaming import live as L

from conftest import SF_SMALL


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_awards_exactly_once_in_any_order_of_increments(spark, tmp_path, order):
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    days = [pa.scalar(dt.datetime(y, 6, 1), type=li.schema.field("l_shipdate").type) for y in (1995, 1998)]
    parts = [li.filter(pc.less(li["l_shipdate"], days[0])),
             li.filter(pc.and_(pc.greater_equal(li["l_shipdate"], days[0]), pc.less(li["l_shipdate"], days[1]))),
             li.filter(pc.greater_equal(li["l_shipdate"], days[1]))]
    src = tmp_path / "attempts"
    src.mkdir()
    ledger_path, ckpt = str(tmp_path / "ledger"), str(tmp_path / "ckpt")
    for i in order:  # each increment repeats passed tasks of the others (same idempotency keys)
        pq.write_table(parts[i], src / f"part-{i}.parquet")
        got, _ = L.award_stream(spark, SF_SMALL, ledger_path, attempt_files=str(src), checkpoint=ckpt)
    batch = EventGame(spark, SF_SMALL).ledger.filter(F.col("source_type") == "validation")
    cols = ["idempotency_key", "user_id", "source_id", "points_delta", "created_at"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def _files(spark, folder, sf_dir, cuts):
    """The events in several files of one folder, added one by one (in the order of ``cuts``)."""
    ev = pq.read_table(f"{sf_dir}/events.parquet")
    ns = pc.cast(ev["ts"], pa.timestamp("us"))
    folder.mkdir(exist_ok=True)
    for lo, hi in cuts:
        a, b = (pa.scalar(dt.datetime(2024, 1, d), pa.timestamp("us")) for d in (lo, hi))
        pq.write_table(ev.filter(pc.and_(pc.greater_equal(ns, a), pc.less(ns, b))), folder / f"d{lo}.parquet")
        yield str(folder)


def _rows(df):
    return sorted(map(str, df.collect()))


def _batch():
    from streakline.plans import adoption as A
    from streakline.sources.tables import Tables
    return lambda spark: A.standin_logs(Tables(spark, SF_SMALL))


@pytest.mark.parametrize("cuts", [[(1, 8), (8, 20), (20, 31)], [(20, 31), (1, 8), (8, 20)], [(9, 31), (1, 3), (3, 9)]])
def test_weeks_and_sessions_equal_batch_in_any_split_and_order(spark, tmp_path, cuts):
    from streakline.operators import detect as D
    from streakline.plans.queries_adoption import CFG
    logs = _batch()(spark)
    states = [L.StreamState(spark, str(tmp_path / f"s{i}")) for i in range(3)]
    for i, files in enumerate(_files(spark, tmp_path / "events", SF_SMALL, cuts)):
        weeks = L.weekly_query_missions_stream(spark, SF_SMALL, CFG.activity, CFG.run_ts, CFG.thresholds, states[0], files)
        points = L.weekly_consumption_stream(spark, SF_SMALL, CFG.activity, CFG.run_ts, states[1], files)
        sessions = L.activity_sessions_stream(spark, SF_SMALL, "6 hours", states[2], files)
        if i == 1:
            states[0].compact(L.merge_counts)
            states[1].compact(L.merge_usage)
            states[2].compact(L.merge_sessions)
    assert _rows(weeks) == _rows(D.query_weekly(logs.query_history, CFG.activity, CFG.run_ts, CFG.thresholds))
    assert _rows(points) == _rows(D.weekly_consumption_points(D.usage_daily(logs.usage, CFG.activity), CFG.activity, CFG.run_ts))
    whole = L.activity_sessions_stream(spark, SF_SMALL, "6 hours")
    assert _rows(sessions) == _rows(whole) and len(_rows(whole)) > 20
    # a run without new files, and folding again, change nothing
    for _ in range(2):
        states[2].compact(L.merge_sessions)
        assert _rows(L.activity_sessions_stream(spark, SF_SMALL, "6 hours", states[2], files)) == _rows(whole)
    assert states[2].folded.read("rows").count() == len(_rows(whole))  # kept: one row a session


def test_a_replayed_batch_overwrites_itself(spark, tmp_path):
    state = L.StreamState(spark, str(tmp_path / "state"))
    first, second = list(_files(spark, tmp_path / "events", SF_SMALL, [(1, 12)])), (12, 31)
    L.activity_sessions_stream(spark, SF_SMALL, state=state, files=first[0])
    list(_files(spark, tmp_path / "events", SF_SMALL, [second]))
    once = _rows(L.activity_sessions_stream(spark, SF_SMALL, state=state, files=first[0]))
    commits = next((tmp_path / "state" / "_checkpoint").rglob("commits"))
    for f in commits.iterdir():  # the batch's rows were written, but the stream died before it noted so
        if f.name.strip(".").startswith("1"):
            f.unlink()
    state.compact(L.merge_sessions)
    assert _rows(L.activity_sessions_stream(spark, SF_SMALL, state=state, files=first[0])) == once


def test_a_ledger_reused_keeps_every_key(spark, tmp_path):
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    half = len(li) // 2
    src = []
    for i, part in enumerate((li.slice(0, half), li.slice(half))):
        d = tmp_path / f"src{i}"
        d.mkdir()
        pq.write_table(part, d / "part.parquet")
        src.append(str(d))
    ledger = str(tmp_path / "ledger")
    first = {r.idempotency_key for r in L.award_stream(spark, SF_SMALL, ledger, src[0])[0].collect()}
    both = L.award_stream(spark, SF_SMALL, ledger, src[1])[0]
    assert first <= {r.idempotency_key for r in both.collect()}
    batch = EventGame(spark, SF_SMALL).ledger.filter(F.col("source_type") == "validation")
    want = _rows(batch.select(*both.columns))
    assert _rows(both) == want
    # another checkpoint reads a source again: nothing is awarded twice, nothing is lost
    again = L.award_stream(spark, SF_SMALL, ledger, src[0], checkpoint=str(tmp_path / "other"))[0]
    assert _rows(again) == want
    L.StreamState(spark, ledger).compact(L.merge_awards)
    assert _rows(L.read_ledger(spark, ledger)) == want


def test_totals_follow_the_ledger_and_resolve_federated_awards(spark, tmp_path):
    from streakline.operators import event as E
    from streakline.versions import VersionedTables
    g = EventGame(spark, SF_SMALL)
    li = pq.read_table(f"{SF_SMALL}/lineitem.parquet")
    src, ledger, out = tmp_path / "src", str(tmp_path / "ledger"), VersionedTables(spark, str(tmp_path / "totals"))
    src.mkdir()
    for i, part in enumerate((li.slice(0, 2000), li.slice(2000))):
        pq.write_table(part, src / f"p{i}.parquet")
        L.award_stream(spark, SF_SMALL, ledger, str(src))
        got = L.team_totals_stream(spark, ledger, g.identity_map, out)
    assert out.versions() == [1, 2]
    awards = g.ledger.filter(F.col("source_type") == "validation")
    want = E.team_scores(awards, g.identity_map)
    assert _rows(got.select(*want.columns)) == _rows(want)
    federated = awards.filter(F.col("team_id").isNull()).agg(F.sum("points_delta")).first()[0]
    own = awards.filter(F.col("team_id").isNotNull()).agg(F.sum("points_delta")).first()[0]
    total = got.agg(F.sum("total_points")).first()[0]
    assert federated and own < total <= own + federated
    L.team_totals_stream(spark, ledger, g.identity_map, out)
    assert out.versions() == [1, 2]  # no new awards, no new version
