"""Report files, JSON round trips, versioned snapshots of outputs, facts by day."""

import os

import pytest
from pyspark.sql import functions as F

from streakline.plans import exports as X
from streakline.plans import report as RP
from streakline.plans.event_game import EventGame
from streakline.versions import VersionedTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    return RP.sections(EventGame(spark, SF))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_section_comes_back_from_json(spark, parts):
    lines = RP.json_lines(parts).persist()
    for name, df in parts.items():
        want = rows(df)
        assert want and rows(RP.read_section(lines, name)) == want, name
    broken = lines.where("section = 'teams'").withColumn("doc", F.expr("left(doc, length(doc) - 1)"))
    assert RP.read_section(broken, "teams").count() == 0
    lines.unpersist()


def test_markdown_files_hold_the_lines_in_order(spark, parts, tmp_path):
    lines = RP.markdown_lines(parts).persist()
    RP.write_markdown(lines, str(tmp_path / "md"))
    want = {}
    for r in sorted(lines.collect(), key=lambda r: (r.event_id, r.section, r.place, r.key)):
        want.setdefault(r.event_id, []).append(r.line)
    lines.unpersist()
    assert len(want) > 1
    for event, texts in want.items():
        folder = tmp_path / "md" / f"event_id={event}"
        got = [x for f in sorted(os.listdir(folder)) if f.endswith(".txt") for x in (folder / f).read_text().splitlines()]
        assert got == texts
        assert got[0].startswith("# Event report — ") and "## Recommended follow-ups" in got


def test_parse_object(spark):
    texts = ['{"a": 1}', ' {"a": 2, "z": 0}', '{"a": 3', "[1]", '[{"a": 1}]', "null", '"x"', "", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in df.select("i", RP.parse_object("t", "a long").alias("d")).collect()}
    assert {i: d.a for i, d in got.items() if d is not None} == {0: 1, 1: 2, 9: None}


def test_publish_keeps_the_old_version(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "store"))
    for n, k in (("a", 3), ("b", 4)):
        spark.range(k).withColumn("x", F.lit(n)).write.parquet(str(tmp_path / n / "1"))
    cols = {"a": ["x", "id"], "b": ["id"]}
    paths = {n: str(tmp_path / n / "1") for n in cols}
    assert X.publish(store, paths, cols) == (1, [])
    assert store.read("a").columns == ["x", "id"] and store.read("b").count() == 4
    # a source that is gone is skipped, its table stays
    spark.range(9).withColumn("x", F.lit("n")).write.parquet(str(tmp_path / "a" / "2"))
    assert X.publish(store, {"a": str(tmp_path / "a" / "2"), "b": str(tmp_path / "none")}, cols) == (2, ["b"])
    assert (store.read("a").count(), store.read("b").count(), store.read("a", 1).count()) == (9, 4, 3)
    # a write that fails half way leaves what readers see
    fails = spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"a": store.read("a"), "b": fails})
    assert store.versions() == [1, 2] and store.read("a").count() == 9


def test_facts_by_day(spark, tmp_path):
    path = str(tmp_path / "facts")
    for day, n in (("2024-01-01", 2), ("2024-01-02", 3), ("2024-01-02", 4)):
        X.append_facts(spark.range(n), path, f"{day} 08:00:00")
    got = {str(r[0]): r[1] for r in spark.read.parquet(path).groupBy("snapshot_date").count().collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 4}
