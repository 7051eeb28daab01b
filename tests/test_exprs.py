"""Column expressions: tiers, progress, keys, slugs, CSV safety, rounding."""

from pyspark.sql import functions as F

from streakline.functions import exprs as X


def _one(spark, col, value, dtype="int"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(col(F.col("v")).alias("o")).first()["o"]


def test_tiers(spark):
    cases = {0: "Bronze", 299: "Bronze", 300: "Silver", 799: "Silver", 800: "Gold", 2000: "Platinum", 5000: "Elite"}
    for points, level in cases.items():
        assert _one(spark, X.tier, points) == level


def test_tier_progress_server_and_ui(spark):
    # 550 in Silver: floor 300, ceiling 800 → 50 %, 250 to next
    assert _one(spark, X.tier_floor, 550) == 300
    assert _one(spark, X.tier_ceiling, 550) == 800
    assert _one(spark, X.tier_progress_pct, 550) == 50
    assert _one(spark, X.tier_points_to_next, 550) == 250
    # top tier: ceiling = floor + 1000, UI shows 100 %
    assert _one(spark, X.tier_ceiling, 5500) == 6000
    assert _one(spark, X.tier_progress_pct, 5500) == 50
    assert _one(spark, X.tier_progress_pct_rounded, 5500) == 100
    # truncation vs half-up rounding: 100 + 0.5 % of 300 → 33.5 %
    assert _one(spark, X.tier_progress_pct, 100) == 33
    assert _one(spark, X.tier_progress_pct_rounded, 100) == 33
    assert _one(spark, X.tier_progress_pct_rounded, 101) == 34


def test_difficulty(spark):
    assert [_one(spark, X.difficulty, p) for p in (0, 100, 200, 400)] == ["Starter", "Intermediate", "Advanced", "Expert"]


def test_display_name_and_slug(spark):
    assert _one(spark, X.display_name, "ann@example.com", "string") == "ann"
    assert _one(spark, X.display_name, "svc-123", "string") == "svc-123"
    assert _one(spark, X.slugify, "  Pipeline Craftsman! ", "string") == "pipeline-craftsman"
    assert _one(spark, X.sanitize_identifier, "AI/BI Game-Day", "string") == "ai_bi_game_day"
    assert _one(spark, X.sanitize_identifier, "!!!", "string") == "x"


def test_csv_safe(spark):
    assert _one(spark, X.csv_safe, "=cmd|calc", "string") == "'=cmd|calc"
    assert _one(spark, X.csv_safe, "-5", "string") == "'-5"
    assert _one(spark, X.csv_safe, "Red Team", "string") == "Red Team"


def test_idempotency_keys(spark):
    df = spark.createDataFrame([("evt_1", "tsk_1", "team_red", None), ("evt_1", "tsk_1", None, "ws-01"),
                                ("evt_1", "tsk_1", None, None)], "e string, t string, team string, ws string")
    keys = [r[0] for r in df.select(X.base_points_key("e", "t", "team", "ws")).collect()]
    assert keys == ["team:team_red:evt_1:tsk_1:base", "ws-01:evt_1:tsk_1:base", "team:noteam:evt_1:tsk_1:base"]
    hk = [r[0] for r in df.select(X.hint_penalty_key("e", "t", "team", "ws")).collect()]
    assert hk == ["hint:team_red:evt_1:tsk_1", "ws-01:evt_1:tsk_1:hint", "hint:noteam:evt_1:tsk_1"]


def test_saturday_week(spark):
    d = spark.createDataFrame([("2024-01-31",)], "d string").select(X.saturday_week_start(F.to_date("d"))).first()[0]
    assert str(d) == "2024-01-27"
