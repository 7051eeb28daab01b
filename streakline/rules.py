"""Rule tables: missions, detectors, badges.

Rules are data. Plans turn them into small DataFrames (tens of rows, a size
fixed by this file, not by the input) that are broadcast into the shared scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Mission catalog (id, name, points, category, track, award type)
# ---------------------------------------------------------------------------
MISSIONS = [
    ("first_steps", "First Steps", 25, "Getting Started", None, "one_time"),
    ("job_creator", "Job Creator", 100, "Data Engineering", None, "one_time"),
    ("pipeline_builder", "Pipeline Builder", 150, "Data Engineering", None, "one_time"),
    ("pipeline_runner", "Pipeline Runner", 200, "Data Engineering", None, "one_time"),
    ("scheduler", "Scheduler", 150, "Data Engineering", None, "one_time"),
    ("auto_loader_pioneer", "Auto Loader Pioneer", 250, "Data Engineering", None, "one_time"),
    ("multi_task_orchestrator", "Multi-Task Orchestrator", 200, "Data Engineering", None, "one_time"),
    ("liquid_clustering", "Liquid Clustering Adopter", 200, "Data Engineering", None, "one_time"),
    ("genie_creator", "Genie Creator", 200, "Analytics", "Business Users", "one_time"),
    ("genie_explorer", "Genie Explorer", 100, "Analytics", "Business Users", "one_time"),
    ("genie_curator", "Genie Curator", 150, "Analytics", "Business Users", "one_time"),
    ("genie_power_user", "Genie Power User", 100, "Analytics", "Business Users", "repeatable"),
    ("genie_code_user", "AI Assistant", 100, "AI / ML", "Business Users", "one_time"),
    ("dashboard_designer", "Dashboard Designer", 150, "Analytics", "Business Users", "one_time"),
    ("dashboard_viewer", "Dashboard Explorer", 75, "Analytics", "Business Users", "one_time"),
    ("dashboard_publisher", "Dashboard Publisher", 150, "Analytics", "Business Users", "one_time"),
    ("dashboard_operator", "Dashboard Operator", 150, "Analytics", "Business Users", "one_time"),
    ("data_explorer", "Data Explorer", 150, "Analytics", "Business Users", "repeatable"),
    ("power_analyst", "Power Analyst", 200, "Analytics", "Business Users", "repeatable"),
    ("query_author", "Query Author", 75, "Analytics", "Business Users", "one_time"),
    ("alert_creator", "Alert Creator", 150, "Analytics", "Business Users", "one_time"),
    ("app_builder", "App Builder", 250, "Analytics", "Business Users", "one_time"),
    ("notebook_author", "Notebook Author", 75, "Analytics", "Business Users", "one_time"),
    ("lakebase_builder", "Lakebase Builder", 250, "Lakebase", "Lakebase", "one_time"),
    ("lakebase_sync", "Lakebase Sync Builder", 250, "Lakebase", "Lakebase", "one_time"),
    ("lakebase_database", "Lakebase Database Creator", 150, "Lakebase", "Lakebase", "one_time"),
    ("lakebase_connector", "Lakebase Connector", 100, "Lakebase", "Lakebase", "one_time"),
    ("model_deployer", "Model Deployer", 300, "AI / ML", None, "one_time"),
    ("ai_function_builder", "AI Function Builder", 250, "AI / ML", None, "one_time"),
    ("vector_search_pioneer", "Vector Search Pioneer", 200, "AI / ML", None, "one_time"),
    ("mlflow_experimenter", "MLflow Experimenter", 150, "AI / ML", None, "one_time"),
    ("stream_starter", "Stream Starter", 250, "Streaming", None, "one_time"),
    ("sql_analyst", "SQL Analyst", 100, "Analytics", "Business Users", "repeatable"),
    ("job_runner", "Job Runner", 100, "Data Engineering", None, "repeatable"),
    ("ml_practitioner", "ML Practitioner", 150, "AI / ML", None, "repeatable"),
    ("dlt_operator", "Pipeline Operator", 100, "Data Engineering", None, "repeatable"),
    ("consistent_operator", "Consistent Operator", 300, "Engagement", None, "repeatable"),
    ("daily_driver", "Daily Driver", 400, "Engagement", None, "repeatable"),
    ("cross_product_champion", "Cross-Product Champion", 500, "Engagement", None, "repeatable"),
    ("uc_publisher", "Unity Catalog Publisher", 150, "Governance", None, "one_time"),
]
# Declared in the catalog but never detected from a log.
UNSCORED_MISSIONS = ["liquid_clustering", "vector_search_pioneer", "stream_starter", "uc_publisher"]

# ---------------------------------------------------------------------------
# Audit-log detectors (mission, service or None = any, actions,
# shape, threshold). Shapes: A first time; B per Monday week count >= k;
# E count >= k over the look-back.
# ---------------------------------------------------------------------------
AUDIT_RULES = [
    ("genie_creator", None, ["genieCreateSpace"], "A", 1),
    ("dashboard_designer", None, ["createDashboard"], "A", 1),
    ("genie_explorer", "aibiGenie", ["genieStartConversationMessage", "genieCreateConversationMessage"], "A", 1),
    ("dashboard_viewer", "dashboards", ["getPublishedDashboard", "getPublishedDashboardEmbedded"], "A", 1),
    ("lakebase_builder", "databaseInstances", ["createDatabaseInstance"], "A", 1),
    ("genie_curator", "aibiGenie", ["createInstruction", "createCuratedQuestion", "updateSampleQuestions"], "A", 1),
    ("genie_power_user", "aibiGenie", ["createConversationMessage", "genieCreateConversationMessage"], "B", 10),
    ("dashboard_publisher", "dashboards", ["publishDashboard"], "A", 1),
    ("dashboard_operator", "dashboards", ["createSchedule", "createSubscription", "setSubscriptions"], "A", 1),
    ("query_author", "databrickssql", ["createQuery"], "A", 1),
    ("app_builder", "apps", ["createApp", "deployApp"], "A", 1),
    ("notebook_author", "notebook", ["createNotebook"], "A", 1),
    ("lakebase_sync", ["databaseInstances", "postgres"], ["createSyncedDatabaseTable", "createSyncedTable"], "A", 1),
    ("lakebase_database", ["databaseInstances", "postgres"], ["createDatabaseCatalog", "createDatabase"], "A", 1),
    ("lakebase_connector", ["databaseInstances", "postgres"], ["generateDatabaseCredential"], "A", 1),
    ("alert_creator", None, ["createAlert", "createLegacyAlert"], "A", 1),
    ("model_deployer", None, ["createServingEndpoint", "create_serving_endpoint"], "A", 1),
    ("mlflow_experimenter", None, ["createRun", "mlflowCreateRun"], "E", 10),
]

# Query-history statement types counted by the weekly missions.
COUNTED_STATEMENT_TYPES = ["SELECT", "INSERT", "MERGE", "CREATE", "ALTER"]
# Weekly query-count missions (mission, threshold).
QUERY_RULES = [("data_explorer", 50), ("power_analyst", 200)]
# Text searched by the AI-function mission (a LIKE pattern).
AI_FUNCTION_PATTERN = "%ai_query%"

# Monthly product consumption missions (mission, product, minimum sum).
PRODUCT_RULES = [
    ("sql_analyst", "SQL", 50),
    ("job_runner", "JOBS", 50),
    ("ml_practitioner", "MODEL_SERVING", 1),
    ("dlt_operator", "DLT", 50),
]

# Other thresholds.
DAILY_DRIVER_DAYS = 20            # distinct active days in the window
DAILY_DRIVER_WINDOW = 30
CROSS_PRODUCT_MIN = 6             # distinct products in a calendar month
CONSISTENT_OPERATOR_DAYS = 7      # distinct run days in the window
CONSISTENT_OPERATOR_WINDOW = 30
MULTI_TASK_MIN = 3                # distinct task keys per creator
SCHEDULE_TRIGGERS = ["CRON", "PERIODIC"]
ETL_PIPELINE_TYPES = ["ETL_PIPELINE"]
DLT_PRODUCT = "DLT"
LOOKBACK_DAYS = 30
CONSUMPTION_LOOKBACK_DAYS = 90
CONSUMPTION_UNITS_PER_POINT = 10
MONTHLY_LOOKBACK_DAYS = 60        # month containing as_of - 60 days onward
SERVICE_PRINCIPAL_MARKERS = ["%service-principal%", "%ServicePrincipal%"]

# Lifetime consumption milestones (declared: 100 / 1K / 10K / 100K units).
LIFETIME_MILESTONES = [
    ("lifetime_100", "Lifetime 100", 100, 50),
    ("lifetime_1k", "Lifetime 1K", 1000, 200),
    ("lifetime_10k", "Lifetime 10K", 10000, 500),
    ("lifetime_100k", "Lifetime 100K", 100000, 1000),
]

# ---------------------------------------------------------------------------
# Badges (id, name, icon, kind, threshold, missions)
# ---------------------------------------------------------------------------
BADGES = [
    ("pipeline_craftsman", "Pipeline Craftsman", "wrench", "missions", 5,
     ["pipeline_builder", "pipeline_runner", "auto_loader_pioneer", "consistent_operator", "scheduler", "job_creator"]),
    ("platform_explorer", "Platform Explorer", "compass", "products", 4, []),
    ("consistent_contributor", "Consistent Contributor", "flame", "streak", 14, []),
    ("ai_pioneer", "AI Pioneer", "brain", "missions", 3,
     ["model_deployer", "ai_function_builder", "vector_search_pioneer", "mlflow_experimenter"]),
    ("full_stack", "Full Stack", "layers", "categories", 5, []),
]
# Badges the scheduled run awards (the other two are catalog-only unless enabled).
SCORED_BADGES = ["platform_explorer", "consistent_contributor", "pipeline_craftsman"]


@dataclass(frozen=True)
class Thresholds:
    """Detector thresholds; defaults are the fixed values above.

    The driver's synthetic activity log is far denser per user than a real
    one, so ``standin()`` gives the values the registered queries use.
    """

    audit: dict = field(default_factory=lambda: {r[0]: r[4] for r in AUDIT_RULES})
    query: dict = field(default_factory=lambda: dict(QUERY_RULES))
    product: dict = field(default_factory=lambda: {r[0]: r[2] for r in PRODUCT_RULES})
    daily_driver_days: int = DAILY_DRIVER_DAYS
    cross_product_min: int = CROSS_PRODUCT_MIN
    consistent_operator_days: int = CONSISTENT_OPERATOR_DAYS
    multi_task_min: int = MULTI_TASK_MIN
    lifetime: dict = field(default_factory=lambda: {r[0]: r[2] for r in LIFETIME_MILESTONES})

    @staticmethod
    def standin() -> "Thresholds":
        t = Thresholds()
        audit = dict(t.audit)
        audit.update({"genie_power_user": 2, "mlflow_experimenter": 3})
        return Thresholds(
            audit=audit,
            query={"data_explorer": 12, "power_analyst": 16},
            product={"sql_analyst": 300, "job_runner": 300, "ml_practitioner": 1, "dlt_operator": 300},
            daily_driver_days=27,
            cross_product_min=5,
            consistent_operator_days=3,
            multi_task_min=3,
            lifetime={"lifetime_100": 100, "lifetime_1k": 1000, "lifetime_10k": 4000, "lifetime_100k": 5000},
        )


def missions_df(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("mission_id", T.StringType(), False),
        T.StructField("mission_name", T.StringType(), False),
        T.StructField("points", T.IntegerType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("track", T.StringType(), True),
        T.StructField("award_type", T.StringType(), False),
    ])
    return spark.createDataFrame(MISSIONS, schema)


def mission_lookup() -> dict:
    return {m[0]: m for m in MISSIONS}


def audit_rules_df(spark: SparkSession, thresholds: Thresholds | None = None) -> DataFrame:
    """One row per (mission, service, action); service NULL means any service."""
    th = thresholds or Thresholds()
    look = mission_lookup()
    rows = []
    for mission_id, services, actions, shape, _ in AUDIT_RULES:
        svc_list = services if isinstance(services, list) else [services]
        for svc in svc_list:
            for action in actions:
                _, name, points, *_ = look[mission_id]
                rows.append((mission_id, name, points, svc, action, shape, int(th.audit[mission_id])))
    schema = T.StructType([
        T.StructField("mission_id", T.StringType(), False),
        T.StructField("mission_name", T.StringType(), False),
        T.StructField("points_awarded", T.IntegerType(), False),
        T.StructField("rule_service", T.StringType(), True),
        T.StructField("rule_action", T.StringType(), False),
        T.StructField("shape", T.StringType(), False),
        T.StructField("threshold", T.IntegerType(), False),
    ])
    return spark.createDataFrame(rows, schema)
