"""Catalog lint (LI-1..7) as joins and aggregations over the catalog tables.

Inputs: quests ``(pack_version_id, quest_id, quest_slug, unlock_quest_slug)``,
tasks ``(pack_version_id, quest_id, task_id, task_slug, points)``, validators
``(task_id, validator_id, type, mode, operator, statement)``, hints
``(task_id, hint_id, penalty_points)``. Output: one row per finding
``(pack_version_id, severity, loc, message)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assertions import KNOWN_OPERATORS

# Fixed values
SLUG_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
KNOWN_VALIDATOR_TYPES = ["sql_assertion", "databricks_sdk", "workspace_api", "system_table", "notebook",
                         "python_code", "rest_api", "manual"]
VALIDATOR_MODES = ["sync", "async"]
TEMPLATE_VARS = ["event_id", "event_slug", "team_id", "team_slug", "team_prefix", "team_catalog", "team_schema",
                 "event_catalog", "event_schema", "event_start", "event_end", "current_user", "team_members"]
TEMPLATE_VAR_PATTERN = r"\$\{([a-zA-Z0-9_]+)\}"


def _finding(df: DataFrame, severity: str, loc: Column, message: Column) -> DataFrame:
    return df.select("pack_version_id", F.lit(severity).alias("severity"), loc.alias("loc"), message.alias("message"))


def _qloc() -> Column:
    return F.concat(F.lit("quests["), F.col("quest_id").cast("string"), F.lit("]("), F.col("quest_slug"), F.lit(")"))


def _tloc() -> Column:
    return F.concat(_qloc(), F.lit(".tasks["), F.col("task_id").cast("string"), F.lit("]("), F.col("task_slug"),
                    F.lit(")"))


def _vloc() -> Column:
    return F.concat(_tloc(), F.lit(".validators["), F.col("validator_id").cast("string"), F.lit("]"))


def lint_packs(packs: DataFrame, quests: DataFrame) -> DataFrame:
    """LI-2, LI-3, LI-5 of the packs themselves: slug, version, at least one quest."""
    slug = packs.filter(~F.coalesce("pack_slug", F.lit("")).rlike(SLUG_PATTERN))
    unnamed = packs.filter(F.trim(F.coalesce("version", F.lit(""))) == "")
    bare = packs.join(quests.select("pack_version_id"), "pack_version_id", "left_anti")
    return (_finding(slug, "error", F.lit("pack.slug"), F.concat(
        F.lit("Invalid pack slug '"), F.coalesce("pack_slug", F.lit("")), F.lit("'.")))
        .unionByName(_finding(unnamed, "error", F.lit("pack.version"), F.lit("The pack has no version.")))
        .unionByName(_finding(bare, "error", F.lit("quests"), F.lit("The pack has no quests."))))


def lint(quests: DataFrame, tasks: DataFrame, validators: DataFrame, hints: DataFrame) -> DataFrame:
    q = quests
    t = tasks.join(q.select("quest_id", "quest_slug"), "quest_id")
    v = validators.join(t.select("task_id", "task_slug", "quest_id", "quest_slug", "pack_version_id"), "task_id")
    h = hints.join(t.select("task_id", "task_slug", "quest_id", "quest_slug", "pack_version_id"), "task_id")
    out = []
    # LI-2 slug pattern
    out.append(_finding(q.filter(~F.col("quest_slug").rlike(SLUG_PATTERN)), "error", F.concat(_qloc(), F.lit(".slug")),
                        F.concat(F.lit("Invalid quest slug '"), F.col("quest_slug"), F.lit("'."))))
    out.append(_finding(t.filter(~F.col("task_slug").rlike(SLUG_PATTERN)), "error", F.concat(_tloc(), F.lit(".slug")),
                        F.concat(F.lit("Invalid task slug '"), F.col("task_slug"), F.lit("'."))))
    # LI-1 duplicate slugs within the parent
    dq = q.groupBy("pack_version_id", "quest_slug").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    out.append(_finding(dq, "error", F.concat(F.lit("quests("), F.col("quest_slug"), F.lit(").slug")),
                        F.concat(F.lit("Duplicate quest slug '"), F.col("quest_slug"), F.lit("'."))))
    dt = t.groupBy("pack_version_id", "quest_id", "quest_slug", "task_slug").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > 1)
    out.append(_finding(dt, "error", F.concat(_qloc(), F.lit(".tasks("), F.col("task_slug"), F.lit(").slug")),
                        F.concat(F.lit("Duplicate task slug '"), F.col("task_slug"), F.lit("' within quest '"),
                                 F.col("quest_slug"), F.lit("'."))))
    dv = v.groupBy("pack_version_id", "quest_id", "quest_slug", "task_id", "task_slug", "validator_id") \
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    out.append(_finding(dv, "error", F.concat(_vloc(), F.lit(".id")),
                        F.concat(F.lit("Duplicate validator id '"), F.col("validator_id").cast("string"),
                                 F.lit("' within task."))))
    # LI-3 parents without children
    qt = q.join(tasks.select("quest_id"), "quest_id", "left_anti")
    out.append(_finding(qt, "error", F.concat(_qloc(), F.lit(".tasks")),
                        F.lit("Each quest must define at least one task.")))
    tv = t.join(validators.select("task_id"), "task_id", "left_anti")
    if "manual_validation_required" in tasks.columns:  # a task that hosts pass by hand needs none
        tv = tv.filter(~F.coalesce("manual_validation_required", F.lit(False)))
    out.append(_finding(tv, "error", F.concat(_tloc(), F.lit(".validators")),
                        F.lit("Task has no validators. Add at least one validator or set "
                              "manual_validation_required: true.")))
    # LI-5 domain checks
    out.append(_finding(t.filter(F.col("points") < 0), "error", F.concat(_tloc(), F.lit(".points")),
                        F.lit("points must be >= 0.")))
    out.append(_finding(v.filter(~F.col("type").isin(*KNOWN_VALIDATOR_TYPES)), "warning",
                        F.concat(_vloc(), F.lit(".type")),
                        F.concat(F.lit("Unknown validator type '"), F.col("type"), F.lit("'."))))
    out.append(_finding(v.filter(~F.coalesce(F.col("mode"), F.lit("")).isin(*VALIDATOR_MODES)), "error",
                        F.concat(_vloc(), F.lit(".mode")),
                        F.concat(F.lit("Validator mode must be 'sync' or 'async', got '"),
                                 F.coalesce(F.col("mode"), F.lit("")), F.lit("'."))))
    sql_v = v.filter(F.col("type") == "sql_assertion")
    out.append(_finding(sql_v.filter(F.coalesce(F.col("statement"), F.lit("")) == ""), "error",
                        F.concat(_vloc(), F.lit(".statement")), F.lit("sql_assertion requires a 'statement'.")))
    out.append(_finding(sql_v.filter(F.col("operator").isNull()), "warning", F.concat(_vloc(), F.lit(".expect")),
                        F.lit("sql_assertion has no 'expect' block; result will not be checked.")))
    out.append(_finding(sql_v.filter(F.col("operator").isNotNull() & ~F.col("operator").isin(*KNOWN_OPERATORS)),
                        "error", F.concat(_vloc(), F.lit(".expect.operator")),
                        F.concat(F.lit("Unknown operator '"), F.col("operator"), F.lit("'."))))
    out.append(_finding(h.filter(F.col("penalty_points") > 0), "warning",
                        F.concat(_tloc(), F.lit(".hints["), F.col("hint_id").cast("string"), F.lit("].penalty_points")),
                        F.concat(F.lit("penalty_points is usually <= 0 (a penalty). Got "),
                                 F.col("penalty_points").cast("string"), F.lit("."))))
    # LI-6 unknown template variables in statements
    vars_ = sql_v.select("*", F.explode(F.array_distinct(
        F.regexp_extract_all(F.coalesce(F.col("statement"), F.lit("")), F.lit(TEMPLATE_VAR_PATTERN), 1))).alias("var"))
    out.append(_finding(vars_.filter(~F.col("var").isin(*TEMPLATE_VARS)), "warning",
                        F.concat(_vloc(), F.lit(".statement")),
                        F.concat(F.lit("Unknown template variable '${"), F.col("var"), F.lit("}'."))))
    # LI-4 unlock references: a self left join on (pack, slug)
    u = q.filter(F.col("unlock_quest_slug").isNotNull() | F.col("has_unlock_rule"))
    targets = q.select("pack_version_id", F.col("quest_slug").alias("unlock_quest_slug"),
                       F.lit(True).alias("_exists")).distinct()
    u = u.join(targets, ["pack_version_id", "unlock_quest_slug"], "left")
    uloc = F.concat(_qloc(), F.lit(".unlock_rule.quest_slug"))
    msg = (F.when(F.coalesce(F.col("unlock_quest_slug"), F.lit("")) == "",
                  F.lit("unlock_rule type 'quest_completed' requires quest_slug."))
           .when(F.col("_exists").isNull(),
                 F.concat(F.lit("unlock_rule references unknown quest '"), F.col("unlock_quest_slug"), F.lit("'.")))
           .when(F.col("unlock_quest_slug") == F.col("quest_slug"),
                 F.lit("A quest cannot be gated on completing itself.")))
    out.append(_finding(u.filter(msg.isNotNull()), "error", uloc, msg))
    res = out[0]
    for f in out[1:]:
        res = res.unionByName(f)
    return res


def lint_summary(findings: DataFrame, quests: DataFrame, tasks: DataFrame, validators: DataFrame,
                 hints: DataFrame) -> DataFrame:
    """LI-7: per pack version: errors, warnings, ok (no errors) and content counts."""
    f = findings.groupBy("pack_version_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    tv = tasks.select("task_id", "pack_version_id")
    counts = (quests.groupBy("pack_version_id").agg(F.count(F.lit(1)).alias("quests"))
              .join(tasks.groupBy("pack_version_id").agg(F.count(F.lit(1)).alias("tasks")), "pack_version_id", "left")
              .join(validators.join(tv, "task_id").groupBy("pack_version_id")
                    .agg(F.count(F.lit(1)).alias("validators")), "pack_version_id", "left")
              .join(hints.join(tv, "task_id").groupBy("pack_version_id").agg(F.count(F.lit(1)).alias("hints")),
                    "pack_version_id", "left"))
    j = counts.join(f, "pack_version_id", "left")
    cols = ["errors", "warnings", "quests", "tasks", "validators", "hints"]
    j = j.select("pack_version_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in cols])
    return j.withColumn("ok", F.col("errors") == 0)
