"""Checks of many rows at once that the event game does one call at a time (DQ-11, DQ-12).

Templates: a statement is split into literal pieces and ``${slot}`` names, the
names are looked up in the team's map of variables, and the pieces are put
together again. A missing, null or unsafe value makes an error row, never a
statement.

Inventory: one pass over the listed objects of a workspace, joined with the
checks of their kind; each check counts the objects it matches and finds, and
keeps the names of the first five.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a slot and a safe value look like.
SLOT = r"\$\{([A-Za-z0-9_.]+)\}"
SAFE_VALUE = r"^[A-Za-z0-9_.\- ]*$"
# States that count as published or completed.
PUBLISHED_STATES = ["ACTIVE", "PUBLISHED"]
COMPLETED_STATES = ["COMPLETED", "COMPLETE"]
# Kinds of checks, and the kind of object each looks at.
CHECK_OBJECTS = {"dashboard_exists_for_team": "dashboard", "dashboard_published": "dashboard",
                 "genie_space_exists": "genie_space", "table_exists": "table", "job_exists_with_schedule": "job",
                 "pipeline_update_completed": "pipeline"}
FIRST_NAMES = 5


def resolve_templates(statements: DataFrame, contexts: DataFrame, on: list[str]) -> DataFrame:
    """Every statement for every context of its group: (.., status, statement, reason).

    ``statements``: the columns ``on``, their own keys and ``template``;
    ``contexts``: ``on``, their own keys and ``variables`` (map of strings).
    """
    s = statements.withColumn("_slots", F.regexp_extract_all("template", F.lit(SLOT), 1)).withColumn(
        "_pieces", F.split("template", SLOT, -1))
    keys = [c for c in statements.columns if c != "template"] + [
        c for c in contexts.columns if c not in (*on, "variables")]
    j = s.join(contexts, on)
    v = F.col("variables")
    missing = F.array_sort(F.array_distinct(F.filter("_slots", lambda x: ~F.map_contains_key(v, x))))
    # of the other slots the first one that is null or unsafe
    bad = F.get(F.filter("_slots", lambda x: v[x].isNull() | ~v[x].rlike(SAFE_VALUE)), F.lit(0))
    reason = (F.when(F.size(missing) > 0, F.concat(F.lit("unresolved template variable(s): "), F.array_join(missing, ", ")))
              .when(bad.isNotNull() & v[bad].isNull(),
                    F.concat(F.lit("template variable '"), bad, F.lit("' resolved to null")))
              .when(bad.isNotNull(), F.concat(F.lit("template variable '"), bad, F.lit("' has an unsafe value"))))
    filled = F.concat(F.get("_pieces", F.lit(0)), F.array_join(F.transform(
        "_slots", lambda x, i: F.concat(v[x], F.get("_pieces", i + 1))), ""))
    out = j.select(*keys, F.col("template").isNull().alias("_none"), reason.alias("reason"), filled.alias("_filled"))
    ok = F.col("reason").isNull() & ~F.col("_none")
    return out.select(*keys, F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                      F.when(ok, F.col("_filled")).alias("statement"),
                      F.when(F.col("_none"), F.lit("empty template")).otherwise(F.col("reason")).alias("reason"))


def inventory_checks(inventory: DataFrame, checks: DataFrame) -> DataFrame:
    """(check_id, kind, n_matched, n_found, found, names) of every check.

    ``inventory``: object_kind, place (order of the listing), name, state,
    scheduled; ``checks``: check_id, kind, needle. A needle matches any name that
    contains it, whatever the case, and no needle matches all; a table is matched
    by its whole name. An object without a state counts as published or completed.
    """
    kinds = F.create_map(*[F.lit(x) for kv in CHECK_OBJECTS.items() for x in kv])
    c = checks.withColumn("object_kind", kinds[F.col("kind")])
    name, needle = F.coalesce("name", F.lit("")), F.coalesce("needle", F.lit(""))
    state = F.upper(F.coalesce("state", F.lit("")))
    matches = F.when(F.col("kind") == "table_exists", name == needle).otherwise(
        F.contains(F.lower(name), F.lower(needle)))
    found = (F.when(F.col("kind") == "dashboard_published", state.isin(*PUBLISHED_STATES, ""))
             .when(F.col("kind") == "pipeline_update_completed", state.isin(*COMPLETED_STATES, ""))
             .when(F.col("kind") == "job_exists_with_schedule", F.coalesce("scheduled", F.lit(False)))
             .otherwise(F.lit(True)))
    hit = inventory.join(c, "object_kind").filter(matches).select("check_id", "place", name.alias("name"), found.alias("_f"))
    counts = hit.groupBy("check_id").agg(F.count(F.lit(1)).alias("n_matched"), F.count_if("_f").alias("n_found"))
    w = Window.partitionBy("check_id").orderBy("place", "name")
    first = hit.filter("_f").select("check_id", "name", F.row_number().over(w).alias("_n")).filter(
        F.col("_n") <= FIRST_NAMES).groupBy("check_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]), ", ")
        .alias("names"))
    j = checks.select("check_id", "kind").join(counts, "check_id", "left").join(first, "check_id", "left")
    n = F.coalesce("n_found", F.lit(0))
    return j.select("check_id", "kind", F.coalesce("n_matched", F.lit(0)).alias("n_matched"), n.alias("n_found"),
                    (n > 0).alias("found"), F.coalesce("names", F.lit("")).alias("names"))
