"""Registered queries of table assertions (DQ-*) and catalog lint (LI-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assertions as A
from ..operators import lint as L
from ..sources import standin_sql as Q
from ..sources import standins as S
from ..sources.tables import TABLES, Tables
from .registry import register

# Rule rows of the bulk table check: the assertion patterns of the packs
# (row count, null keys, forbidden rows, positive sums, reconciled sums) plus
# every operator, including the malformed cases that must come back as errors.
RULES = [
    A.Assertion("lineitem_has_rows", "lineitem", None),
    A.Assertion("orders_min_rows", "orders", None, min_rows=1000),
    A.Assertion("customer_null_keys", "customer", "count_if(c_custkey IS NULL)", "=", "0"),
    A.Assertion("events_forbidden_rows", "events", "count_if(value <= 0)", "=", "0"),
    A.Assertion("lineitem_revenue_positive", "lineitem",
                "CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))), 2)"
                " AS DECIMAL(28,2))", ">", "0"),
    A.Assertion("orders_status_known", "orders", "count_if(o_orderstatus NOT IN ('F', 'O', 'P'))", "<=", "0"),
    A.Assertion("region_names_contain", "region", "min(r_name)", "contains", "AFRICA"),
    A.Assertion("segments_all_present", "customer", "count(DISTINCT c_mktsegment) = 5", "is_true"),
    A.Assertion("no_negative_prices", "part", "count_if(p_retailprice < 0) > 0", "is_false"),
    A.Assertion("nation_count", "nation", "count(*)", "=", "25"),
    A.Assertion("first_event_type", "events", "min(event_type)", "=", "click"),
    A.Assertion("last_event_type_clean", "events", "max(event_type)", "not_contains", "zzz"),
    A.Assertion("reconcile_event_sums", "events",
                "sum(CAST(value AS DECIMAL(18,2))) - (sum(CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18,2))"
                " ELSE 0 END) + sum(CASE WHEN event_type <> 'click' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END))",
                "=", "0"),
    A.Assertion("documents_have_text", "documents", "count_if(text IS NULL OR text = '')", "<", "1"),
    A.Assertion("conversation_roles", "conversations", "count(DISTINCT role)", ">=", "2"),
    A.Assertion("labels_binary", "labels", "count_if(quality NOT IN (0, 1) OR toxic NOT IN (0, 1))", "=", "0"),
    A.Assertion("suppliers_not_42", "supplier", "count(*)", "!=", "42"),
    A.Assertion("pages_min_rows", "pages", None, min_rows=1),
    A.Assertion("embeddings_has_rows", "embeddings", None),
    A.Assertion("benchmark_item_count", "benchmark", "count(*)", ">", "0"),
    A.Assertion("unknown_operator", "supplier", "count(*)", "~=", "1"),
    A.Assertion("expectation_without_operator", "supplier", None, value="1"),
    A.Assertion("numeric_operator_on_text", "supplier", "min(s_name)", ">=", "1"),
]


def _assertions_sql() -> str:
    measured = "\n  UNION ALL ".join(
        f"SELECT '{r.rule_id}' AS rule_id, CAST((SELECT {A._metric_sql(r)} FROM {r.table}) AS VARCHAR) AS actual"
        for r in RULES)

    def lit(v):
        return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"

    values = ", ".join(f"({lit(r.rule_id)}, {lit(r.table)}, {lit(r.operator)}, {lit(r.value)}, "
                       f"{'NULL' if r.min_rows is None else r.min_rows})" for r in RULES)
    known = ", ".join(f"'{o}'" for o in A.KNOWN_OPERATORS)
    numeric = ", ".join(f"'{o}'" for o in A.NUMERIC_OPERATORS)
    truthy = ("(CASE WHEN actual IS NULL THEN false WHEN TRY_CAST(actual AS DOUBLE) IS NOT NULL "
              "THEN TRY_CAST(actual AS DOUBLE) <> 0 WHEN lower(actual) IN ('', 'false') THEN false ELSE true END)")
    both = "(TRY_CAST(actual AS DOUBLE) IS NOT NULL AND TRY_CAST(expected AS DOUBLE) IS NOT NULL)"
    equal = (f"(CASE WHEN {both} THEN TRY_CAST(actual AS DOUBLE) = TRY_CAST(expected AS DOUBLE) "
             "ELSE coalesce(actual, 'None') = coalesce(expected, 'None') END)")
    found = "(instr(coalesce(actual, ''), coalesce(expected, '')) > 0)"
    a, e = "TRY_CAST(actual AS DOUBLE)", "TRY_CAST(expected AS DOUBLE)"
    passed = f"""CASE WHEN operator IS NULL AND min_rows IS NULL THEN {a} >= 1
  WHEN operator IS NULL THEN {a} >= min_rows
  WHEN operator = 'is_true' THEN {truthy} WHEN operator = 'is_false' THEN NOT {truthy}
  WHEN operator = 'contains' THEN {found} WHEN operator = 'not_contains' THEN NOT {found}
  WHEN operator = '=' THEN {equal} WHEN operator = '!=' THEN NOT {equal}
  WHEN operator = '>' THEN {a} > {e} WHEN operator = '>=' THEN {a} >= {e}
  WHEN operator = '<' THEN {a} < {e} WHEN operator = '<=' THEN {a} <= {e} END"""
    err = f"((operator IS NULL AND expected IS NOT NULL) OR (operator IS NOT NULL AND operator NOT IN ({known})) OR (operator IN ({numeric}) AND NOT {both}))"
    reason = f"""CASE WHEN operator IS NOT NULL AND operator NOT IN ({known}) THEN 'unsupported expect operator: ' || operator
  WHEN operator IS NULL AND expected IS NOT NULL THEN 'unsupported expect operator: None'
  WHEN operator IN ({numeric}) AND NOT {both} THEN 'operator ' || operator || ' requires numeric value and result'
  WHEN operator IS NULL AND min_rows IS NULL THEN 'returned ' || actual || ' row(s); expected at least 1'
  WHEN operator IS NULL THEN 'returned ' || actual || ' row(s); expected >= ' || CAST(min_rows AS VARCHAR)
  ELSE concat_ws(' ', 'value', coalesce(actual, 'None'), operator, coalesce(expected, 'None')) END"""
    return f"""WITH measured AS ({measured}),
rules AS (SELECT * FROM (VALUES {values}) r(rule_id, table_name, operator, expected, min_rows))
SELECT rule_id, table_name, operator, expected, actual,
  CASE WHEN {err} THEN 'error' WHEN coalesce({passed}, false) THEN 'passed' ELSE 'failed' END AS status,
  {reason} AS reason
FROM measured JOIN rules USING (rule_id)"""


@register("dq_table_assertions", _assertions_sql())
def q_assertions(spark, sf_dir):
    """DQ-1..9: every rule of every table in one aggregation pass per table."""
    t = Tables(spark, sf_dir)
    needed = sorted({r.table for r in RULES})
    return A.run_assertions(spark, {n: t.get(n) for n in needed if n in TABLES}, RULES)


# DQ-10 stand-in: the usage log's rows by each team's members since the event start.
TEAM_LOG_SINCE = "2024-01-15 00:00:00"
TEAM_LOG_MIN_ROWS = 40


@register("dq_team_log_assertion", "WITH " + ",\n".join([Q.PARTICIPANTS]) + f"""
SELECT p.event_id, p.team_id, coalesce(c.row_count, 0) AS row_count,
  CASE WHEN coalesce(c.row_count, 0) >= {TEAM_LOG_MIN_ROWS} THEN 'passed' ELSE 'failed' END AS status
FROM (SELECT DISTINCT event_id, team_id FROM participants) p
LEFT JOIN (SELECT m.event_id, m.team_id, count(*) AS row_count
           FROM (SELECT {Q.principal('user_id')} AS user_id FROM events
                 WHERE ts >= TIMESTAMP '{TEAM_LOG_SINCE}') e
           JOIN participants m ON m.user_id = e.user_id GROUP BY 1, 2) c
  ON c.event_id = p.event_id AND c.team_id = p.team_id""")
def q_team_log(spark, sf_dir):
    t = Tables(spark, sf_dir)
    log = t.get("events", ["user_id", "ts"]).select(S.principal("user_id").alias("user_id"), "ts")
    return A.team_log_assertion(log, S.participants(t), TEAM_LOG_SINCE, TEAM_LOG_MIN_ROWS)


# ----------------------------- lint -----------------------------------------

_LINT_CTES = [Q.TASKS, Q.CATALOG_QUESTS, Q.CATALOG_VALIDATORS, Q.CATALOG_HINTS,
              """lt AS (SELECT k.pack_version_id, k.quest_id, q.quest_slug, k.task_id, k.task_slug, k.points,
                         s.s_acctbal < 0 AS manual
                  FROM tasks k JOIN catalog_quests q ON q.quest_id = k.quest_id JOIN supplier s ON s.s_suppkey = k.task_id)""",
              """lv AS (SELECT v.*, t.pack_version_id, t.quest_id, t.quest_slug, t.task_slug
                  FROM catalog_validators v JOIN lt t ON t.task_id = v.task_id)""",
              """lh AS (SELECT h.*, t.pack_version_id, t.quest_id, t.quest_slug, t.task_slug
                  FROM catalog_hints h JOIN lt t ON t.task_id = h.task_id)"""]
_QLOC = "'quests[' || CAST(quest_id AS VARCHAR) || '](' || quest_slug || ')'"
_TLOC = f"{_QLOC} || '.tasks[' || CAST(task_id AS VARCHAR) || '](' || task_slug || ')'"
_VLOC = f"{_TLOC} || '.validators[' || CAST(validator_id AS VARCHAR) || ']'"
_SLUG = L.SLUG_PATTERN.replace("'", "''")
_TYPES = ", ".join(f"'{x}'" for x in L.KNOWN_VALIDATOR_TYPES)
_OPS = ", ".join(f"'{x}'" for x in A.KNOWN_OPERATORS)
_VARS = ", ".join(f"'{x}'" for x in L.TEMPLATE_VARS)

_FINDINGS = f"""findings AS (
SELECT pack_version_id, 'error' AS severity, {_QLOC} || '.slug' AS loc, 'Invalid quest slug ''' || quest_slug || '''.' AS message
  FROM catalog_quests WHERE NOT regexp_matches(quest_slug, '{_SLUG}')
UNION ALL SELECT pack_version_id, 'error', {_TLOC} || '.slug', 'Invalid task slug ''' || task_slug || '''.'
  FROM lt WHERE NOT regexp_matches(task_slug, '{_SLUG}')
UNION ALL SELECT pack_version_id, 'error', 'quests(' || quest_slug || ').slug', 'Duplicate quest slug ''' || quest_slug || '''.'
  FROM catalog_quests GROUP BY pack_version_id, quest_slug HAVING count(*) > 1
UNION ALL SELECT pack_version_id, 'error', {_QLOC} || '.tasks(' || task_slug || ').slug',
  'Duplicate task slug ''' || task_slug || ''' within quest ''' || quest_slug || '''.'
  FROM lt GROUP BY pack_version_id, quest_id, quest_slug, task_slug HAVING count(*) > 1
UNION ALL SELECT pack_version_id, 'error', {_VLOC} || '.id',
  'Duplicate validator id ''' || CAST(validator_id AS VARCHAR) || ''' within task.'
  FROM lv GROUP BY pack_version_id, quest_id, quest_slug, task_id, task_slug, validator_id HAVING count(*) > 1
UNION ALL SELECT pack_version_id, 'error', {_QLOC} || '.tasks', 'Each quest must define at least one task.'
  FROM catalog_quests q WHERE NOT EXISTS (SELECT 1 FROM tasks k WHERE k.quest_id = q.quest_id)
UNION ALL SELECT pack_version_id, 'error', {_TLOC} || '.validators',
  'Task has no validators. Add at least one validator or set manual_validation_required: true.'
  FROM lt WHERE NOT manual AND NOT EXISTS (SELECT 1 FROM catalog_validators v WHERE v.task_id = lt.task_id)
UNION ALL SELECT pack_version_id, 'error', {_TLOC} || '.points', 'points must be >= 0.' FROM lt WHERE points < 0
UNION ALL SELECT pack_version_id, 'warning', {_VLOC} || '.type', 'Unknown validator type ''' || type || '''.'
  FROM lv WHERE type NOT IN ({_TYPES})
UNION ALL SELECT pack_version_id, 'error', {_VLOC} || '.mode',
  'Validator mode must be ''sync'' or ''async'', got ''' || coalesce(mode, '') || '''.'
  FROM lv WHERE coalesce(mode, '') NOT IN ('sync', 'async')
UNION ALL SELECT pack_version_id, 'error', {_VLOC} || '.statement', 'sql_assertion requires a ''statement''.'
  FROM lv WHERE type = 'sql_assertion' AND coalesce(statement, '') = ''
UNION ALL SELECT pack_version_id, 'warning', {_VLOC} || '.expect',
  'sql_assertion has no ''expect'' block; result will not be checked.'
  FROM lv WHERE type = 'sql_assertion' AND operator IS NULL
UNION ALL SELECT pack_version_id, 'error', {_VLOC} || '.expect.operator', 'Unknown operator ''' || operator || '''.'
  FROM lv WHERE type = 'sql_assertion' AND operator IS NOT NULL AND operator NOT IN ({_OPS})
UNION ALL SELECT pack_version_id, 'warning', {_TLOC} || '.hints[' || CAST(hint_id AS VARCHAR) || '].penalty_points',
  'penalty_points is usually <= 0 (a penalty). Got ' || CAST(penalty_points AS VARCHAR) || '.'
  FROM lh WHERE penalty_points > 0
UNION ALL SELECT pack_version_id, 'warning', {_VLOC} || '.statement', 'Unknown template variable ''${{' || var || '}}''.'
  FROM (SELECT *, unnest(list_distinct(regexp_extract_all(coalesce(statement, ''), '\\$\\{{([a-zA-Z0-9_]+)\\}}', 1))) AS var
        FROM lv WHERE type = 'sql_assertion') WHERE var NOT IN ({_VARS})
UNION ALL SELECT pack_version_id, 'error', {_QLOC} || '.unlock_rule.quest_slug',
  CASE WHEN coalesce(unlock_quest_slug, '') = '' THEN 'unlock_rule type ''quest_completed'' requires quest_slug.'
       WHEN NOT EXISTS (SELECT 1 FROM catalog_quests t WHERE t.pack_version_id = q.pack_version_id
                        AND t.quest_slug = q.unlock_quest_slug)
         THEN 'unlock_rule references unknown quest ''' || unlock_quest_slug || '''.'
       WHEN unlock_quest_slug = quest_slug THEN 'A quest cannot be gated on completing itself.' END
  FROM catalog_quests q WHERE (unlock_quest_slug IS NOT NULL OR has_unlock_rule)
    AND (coalesce(unlock_quest_slug, '') = '' OR unlock_quest_slug = quest_slug
         OR NOT EXISTS (SELECT 1 FROM catalog_quests t WHERE t.pack_version_id = q.pack_version_id
                        AND t.quest_slug = q.unlock_quest_slug)))"""


def _catalog(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.catalog_quests(t), S.catalog_tasks(t), S.catalog_validators(t), S.catalog_hints(t)


@register("li_catalog_lint", "WITH " + ",\n".join(_LINT_CTES + [_FINDINGS]) + f"""
SELECT * FROM findings
UNION ALL SELECT r_regionkey + {S.PACK_VERSION}, 'error', 'pack.slug', 'Invalid pack slug ''' || lower(r_name) || '''.'
  FROM region WHERE NOT regexp_matches(lower(r_name), '{_SLUG}')
UNION ALL SELECT r_regionkey + {S.PACK_VERSION}, 'error', 'pack.version', 'The pack has no version.' FROM region WHERE r_regionkey = 2
UNION ALL SELECT r_regionkey + {S.PACK_VERSION}, 'error', 'quests', 'The pack has no quests.'
  FROM region WHERE r_regionkey + {S.PACK_VERSION} NOT IN (SELECT pack_version_id FROM catalog_quests)""")
def q_lint(spark, sf_dir):
    """LI-1..6: every finding of the pack catalog and of the packs."""
    frames = _catalog(spark, sf_dir)
    return L.lint(*frames).unionByName(L.lint_packs(S.catalog_packs(Tables(spark, sf_dir)), frames[0]))


@register("li_lint_summary", "WITH " + ",\n".join(_LINT_CTES + [_FINDINGS]) + """
SELECT q.pack_version_id, CAST(coalesce(f.errors, 0) AS BIGINT) AS errors, CAST(coalesce(f.warnings, 0) AS BIGINT) AS warnings,
  CAST(q.quests AS BIGINT) AS quests, CAST(coalesce(k.tasks, 0) AS BIGINT) AS tasks,
  CAST(coalesce(v.validators, 0) AS BIGINT) AS validators, CAST(coalesce(h.hints, 0) AS BIGINT) AS hints,
  coalesce(f.errors, 0) = 0 AS ok
FROM (SELECT pack_version_id, count(*) AS quests FROM catalog_quests GROUP BY 1) q
LEFT JOIN (SELECT pack_version_id, count(*) AS tasks FROM lt GROUP BY 1) k USING (pack_version_id)
LEFT JOIN (SELECT pack_version_id, count(*) AS validators FROM lv GROUP BY 1) v USING (pack_version_id)
LEFT JOIN (SELECT pack_version_id, count(*) AS hints FROM lh GROUP BY 1) h USING (pack_version_id)
LEFT JOIN (SELECT pack_version_id, count(*) FILTER (WHERE severity = 'error') AS errors,
                  count(*) FILTER (WHERE severity = 'warning') AS warnings FROM findings GROUP BY 1) f USING (pack_version_id)""")
def q_lint_summary(spark, sf_dir):
    """LI-7: errors block, warnings allowed, content counts."""
    quests, tasks, validators, hints = _catalog(spark, sf_dir)
    return L.lint_summary(L.lint(quests, tasks, validators, hints), quests, tasks, validators, hints)
