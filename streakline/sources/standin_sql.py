"""SQL twins of :mod:`streakline.sources.standins` for the DuckDB oracle.

Each constant is a ``name AS (...)`` CTE over the driver's views, written from
the same fixed values as the Spark adapters.
"""

from __future__ import annotations

from . import standins as S


def principal(x: str) -> str:
    return (f"concat('user', CAST({x} AS VARCHAR), CASE WHEN {x} % {S.NON_HUMAN_EVERY} = 0 "
            f"THEN '' ELSE '{S.EMAIL_DOMAIN}' END)")


K = "CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER)"


def _case(col: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {('NULL' if default is None else repr(default))} END"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_TYPE_IDX = ("CASE " + " ".join(f"WHEN event_type = '{t}' THEN {i}" for i, t in enumerate(S.EVENT_TYPE_ORDER))
             + f" ELSE {len(S.EVENT_TYPE_ORDER)} END")
_SLOT = f"(({_TYPE_IDX}) * 10 + CAST(floor({K} / 10) AS INTEGER)) % {len(S.AUDIT_VOCABULARY)} + 1"

USAGE = f"""usage AS (
  SELECT {principal('user_id')} AS run_as,
         CAST(ts AS DATE) AS usage_date,
         value AS usage_quantity,
         {_case('event_type', S.PRODUCT_BY_EVENT_TYPE)} AS billing_origin_product,
         CASE WHEN event_type = 'signup' THEN event_id END AS dlt_pipeline_id
  FROM events)"""

AUDIT = f"""audit AS (
  SELECT {principal('user_id')} AS email,
         list_extract({_list(s for s, _ in S.AUDIT_VOCABULARY)}, {_SLOT}) AS service_name,
         list_extract({_list(a for _, a in S.AUDIT_VOCABULARY)}, {_SLOT}) AS action_name,
         CASE WHEN {K} < {S.SUCCESS_K_BELOW} THEN 200 ELSE 500 END AS status_code,
         CAST(ts AS TIMESTAMP) AS event_time
  FROM events)"""

QUERY_HISTORY = f"""query_history AS (
  SELECT {principal('e.user_id')} AS executed_by,
         {_case('e.event_type', S.STATEMENT_BY_EVENT_TYPE)} AS statement_type,
         CASE WHEN {K.replace('props', 'e.props')} < {S.SUCCESS_K_BELOW} THEN 'FINISHED' ELSE 'FAILED' END
           AS execution_status,
         CAST(e.ts AS TIMESTAMP) AS start_time,
         d.text AS statement_text
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id)"""

ASSISTANT = f"""assistant_events AS (
  SELECT {principal('user_id')} AS initiated_by, CAST(ts AS TIMESTAMP) AS event_time
  FROM events WHERE event_type = '{S.ASSISTANT_EVENT_TYPE}')"""

JOBS = f"""jobs AS (
  SELECT concat('ws-', substr(o.o_orderpriority, 1, 1)) AS workspace_id,
         l.l_orderkey AS job_id,
         {principal('o.o_custkey')} AS creator_user_name,
         CASE WHEN l.l_returnflag = 'A' THEN 'CRON' WHEN l.l_returnflag = 'N' THEN 'PERIODIC'
              ELSE 'ONE_TIME' END AS trigger_type,
         CAST(l.l_shipdate AS TIMESTAMP) AS change_time,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN CAST(l.l_shipdate AS TIMESTAMP) END
           AS delete_time,
         l.l_linenumber AS version
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

JOB_TASKS = """job_tasks AS (
  SELECT concat('ws-', substr(o.o_orderpriority, 1, 1)) AS workspace_id,
         l.l_orderkey AS job_id,
         concat('task_', CAST(l.l_linenumber AS VARCHAR)) AS task_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

JOB_RUNS = """job_runs AS (
  SELECT concat('ws-', substr(o.o_orderpriority, 1, 1)) AS workspace_id,
         l.l_orderkey AS job_id,
         CASE WHEN l.l_linestatus = 'F' THEN 'SUCCEEDED' END AS result_state,
         CAST(l.l_shipdate AS TIMESTAMP) AS period_start_time
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

PIPELINES = f"""pipelines AS (
  SELECT o_orderkey AS pipeline_id,
         {principal('o_custkey')} AS created_by,
         CASE WHEN o_orderstatus = 'O' THEN 'MATERIALIZED_VIEW' ELSE 'ETL_PIPELINE' END AS pipeline_type,
         CAST(o_orderdate AS TIMESTAMP) AS change_time,
         CASE WHEN o_orderpriority = '5-LOW' THEN CAST(o_orderdate AS TIMESTAMP) END AS delete_time
  FROM orders)"""

PIPELINE_UPDATES = f"""pipeline_updates AS (
  SELECT {principal('o_custkey')} AS run_as_user_name,
         CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'P' THEN 'FAILED' END
           AS result_state,
         CAST(o_orderdate AS TIMESTAMP) AS period_start_time
  FROM orders)"""

# ----------------------------- event game -----------------------------------
_FED = ", ".join(f"'{s}'" for s in S.FEDERATED_SEGMENTS)

COMPETITIONS = f"""competitions AS (
  SELECT r_regionkey AS event_id, replace(lower(r_name), ' ', '-') AS slug, r_name AS title,
         CASE WHEN r_regionkey = {S.FROZEN_REGION} THEN 'frozen' ELSE 'active' END AS status,
         CASE WHEN r_regionkey = {S.FROZEN_REGION} THEN TIMESTAMP '{S.FROZEN_AT}' END AS scoring_frozen_at, {S.PACK_VERSION} AS pack_version_id
  FROM region)"""

TEAMS = """teams AS (
  SELECT n_nationkey AS team_id, n_regionkey AS event_id, n_name AS name, n_name AS display_name
  FROM nation)"""

PARTICIPANTS = f"""participants AS (
  SELECT c.c_custkey AS participant_id, {principal('c.c_custkey')} AS user_id, c.c_name AS display_name,
         n.n_regionkey AS event_id, c.c_nationkey AS team_id,
         CASE WHEN c.c_mktsegment IN ({_FED}) THEN lower(c.c_mktsegment) END AS workspace_id,
         c.c_acctbal
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

TEAM_MEMBERS = f"""order_dates AS (SELECT o_custkey AS participant_id, min(CAST(o_orderdate AS TIMESTAMP)) AS first_at,
         max(CAST(o_orderdate AS TIMESTAMP)) AS last_at FROM orders GROUP BY 1),
member_base AS (SELECT c.c_custkey AS participant_id, c.c_nationkey AS team_id, c.c_mktsegment,
         min(n.n_nationkey) OVER (PARTITION BY n.n_regionkey) AS lead, c.c_acctbal, d.first_at, d.last_at
  FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey
  LEFT JOIN order_dates d ON d.participant_id = c.c_custkey),
team_members AS (
  SELECT team_id, participant_id, coalesce(first_at, TIMESTAMP '{S.NO_ORDER_DATE}') AS joined_at
  FROM member_base WHERE c_acctbal >= 0
  UNION ALL SELECT lead, participant_id, coalesce(last_at, TIMESTAMP '{S.NO_ORDER_DATE}')
  FROM member_base WHERE c_acctbal >= 0 AND c_mktsegment = '{S.SECOND_TEAM_SEGMENT}' AND lead <> team_id)"""

IMPORT_ROWS = f"""import_rows AS (
  SELECT n.n_regionkey AS event_id, o.o_orderkey AS line,
         CASE WHEN o.o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN '' ELSE {principal('o.o_custkey')} || ' ' END AS user_id,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN {principal('o.o_custkey')}
              WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus <> 'P' THEN {principal('o.o_custkey')} END AS email,
         CASE WHEN o.o_orderstatus = 'P' THEN ' ' ELSE c.c_name END AS display_name,
         CASE o.o_orderstatus WHEN 'F' THEN n.n_name WHEN 'O' THEN n.n_name || ' ' || substr(o.o_orderpriority, 1, 1)
              ELSE '  ' END AS team_name
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

IDENTITY_MAP = """identity_map AS (
  SELECT event_id, workspace_id, user_id AS lab_user_email, team_id
  FROM participants WHERE workspace_id IS NOT NULL AND c_acctbal >= 0)"""

QUESTS = """quests AS (
  SELECT r_regionkey AS quest_id, replace(lower(r_name), ' ', '-') AS quest_slug,
         r_name AS quest_title, r_regionkey AS quest_sort
  FROM region)"""

TASKS = f"""tasks AS (
  SELECT s.s_suppkey AS task_id, {S.PACK_VERSION} AS pack_version_id, n.n_regionkey AS quest_id,
         concat('task-', CAST(s.s_suppkey AS VARCHAR)) AS task_slug, s.s_name AS task_title,
         CAST(round(s.s_acctbal / {S.POINTS_PER_ACCTBAL}) AS INTEGER) AS points,
         s.s_suppkey AS task_sort,
         CAST(-{S.HINT_PENALTY_STEP} * (1 + floor(s.s_nationkey / 5)) AS INTEGER) AS hint_penalty
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)"""

ATTEMPTS = """attempts AS (
  SELECT concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
                   CAST(l.l_suppkey AS VARCHAR)) AS attempt_id,
         p.event_id,
         CASE WHEN p.workspace_id IS NULL THEN p.team_id END AS team_id,
         p.workspace_id, p.user_id, l.l_suppkey AS task_id,
         CAST(l.l_shipdate AS TIMESTAMP) AS created_at,
         l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN participants p ON o.o_custkey = p.participant_id)"""

VALIDATION_RESULTS = f"""validation_results AS (
  SELECT attempt_id, 1 AS validator_id,
         CASE WHEN l_returnflag = 'A' THEN 'passed' ELSE 'failed' END AS status, created_at AS completed_at
  FROM attempts WHERE l_quantity <> {S.NO_RESULT_QUANTITY}
  UNION ALL
  SELECT attempt_id, 2 AS validator_id,
         CASE WHEN l_tax = {S.ERROR_TAX} THEN 'error' WHEN l_discount >= {S.PASS_DISCOUNT} THEN 'passed'
              ELSE 'failed' END AS status, created_at AS completed_at
  FROM attempts WHERE l_quantity <> {S.NO_RESULT_QUANTITY})"""

HINT_REVEALS = f"""hint_reveals AS (
  SELECT event_id, team_id, workspace_id, user_id, task_id, task_id AS hint_id, created_at,
         attempt_id AS source_id
  FROM attempts WHERE l_returnflag = '{S.HINT_RETURNFLAG}' AND l_discount = 0.0)"""

EVENT_GAME = [COMPETITIONS, TEAMS, PARTICIPANTS, IDENTITY_MAP, QUESTS, TASKS, ATTEMPTS,
              VALIDATION_RESULTS, HINT_REVEALS]


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

CATALOG_QUESTS = f"""catalog_quests AS (
  SELECT {S.PACK_VERSION} AS pack_version_id, r.r_regionkey AS quest_id, replace(lower(r.r_name), ' ', '-') AS quest_slug,
         CASE WHEN n.r_regionkey IS NULL THEN replace(lower(r.r_name), ' ', '-')
              ELSE replace(lower(p.r_name), ' ', '-') END AS unlock_quest_slug,
         r.r_regionkey > 0 AS has_unlock_rule
  FROM region r LEFT JOIN region p ON r.r_regionkey = p.r_regionkey + 1
  LEFT JOIN region n ON n.r_regionkey = r.r_regionkey + 1)"""

_STMT = (f"concat('SELECT count(*) FROM ${{team_schema}}.orders WHERE supplier = ', CAST(s_suppkey AS VARCHAR), "
         f"CASE WHEN s_nationkey = {S.BAD_TEMPLATE_NATION} THEN ' AND day = ${{run_day}}' ELSE '' END)")

CATALOG_VALIDATORS = f"""catalog_validators AS (
  SELECT s_suppkey AS task_id, 1 AS validator_id, 'sql_assertion' AS type, 'sync' AS mode, '>=' AS operator,
         {_STMT} AS statement FROM supplier WHERE s_nationkey <> {S.NO_VALIDATOR_NATION}
  UNION ALL
  SELECT s_suppkey, 2,
         CASE WHEN s_acctbal < 0 THEN 'manual' WHEN s_acctbal > {S.UNKNOWN_TYPE_ABOVE} THEN 'custom_probe'
              ELSE 'sql_assertion' END,
         CASE WHEN s_acctbal BETWEEN {S.BAD_MODE_RANGE[0]} AND {S.BAD_MODE_RANGE[1]} THEN 'batch' ELSE 'async' END,
         CASE WHEN s_acctbal BETWEEN {S.BAD_OPERATOR_RANGE[0]} AND {S.BAD_OPERATOR_RANGE[1]} THEN 'approx' ELSE 'contains' END,
         {_STMT} FROM supplier WHERE s_nationkey <> {S.NO_VALIDATOR_NATION})"""

INVENTORY = """inventory AS (
  SELECT 'dashboard' AS object_kind, p_partkey AS place, p_name AS name,
         CASE WHEN p_size < 20 THEN 'active' WHEN p_size < 35 THEN 'DRAFT' ELSE '' END AS state, CAST(NULL AS BOOLEAN) AS scheduled
  FROM part
  UNION ALL SELECT 'table', p_partkey, concat_ws('.', p_brand, p_type, CAST(p_partkey AS VARCHAR)), NULL, NULL FROM part
  UNION ALL SELECT 'genie_space', s_suppkey, s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'job', c_custkey, c_name, NULL, CASE WHEN c_acctbal <> 0 THEN c_acctbal > 5000 END FROM customer
  UNION ALL SELECT 'pipeline', o_orderkey, o_orderpriority || '/' || CAST(o_orderkey AS VARCHAR),
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'FAILED' END, NULL FROM orders)"""

ANNOUNCEMENTS = """announcements AS (
  SELECT n.n_regionkey AS event_id, o.o_orderkey AS announcement_id, 'Order ' || CAST(o.o_orderkey AS VARCHAR) AS title,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'critical' ELSE 'info' END AS severity,
         CAST(o.o_orderdate AS TIMESTAMP) AS created_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

CATALOG_HINTS = f"""catalog_hints AS (
  SELECT k.task_id, k.task_id AS hint_id,
         CASE WHEN s.s_acctbal > {S.BONUS_HINT_ABOVE} THEN -k.hint_penalty ELSE k.hint_penalty END AS penalty_points
  FROM tasks k JOIN supplier s ON k.task_id = s.s_suppkey)"""
