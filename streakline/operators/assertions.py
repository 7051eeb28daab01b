"""Table assertions in bulk (DQ-1..10).

An assertion is a rule row ``(rule_id, table, metric, operator, value)``
where ``metric`` is an aggregate SQL expression over the table. All rules of
one table are folded into a single aggregation pass (one scan per table, not
one per rule); the results are unpivoted to ``(rule_id, actual)`` and judged
against the rule with built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Operators an expectation may use.
KNOWN_OPERATORS = ["=", "!=", ">", ">=", "<", "<=", "contains", "not_contains", "is_true", "is_false"]
NUMERIC_OPERATORS = [">", ">=", "<", "<="]


@dataclass(frozen=True)
class Assertion:
    rule_id: str
    table: str
    metric: str | None          # aggregate SQL; None = row count
    operator: str | None = None  # None with min_rows None = "at least one row"
    value: str | None = None
    min_rows: int | None = None


RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("operator", T.StringType(), True),
    T.StructField("expected", T.StringType(), True),
    T.StructField("min_rows", T.LongType(), True),
])


def _metric_sql(a: Assertion) -> str:
    return "count(*)" if a.metric is None or a.operator is None else a.metric


def measure(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Assertion]) -> DataFrame:
    """One aggregation per table computing every rule's metric, unpivoted to rows."""
    out = None
    by_table: dict[str, list[Assertion]] = {}
    for r in rules:
        by_table.setdefault(r.table, []).append(r)
    for table, rs in by_table.items():
        aggs = [F.expr(_metric_sql(r)).cast("string").alias(f"m{i}") for i, r in enumerate(rs)]
        row = tables[table].agg(*aggs)
        stack = ", ".join(f"'{r.rule_id}', m{i}" for i, r in enumerate(rs))
        part = row.selectExpr(f"stack({len(rs)}, {stack}) AS (rule_id, actual)")
        out = part if out is None else out.unionByName(part)
    return out


def _truthy(actual: Column) -> Column:
    """Typed truthiness: NULL, 0, '' and 'false' are false (see the T-14 note)."""
    num = F.expr("try_cast(actual AS DOUBLE)")
    return (F.when(actual.isNull(), F.lit(False))
            .when(num.isNotNull(), num != 0)
            .when(F.lower(actual).isin("", "false"), F.lit(False))
            .otherwise(F.lit(True)))


def judge(measured: DataFrame, rules_df: DataFrame) -> DataFrame:
    """Evaluate each measured metric against its rule → status, reason."""
    j = measured.join(F.broadcast(rules_df), "rule_id")
    op, exp, act = F.col("operator"), F.col("expected"), F.col("actual")
    a_num, e_num = F.expr("try_cast(actual AS DOUBLE)"), F.expr("try_cast(expected AS DOUBLE)")
    both_num = a_num.isNotNull() & e_num.isNotNull()
    equal = F.when(both_num, a_num == e_num).otherwise(F.coalesce(act, F.lit("None")) == F.coalesce(exp, F.lit("None")))
    found = F.instr(F.coalesce(act, F.lit("")), F.coalesce(exp, F.lit(""))) > 0
    n = a_num
    passed = (F.when(op.isNull() & F.col("min_rows").isNull(), n >= 1)
              .when(op.isNull(), n >= F.col("min_rows"))
              .when(op == "is_true", _truthy(act))
              .when(op == "is_false", ~_truthy(act))
              .when(op == "contains", found)
              .when(op == "not_contains", ~found)
              .when(op == "=", equal)
              .when(op == "!=", ~equal)
              .when(op == ">", a_num > e_num)
              .when(op == ">=", a_num >= e_num)
              .when(op == "<", a_num < e_num)
              .when(op == "<=", a_num <= e_num))
    no_op = op.isNull() & exp.isNotNull()
    error = no_op | (op.isNotNull() & ~op.isin(*KNOWN_OPERATORS)) | (op.isin(*NUMERIC_OPERATORS) & ~both_num)
    status = F.when(error, F.lit("error")).when(passed, F.lit("passed")).otherwise(F.lit("failed"))
    reason = (F.when(op.isNotNull() & ~op.isin(*KNOWN_OPERATORS),
                     F.concat(F.lit("unsupported expect operator: "), op))
              .when(no_op, F.lit("unsupported expect operator: None"))
              .when(op.isin(*NUMERIC_OPERATORS) & ~both_num,
                    F.concat(F.lit("operator "), op, F.lit(" requires numeric value and result")))
              .when(op.isNull() & F.col("min_rows").isNull(),
                    F.concat(F.lit("returned "), act, F.lit(" row(s); expected at least 1")))
              .when(op.isNull(), F.concat(F.lit("returned "), act, F.lit(" row(s); expected >= "),
                                          F.col("min_rows").cast("string")))
              .otherwise(F.concat_ws(" ", F.lit("value"), F.coalesce(act, F.lit("None")), op,
                                     F.coalesce(exp, F.lit("None")))))
    return j.select("rule_id", "table_name", "operator", "expected", "actual", status.alias("status"),
                    reason.alias("reason"))


def run_assertions(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Assertion]) -> DataFrame:
    rules_df = spark.createDataFrame(
        [(r.rule_id, r.table, r.operator, r.value, r.min_rows) for r in rules], RULE_SCHEMA)
    return judge(measure(spark, tables, rules), rules_df)


def team_log_assertion(log: DataFrame, members: DataFrame, since: str, min_rows: int) -> DataFrame:
    """DQ-10: per team, log rows by the team's members since the event start >= k.

    The log is semi-joined to the member list (one shuffle on the user key) and
    counted per team; teams with no rows still get a (failed) result.
    """
    m = members.select("event_id", "team_id", "user_id")
    rows = (log.filter(F.col("ts") >= F.to_timestamp(F.lit(since)))
            .join(m, "user_id").groupBy("event_id", "team_id").agg(F.count(F.lit(1)).alias("row_count")))
    teams = m.select("event_id", "team_id").distinct()
    j = teams.join(rows, ["event_id", "team_id"], "left")
    n = F.coalesce(F.col("row_count"), F.lit(0))
    return j.select("event_id", "team_id", n.alias("row_count"),
                    F.when(n >= min_rows, F.lit("passed")).otherwise(F.lit("failed")).alias("status"))


# Evidence limits.
EVIDENCE_ROWS = 5
EVIDENCE_CELL_CHARS = 200
EVIDENCE_TOTAL_CHARS = 2000


def evidence(samples: DataFrame, order: list[str] | Column) -> DataFrame:
    """DQ-8: evidence of all rules at once, or of one condition.

    With a condition as ``order``: the first rows of ``samples`` that it holds for,
    in the order of their cells, all columns as text, under the same limits.

    Otherwise (rule_id, position, evidence) of every rule's first violating rows, for all rules at once.

    ``samples``: rule_id, the columns ``order`` and ``cells`` (array of name and
    value). At most ``EVIDENCE_ROWS`` rows a rule, values cut to
    ``EVIDENCE_CELL_CHARS`` characters; rows are kept while names and values add up
    to at most ``EVIDENCE_TOTAL_CHARS``. The first rows of a rule are picked before
    the shuffle, so a rule with very many of them sends few.
    """
    if isinstance(order, Column):
        return _evidence_rows(samples, order)
    w = Window.partitionBy("rule_id").orderBy(*order)
    first = samples.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= EVIDENCE_ROWS)
    cells = F.transform("cells", lambda c: F.struct(
        c["name"].alias("name"), F.substring(F.coalesce(c["value"], F.lit("None")), 1, EVIDENCE_CELL_CHARS).alias("value")))
    size = F.aggregate("_cells", F.lit(0), lambda n, c: n + F.length(c["name"]) + F.length(c["value"]))
    run = first.withColumn("_cells", cells).withColumn(
        "_run", F.sum(size).over(Window.partitionBy("rule_id").orderBy("position")
                                 .rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform("_cells", lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")
    return run.filter(F.col("_run") <= EVIDENCE_TOTAL_CHARS).select(
        "rule_id", F.col("position").cast("long").alias("position"), text.alias("evidence"))


def _evidence_rows(df: DataFrame, where: Column) -> DataFrame:
    cells = [F.substring(F.col(f"`{c}`").cast("string"), 1, EVIDENCE_CELL_CHARS).alias(c) for c in df.columns]
    cut = df.filter(where).orderBy(*[f"`{c}`" for c in df.columns]).limit(EVIDENCE_ROWS).select(*cells)
    size = sum((F.lit(len(c)) + F.coalesce(F.length(f"`{c}`"), F.lit(len("None")))) for c in df.columns)
    w = Window.orderBy(*[f"`{c}`" for c in df.columns]).rowsBetween(Window.unboundedPreceding, 0)  # a few rows
    return cut.withColumn("_run", F.sum(size).over(w)).filter(F.col("_run") <= EVIDENCE_TOTAL_CHARS).drop("_run")


def violating(table: DataFrame, rule_id: str, where: str, columns: dict[str, str], order: str) -> DataFrame:
    """Rows of ``table`` that break a rule, as :func:`evidence` takes them; ``columns``: name and SQL expression."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).cast("string").alias("value")) for n, e in columns.items()])
    return table.filter(where).select(F.lit(rule_id).alias("rule_id"), F.expr(order).cast("long").alias("place"),
                                      cells.alias("cells"))
