"""Plan shape: no cartesian products, filters and pruning reach the scans."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

PLAN_CHECKED = ["mi_audit_missions", "mi_job_missions", "mi_consistent_operator", "mi_product_monthly",
                "ev_team_scores", "ev_completion_matrix", "ev_blockers", "dq_table_assertions", "li_catalog_lint"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAN_CHECKED)
def test_no_cartesian_product(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan


def test_lookback_filter_pushed_to_scan(spark):
    plan = _plan(E.queries()["mi_job_missions"](spark, SF_SMALL))
    assert "PushedFilters" in plan and "l_shipdate" in plan


def test_audit_scan_reads_only_needed_columns(spark):
    plan = _plan(E.queries()["mi_audit_missions"](spark, SF_SMALL))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("value" not in line.split("ReadSchema")[-1] for line in scans)
