"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate, locally)."""

import datetime as _dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from streakline.sources.tables import TABLES

from conftest import SF_SMALL


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "∅" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, (decimal.Decimal, int)) and not isinstance(v, bool):
        return f"{float(v):.6f}"
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(srows, sdf.columns) == _rows(res.fetchall(), dcols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "all_time_rank" in df.columns
