"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver's tables; the SQL computes the same columns in DuckDB from the
pre-registered table views.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            # The plans compare and truncate timestamps as UTC wall time, like the oracle.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from . import queries_adoption  # noqa: F401
    from . import queries_event  # noqa: F401
    from . import queries_checks  # noqa: F401
    from . import queries_streaming  # noqa: F401
    from . import queries_extra  # noqa: F401
    from . import queries_membership  # noqa: F401
    from . import queries_snapshots  # noqa: F401
    from . import queries_packs  # noqa: F401
    from . import queries_bulk  # noqa: F401
    from . import queries_report  # noqa: F401
