"""Column expressions shared by every plan.

All helpers return ``Column`` objects built from ``pyspark.sql.functions`` so
they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Level tiers, highest first: (name, minimum points).
LEVEL_TIERS = [("Elite", 5000), ("Platinum", 2000), ("Gold", 800), ("Silver", 300), ("Bronze", 0)]
# Points added above the top threshold to form the top tier's progress ceiling.
TOP_TIER_SPAN = 1000
# Mission difficulty labels by points, highest first.
DIFFICULTY_TIERS = [("Expert", 400), ("Advanced", 200), ("Intermediate", 100), ("Starter", 0)]
# Characters that make a spreadsheet cell a formula.
CSV_FORMULA_PREFIXES = ["=", "+", "-", "@"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def display_name(user_id) -> Column:
    """Local part of an e-mail; text without '@' is returned whole."""
    return F.split(_c(user_id), "@").getItem(0)


def tier(points) -> Column:
    p = _c(points)
    expr = None
    for name, floor in LEVEL_TIERS[:-1]:
        expr = F.when(p >= floor, F.lit(name)) if expr is None else expr.when(p >= floor, F.lit(name))
    return expr.otherwise(F.lit(LEVEL_TIERS[-1][0]))


def tier_floor(points) -> Column:
    p = _c(points)
    expr = None
    for _, floor in LEVEL_TIERS[:-1]:
        expr = F.when(p >= floor, F.lit(floor)) if expr is None else expr.when(p >= floor, F.lit(floor))
    return expr.otherwise(F.lit(LEVEL_TIERS[-1][1]))


def tier_ceiling(points) -> Column:
    """Next tier's threshold; the top tier's ceiling is its floor + TOP_TIER_SPAN."""
    p = _c(points)
    top_name, top_floor = LEVEL_TIERS[0]
    expr = F.when(p >= top_floor, F.lit(top_floor + TOP_TIER_SPAN))
    for (_, upper), (_, floor) in zip(LEVEL_TIERS[:-1], LEVEL_TIERS[1:]):
        expr = expr.when(p >= floor, F.lit(upper))
    return expr.otherwise(F.lit(LEVEL_TIERS[-2][1]))


def tier_progress_pct(points) -> Column:
    """Server variant: truncated percentage of the way to the ceiling, capped at 100."""
    p = _c(points)
    lo, hi = tier_floor(p), tier_ceiling(p)
    raw = (p - lo) / F.greatest(F.lit(1), hi - lo) * 100
    return F.least(F.lit(100), raw.cast("int"))


def tier_points_to_next(points) -> Column:
    """UI variant: points left to the next tier, 0 at the top tier."""
    p = _c(points)
    top_floor = LEVEL_TIERS[0][1]
    return F.when(p >= top_floor, F.lit(0)).otherwise(F.greatest(F.lit(0), tier_ceiling(p) - p))


def tier_progress_pct_rounded(points) -> Column:
    """UI variant: half-up rounded percentage, 100 at the top tier."""
    p = _c(points)
    top_floor = LEVEL_TIERS[0][1]
    lo, hi = tier_floor(p), tier_ceiling(p)
    pct = F.floor((p - lo) / (hi - lo) * 100 + 0.5)
    return F.when(p >= top_floor, F.lit(100)).otherwise(
        F.least(F.lit(100), F.greatest(F.lit(0), pct)).cast("int"))


def difficulty(points) -> Column:
    p = _c(points)
    expr = None
    for name, floor in DIFFICULTY_TIERS[:-1]:
        expr = F.when(p >= floor, F.lit(name)) if expr is None else expr.when(p >= floor, F.lit(name))
    return expr.otherwise(F.lit(DIFFICULTY_TIERS[-1][0]))


def monday_week(ts) -> Column:
    """Start date of the Monday-based week containing ``ts``."""
    return F.date_trunc("WEEK", _c(ts)).cast("date")


def month_start(d) -> Column:
    return F.trunc(_c(d).cast("date"), "MM")


def saturday_week_start(d) -> Column:
    """Start of the Saturday-based leaderboard week containing date ``d``."""
    d = _c(d).cast("date")
    return F.date_sub(d, F.dayofweek(d) % 7)


def slugify(text) -> Column:
    """Lower-case, runs of non [a-z0-9] become '-', no leading/trailing '-'."""
    s = F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def sanitize_identifier(text) -> Column:
    """Safe identifier fragment: runs of non-alnum → '_', trimmed, empty → 'x'."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(_c(text), F.lit("")))), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("x"))


def csv_safe(value) -> Column:
    """Prefix a quote to cells that a spreadsheet would run as a formula."""
    s = F.coalesce(_c(value).cast("string"), F.lit(""))
    risky = F.substring(s, 1, 1).isin(*CSV_FORMULA_PREFIXES)
    return F.when(risky, F.concat(F.lit("'"), s)).otherwise(s)


def iso_ts(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def first_nonblank(*cols) -> Column:
    """Python ``a or b or c`` over strings: empty and NULL both fall through."""
    return F.coalesce(*[F.nullif(_c(c).cast("string"), F.lit("")) for c in cols])


def base_points_key(event_id, task_id, team_id, workspace_id, rule="base") -> Column:
    """Idempotency key of a task award.

    Workspace scope wins (``{ws}:{event}:{task}:{rule}``), else team scope
    (``team:{team|noteam}:{event}:{task}:{rule}``); the prefixes keep the two
    keyspaces apart.
    """
    ws = F.nullif(_c(workspace_id).cast("string"), F.lit(""))
    team = F.coalesce(F.nullif(_c(team_id).cast("string"), F.lit("")), F.lit("noteam"))
    return F.when(ws.isNotNull(), F.concat_ws(":", ws, _c(event_id).cast("string"), _c(task_id).cast("string"), F.lit(rule))) \
        .otherwise(F.concat_ws(":", F.lit("team"), team, _c(event_id).cast("string"), _c(task_id).cast("string"), F.lit(rule)))


def hint_penalty_key(event_id, hint_id, team_id, workspace_id) -> Column:
    """Once-only key of a hint charge: ``{ws}:{event}:{hint}:hint`` or ``hint:{team|noteam}:{event}:{hint}``."""
    ws = F.nullif(_c(workspace_id).cast("string"), F.lit(""))
    team = F.coalesce(F.nullif(_c(team_id).cast("string"), F.lit("")), F.lit("noteam"))
    return F.when(ws.isNotNull(), F.concat_ws(":", ws, _c(event_id).cast("string"), _c(hint_id).cast("string"), F.lit("hint"))) \
        .otherwise(F.concat_ws(":", F.lit("hint"), team, _c(event_id).cast("string"), _c(hint_id).cast("string")))


def mission_message(points, mission_name) -> Column:
    return F.concat(F.lit("You earned "), _c(points).cast("string"),
                    F.lit(" points for completing "), _c(mission_name), F.lit("!"))
