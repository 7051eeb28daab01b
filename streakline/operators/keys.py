"""Key-based operators: latest-per-key, first-per-key and the MERGE family.

MERGE is not available on plain parquet, so the upsert operators return the
new target as a DataFrame built from anti/semi joins and unions; the caller
writes it to a new versioned path (never over the path it reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order_cols: list[str], latest: bool) -> DataFrame:
    """Row with the largest (latest=True) or smallest ordering tuple per key.

    Written as an aggregate (``max_by``/``min_by`` over a struct of the row)
    rather than ``row_number`` over a window: the aggregate combines map-side,
    so a key holding a third of all rows is reduced inside each input task
    instead of being sorted whole in one task. Ties in ``order_cols`` are broken
    by the remaining columns, which makes the pick deterministic.
    """
    others = [c for c in df.columns if c not in keys]
    tie = [c for c in others if c not in order_cols]
    order = F.struct(*[F.col(c) for c in order_cols + tie])
    row = F.struct(*[F.col(c) for c in others])
    agg = F.max_by(row, order) if latest else F.min_by(row, order)
    return df.groupBy(*keys).agg(agg.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """WI-1: latest version per key (largest ``order_cols``)."""
    return _pick(df, keys, order_cols, latest=True)


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """WI-6 / TK-6: earliest row per key (smallest ``order_cols``)."""
    return _pick(df, keys, order_cols, latest=False)


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """UP-1/2/3/7: rows of ``source`` whose key is not in ``target``.

    Same as ``MERGE ... WHEN NOT MATCHED THEN INSERT``: NULL keys never match, so
    they are always new. Returns only the new rows; append them to the target.
    """
    # No distinct on the target keys: duplicates on the right never change an
    # anti-join's result, and de-duplicating would cost a shuffle of its own.
    return source.join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """UP-4: ``UPDATE SET * / INSERT *`` — source rows win, other target rows stay."""
    kept = target.join(source.select(*keys), keys, "left_anti")
    return source.select(*target.columns).unionByName(kept)


def update_changed(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str],
                   stamp_col: str | None = None, stamp=None) -> DataFrame:
    """UP-5: update ``cols`` where the matched source value differs; others untouched."""
    s = source.select(*keys, *[F.col(c).alias(f"_src_{c}") for c in cols])
    j = target.join(s, keys, "left")
    changed = None
    for c in cols:
        diff = F.col(f"_src_{c}").isNotNull() & (F.col(c) != F.col(f"_src_{c}"))
        changed = diff if changed is None else (changed | diff)
    out = j
    for c in cols:
        out = out.withColumn(c, F.when(changed, F.col(f"_src_{c}").cast(target.schema[c].dataType))
                             .otherwise(F.col(c)))
    if stamp_col:
        out = out.withColumn(stamp_col, F.when(changed, stamp).otherwise(F.col(stamp_col)))
    return out.select(*target.columns)


def partial_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """UP-11/12: upsert keeping the old value wherever the new one is NULL."""
    cols = [c for c in target.columns if c not in keys]
    s = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols if c in source.columns])
    j = target.join(s, keys, "full")
    out = j.select(*keys, *[
        (F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in source.columns else F.col(c)).alias(c)
        for c in cols])
    return out.select(*target.columns)


def sweep(df: DataFrame, keep) -> DataFrame:
    """UP-6: keep only rows satisfying ``keep`` (a NULL predicate drops the row)."""
    return df.filter(keep)
