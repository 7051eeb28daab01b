"""Ranking operators (WI-4, WI-5, WI-9, TK-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sort_exprs(order: list[Column | str]) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in order]


def global_row_number(df: DataFrame, order: list[Column | str], name: str,
                      partitions: int | None = None) -> DataFrame:
    """WI-5: dense 1..N row numbers over the whole frame, without a single-partition sort.

    ``row_number() OVER (ORDER BY ...)`` moves every row into one task. Here
    the frame is range-partitioned on the sort key (sampled bounds, so each
    task gets a contiguous slice), sorted within partitions, numbered locally
    with ``monotonically_increasing_id`` (partition id in the upper bits, row
    position in the lower bits), and shifted by the row counts of all earlier
    partitions. Those counts are one row per partition — bounded by the
    partition count, not by the data — and are broadcast back.

    ``order`` must end in a unique column so numbers are deterministic.
    """
    sort = _sort_exprs(order)
    # Without an explicit count AQE may coalesce neighbouring ranges, which
    # keeps them contiguous, so partition order is still the sort order.
    ranged = (df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)) \
        .sortWithinPartitions(*sort)
    local = ranged.withColumn("_pid", F.spark_partition_id()) \
        .withColumn("_mid", F.monotonically_increasing_id())
    local = local.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33) + 1)
    # The numbered slice feeds both the per-partition counts and the final
    # join; write it once so the range sort is not run twice.
    from ..session import materialize
    local = materialize(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = local.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_local")).cast("int")) \
        .drop("_pid", "_mid", "_local", "_off")


def window_row_number(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Single-window variant of :func:`global_row_number` (one task; small inputs only)."""
    w = Window.orderBy(*_sort_exprs(order))
    return df.withColumn(name, F.row_number().over(w).cast("int"))


def partition_rank(df: DataFrame, partition: list[str], order: list[Column | str], name: str = "rank",
                   method: str = "rank") -> DataFrame:
    """WI-4: ``RANK() OVER (PARTITION BY ... ORDER BY ...)``.

    Used on pre-aggregated inputs (one row per team or task), so a partition
    holds one event's teams, not its raw events.
    """
    w = Window.partitionBy(*partition).orderBy(*_sort_exprs(order))
    fn = {"rank": F.rank, "row_number": F.row_number, "dense_rank": F.dense_rank}[method]
    return df.withColumn(name, fn().over(w).cast("int"))


def top_k(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """TK-*: ordered top-k (planned as TakeOrderedAndProject: per-task top-k, then merge)."""
    return df.orderBy(*_sort_exprs(order)).limit(k)


def top_k_per_group(df: DataFrame, partition: list[str], order: list[Column | str], k: int,
                    name: str = "rn") -> DataFrame:
    """Top-k per group; the ``rn <= k`` filter lets Spark plan a WindowGroupLimit."""
    w = Window.partitionBy(*partition).orderBy(*_sort_exprs(order))
    top = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return top.withColumn(name, F.col(name).cast("long"))
