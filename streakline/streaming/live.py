"""Structured Streaming versions of the scoring jobs (ST-1..6).

Every stream reads files incrementally and writes, batch by batch, what the
batch adds: partial counts of a week, pieces of a session, first attempts of a
key (:class:`StreamState`). Partials of all batches merge when the output is
read. Merging does not depend on order, so rows that come late, in any order and
in any split into increments, give the rows of the batch job, and nothing is
dropped by event time. The streams hold no operator state; what they keep is in
the output table, and ``compact`` folds it to one row a key.

An output and its checkpoint live under one path, so a second call on that path
goes on where the first ended. A micro-batch replayed after a failure overwrites
its own partition instead of adding a second copy.

* ST-1 ``award_stream``: exactly-once awards, the earliest attempt a key.
* ST-2 ``team_totals``, ``team_totals_stream``: per-team totals of the ledger.
* ST-3 ``weekly_query_missions_stream``: Monday weeks with thresholds.
* ST-4 ``weekly_consumption_stream``: weekly consumption points.
* ST-5 ``activity_sessions_stream``: sessions by gap.

The calls drive a stream to the end of its input (a scheduled catch-up run).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import exprs as X
from ..operators import detect as D
from ..operators import event as E
from ..operators.keys import first_per_key
from ..operators.ranking import partition_rank
from ..session import shared_path
from ..sources import standins as S
from ..sources.tables import Tables, table_path
from ..versions import VersionedTables

def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Incremental reader over a table's files (schema taken from the batch reader)."""
    path = table_path(sf_dir, name)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")


def file_stream(spark: SparkSession, sf_dir: str, name: str, files: str | None) -> tuple[DataFrame, str]:
    """Table ``name`` as a stream, and the path it reads; ``files``: a folder of its rows' files instead."""
    if files is None:
        return stream_table(spark, sf_dir, name), table_path(sf_dir, name)
    return spark.readStream.schema(spark.read.parquet(table_path(sf_dir, name)).schema).parquet(files), files


class StreamState:
    """Output and checkpoint of one stream, under one path (a new folder by default).

    Each source path that feeds the output has a checkpoint and a writer's mark of
    its own, so batch numbers of two sources may meet. A ``checkpoint`` elsewhere
    is one more writer; it reads a source again, which outputs that keep one row a
    key (awards) take, and sums do not.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, checkpoint: str | None = None):
        self.spark = spark
        self.path = (path or shared_path(spark, "streams", uuid.uuid4().hex)).rstrip("/")
        self.parts = f"{self.path}/parts"
        self.checkpoint = checkpoint or f"{self.path}/_checkpoint"
        self.folded = VersionedTables(spark, f"{self.path}/_folded")

    def run(self, stream: DataFrame, source: str, partial: Callable[[DataFrame], DataFrame]) -> None:
        """Take in all new input of ``stream`` from ``source``; ``partial`` makes a batch's rows of the output."""
        of_source = hashlib.sha256(source.rstrip("/").encode()).hexdigest()[:16]
        writer = "w" + hashlib.sha256(f"{self.checkpoint} {of_source}".encode()).hexdigest()[:16]

        def write(batch: DataFrame, batch_id: int) -> None:
            (partial(batch).withColumn("writer", F.lit(writer)).withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("writer", "batch_id").parquet(self.parts))

        q = (stream.writeStream.queryName(f"s{uuid.uuid4().hex[:12]}")
             .option("checkpointLocation", f"{self.checkpoint}/{of_source}")
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()

    def _parts(self) -> DataFrame:
        p = self.spark.read.parquet(self.parts)
        return p.withColumn("writer", F.col("writer").cast("string")).withColumn("batch_id", F.col("batch_id").cast("long"))

    def _later(self) -> DataFrame:
        parts = self._parts()
        upto = self.folded.read("upto")
        if upto is None:
            return parts
        # a row a writer
        return parts.join(F.broadcast(upto), "writer", "left").filter(
            F.col("upto").isNull() | (F.col("batch_id") > F.col("upto"))).drop("upto")

    def rows(self) -> DataFrame:
        """Partial rows of all batches: the folded ones and those of later batches."""
        later = self._later().drop("writer", "batch_id")
        base = self.folded.read("rows")
        return later if base is None else base.unionByName(later)

    def compact(self, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Fold all batches so far to merged rows, as one version; later batches add to them."""
        seen = self._parts().groupBy("writer").agg(F.max("batch_id").alias("upto"))
        self.folded.commit({"rows": merge(self.rows()), "upto": seen})


# ----------------------------- ST-3 / ST-4 ----------------------------------

def _query_batch(events: DataFrame, clock: D.Clock) -> DataFrame:
    e = events.select(S.principal("user_id").alias("user_id"),
                      S.statement_type().alias("statement_type"), F.col("ts").cast("timestamp").alias("start_time"))
    e = e.filter(D.nonblank("user_id") & F.col("statement_type").isin(*R.COUNTED_STATEMENT_TYPES)
                 & (F.col("start_time") >= clock.since()))
    return e.groupBy("user_id", X.monday_week("start_time").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.max("start_time").alias("last_at"))


def merge_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "week").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


def weekly_query_missions_stream(spark: SparkSession, sf_dir: str, clock: D.Clock, run_ts: str,
                                 thresholds: R.Thresholds | None = None, state: StreamState | None = None,
                                 files: str | None = None) -> DataFrame:
    """ST-3: weekly threshold missions of all statements taken in so far."""
    th, state = thresholds or R.Thresholds(), state or StreamState(spark)
    state.run(*file_stream(spark, sf_dir, "events", files), lambda b: _query_batch(b, clock))
    w = merge_counts(state.rows())
    return D._union([D._emit(w.filter(F.col("n") >= th.query[m]), m, run_ts, F.col("last_at"), F.col("week"),
                             F.date_add(F.col("week"), 6)) for m, _ in R.QUERY_RULES])


def _usage_batch(events: DataFrame, clock: D.Clock) -> DataFrame:
    u = events.select(S.principal("user_id").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("value").alias("qty"))
    u = u.filter(D.nonblank("user_id") & (F.col("qty") > 0)
                 & (F.col("ts").cast("date") >= clock.since(R.CONSUMPTION_LOOKBACK_DAYS)))
    return u.groupBy("user_id", X.monday_week("ts").alias("week")).agg(
        F.sum(F.col("qty").cast("decimal(18,2)")).cast("decimal(28,2)").alias("qty"), F.max("ts").alias("last_at"))


def merge_usage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "week").agg(F.sum("qty").cast("decimal(28,2)").alias("qty"),
                                               F.max("last_at").alias("last_at"))


def weekly_consumption_stream(spark: SparkSession, sf_dir: str, clock: D.Clock, run_ts: str,
                              state: StreamState | None = None, files: str | None = None) -> DataFrame:
    """ST-4: weekly consumption points of all usage taken in so far."""
    state = state or StreamState(spark)
    state.run(*file_stream(spark, sf_dir, "events", files), lambda b: _usage_batch(b, clock))
    w = merge_usage(state.rows()).filter(F.col("qty") >= R.CONSUMPTION_UNITS_PER_POINT)
    return w.select(
        "user_id", F.lit("consumption").alias("event_type"), F.lit("weekly_dbu").alias("mission_id"),
        F.floor(F.col("qty") / R.CONSUMPTION_UNITS_PER_POINT).cast("int").alias("points"),
        F.concat(F.lit("Weekly compute: "), F.round(F.col("qty"), 1).cast("string"), F.lit(" DBUs")).alias("reason"),
        F.col("last_at").cast("date").cast("timestamp").alias("event_timestamp"),
        D.run_ts_col(run_ts).alias("scored_at"))


# ----------------------------- ST-1 / ST-2 ----------------------------------

def award_candidate_stream(spark: SparkSession, sf_dir: str, attempt_files: str | None = None) -> DataFrame:
    """Attempt stream (lineitem files) joined to static dimensions → award candidates."""
    t = Tables(spark, sf_dir)
    src, _ = file_stream(spark, sf_dir, "lineitem", attempt_files)
    li = src.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_shipdate")
    o = t.get("orders", ["o_orderkey", "o_custkey"])
    p = S.participants(t).select("participant_id", "user_id", "event_id", "team_id", "workspace_id")
    a = li.join(o, li.l_orderkey == o.o_orderkey).join(p, F.col("o_custkey") == p.participant_id)
    v1 = F.when(F.col("l_returnflag") == "A", 2).otherwise(4)
    v2 = (F.when(F.col("l_tax") == S.ERROR_TAX, 5).when(F.col("l_discount") >= S.PASS_DISCOUNT, 2).otherwise(4))
    sev = F.when(F.col("l_quantity") == S.NO_RESULT_QUANTITY, F.lit(5)).otherwise(F.greatest(v1, v2))
    a = a.select(
        S.attempt_id().alias("attempt_id"),
        "event_id", F.when(F.col("workspace_id").isNull(), F.col("team_id")).alias("team_id"), "workspace_id",
        "user_id", F.col("l_suppkey").alias("task_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.when(sev == 2, "passed").when(sev == 4, "failed").otherwise("error").alias("status"))
    return E.award_candidates(a, S.tasks(t))


AWARD_ORDER = ["created_at", "candidate_id"]


def merge_awards(rows: DataFrame) -> DataFrame:
    """Of each idempotency key the earliest attempt."""
    return first_per_key(rows, ["idempotency_key"], AWARD_ORDER)


def award_stream(spark: SparkSession, sf_dir: str, ledger_path: str | None = None,
                 attempt_files: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, str]:
    """ST-1: exactly-once base-point awards; returns (ledger rows, ledger path).

    A batch adds its earliest attempt a key; the ledger is the earliest of all
    batches, so a key is awarded once whatever repeats, and a late attempt that
    is earlier supersedes the one before it. A second call on a ledger reads the
    files that are new to its checkpoint.
    """
    state = StreamState(spark, ledger_path, checkpoint)
    state.run(award_candidate_stream(spark, sf_dir, attempt_files), attempt_files or table_path(sf_dir, "lineitem"),
              lambda b: merge_awards(b.select(*E.LEDGER_COLS, "candidate_id")))
    return read_ledger(spark, state.path), state.path


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    """The award stream's ledger: of each key the earliest attempt that was written."""
    return merge_awards(StreamState(spark, ledger_path).rows()).select(*E.LEDGER_COLS)


def team_totals(spark: SparkSession, ledger_path: str, identity_map: DataFrame) -> DataFrame:
    """ST-2: ranked totals per (event, team) of the ledger as it stands; federated awards go to the mapped team."""
    return partition_rank(E.team_scores(read_ledger(spark, ledger_path), identity_map), ["event_id"],
                          [F.col("total_points").desc(), F.col("last_scored_at").asc_nulls_last()], "rank")


def team_totals_stream(spark: SparkSession, ledger_path: str, identity_map: DataFrame,
                       out: VersionedTables) -> DataFrame:
    """ST-2: totals kept up with the ledger: new ledger files make a new version of ``out``'s totals."""
    parts = StreamState(spark, ledger_path).parts

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            out.commit({"totals": team_totals(spark, ledger_path, identity_map)})

    q = (spark.readStream.schema(spark.read.parquet(parts).schema).parquet(parts).writeStream
         .queryName(f"s{uuid.uuid4().hex[:12]}").option("checkpointLocation", f"{out.path}/_checkpoint")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return out.read("totals")


# ----------------------------- ST-5 -----------------------------------------

def merge_sessions(rows: DataFrame) -> DataFrame:
    """Sessions that overlap are one; a session ends ``gap`` after its last event and takes no event at its end."""
    w = Window.partitionBy("user_id").orderBy("session_start", "session_end")
    before = F.max("session_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    j = rows.withColumn("_new", F.when(before.isNull() | (F.col("session_start") >= before), 1).otherwise(0))
    j = j.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return j.groupBy("user_id", "_no").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("events").alias("events")).drop("_no")


def activity_sessions_stream(spark: SparkSession, sf_dir: str, gap: str = "1 day", state: StreamState | None = None,
                             files: str | None = None) -> DataFrame:
    """ST-5: per-user activity sessions (events closer than ``gap`` merge) of all events taken in so far.

    A batch adds the sessions within it, one row each, so a user who sends a
    third of all events adds a few rows; an event that comes late and lies
    between two sessions joins them.
    """
    state = state or StreamState(spark)
    state.run(*file_stream(spark, sf_dir, "events", files), lambda b: b.select(
        S.principal("user_id").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
        .groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"))
    return merge_sessions(state.rows())
