"""SparkSession construction and shared-folder helpers.

Every job in the package runs on whatever session the caller hands in; this
module only builds one for tests, the bench and command-line use, with the
settings the plans rely on (UTC clock, AQE, no UI).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner can prove small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Checkpoint files of a run are removed once their DataFrames are unreachable.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
# Applied only when this process launches the JVM (local mode, tests, bench).
LOCAL_CONF = {
    "spark.driver.memory": "16g",
    "spark.sql.shuffle.partitions": "8",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "streakline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        conf.update(LOCAL_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared folder and is used as is. Only
    when it is unset (local tests) a scratch folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="streakline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the session's shared checkpoint folder (for written tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def materialize(df):
    """Cut lineage at a reuse point: a reliable checkpoint in the shared folder.

    Used where one intermediate feeds several consumers (the daily usage
    aggregate, the completions, the per-user totals), so each consumer reads
    the written rows instead of recomputing the upstream plan, and a lost
    executor re-reads files instead of replaying the whole run.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if os.environ.get("STREAKLINE_TRACE"):
        import time
        t = time.time()
        out = df.checkpoint(eager=True)
        print(f"[materialize] {time.time() - t:.2f}s cols={len(df.columns)}", flush=True)
        return out
    return df.checkpoint(eager=True)


def written(df, name: str):
    """Cut lineage like :func:`materialize`, as a compressed Parquet table that is read by columns.

    For large intermediates of which most consumers need a few columns.
    """
    path = shared_path(df.sparkSession, "streakline-written", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
