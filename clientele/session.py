"""Spark session defaults and the shared scratch location.

The library never creates a session on its own inside an operator; these helpers are for
scripts, tests and the bench. On a cluster the session comes from the job submitter and
``spark.checkpoint.dir`` names a shared folder; only when it is unset (local tests) do we
create one.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from measured shuffle sizes (broadcast
# only what it measured to be small), splits skewed join partitions, and coalesces tiny
# post-shuffle partitions. The UI stays off (no server).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "clientele") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CLIENTELE_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and checkpoints.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset (local runs and
    tests) a fresh local folder is created and registered as the checkpoint dir.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="clientele-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the scratch folder (one per call, never reused)."""
    base = scratch_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Reliable checkpoint of ``df`` into the shared checkpoint folder (eager).

    Used where one expensive intermediate feeds several branches of a plan (e.g. the
    collapsed sessions feed the as-of match, the join back and the entropies): it is
    computed once, and a lost executor re-reads files instead of recomputing the lineage.
    Never a local checkpoint.
    """
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
