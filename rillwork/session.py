"""Session defaults and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rillwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; anything passed in wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the session names; on a local master without one, a scratch folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and drop its lineage.

    The data goes to the shared checkpoint folder, so losing an executor in a later
    round costs a re-read, not a replay of every earlier round.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_sized(df: DataFrame) -> DataFrame:
    """``cut`` for rounds of joins: the result has the size of its rows, not an estimate.

    A checkpoint keeps the estimate of the plan it came from, and a join's is the product of both sides. Over rounds
    that join a table with itself the digits of the estimate double each time, and planning soon takes longer
    than the job, however few rows there are. Stored rows have a measured size, which the checkpoint then keeps.
    """
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    before = conf.get(name)
    conf.set(name, "true")  # else a handful of rows is stored in as many partitions as a shuffle has
    try:
        stored = df.persist(StorageLevel.DISK_ONLY)
    finally:
        conf.set(name, before)
    try:
        stored.count()
        return cut(stored)
    finally:
        stored.unpersist()


def attach(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one row per key onto ``df``.

    How to join is left to adaptive execution: it knows the size of ``facts`` once they are computed,
    broadcasts them below ``spark.sql.autoBroadcastJoinThreshold``, and splits skewed keys otherwise.
    """
    return df.join(facts, list(keys), how)
