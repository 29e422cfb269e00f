"""Registry of runnable queries and the readings of the driver tables they work on.

Each query is registered with the SQL that must give the same rows; queries without a SQL
twin are checked against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts) -> F.Column:
    """Microseconds since the epoch, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


DAY = 86_400_000_000


def records(spark: SparkSession, folder: str, naming: str = "load") -> DataFrame:
    """``events`` read as request records: one run per day, ``t`` = seconds into the day."""
    e = table(spark, folder, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    d = F.dayofmonth(ts)
    if naming == "load":
        run = F.concat(
            F.lit("L"), 1 + d % 3, F.lit("_c"), 25 * (1 + d % 2), F.lit("_rep"), d.cast("string")
        )
    else:
        level = F.when(F.hour(ts) < 12, "THR").otherwise("THRLOW")
        run = F.concat(level, F.lit("_t0."), 15 + 5 * (d % 4), F.lit("_rep"), d.cast("string"))
    is_err = F.col("event_type") == "error"
    slow = F.col("value") > 100
    return e.select(
        run.alias("run_id"),
        ((micros(F.col("ts")) % DAY) / F.lit(1e6)).alias("t"),
        F.col("value").alias("ms"),
        F.when(is_err, 500).otherwise(200).alias("status"),
        F.concat(F.lit("sys"), (2 + F.col("user_id") % 3).cast("string")).alias("backend"),
        F.when(is_err & slow, "timeout").otherwise("").alias("err"),
        (1 + F.floor(F.hour(ts) / 8)).cast("int").alias("active"),
        (F.col("event_type") == "signup").alias("dup"),
        F.when(slow, 2).otherwise(1).alias("attempts"),
        F.when(F.col("event_type").isin("click", "purchase"), "send").otherwise("feed").alias("kind"),
    )


_RUN = {
    "load": "'L'||(1+day(ts)%3)||'_c'||(25*(1+day(ts)%2))||'_rep'||day(ts)",
    "sweep": "CASE WHEN hour(ts)<12 THEN 'THR' ELSE 'THRLOW' END||'_t0.'||(15+5*(day(ts)%4))||'_rep'||day(ts)",
}


def records_sql(naming: str = "load") -> str:
    """The SQL spelling of :func:`records`, as a CTE body named ``rec``."""
    return f"""rec AS (SELECT {_RUN[naming]} AS run_id,
      (epoch_us(ts) % {DAY}) / 1e6 AS t, value AS ms,
      CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status,
      'sys'||(2+user_id%3) AS backend,
      CASE WHEN event_type='error' AND value>100 THEN 'timeout' ELSE '' END AS err,
      CAST(1+hour(ts)//8 AS INTEGER) AS active, event_type='signup' AS dup,
      CASE WHEN value>100 THEN 2 ELSE 1 END AS attempts,
      CASE WHEN event_type IN ('click','purchase') THEN 'send' ELSE 'feed' END AS kind
    FROM events)"""
