"""Live message log: exactly-once ingest, room sequences, one event per room and batch, outbox.

A store is a folder of Parquet files, one ``batch=<n>`` folder per micro-batch. A replayed batch
overwrites its own folder, so a restart neither loses nor repeats anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rillwork.operators import messages as M
from rillwork.session import cut

MESSAGE = "id string, room string, sender string, ts bigint, kind string, text string, via string, stored_at bigint"


def _read(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The store as it was before batch ``before``. Only at batch 0 may its folder be missing: then None.

    Anything else that keeps a store from being read is an error, never an empty store.
    """
    try:
        df = spark.read.parquet(path)
    except AnalysisException as gone:
        if before == 0 and gone.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return df if before is None else df.filter(F.col("batch") < before)


def _write(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest(
    stream: DataFrame, store: str, rejected: str, events: str, checkpoint: str, watermark: str | None = None, chunk: int = 1000
):
    """Start the ingest; returns the streaming query.

    Every batch is checked against the store, so a copy is found however late it comes, and goes to the
    audit; nothing is dropped before that. ``watermark`` only sets the event-time progress of column
    ``at`` for whatever follows in the same query.
    """
    if watermark:
        stream = stream.withWatermark("at", watermark)

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.drop("at") if "at" in batch.columns else batch)
        old = _read(spark, store, before=n)
        accepted, copies = M.append(old.select("id", "room", "seq") if old is not None else None, rows)
        accepted = cut(accepted)
        _write(accepted, store, n)
        _write(copies, rejected, n)
        _write(M.fan_out(accepted, chunk), events, n)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain_outbox(stream: DataFrame, audit: str, checkpoint: str):
    """Copy new outbox events to the append-only audit table, each once, in creation order."""

    def run(batch: DataFrame, n: int) -> None:
        old = _read(batch.sparkSession, audit, before=n)
        new = M.first_arrivals(batch, "id", ["created_at"])
        if old is not None:
            new = new.join(old.select("id"), "id", "left_anti")
        _write(new.sortWithinPartitions("created_at", "id"), audit, n)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_latest(stream: DataFrame, key: list[str], version: str, target: str, checkpoint: str):
    """Nightly refresh: fold new rows into a keep-latest table, one version folder per batch."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = _read(spark, f"{target}/v={n - 1}") if n else None
        new = batch if old is None else M.upsert(old, batch, key, version)
        if old is None:
            new = M.upsert(batch.limit(0), batch, key, version)
        new.write.mode("overwrite").parquet(f"{target}/v={n}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
