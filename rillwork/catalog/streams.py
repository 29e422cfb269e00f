"""Streaming jobs run over the driver tables to the end, each checked against its batch twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rillwork.catalog import climate as CC
from rillwork.catalog import messages as CM
from rillwork.catalog import runs as CR
from rillwork.catalog.base import micros, query, records, records_sql, table
from rillwork.catalog.climate import rnd
from rillwork.functions import hydro as H
from rillwork.session import ensure_checkpoint_dir
from rillwork.streaming import messages as SM
from rillwork.streaming import runs as SR


def folder(spark, name):
    """A new folder for one run, beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


FILES = 4


def replay(spark, df, name, order, parts=3):
    """Write a table in ``parts`` steps of growing ``order`` and stream it, a step per micro-batch.

    Every step is ``FILES`` files, so neither the writing nor a batch hangs on one task.
    """
    path = folder(spark, name)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    at = F.col(order) if not hasattr(lo, "year") else F.unix_seconds(F.col(order).cast("timestamp"))
    a, b = (float(x) if not hasattr(x, "year") else None for x in (lo, hi))
    if a is None:
        a, b = (float(x) for x in df.agg(F.min(at), F.max(at)).first())
    step = F.least(F.floor((at - a) / ((b - a) / parts)), F.lit(parts - 1))
    for i in range(parts):
        df.filter(step == i).repartition(FILES).write.mode("append").parquet(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("maxFilesPerTrigger", FILES).parquet(path)


def run(spark, stream, name, mode="append"):
    """Drive a stream to its end and read what it wrote."""
    out = folder(spark, name)
    SR.run_to_folder(stream, out, folder(spark, name + "-cp"), mode).awaitTermination()
    return spark.read.parquet(out)


@query("stream_ingest", f"WITH {CM.INC} SELECT id, room, via, seq FROM st")
def stream_ingest(spark, d):
    """Messages arrive in three files by time; ids, arrivals and sequences equal the batch append."""
    stream = replay(spark, CM.incoming(spark, d), "incoming", "stored_at")
    store, dup, ev = (folder(spark, n) for n in ("store", "rejected", "events"))
    SM.ingest(stream, store, dup, ev, folder(spark, "ingest-cp")).awaitTermination()
    return spark.read.parquet(store).select("id", "room", "via", "seq")


@query("stream_rejections", f"WITH {CM.INC} SELECT room, count(*) AS n FROM rk WHERE k>1 GROUP BY 1")
def stream_rejections(spark, d):
    stream = replay(spark, CM.incoming(spark, d), "incoming", "stored_at")
    store, dup, ev = (folder(spark, n) for n in ("store", "rejected", "events"))
    SM.ingest(stream, store, dup, ev, folder(spark, "ingest-cp")).awaitTermination()
    return spark.read.parquet(dup).groupBy("room").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_request_buckets",
    """SELECT 'L'||(1+day(ts)%3)||'_c'||(25*(1+day(ts)%2))||'_rep'||day(ts) AS run_id, epoch_us(ts)//5000000*5 AS t, count(*) AS requests, count(*) FILTER (event_type<>'error') AS ok,
    count(*) FILTER (event_type='error') AS errors, round(avg(value) FILTER (event_type<>'error'),6) AS mean FROM events GROUP BY 1,2""",
)
def stream_request_buckets(spark, d):
    day = F.dayofmonth(F.col("ts").cast("timestamp_ntz"))
    run_id = F.concat(F.lit("L"), 1 + day % 3, F.lit("_c"), 25 * (1 + day % 2), F.lit("_rep"), day.cast("string"))
    r = table(spark, d, "events").select(
        F.timestamp_micros(micros(F.col("ts"))).alias("at"), run_id.alias("run_id"), F.col("value").alias("ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )
    stream = SR.request_buckets(replay(spark, r, "requests", "at"), "5 seconds", "2 days")
    got = run(spark, stream, "buckets", "update")
    # a window updated by a later batch replaces its earlier row
    rest = [c for c in got.columns if c not in ("run_id", "start", "batch")]
    last = got.groupBy("run_id", "start").agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select("run_id", "start", "_l.*")
    return last.select("run_id", F.unix_seconds("start").alias("t"), "requests", "ok", "errors", F.round("mean", 6).alias("mean"))


@query(
    "stream_counter_rate",
    f"""WITH {CR._SMP}, l AS (SELECT *, lag(t) OVER w AS t0, lag(usage) OVER w AS u0 FROM smp WINDOW w AS (PARTITION BY run_id,system ORDER BY t))
    SELECT run_id, system, t, round(greatest(0.0, least(800.0, (usage-u0)/(t-t0)/2*100)),6) AS cpu_pct FROM l WHERE t0 IS NOT NULL AND t>t0""",
)
def stream_counter_rate(spark, d):
    s = CR.samples(spark, d).select("run_id", "system", "t", "usage")
    got = run(spark, SR.counter_rates(replay(spark, s, "samples", "t"), 2.0, 800.0), "rates").filter("not late")
    return got.select("run_id", "system", "t", F.round("cpu_pct", 6).alias("cpu_pct"))


@query(
    "stream_backend_metrics",
    f"""WITH {records_sql()}, o AS (SELECT backend, ms, row_number() OVER (PARTITION BY backend ORDER BY CAST(regexp_extract(run_id,'rep(\\d+)$',1) AS INTEGER)*86400+t) AS i,
      count(*) OVER (PARTITION BY backend) AS n FROM rec),
    a AS (SELECT backend, max(n) AS n, sum(ms*pow(0.8::DOUBLE,n-i)*CASE WHEN i=1 THEN 1 ELSE 0.2::DOUBLE END) AS ewma, list_sort(list(ms) FILTER (i>n-500)) AS l FROM o GROUP BY 1)
    SELECT backend, n, round(ewma,4) AS ewma, {", ".join(f"round(l[1+least(len(l)-1, CAST(floor({p / 100!r}::DOUBLE*len(l)) AS BIGINT))],4) AS p{p}" for p in (50, 95, 99))} FROM a""",
)
def stream_backend_metrics(spark, d):
    r = records(spark, d).select("backend", "ms", (F.regexp_extract("run_id", r"rep(\d+)$", 1).cast("int") * 86400 + F.col("t")).alias("t"))
    got = run(spark, SR.backend_metrics(replay(spark, r, "metrics", "t")), "metrics-out", "update")
    last = got.groupBy("backend").agg(F.max_by(F.struct("n", "ewma", "p50", "p95", "p99"), "batch").alias("l"))
    return rnd(last.select("backend", "l.*"), 4)


@query(
    "stream_health_events",
    f"""WITH RECURSIVE {records_sql()}, pr AS (SELECT run_id AS pool, t, backend, CAST(substr(backend,4) AS INTEGER)-1 AS k, ms*10>1500 OR ms/4>=95 AS slow,
      CASE WHEN status=200 THEN 'ok' WHEN err='timeout' THEN 'timeout' ELSE 'refused' END AS o, row_number() OVER (PARTITION BY run_id ORDER BY t, backend) AS i FROM rec),
    w AS (SELECT pool, 0::BIGINT AS i, [NULL,NULL,NULL]::VARCHAR[] AS st, [0,0,0]::BIGINT[] AS f, [0,0,0]::BIGINT[] AS b, NULL::DOUBLE AS t, NULL::VARCHAR AS backend, NULL::VARCHAR AS event, NULL::VARCHAR AS state
        FROM (SELECT DISTINCT pool FROM pr) UNION ALL
      SELECT pool, i, list_transform([1,2,3], lambda j: CASE WHEN j=k THEN state ELSE st[j] END), list_transform([1,2,3], lambda j: CASE WHEN j=k THEN nf ELSE f[j] END),
        list_transform([1,2,3], lambda j: CASE WHEN j=k THEN nb ELSE b[j] END), t, backend, event, state
      FROM (SELECT *, CASE event WHEN 'ejected' THEN 'DOWN' WHEN 'degraded' THEN 'DEGRADED' WHEN 'recovered' THEN 'UP' WHEN 'readmitted' THEN CASE WHEN slow THEN 'DEGRADED' ELSE 'UP' END ELSE s END AS state
      FROM (SELECT *, CASE WHEN o='ok' AND s='DOWN' AND nf>=2 THEN 'readmitted' WHEN o='ok' AND s='UP' AND slow THEN 'degraded' WHEN o='ok' AND s='DEGRADED' AND NOT slow THEN 'recovered'
        WHEN o='timeout' AND s='UP' THEN 'degraded' WHEN o='refused' AND s<>'DOWN' AND nb>=2 AND others THEN 'ejected' END AS event
      FROM (SELECT pr.*, st, f, b, coalesce(st[k],'UP') AS s, CASE WHEN o='ok' THEN f[k]+1 ELSE 0 END AS nf, CASE o WHEN 'ok' THEN 0 WHEN 'refused' THEN b[k]+1 ELSE b[k] END AS nb,
        len(list_filter([1,2,3], lambda j: j<>k AND st[j]<>'DOWN'))>0 AS others FROM w JOIN pr ON pr.pool=w.pool AND pr.i=w.i+1))))
    SELECT pool, t, backend, event, state FROM w WHERE event IS NOT NULL""",
)
def stream_health_events(spark, d):
    e = records(spark, d)
    outcome = F.when(F.col("status") == 200, "ok").when(F.col("err") == "timeout", "timeout").otherwise("refused")
    probes = e.select(
        F.col("run_id").alias("pool"), "t", "backend", outcome.alias("outcome"), (F.col("ms") * 10).alias("ms"), (F.col("ms") / 4).alias("cpu_pct")
    )
    return run(spark, SR.health_events(replay(spark, probes, "probes", "t")), "health").drop("batch")


@query(
    "stream_water_levels",
    f"WITH RECURSIVE {CC._BAL} SELECT site, count(*) AS days, round(sum(over),2) AS overflow_m3, round(max_by(s,day),3) AS storage_m3 FROM bal WHERE i>0 GROUP BY 1",
)
def stream_water_levels(spark, d):
    p = CC.runoff_params(spark, d)
    q = H.curve_number_runoff(F.col("mm"), F.col("cn"))
    days = CC.rain(spark, d).join(p, "site").select(
        "site", "day", (q / 1000.0 * (20000.0 * (1 + F.col("site"))) * 0.6).alias("inflow"), (40.0 + 5 * F.col("site")).alias("length"),
        F.lit(30.0).alias("width"), F.lit(2.5).alias("depth"),
    )
    got = run(spark, SR.water_levels(replay(spark, days, "days", "day")), "levels")
    return got.groupBy("site").agg(
        F.count(F.lit(1)).alias("days"), F.round(F.sum("overflow_m3"), 2).alias("overflow_m3"), F.round(F.max_by("storage_m3", "day"), 3).alias("storage_m3")
    )


@query("stream_outbox_drain", "SELECT event_id AS id, user_id AS entity FROM events")
def stream_outbox_drain(spark, d):
    audit = folder(spark, "audit")
    SM.drain_outbox(replay(spark, CM.outbox(spark, d), "outbox", "created_at"), audit, folder(spark, "drain-cp")).awaitTermination()
    return spark.read.parquet(audit).select("id", "entity")


@query("stream_latest_refresh", "SELECT o_custkey AS site, max(o_orderkey) AS version, max_by(o_totalprice,o_orderkey) AS mm FROM orders GROUP BY 1")
def stream_latest_refresh(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("mm"))
    target = folder(spark, "latest")
    SM.refresh_latest(replay(spark, o, "refresh", "version"), ["site"], "version", target, folder(spark, "refresh-cp")).awaitTermination()
    newest = spark.read.parquet(target)
    return newest.filter(F.col("v") == newest.agg(F.max("v")).first()[0]).drop("v")


@query(
    "stream_session_expiry",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS at_, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR at_-p>=21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_) AS k FROM e)
    SELECT user_id, min(at_) AS start, max(at_)+21600000000 AS "end", count(*) AS events FROM s GROUP BY user_id, k
    HAVING max(at_)+21600000000 <= (SELECT max(epoch_us(ts))-21600000000 FROM events)""",
)
def stream_session_expiry(spark, d):
    e = table(spark, d, "events").select("user_id", F.timestamp_micros(micros(F.col("ts"))).alias("at"))
    got = run(spark, SR.session_expiry(replay(spark, e, "sessions", "at"), "6 hours"), "expired")
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "events")
