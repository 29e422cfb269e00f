"""Run analytics over ``events`` and ``lineitem``, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import DAY, micros, query, records, records_sql, table
from rillwork.functions import load as L
from rillwork.operators import ordered as O
from rillwork.operators import runs as R
from rillwork.plans import report as RP
from rillwork.session import cut

DURATION, WARMUP = 86_400.0, 3_600.0


def _pa(p: float, col: str = "ms", n: str = "n") -> str:
    """SQL for ``sorted[min(n-1, int(p/100*n))]`` over a ranked table."""
    return f"max(CASE WHEN rn-1 = least({n}-1, CAST(floor({p}/100.0::DOUBLE*{n}) AS BIGINT)) THEN {col} END)"


def summary_sql(naming: str = "load", warmup: float = WARMUP, duration: float = DURATION) -> str:
    """CTE bodies ending in ``summ``: the run summary."""
    return f"""{records_sql(naming)},
    smp AS (SELECT * FROM rec WHERE t >= {warmup}),
    rk AS (SELECT run_id, ms, row_number() OVER (PARTITION BY run_id ORDER BY ms) AS rn,
                  count(*) OVER (PARTITION BY run_id) AS n FROM smp WHERE status=200),
    pc AS (SELECT run_id, {_pa(50)} AS p50, {_pa(90)} AS p90, {_pa(95)} AS p95, {_pa(99)} AS p99 FROM rk GROUP BY 1),
    bs AS (SELECT run_id, count(*) AS total, count(*) FILTER (status=200) AS success,
        count(*) FILTER (status<>200) AS errors,
        count(*) FILTER (kind='send' AND attempts>1) AS retried, count(*) FILTER (dup) AS dups,
        avg(ms) FILTER (status=200) AS mean, stddev_pop(ms) FILTER (status=200) AS stddev,
        min(ms) FILTER (status=200) AS mn, max(ms) FILTER (status=200) AS mx,
        coalesce(min(active) FILTER (active<>0), 0) AS active_min,
        coalesce(max(active) FILTER (active<>0), 0) AS active_max FROM smp GROUP BY 1),
    summ AS (SELECT bs.run_id, total, success, errors, round(errors::DOUBLE/total*100,3) AS error_pct,
        round(success::DOUBLE/{duration - warmup},2) AS rps, retried, dups, round(coalesce(mean,0),2) AS mean,
        round(coalesce(stddev,0),2) AS stddev, round(coalesce(mn,0),2) AS min, round(coalesce(mx,0),2) AS max,
        round(coalesce(p50,0),2) AS p50, round(coalesce(p90,0),2) AS p90, round(coalesce(p95,0),2) AS p95,
        round(coalesce(p99,0),2) AS p99, active_min, active_max FROM bs LEFT JOIN pc ON pc.run_id=bs.run_id)"""


def _cfg_sql(src: str = "summ") -> str:
    return f"""cfg AS (SELECT *, regexp_extract(run_id,'^([A-Z]+[0-9]?)_',1) AS config,
      regexp_extract(run_id,'_[a-z]+([0-9.]+)_rep',1) AS param,
      CAST(regexp_extract(run_id,'_rep([0-9]+)$',1) AS INTEGER) AS rep FROM {src})"""


@query("run_summary", f"WITH {summary_sql()} SELECT * FROM summ")
def run_summary(spark, d):
    return R.run_summary(records(spark, d), DURATION, WARMUP)


@query(
    "errors_by_class",
    f"""WITH {records_sql()} SELECT run_id, coalesce(nullif(err,''),'HTTP'||status) AS error_class,
    count(*) AS n FROM rec WHERE status<>200 GROUP BY 1,2""",
)
def errors_by_class(spark, d):
    return R.errors_by_class(records(spark, d))


@query(
    "latency_percentiles_by_kind",
    f"""WITH {records_sql()}, rk AS (SELECT kind, ms, row_number() OVER (PARTITION BY kind ORDER BY ms) AS rn,
      count(*) OVER (PARTITION BY kind) AS n FROM rec)
    SELECT kind, max(n) AS n, max(CASE WHEN rn-1=CAST(floor(0.5*(n-1)) AS BIGINT) THEN ms END) AS p50,
      max(CASE WHEN rn-1=CAST(floor(0.9::DOUBLE*(n-1)) AS BIGINT) THEN ms END) AS p90,
      max(CASE WHEN rn-1=CAST(floor(0.99::DOUBLE*(n-1)) AS BIGINT) THEN ms END) AS p99 FROM rk GROUP BY 1""",
)
def latency_percentiles_by_kind(spark, d):
    return O.percentiles_floor_n1(records(spark, d), ["kind"], "ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(
    "latency_percentiles_linear",
    """SELECT event_type, count(*) AS n, round(quantile_cont(value,0.02),6) AS p2, round(quantile_cont(value,0.5),6) AS p50,
    round(quantile_cont(value,0.98),6) AS p98 FROM events GROUP BY 1""",
)
def latency_percentiles_linear(spark, d):
    got = O.percentiles_linear(
        table(spark, d, "events"), ["event_type"], "value", {"p2": 0.02, "p50": 0.5, "p98": 0.98}
    )
    return got.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p2", "p50", "p98")])


def _dense_sql(width: int) -> str:
    return f"""{records_sql()},
    b AS (SELECT *, CAST(floor(t/{width}) AS BIGINT) AS b FROM rec),
    fx AS (SELECT run_id, b, count(*) AS requests, count(*) FILTER (status=200) AS ok,
      count(*) FILTER (status<>200) AS errors, count(*) FILTER (dup) AS dups,
      avg(ms) FILTER (status=200) AS mean, max(active) AS active FROM b GROUP BY 1,2),
    rk AS (SELECT run_id, b, ms, row_number() OVER (PARTITION BY run_id,b ORDER BY ms) AS rn,
      count(*) OVER (PARTITION BY run_id,b) AS n FROM b WHERE status=200),
    pc AS (SELECT run_id, b, {_pa(50)} AS p50, {_pa(95)} AS p95 FROM rk GROUP BY 1,2),
    sp AS (SELECT run_id, unnest(range(0, {86400 // width} + 1)) AS b FROM (SELECT DISTINCT run_id FROM rec)),
    ser AS (SELECT sp.run_id, CAST(sp.b*{width} AS BIGINT) AS t, coalesce(requests,0) AS requests, coalesce(ok,0) AS ok,
      coalesce(errors,0) AS errors, coalesce(dups,0) AS dups, coalesce(active,0) AS active,
      round(coalesce(mean,0),6) AS mean, round(coalesce(p50,0),6) AS p50, round(coalesce(p95,0),6) AS p95
      FROM sp LEFT JOIN fx ON fx.run_id=sp.run_id AND fx.b=sp.b LEFT JOIN pc ON pc.run_id=sp.run_id AND pc.b=sp.b)"""


def series(spark, d, width=60.0):
    return R.dense_buckets(records(spark, d), DURATION, width, digits=6)


@query("dense_time_buckets", f"WITH {_dense_sql(60)} SELECT * FROM ser")
def dense_time_buckets(spark, d):
    return series(spark, d).drop("by_backend")


@query(
    "bucket_backend_split",
    f"""WITH {records_sql()} SELECT run_id, CAST(floor(t/3600) AS BIGINT)*3600 AS t, backend, count(*) AS n
    FROM rec GROUP BY 1,2,3""",
)
def bucket_backend_split(spark, d):
    s = series(spark, d, 3600.0)
    return s.select("run_id", "t", F.explode("by_backend").alias("backend", "n"))


@query(
    "five_second_buckets",
    f"""WITH {records_sql()} SELECT run_id, CAST(floor(t/5) AS BIGINT)*5 AS t, count(*) AS requests,
    count(*) FILTER (status<>200) AS errors FROM rec GROUP BY 1,2""",
)
def five_second_buckets(spark, d):
    return R.time_buckets(records(spark, d), 5.0)


@query(
    "merged_backend_share",
    f"""WITH {records_sql()}, {_cfg_sql("rec")}, s AS (SELECT config,param,backend,count(*) AS n FROM cfg GROUP BY 1,2,3)
    SELECT *, round(n::DOUBLE/sum(n) OVER (PARTITION BY config,param)*100,1) AS share_pct FROM s""",
)
def merged_backend_share(spark, d):
    dist = R.classify(R.backend_distribution(records(spark, d)))
    return R.merge_distributions(dist, ["config", "param"]).withColumn("n", F.col("n").cast("long"))


@query(
    "busiest_backend_share",
    f"""WITH {records_sql()}, s AS (SELECT run_id,
      CASE WHEN err='timeout' THEN 'ERR' ELSE backend END AS backend, count(*) AS n FROM rec GROUP BY 1,2)
    SELECT run_id, round(100.0::DOUBLE*max(n) FILTER (backend<>'ERR')/sum(n) FILTER (backend<>'ERR'),1) AS busiest FROM s GROUP BY 1""",
)
def busiest_backend_share(spark, d):
    r = records(spark, d).withColumn(
        "backend", F.when(F.col("err") == "timeout", "ERR").otherwise(F.col("backend"))
    )
    return R.busiest_share(R.backend_distribution(r), ["run_id"])


_MED = ("total", "success", "errors", "error_pct", "rps", "mean", "p50", "p90", "p95", "p99", "max")
_MED_SQL = f"""{summary_sql()}, {_cfg_sql()},
    med AS (SELECT config, param, count(*) AS reps, {", ".join(f"round(quantile_cont({c}::DOUBLE,0.5),2) AS {c}" for c in _MED)},
    CAST(sum(retried) AS BIGINT) AS retried, CAST(sum(dups) AS BIGINT) AS dups FROM cfg GROUP BY 1,2)"""


def _medians(spark, d):
    runs = cut(R.classify(run_summary(spark, d)))  # one row per run: small, and read many times
    return R.median_over_reps(runs, _MED, ("retried", "dups"))


@query("median_over_repetitions", f"WITH {_MED_SQL} SELECT * FROM med")
def median_over_repetitions(spark, d):
    return _medians(spark, d)


@query(
    "speed_up_over_one_backend",
    f"""WITH {_MED_SQL} SELECT m.config, m.param, m.rps,
    CASE WHEN m.config<>'L1' AND b.rps<>0 THEN round(m.rps/b.rps,2) END AS speed_up
    FROM med m LEFT JOIN med b ON b.config='L1' AND b.param=m.param""",
)
def speed_up_over_one_backend(spark, d):
    return R.speed_up(_medians(spark, d), "L").select("config", "param", "rps", "speed_up")


def _phases(runs):
    """Three working windows per run."""
    win = F.array(
        *[
            F.struct(F.lit(n).alias("phase"), F.lit(a).alias("t0"), F.lit(b).alias("t1"))
            for n, a, b in (("night", 0.0, 28800.0), ("day", 28800.0, 64800.0), ("evening", 64800.0, 86400.0))
        ]
    )
    return runs.select("run_id").distinct().select("run_id", F.inline(win))


_PH = """ph(phase,t0,t1) AS (VALUES ('night',0.0,28800.0),('day',28800.0,64800.0),('evening',64800.0,86400.0))"""


@query(
    "phase_table",
    f"""WITH {_dense_sql(60)}, {_PH}, sg AS (SELECT ser.*, phase, row_number() OVER (PARTITION BY run_id,phase ORDER BY t) AS rn,
      count(*) OVER (PARTITION BY run_id,phase) AS secs FROM ser JOIN ph ON t>=t0 AND t<t1)
    SELECT run_id, phase, round(sum(ok)::DOUBLE/count(*),4) AS rps, coalesce(quantile_cont(p50,0.5) FILTER (ok>0),0.0) AS p50,
      coalesce(quantile_cont(p95,0.5) FILTER (ok>0),0.0) AS p95, CAST(sum(errors) AS BIGINT) AS errors,
      coalesce(quantile_cont(active::DOUBLE,0.5) FILTER (active>0),0.0) AS active,
      max(CASE WHEN rn-1=secs//2 THEN t END) AS mid_t FROM sg GROUP BY 1,2""",
)
def phase_table(spark, d):
    s = series(spark, d)
    return R.phase_table(s, _phases(records(spark, d)))


@query(
    "phase_backend_share",
    f"""WITH {records_sql()}, {_PH}, s AS (SELECT run_id,phase,backend,count(*) AS n FROM rec JOIN ph ON t>=t0 AND t<t1 GROUP BY 1,2,3)
    SELECT *, round(n::DOUBLE/sum(n) OVER (PARTITION BY run_id,phase)*100,1) AS share_pct FROM s""",
)
def phase_backend_share(spark, d):
    r = records(spark, d)
    return R.phase_shares(r, _phases(r)).withColumn("n", F.col("n").cast("long"))


def _ladder(spark, d):
    """Ladder reading: one run per week day of the month, one stage per hour of day."""
    return records(spark, d).withColumn("stage", (1 + F.floor(F.col("t") / 3600)).cast("int"))


_LAD = f"""{records_sql()}, st AS (SELECT run_id, CAST(1+floor(t/3600) AS INTEGER) AS stage, count(*) AS requests,
      count(*) FILTER (status BETWEEN 200 AND 299) AS successes, count(*) FILTER (status NOT BETWEEN 200 AND 299) AS errors,
      coalesce(sum(ms) FILTER (status BETWEEN 200 AND 299),0) AS lat_sum, max(t)-min(t) AS span FROM rec GROUP BY 1,2),
    sg AS (SELECT *, errors::DOUBLE/requests AS err_rate, CASE WHEN successes>0 THEN lat_sum/successes ELSE 0 END AS mean_ms,
      CASE WHEN span>0 THEN successes/span ELSE 0 END AS rps FROM st)"""


@query(
    "ladder_until_break",
    f"""WITH {_LAD}, k AS (SELECT *, max(CASE WHEN err_rate>0.2 THEN 1 ELSE 0 END) OVER
      (PARTITION BY run_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS broke FROM sg)
    SELECT run_id, stage, requests, successes, errors, round(err_rate,5) AS err_rate, round(mean_ms,2) AS mean_ms,
      round(rps,4) AS rps FROM k WHERE coalesce(broke,0)=0""",
)
def ladder_until_break(spark, d):
    s = R.until_break(R.ladder_stages(_ladder(spark, d)))
    return s.select(
        "run_id", "stage", "requests", "successes", "errors",
        F.round("err_rate", 5).alias("err_rate"), F.round("mean_ms", 2).alias("mean_ms"), F.round("rps", 4).alias("rps"),
    )


@query(
    "ladder_summary",
    f"""WITH {_LAD} SELECT run_id, count(*) AS stages, CAST(sum(requests) AS BIGINT) AS requests,
      CAST(sum(successes) AS BIGINT) AS successes, CAST(sum(errors) AS BIGINT) AS errors,
      round(sum(errors)::DOUBLE/sum(requests),5) AS err_rate_overall, round(sum(lat_sum)/sum(successes),2) AS mean_response_ms,
      round(max(rps),4) AS peak_rps, min(stage) FILTER (err_rate>0.2) AS break_stage FROM sg GROUP BY 1""",
)
def ladder_summary(spark, d):
    return R.ladder_summary(R.ladder_stages(_ladder(spark, d)))


@query(
    "ladder_with_totals",
    f"""WITH {_LAD} SELECT run_id, CAST(stage AS VARCHAR) AS stage, requests, successes, errors,
      CASE WHEN successes>0 THEN round(lat_sum/successes,6) END AS mean_ms FROM sg
    UNION ALL SELECT run_id, 'total', CAST(sum(requests) AS BIGINT), CAST(sum(successes) AS BIGINT), CAST(sum(errors) AS BIGINT),
      CASE WHEN sum(successes)>0 THEN round(sum(lat_sum)/sum(successes),6) END FROM sg GROUP BY 1""",
)
def ladder_with_totals(spark, d):
    return R.with_totals(R.ladder_stages(_ladder(spark, d)))


@query(
    "step_effect",
    f"""WITH {_LAD}, s AS (SELECT regexp_extract(run_id,'^(L[0-9])',1) AS series, CAST(regexp_extract(run_id,'rep([0-9]+)$',1) AS INTEGER) AS step,
      max(rps) AS peak_rps, sum(lat_sum)/sum(successes) AS mean_ms FROM sg GROUP BY 1,2)
    SELECT series, round(max_by(peak_rps,step)/min_by(peak_rps,step),4) AS rps_ratio,
      round((1-max_by(mean_ms,step)/min_by(mean_ms,step))*100,4) AS ms_cut_pct FROM s GROUP BY 1""",
)
def step_effect(spark, d):
    s = R.ladder_stages(_ladder(spark, d)).groupBy(
        F.regexp_extract("run_id", r"^(L\d)", 1).alias("series"),
        F.regexp_extract("run_id", r"rep(\d+)$", 1).cast("int").alias("step"),
    ).agg(F.max("rps").alias("peak_rps"), (F.sum("lat_sum") / F.sum("successes")).alias("mean_ms"))
    return R.step_effect(s)


def samples(spark, d):
    """Utilisation reading: every event is a sample of the system ``sys1 + user % 4``."""
    ts = F.col("ts").cast("timestamp_ntz")
    day = F.dayofmonth(ts)
    run = F.concat(F.lit("L"), 1 + day % 3, F.lit("_c"), 25 * (1 + day % 2), F.lit("_rep"), day.cast("string"))
    return table(spark, d, "events").select(
        run.alias("run_id"),
        ((micros(F.col("ts")) % DAY) / F.lit(1e6)).alias("t"),
        F.concat(F.lit("sys"), (1 + F.col("user_id") % 4).cast("string")).alias("system"),
        F.col("value").alias("cpu_pct"),
        (100.0 + F.col("user_id")).alias("mem_mb"),
        (F.col("event_id") * 0.5).alias("usage"),
    )


_SMP = """smp AS (SELECT 'L'||(1+day(ts)%3)||'_c'||(25*(1+day(ts)%2))||'_rep'||day(ts) AS run_id,
      (epoch_us(ts) % 86400000000)/1e6 AS t, 'sys'||(1+user_id%4) AS system, value AS cpu_pct,
      100.0+user_id AS mem_mb, event_id*0.5 AS usage FROM events)"""
_UTIL = f"""{_SMP}, rk AS (SELECT run_id, system, cpu_pct, row_number() OVER (PARTITION BY run_id,system ORDER BY cpu_pct) AS rn,
      count(*) OVER (PARTITION BY run_id,system) AS n FROM smp),
    ut AS (SELECT s.*, round(p.p95,1) AS cpu_p95 FROM (SELECT run_id, system, round(avg(cpu_pct),1) AS cpu_mean,
      round(max(cpu_pct),1) AS cpu_max, round(avg(mem_mb::DOUBLE),1) AS mem_mean, count(*) AS n FROM smp GROUP BY 1,2) s
      JOIN (SELECT run_id, system, {_pa(95, "cpu_pct")} AS p95 FROM rk GROUP BY 1,2) p USING (run_id,system))"""


@query("utilisation", f"WITH {_UTIL} SELECT * FROM ut")
def utilisation(spark, d):
    return R.utilisation(samples(spark, d))


@query(
    "backend_cpu_spread",
    f"""WITH {_UTIL}, c AS (SELECT run_id, max(cpu_mean)-min(cpu_mean) AS s FROM ut WHERE system<>'sys1' GROUP BY 1)
    SELECT regexp_extract(run_id,'^(L[0-9])',1) AS config, round(quantile_cont(s,0.5),4) AS cpu_spread FROM c GROUP BY 1""",
)
def backend_cpu_spread(spark, d):
    s = R.cpu_spread(R.utilisation(samples(spark, d))).withColumn(
        "config", F.regexp_extract("run_id", r"^(L\d)", 1)
    )
    return O.medians(s, ["config"], ["cpu_spread"]).withColumn("cpu_spread", F.round("cpu_spread", 4))


@query(
    "run_with_utilisation",
    f"""WITH {summary_sql()}, {_UTIL.replace("smp", "us").replace("rk AS", "rku AS").replace("FROM rk", "FROM rku")}
    SELECT coalesce(s.run_id,u.run_id) AS run_id, rps, total, system, cpu_mean, cpu_max, mem_mean, n, cpu_p95
    FROM (SELECT * FROM summ WHERE run_id NOT LIKE 'L1%') s FULL OUTER JOIN (SELECT * FROM ut WHERE run_id NOT LIKE 'L2%') u ON s.run_id=u.run_id""",
)
def run_with_utilisation(spark, d):
    s = run_summary(spark, d).filter(~F.col("run_id").startswith("L1"))
    u = utilisation(spark, d).filter(~F.col("run_id").startswith("L2"))
    return R.run_utilisation(s, u)


@query(
    "busy_window_utilisation",
    f"""WITH {_SMP}, w AS (SELECT run_id, min(t)-5 AS lo, max(t)+5 AS hi FROM smp WHERE system<>'sys1' AND cpu_pct>20 GROUP BY 1)
    SELECT run_id, system, round(coalesce(avg(cpu_pct) FILTER (cpu_pct>20),0),6) AS busy_mean, max(cpu_pct) AS cpu_max,
      max(mem_mb::DOUBLE) AS mem_max FROM smp JOIN w USING (run_id) WHERE t BETWEEN lo AND hi GROUP BY 1,2""",
)
def busy_window_utilisation(spark, d):
    return R.busy_window(samples(spark, d)).withColumn("busy_mean", F.round("busy_mean", 6))


@query(
    "counter_rate",
    f"""WITH {_SMP}, l AS (SELECT *, lag(t) OVER w AS t0, lag(usage) OVER w AS u0 FROM smp WINDOW w AS (PARTITION BY run_id,system ORDER BY t))
    SELECT run_id, system, t, round(greatest(0.0, least(800.0, (usage-u0)/(t-t0)/2*100)),6) AS cpu_pct, (usage-u0)/(t-t0)/2*100 NOT BETWEEN 0 AND 800 AS clipped FROM l WHERE t0 IS NOT NULL AND t>t0""",
)
def counter_rate(spark, d):
    s = samples(spark, d).select("run_id", "system", "t", "usage")
    return R.counter_rate(s, F.lit(2), 800.0).select("run_id", "system", "t", F.round("cpu_pct", 6).alias("cpu_pct"), "clipped")


@query(
    "busy_share",
    f"""WITH {_SMP}, l AS (SELECT *, lag(usage) OVER w AS b0, lag(event_n) OVER w AS n0 FROM (SELECT *, usage*2+t AS event_n FROM smp)
      WINDOW w AS (PARTITION BY run_id,system ORDER BY t))
    SELECT run_id, system, t, round((usage-b0)*100.0/(event_n-n0),6) AS cpu_pct FROM l WHERE b0 IS NOT NULL""",
)
def busy_share(spark, d):
    s = samples(spark, d).select(
        "run_id", "system", "t", F.col("usage").alias("busy"), (F.col("usage") * 2 + F.col("t")).alias("total")
    )
    return R.busy_share(s).select("run_id", "system", "t", F.round("cpu_pct", 6).alias("cpu_pct"))


@query(
    "membership_change_points",
    f"""WITH {_dense_sql(60)}, a AS (SELECT run_id, t, active FROM ser WHERE active>0),
    l AS (SELECT *, lag(active) OVER (PARTITION BY run_id ORDER BY t) AS prev FROM a),
    e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t) AS k FROM l WHERE prev IS NOT NULL AND prev<>active)
    SELECT run_id, k, t, active, CASE k WHEN 1 THEN 'scale up' ELSE 'active '||prev||'->'||active END AS label FROM e""",
)
def membership_change_points(spark, d):
    s = series(spark, d).filter(F.col("active") > 0)
    labels = s.select("run_id").distinct().select(
        "run_id", F.lit(1).cast("long").alias("k"), F.lit("scale up").alias("label")
    )
    return R.change_points(s, labels)


@query(
    "trailing_mean",
    f"""WITH {_dense_sql(60)}, a AS (SELECT run_id, t, CASE WHEN ok>0 THEN p95 END AS y FROM ser)
    SELECT run_id, t, round(coalesce(avg(y) OVER (PARTITION BY run_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),0),6) AS mean5 FROM a""",
)
def trailing_mean(spark, d):
    s = series(spark, d).select("run_id", "t", F.when(F.col("ok") > 0, F.col("p95")).alias("y"))
    got = O.trailing_mean(s, ["run_id"], F.floor(F.col("t") / 3600), ["t"], "y", 5, "mean5")
    return got.select("run_id", "t", F.round("mean5", 6).alias("mean5"))


@query(
    "centred_mean",
    f"""WITH {_SMP} SELECT run_id, system, t, round(CASE WHEN count(*) OVER (PARTITION BY run_id,system)<5 THEN cpu_pct ELSE
      avg(cpu_pct) OVER (PARTITION BY run_id,system ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END,6) AS cpu_smooth FROM smp""",
)
def centred_mean(spark, d):
    got = O.centred_mean(
        samples(spark, d), ["run_id", "system"], F.floor(F.col("t") / 3600), ["t"], "cpu_pct", 5, "cpu_smooth"
    )
    return got.select("run_id", "system", "t", F.round("cpu_smooth", 6).alias("cpu_smooth"))


@query(
    "latency_cdf",
    f"""WITH {records_sql()} SELECT run_id, ms, (row_number() OVER (PARTITION BY run_id ORDER BY ms)-1)::DOUBLE/count(*) OVER (PARTITION BY run_id) AS cdf
    FROM rec WHERE status=200""",
)
def latency_cdf(spark, d):
    return R.latency_cdf(records(spark, d))


_BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query(
    "latency_histogram",
    f"""WITH {records_sql()}, le(le) AS (VALUES {",".join(f"({b}::DOUBLE)" for b in _BOUNDS)},('inf'::DOUBLE))
    SELECT kind, status, le, count(*) FILTER (ms<=le) AS n FROM rec CROSS JOIN le GROUP BY 1,2,3""",
)
def latency_histogram(spark, d):
    return R.latency_histogram(records(spark, d), ["kind", "status"], _BOUNDS)


_SWEEP = f"""{summary_sql("sweep", 0.0, 432.0)}, {_cfg_sql()},
    bz AS (SELECT run_id, round(100.0::DOUBLE*max(n)/sum(n),1) AS busiest FROM (SELECT run_id,backend,count(*) AS n FROM rec GROUP BY 1,2) GROUP BY 1),
    sw AS (SELECT config, param, quantile_cont(p50,0.5) AS p50, quantile_cont(p95,0.5) AS p95, quantile_cont(p99,0.5) AS p99,
      quantile_cont(rps,0.5) AS rps, quantile_cont(error_pct,0.5) AS error_pct, quantile_cont(busiest,0.5) AS busiest, count(*) AS reps,
      min(p95) AS p95_lo, max(p95) AS p95_hi, min(rps) AS rps_lo, max(rps) AS rps_hi FROM cfg JOIN bz USING (run_id) GROUP BY 1,2),
    bst AS (SELECT config, max(rps) AS tp, min(p95) AS lat FROM sw GROUP BY 1),
    cost AS (SELECT sw.*, round(p95/lat + 0.6::DOUBLE*(tp-rps)/tp + error_pct, 4) AS cost FROM sw JOIN bst USING (config)),
    comb AS (SELECT a.* REPLACE (CASE WHEN b.cost IS NOT NULL THEN round((a.cost+b.cost)/2,6) ELSE a.cost END AS cost)
      FROM cost a LEFT JOIN cost b ON b.config='THRLOW' AND b.param=a.param WHERE a.config='THR')"""


def _sweep(spark, d):
    r = records(spark, d, "sweep")
    runs = R.run_summary(r, 432.0).join(R.busiest_share(R.backend_distribution(r), ["run_id"]), "run_id")
    return R.sweep_cost(R.sweep_table(cut(R.classify(runs))))


def _r6(df):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


_SW_COLS = "config,param,reps,cost," + ",".join(
    f"round({c},6) AS {c}"
    for c in ("p50", "p95", "p99", "rps", "error_pct", "busiest", "p95_lo", "p95_hi", "rps_lo", "rps_hi")
)


@query("threshold_sweep", f"WITH {_SWEEP} SELECT {_SW_COLS} FROM cost")
def threshold_sweep(spark, d):
    return _r6(_sweep(spark, d))


@query("threshold_sweep_combined", f"WITH {_SWEEP} SELECT {_SW_COLS} FROM comb")
def threshold_sweep_combined(spark, d):
    return _r6(R.combine_levels(_sweep(spark, d), "THR", "THRLOW", digits=6))


@query("threshold_choice", f"WITH {_SWEEP} SELECT param, cost FROM comb ORDER BY cost, param::DOUBLE LIMIT 1")
def threshold_choice(spark, d):
    return R.cheapest(R.combine_levels(_sweep(spark, d), "THR", "THRLOW", digits=6))


@query(
    "best_repetition",
    f"""WITH {summary_sql()}, {_cfg_sql()} SELECT config, param, count(*) AS reps,
    max_by(run_id,{{'a':rps,'b':run_id}}) AS run_id, max(rps) AS rps, max_by(p50,{{'a':rps,'b':run_id}}) AS p50,
    max_by(p95,{{'a':rps,'b':run_id}}) AS p95, max_by(p99,{{'a':rps,'b':run_id}}) AS p99, max_by(error_pct,{{'a':rps,'b':run_id}}) AS error_pct,
    min(rps) AS rps_lo, max(rps) AS rps_hi, min(p95) AS p95_lo, max(p95) AS p95_hi FROM cfg GROUP BY 1,2""",
)
def best_repetition(spark, d):
    return R.best_repetition(R.classify(run_summary(spark, d)), ["config", "param"])


@query(
    "feed_completeness",
    """WITH a AS (SELECT event_type AS stage, user_id, event_id FROM events WHERE event_type<>'error'),
    f AS (SELECT event_id FROM events WHERE value<=100)
    SELECT stage, count(*) AS accepted, count(f.event_id) AS delivered, count(*)-count(f.event_id) AS lost,
    round(count(f.event_id)::DOUBLE/count(*),4) AS completeness FROM a LEFT JOIN f USING (event_id) GROUP BY 1""",
)
def feed_completeness(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), "event_id", "value")
    sent = e.filter("stage <> 'error'").select("stage", "event_id")
    return R.completeness(sent, e.filter("value <= 100"), ["stage"], "event_id")


def io_runs(spark, d):
    """Storage-benchmark reading of ``lineitem``: case, depth, repetition, two directions."""
    li = table(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("case"),
        F.col("l_linenumber").alias("depth"),
        (F.col("l_suppkey") % 3).cast("int").alias("rep"),
        F.when(F.col("l_linestatus") == "O", "read").otherwise("write").alias("direction"),
    ).agg(
        F.count(F.lit(1)).alias("ios"),
        F.sum("l_quantity").alias("iops"),
        (F.sum("l_extendedprice") / 1048576).alias("bw_mib"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("lat_us"),
        F.max("l_extendedprice").alias("p99"),
    )


_IO = """io AS (SELECT l_returnflag AS case_, l_linenumber AS depth, CAST(l_suppkey%3 AS INTEGER) AS rep,
      CASE WHEN l_linestatus='O' THEN 'read' ELSE 'write' END AS direction, count(*) AS ios, sum(l_quantity) AS iops,
      sum(l_extendedprice)/1048576 AS bw_mib, sum(l_extendedprice)/sum(l_quantity) AS lat_us, max(l_extendedprice) AS p99
      FROM lineitem GROUP BY 1,2,3,4),
    tot AS (SELECT case_, depth, rep, CAST(sum(ios) AS BIGINT) AS ios, sum(iops) AS iops, sum(bw_mib) AS bw_mib,
      sum(lat_us*ios)/sum(ios) AS lat_us, max(p99) AS worst_p99 FROM io GROUP BY 1,2,3)"""


def _io_totals(spark, d):
    return R.io_totals(io_runs(spark, d), ["case", "depth", "rep"])


@query(
    "io_run_totals",
    f"WITH {_IO} SELECT case_ AS \"case\", depth, rep, ios, iops, round(bw_mib,4) AS bw_mib, round(lat_us,4) AS lat_us, worst_p99 FROM tot",
)
def io_run_totals(spark, d):
    t = _io_totals(spark, d)
    return t.withColumn("bw_mib", F.round("bw_mib", 4)).withColumn("lat_us", F.round("lat_us", 4))


_IOS = ",".join(
    f"round(avg({v}),4) AS {v}_mean, round(coalesce(stddev_samp({v}),0),4) AS {v}_sd, "
    f"round(100*coalesce(stddev_samp({v}),0)/avg({v}),4) AS {v}_cv_pct"
    for v in ("iops", "lat_us")
)


@query("io_benchmark_summary", f'WITH {_IO} SELECT case_ AS "case", depth, count(*) AS n, {_IOS} FROM tot GROUP BY 1,2')
def io_benchmark_summary(spark, d):
    return R.mean_sd(_io_totals(spark, d), ["case", "depth"], ["iops", "lat_us"])


@query(
    "io_depth_scaling",
    f"""WITH {_IO}, m AS (SELECT case_, depth, avg(iops) AS iops, avg(lat_us) AS lat_us FROM tot GROUP BY 1,2)
    SELECT a.case_ AS "case", a.depth, round(a.iops/b.iops,4) AS iops_ratio, round(a.lat_us/b.lat_us,4) AS lat_ratio
    FROM m a LEFT JOIN m b ON b.case_=a.case_ AND b.depth=1""",
)
def io_depth_scaling(spark, d):
    m = _io_totals(spark, d).groupBy("case", "depth").agg(F.avg("iops").alias("iops"), F.avg("lat_us").alias("lat_us"))
    base = m.filter("depth = 1").drop("depth")
    return R.against_baseline(m, base, ["case"], {"iops": "iops_ratio", "lat_us": "lat_ratio"}).drop("iops", "lat_us")


@query(
    "io_working_set_ratio",
    f"""WITH {_IO}, s AS (SELECT case_, depth, avg(iops) AS iops, max(worst_p99) AS p99 FROM tot WHERE rep<2 GROUP BY 1,2),
    g AS (SELECT case_, depth, avg(iops) AS iops, max(worst_p99) AS p99 FROM tot WHERE rep=2 GROUP BY 1,2)
    SELECT s.case_ AS "case", s.depth, round(s.iops/g.iops,4) AS iops_ratio, round(s.p99/g.p99,4) AS p99_ratio
    FROM s LEFT JOIN g USING (case_,depth)""",
)
def io_working_set_ratio(spark, d):
    t = _io_totals(spark, d)

    def part(cond):
        return t.filter(cond).groupBy("case", "depth").agg(F.avg("iops").alias("iops"), F.max("worst_p99").alias("p99"))

    got = R.against_baseline(
        part("rep < 2"), part("rep = 2"), ["case", "depth"], {"iops": "iops_ratio", "p99": "p99_ratio"}
    )
    return got.drop("iops", "p99")


@query(
    "io_modal_depth",
    """WITH c AS (SELECT l_returnflag AS case_, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1,2)
    SELECT case_ AS "case", CAST(max_by(b,{'n':n,'p':-b}) AS VARCHAR) AS bucket, round(max(n)::DOUBLE/sum(n)*100,4) AS share_pct FROM c GROUP BY 1""",
)
def io_modal_depth(spark, d):
    c = table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("case"),
        F.col("l_linenumber").cast("string").alias("bucket"),
        F.col("l_linenumber").alias("pos"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return R.modal_bucket(c, ["case"])


@query(
    "io_repetition_drift",
    f"""WITH {_IO} SELECT case_ AS "case", depth, round(max_by(iops,rep)/min_by(iops,rep),4) AS last_over_first,
    round(100*coalesce(stddev_samp(iops),0)/avg(iops),4) AS cv_pct FROM tot GROUP BY 1,2""",
)
def io_repetition_drift(spark, d):
    return R.first_last_ratio(_io_totals(spark, d), ["case", "depth"], "iops")


_WALV = ",".join(
    f"round(avg({v}),4) AS {v}_mean, round(coalesce(stddev_samp({v}),0),4) AS {v}_sd, "
    f"round(100*coalesce(stddev_samp({v}),0)/avg({v}),4) AS {v}_cv_pct"
    for v in ("iops", "lat_us", "sync_mean", "sync_p99")
)


@query(
    "sync_append_summary",
    f"""WITH {_IO}, w AS (SELECT case_, iops, lat_us, lat_us/10 AS sync_mean, p99/10 AS sync_p99 FROM io WHERE direction='write')
    SELECT case_ AS "case", count(*) AS n, {_WALV}, round(1e6/round(avg(iops),4),4) AS us_per_append FROM w GROUP BY 1""",
)
def sync_append_summary(spark, d):
    w = io_runs(spark, d).filter("direction = 'write'").withColumn("sync_mean", F.col("lat_us") / 10).withColumn(
        "sync_p99", F.col("p99") / 10
    )
    return R.wal_summary(w, ["case"])


@query(
    "backend_ewma",
    f"""WITH {records_sql()}, n AS (SELECT backend, ms, row_number() OVER (PARTITION BY backend ORDER BY run_id,t) AS i,
      count(*) OVER (PARTITION BY backend) AS n FROM rec)
    SELECT backend, max(n) AS n, round(sum(pow(0.8,n-i)*(CASE WHEN i=1 THEN 1.0 ELSE 0.2 END)*ms),4) AS ewma FROM n GROUP BY 1""",
)
def backend_ewma(spark, d):
    r = records(spark, d)
    # Runs are ordered by name here, so one bucket per run keeps buckets in order.
    runs = r.select("run_id").distinct()
    pos = O.range_row_number(runs, ["run_id"], "_run")
    got = O.ewma(
        r.join(pos, "run_id"), ["backend"], F.col("_run") * 100 + F.floor(F.col("t") / 3600), ["run_id", "t"], "ms", 0.2
    )
    return got.select("backend", "n", F.round("ewma", 4).alias("ewma"))


@query(
    "backend_load_index",
    f"""WITH {records_sql()}, m AS (SELECT run_id, backend, avg(ms)/400 AS cpu, count(*) FILTER (ms>100) AS in_flight, avg(ms) AS ewma,
      max(ms)>300 AS degraded FROM rec GROUP BY 1,2)
    SELECT run_id, backend, round(greatest(cpu, in_flight/32.0::DOUBLE, ewma/500)*(CASE WHEN degraded THEN 1.5 ELSE 1 END),6) AS load_index,
      round(ewma*(1+in_flight)*(1+0.5*cpu)*(CASE WHEN degraded THEN 2 ELSE 1 END),4) AS score FROM m""",
)
def backend_load_index(spark, d):
    m = records(spark, d).groupBy("run_id", "backend").agg(
        (F.avg("ms") / 400).alias("cpu"),
        F.count(F.when(F.col("ms") > 100, 1)).alias("in_flight"),
        F.avg("ms").alias("ewma"),
        (F.max("ms") > 300).alias("degraded"),
    )
    one = F.lit(1)
    idx = L.load_index(F.col("cpu"), F.col("in_flight"), F.col("ewma"), F.col("degraded"), one, 32, 500)
    sc = L.adaptive_score(F.col("cpu"), F.col("in_flight"), F.col("ewma"), F.col("degraded"), one, 0.5)
    return m.select("run_id", "backend", F.round(idx, 6).alias("load_index"), F.round(sc, 4).alias("score"))


@query(
    "users_in_effect",
    f"""WITH {_dense_sql(60)}, s AS (SELECT run_id, t, CAST(regexp_extract(run_id,'_c([0-9]+)_',1) AS INTEGER) AS c FROM ser)
    SELECT run_id, t, CASE WHEN t>=64800 THEN 2*c WHEN t>=28800 THEN 4*c ELSE c END AS users FROM s""",
)
def users_in_effect(spark, d):
    s = series(spark, d).select("run_id", "t", F.regexp_extract("run_id", r"_c(\d+)_", 1).cast("int").alias("c"))
    spec = F.concat_ws(
        ",",
        F.concat(F.col("c").cast("string"), F.lit(":28800")),
        F.concat((F.col("c") * 4).cast("string"), F.lit(":36000")),
        F.concat((F.col("c") * 2).cast("string"), F.lit(":21600")),
    )
    return s.select("run_id", "t", L.users_at(F.col("t"), L.ramp_steps(spec), F.col("c")).alias("users"))


@query(
    "load_schedule",
    f"""WITH {records_sql()}, r AS (SELECT DISTINCT run_id, CAST(regexp_extract(run_id,'_c([0-9]+)_',1) AS INTEGER) AS c FROM rec)
    SELECT run_id, k AS step, c*(k+1) AS users, k*600.0::DOUBLE AS t0, (k+1)*600.0::DOUBLE AS t1 FROM r CROSS JOIN (SELECT CAST(unnest([0,1,2]) AS INTEGER) AS k)""",
)
def load_schedule(spark, d):
    r = records(spark, d).select("run_id", F.regexp_extract("run_id", r"_c(\d+)_", 1).cast("int").alias("c")).distinct()
    spec = F.concat_ws(",", *[F.concat((F.col("c") * k).cast("string"), F.lit(":600")) for k in (1, 2, 3)])
    return r.select("run_id", F.inline(L.ramp_steps(spec)))


UNIT = 100  # the report's runs last 864 seconds: a hundred seconds of the day count as one
SPAN, COLD, STEP = DURATION / UNIT, WARMUP / UNIT, 36

_REC = records_sql("load")
_BOTH = f"""{_REC.replace("rec AS", "ra AS", 1)}, {records_sql("sweep").replace("rec AS", "rb AS", 1)}, rec AS (SELECT * REPLACE (t/{UNIT} AS t) FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb))"""
_SAMPLED = f"""{_BOTH}, sm AS (SELECT run_id, 'sys'||(1+k%4) AS system, ms AS cpu FROM (SELECT *, CAST(substr(backend,4) AS INTEGER)+CAST(floor(t) AS BIGINT) AS k FROM rec)),
    sy AS (SELECT run_id, system, round(avg(cpu),1) AS cpu FROM sm GROUP BY 1,2),
    mc AS (SELECT run_id, max(cpu) FILTER (system='sys1') AS sys1_cpu, avg(cpu) FILTER (system<>'sys1') AS backend_cpu, max(cpu) FILTER (system<>'sys1')-min(cpu) FILTER (system<>'sys1') AS cpu_spread FROM sy GROUP BY 1)"""
_BZ = """bz AS (SELECT run_id, round(100.0::DOUBLE*max(n)/sum(n),1) AS busiest FROM (SELECT run_id,backend,count(*) AS n FROM rec GROUP BY 1,2) GROUP BY 1)"""
_RSUM = f"""{summary_sql("load", COLD, SPAN).replace(_REC, _SAMPLED)}, {_BZ}, dp AS (SELECT run_id, count(*) AS dropped FROM rec WHERE ms>150 GROUP BY 1),
    sx AS (SELECT s.*, coalesce(dropped,0) AS dropped, round((total+coalesce(dropped,0))/{SPAN - COLD}::DOUBLE,4) AS offered, busiest, sys1_cpu, backend_cpu, cpu_spread
      FROM summ s LEFT JOIN dp USING (run_id) LEFT JOIN bz USING (run_id) LEFT JOIN mc USING (run_id)), {_cfg_sql("sx")}"""
_RMED = f"""{_RSUM}, med AS (SELECT config, param, count(*) AS reps, {", ".join(f"CAST(round(CAST(CAST(quantile_cont({c}::DOUBLE,0.5) AS VARCHAR) AS DECIMAL(38,18)),2) AS DOUBLE) AS {c}" for c in RP.MEDIANS)},
    sum(retried) AS retried, sum(dups) AS dups, sum(dropped) AS dropped FROM cfg GROUP BY 1,2)"""
_RSWEEP = f"""{_RSUM}, sw AS (SELECT config, param, {", ".join(f"quantile_cont({c},0.5) AS {c}" for c in (*R.SWEPT, "sys1_cpu", "backend_cpu"))}, count(*) AS reps,
      min(p95) AS p95_lo, max(p95) AS p95_hi, min(rps) AS rps_lo, max(rps) AS rps_hi FROM cfg WHERE config LIKE 'THR%' GROUP BY 1,2),
    bst AS (SELECT config, max(rps) AS tp, min(p95) AS lat FROM sw GROUP BY 1),
    cost AS (SELECT sw.*, round(p95/lat + 0.6::DOUBLE*(tp-rps)/tp + error_pct, 4) AS cost FROM sw JOIN bst USING (config)),
    comb AS (SELECT a.* REPLACE (CASE WHEN b.cost IS NOT NULL THEN round((a.cost+b.cost)/2,6) ELSE a.cost END AS cost)
      FROM cost a LEFT JOIN cost b ON b.config='THRLOW' AND b.param=a.param WHERE a.config='THR')"""
_RSER = _dense_sql(STEP).replace(_REC, _BOTH).replace(f"range(0, {86400 // STEP} + 1)", f"range(0, {int(SPAN) // STEP} + 1)")
_RPH = "ph(phase,t0,t1) AS (VALUES ('night',0.0,288.0),('day',288.0,648.0),('evening',648.0,864.0))"


def _section(name: str, item: str, metrics: str, source: str) -> str:
    names = metrics.split()
    return f"""SELECT '{name}' AS section, {item} AS item, unnest([{",".join(f"'{m}'" for m in names)}]) AS metric, unnest([{",".join(f"round(CAST({m} AS DOUBLE),6)" for m in names)}]) AS value FROM ({source})"""


_SUMMED = "total success errors error_pct rps offered retried dups dropped mean stddev min max p50 p90 p95 p99 active_min active_max busiest sys1_cpu backend_cpu cpu_spread"
_BEST = f"""WITH {_RSUM} SELECT config, param, count(*) AS reps, max_by(run_id,{{'a':rps,'b':run_id}}) AS run_id, max(rps) AS rps, {", ".join(f"max_by({c},{{'a':rps,'b':run_id}}) AS {c}" for c in ("p50", "p95", "p99", "error_pct"))},
    min(rps) AS rps_lo, max(rps) AS rps_hi, min(p95) AS p95_lo, max(p95) AS p95_hi FROM cfg GROUP BY 1,2"""
_PHASED = f"""WITH {_RSER}, {_RPH}, sg AS (SELECT ser.*, phase, row_number() OVER (PARTITION BY run_id,phase ORDER BY t) AS rn, count(*) OVER (PARTITION BY run_id,phase) AS secs FROM ser JOIN ph ON t>=t0 AND t<t1)
    SELECT run_id, phase, round(sum(ok)::DOUBLE/count(*),4) AS rps, coalesce(quantile_cont(p50,0.5) FILTER (ok>0),0.0) AS p50, coalesce(quantile_cont(p95,0.5) FILTER (ok>0),0.0) AS p95, sum(errors) AS errors,
      coalesce(quantile_cont(active::DOUBLE,0.5) FILTER (active>0),0.0) AS active, max(CASE WHEN rn-1=secs//2 THEN t END) AS mid_t FROM sg GROUP BY 1,2"""
_SHARED = f"""WITH {_BOTH}, {_RPH}, s AS (SELECT run_id,phase,backend,count(*) AS n FROM rec JOIN ph ON t>=t0 AND t<t1 GROUP BY 1,2,3)
    SELECT *, round(n::DOUBLE/sum(n) OVER (PARTITION BY run_id,phase)*100,1) AS share_pct FROM s"""


@query(
    "run_report",
    " UNION ALL ".join(
        (
            _section("counters", "input", "records unusable trial", f"WITH {_BOTH} SELECT 'records' AS input, count(*) AS records, 0 AS unusable, 0 AS trial FROM rec"),
            _section("summary", "run_id", _SUMMED, f"WITH {_RSUM} SELECT * FROM cfg"),
            _section("errors", "run_id||'|'||error_class", "n", f"WITH {_BOTH} SELECT run_id, coalesce(nullif(err,''),'HTTP'||status) AS error_class, count(*) AS n FROM rec WHERE status<>200 GROUP BY 1,2"),
            _section("distribution", "run_id||'|'||backend", "n share_pct", f"WITH {_BOTH}, s AS (SELECT run_id, backend, count(*) AS n FROM rec GROUP BY 1,2) SELECT *, round(n::DOUBLE/sum(n) OVER (PARTITION BY run_id)*100,1) AS share_pct FROM s"),
            _section("medians", "config||'|'||param", "reps " + " ".join(RP.MEDIANS) + " retried dups dropped", f"WITH {_RMED} SELECT * FROM med"),
            _section("best", "config||'|'||param||'|'||run_id", "reps rps p50 p95 p99 error_pct rps_lo rps_hi p95_lo p95_hi", _BEST),
            _section("speed_up", "config||'|'||param", "rps speed_up", f"WITH {_RMED} SELECT m.config, m.param, m.rps, CASE WHEN m.config<>'L1' AND b.rps<>0 THEN round(m.rps/b.rps,2) END AS speed_up FROM med m LEFT JOIN med b ON b.config='L1' AND b.param=m.param WHERE m.config LIKE 'L%'"),
            _section("sweep", "config||'|'||param", " ".join(R.SWEPT) + " sys1_cpu backend_cpu reps p95_lo p95_hi rps_lo rps_hi cost", f"WITH {_RSWEEP} SELECT * FROM comb"),
            _section("choice", "param", "cost", f"WITH {_RSWEEP} SELECT param, cost FROM comb ORDER BY cost, param::DOUBLE LIMIT 1"),
            _section("buckets", "run_id||'|'||t", "requests ok errors dups active mean p50 p95", f"WITH {_RSER} SELECT * FROM ser"),
            _section("phases", "run_id||'|'||phase", "rps p50 p95 errors active mid_t", _PHASED),
            _section("phase_share", "run_id||'|'||phase||'|'||backend", "n share_pct", _SHARED),
        )
    ),
)
def run_report(spark, d):
    rec = records(spark, d).unionByName(records(spark, d, "sweep")).withColumn("t", F.col("t") / UNIT)
    turn = F.substring("backend", 4, 9).cast("int") + F.floor("t")
    cpu = rec.select("run_id", F.concat(F.lit("sys"), (1 + turn % 4).cast("string")).alias("system"), F.col("ms").alias("cpu_pct"))
    dropped = rec.filter("ms > 150").groupBy("run_id").agg(F.count(F.lit(1)).alias("dropped"))
    phases = _phases(rec).withColumns({"t0": F.col("t0") / UNIT, "t1": F.col("t1") / UNIT})
    return RP.long_form(RP.run_report(rec, cpu, SPAN, COLD, float(STEP), phases, dropped))
