"""Run analytics: request records to summaries, buckets, phases, medians and choices.

``records(run_id, t, ms, status, backend, err, active, dup, attempts, kind)`` is the input of
most functions; every function works on all runs at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.functions import load as L
from rillwork.operators import ordered as O
from rillwork.session import attach

LATENCY_POINTS = {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0}


def warm(records: DataFrame, warmup: float) -> DataFrame:
    """Records at or after the warm-up cut."""
    return records.filter(F.col("t") >= warmup)


def run_summary(records: DataFrame, duration: float, warmup: float = 0.0) -> DataFrame:
    """One row per run: counts, error share, throughput, latency moments and percentiles."""
    sample = warm(records, warmup)
    ok = L.succeeded(F.col("status"))
    ok_ms = F.when(ok, F.col("ms"))
    span = duration - warmup
    base = sample.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(ok, 1)).alias("success"),
        F.count(F.when(~ok, 1)).alias("errors"),
        F.count(F.when((F.col("kind") == "send") & (F.col("attempts") > 1), 1)).alias("retried"),
        F.count(F.when(F.col("dup"), 1)).alias("dups"),
        F.coalesce(F.avg(ok_ms), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(ok_ms), F.lit(0.0)).alias("stddev"),
        F.coalesce(F.min(ok_ms), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(ok_ms), F.lit(0.0)).alias("max"),
        F.coalesce(F.min(F.when(F.col("active") != 0, F.col("active"))), F.lit(0)).alias("active_min"),
        F.coalesce(F.max(F.when(F.col("active") != 0, F.col("active"))), F.lit(0)).alias("active_max"),
    )
    points = O.percentiles_floor_n(sample.filter(ok), ["run_id"], "ms", LATENCY_POINTS).drop("n")
    rps = F.col("success") / F.lit(span) if span else F.lit(0.0)
    return (
        base.join(points, "run_id", "left")
        .withColumn("error_pct", F.round(F.col("errors") / F.col("total") * 100, 3))
        .withColumn("rps", F.round(rps, 2))
        .select(
            "run_id", "total", "success", "errors", "error_pct", "rps", "retried", "dups",
            *[F.round(c, 2).alias(c) for c in ("mean", "stddev", "min", "max")],
            *[F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in LATENCY_POINTS],
            "active_min", "active_max",
        )
    )


def errors_by_class(records: DataFrame) -> DataFrame:
    """Failed requests per run and error class."""
    cls = L.error_class(F.col("err"), F.col("status"))
    return (
        records.withColumn("error_class", cls)
        .filter(F.col("error_class").isNotNull())
        .groupBy("run_id", "error_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def backend_distribution(records: DataFrame) -> DataFrame:
    """Requests per run and backend."""
    return records.groupBy("run_id", "backend").agg(F.count(F.lit(1)).alias("n"))


def merge_distributions(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum per-run distributions over ``keys`` and give each backend's share in per cent."""
    keys = list(keys)
    sums = dist.groupBy(*keys, "backend").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(*keys)) * 100
    return sums.withColumn("share_pct", F.round(share, 1))


def busiest_share(dist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the busiest real backend in per cent; 0 when only error labels are left."""
    real = L.real_backend(F.col("backend"))
    sums = dist.groupBy(*keys, "backend").agg(F.sum(F.when(real, F.col("n")).otherwise(0)).alias("n"))
    return sums.groupBy(*keys).agg(
        F.when(F.sum("n") > 0, F.round(100.0 * F.max("n") / F.sum("n"), 1)).otherwise(0.0).alias("busiest")
    )


def time_buckets(records: DataFrame, width: float) -> DataFrame:
    """Non-empty buckets of ``width`` seconds: requests and errors."""
    b = F.floor(F.col("t") / width) * width
    return records.groupBy("run_id", b.cast("long").alias("t")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(~L.succeeded(F.col("status")), 1)).alias("errors"),
    )


def dense_buckets(
    records: DataFrame, duration: float, width: float = 1.0, digits: int = 1
) -> DataFrame:
    """Every bucket of every run from 0 to ``duration``, empty ones included."""
    b = F.floor(F.col("t") / width).cast("long")
    r = records.withColumn("b", b)
    ok = L.succeeded(F.col("status"))
    facts = r.groupBy("run_id", "b").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(ok, 1)).alias("ok"),
        F.count(F.when(~ok, 1)).alias("errors"),
        F.count(F.when(F.col("dup"), 1)).alias("dups"),
        F.avg(F.when(ok, F.col("ms"))).alias("mean"),
        F.max("active").alias("active"),
    )
    points = O.percentiles_floor_n(
        r.filter(ok), ["run_id", "b"], "ms", {"p50": 50.0, "p95": 95.0}
    ).drop("n")
    share = (
        r.groupBy("run_id", "b", "backend")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("run_id", "b")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("backend", "n")))).alias("by_backend"))
    )
    return fill_buckets(facts, points, share, duration, width, digits)


def fill_buckets(facts: DataFrame, points: DataFrame, share: DataFrame, duration: float, width: float, digits: int) -> DataFrame:
    """Every bucket ``b`` of every run of ``facts`` with its counts, percentiles and backends; zeros where nothing came."""
    spine = facts.select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(duration // width)).cast("long"))).alias("b")
    )
    zero = ("requests", "ok", "errors", "dups", "active")
    real = ("mean", "p50", "p95")
    return (
        spine.join(facts, ["run_id", "b"], "left")
        .join(points, ["run_id", "b"], "left")
        .join(share, ["run_id", "b"], "left")
        .select(
            "run_id",
            (F.col("b") * F.lit(width)).cast("long").alias("t"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
            *[F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in real],
            F.coalesce("by_backend", F.expr("cast(map() as map<string,bigint>)")).alias("by_backend"),
        )
    )


def classify(runs: DataFrame) -> DataFrame:
    """Add ``config``, ``param`` and ``rep`` read from the run id; drop ignored runs."""
    cfg = L.run_config(F.col("run_id"))
    return (
        runs.filter(~L.ignored_run(F.col("run_id"))).withColumn("_c", cfg).select("*", "_c.*").drop("_c")
    )


def median_over_reps(
    runs: DataFrame, values: Sequence[str], sums: Sequence[str] = (), keys=("config", "param")
) -> DataFrame:
    """Medians of ``values`` over repetitions, rounded to 2, plus repetition count and totals."""
    keys = list(keys)
    med = O.medians(runs, keys, values)
    extra = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reps"), *[F.sum(c).alias(c) for c in sums]
    )
    shown = [F.round(F.coalesce(c, F.lit(0.0)), 2).alias(c) for c in values]
    return extra.join(med, keys).select(*keys, "reps", *shown, *sums)


def speed_up(medians: DataFrame, family: str, value: str = "rps") -> DataFrame:
    """Value over that of the one-backend configuration at the same load."""
    base = medians.filter(F.col("config") == family + "1").select("param", F.col(value).alias("_base"))
    ratio = F.when((F.col("_base") != 0) & (F.col("config") != family + "1"), F.col(value) / F.col("_base"))
    rows = medians.filter(F.col("config").startswith(family))
    return rows.join(base, "param", "left").withColumn("speed_up", F.round(ratio, 2)).drop("_base")


def phase_table(series: DataFrame, phases: DataFrame) -> DataFrame:
    """Per run and phase ``[t0, t1)``: ok per second, medians of p50/p95, errors, active, users.

    ``series`` holds one row per run and second; ``phases(run_id, phase, t0, t1)`` one row per
    window, so the range condition runs inside an equi-join on the run.
    """
    inside = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
    seg = attach(series, phases.select("run_id", "phase", "t0", "t1"), ["run_id"]).filter(inside).drop("t0", "t1")
    seg = seg.withColumn("_p50", F.when(F.col("ok") > 0, F.col("p50"))).withColumn(
        "_p95", F.when(F.col("ok") > 0, F.col("p95"))
    ).withColumn("_act", F.when(F.col("active") > 0, F.col("active")))
    keys = ["run_id", "phase"]
    med = O.medians(seg, keys, ["_p50", "_p95", "_act"])
    sums = seg.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("secs"),
        F.sum("ok").alias("ok"),
        F.sum("errors").alias("errors"),
    )
    mid = O.order_statistics(seg, keys, "t", {"_mid": lambda n: F.floor(n / 2)}).drop("n")
    return (
        sums.join(med, keys, "left")  # a phase without any success has no medians
        .join(mid, keys)
        .select(
            *keys,
            F.round(F.col("ok") / F.col("secs"), 4).alias("rps"),
            F.coalesce("_p50", F.lit(0.0)).alias("p50"),
            F.coalesce("_p95", F.lit(0.0)).alias("p95"),
            "errors",
            F.coalesce("_act", F.lit(0.0)).alias("active"),
            F.col("_mid").cast("long").alias("mid_t"),
        )
    )


def phase_shares(records: DataFrame, phases: DataFrame) -> DataFrame:
    """Each backend's share of the requests inside a phase, in per cent."""
    inside = (F.col("t") >= F.col("t0")) & (F.col("t") < F.col("t1"))
    hit = attach(records, phases.select("run_id", "phase", "t0", "t1"), ["run_id"]).filter(inside)
    counts = hit.groupBy("run_id", "phase", "backend").agg(F.count(F.lit(1)).alias("n"))
    return merge_distributions(counts, ["run_id", "phase"])


def ladder_stages(records: DataFrame) -> DataFrame:
    """Per run and stage: requests, successes (2xx), errors, error share, mean latency, rate."""
    ok = L.succeeded_2xx(F.col("status"))
    g = records.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(ok, 1)).alias("successes"),
        F.count(F.when(~ok, 1)).alias("errors"),
        F.coalesce(F.sum(F.when(ok, F.col("ms"))), F.lit(0.0)).alias("lat_sum"),
        (F.max("t") - F.min("t")).alias("span"),
    )
    mean = F.when(F.col("successes") > 0, F.col("lat_sum") / F.col("successes")).otherwise(0.0)
    rps = F.when(F.col("span") > 0, F.col("successes") / F.col("span")).otherwise(0.0)
    return g.select(
        "run_id", "stage", "requests", "successes", "errors",
        (F.col("errors") / F.col("requests")).alias("err_rate"),
        mean.alias("mean_ms"), rps.alias("rps"), "lat_sum",
    )


def until_break(stages: DataFrame, limit: float = 0.2) -> DataFrame:
    """Stages up to and including the first whose error share exceeds ``limit``."""
    before = W.partitionBy("run_id").orderBy("stage").rowsBetween(W.unboundedPreceding, -1)
    broke = F.max((F.col("err_rate") > limit).cast("int")).over(before)
    return stages.withColumn("_b", F.coalesce(broke, F.lit(0))).filter("_b = 0").drop("_b")


def ladder_summary(stages: DataFrame, limit: float = 0.2) -> DataFrame:
    """Per run: totals, overall error share, mean over all latencies, peak rate, break stage."""
    return stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stages"),
        F.sum("requests").alias("requests"),
        F.sum("successes").alias("successes"),
        F.sum("errors").alias("errors"),
        F.round(F.sum("errors") / F.sum("requests"), 5).alias("err_rate_overall"),
        F.round(F.sum("lat_sum") / F.sum("successes"), 2).alias("mean_response_ms"),
        F.round(F.max("rps"), 4).alias("peak_rps"),
        F.min(F.when(F.col("err_rate") > limit, F.col("stage"))).alias("break_stage"),
    )


def with_totals(stages: DataFrame, label: str = "total") -> DataFrame:
    """Stage rows plus one totals row per run, from a single rollup."""
    g = stages.rollup("run_id", "stage").agg(
        F.grouping_id().alias("_g"),
        F.sum("requests").alias("requests"),
        F.sum("successes").alias("successes"),
        F.sum("errors").alias("errors"),
        F.sum("lat_sum").alias("_lat"),
    )
    name = F.when(F.col("_g") == 1, F.lit(label)).otherwise(F.col("stage").cast("string"))
    return g.filter("_g < 3").select(
        "run_id", name.alias("stage"), "requests", "successes", "errors",
        F.round(F.try_divide(F.col("_lat"), F.col("successes")), 6).alias("mean_ms"),
    )


def step_effect(steps: DataFrame) -> DataFrame:
    """First against last step of each series: throughput ratio and response-time cut in %."""
    g = steps.groupBy("series").agg(
        F.min_by("peak_rps", "step").alias("rps0"),
        F.max_by("peak_rps", "step").alias("rps1"),
        F.min_by("mean_ms", "step").alias("ms0"),
        F.max_by("mean_ms", "step").alias("ms1"),
    )
    return g.select(
        "series",
        F.round(F.try_divide(F.col("rps1"), F.col("rps0")), 4).alias("rps_ratio"),
        F.round((1 - F.try_divide(F.col("ms1"), F.col("ms0"))) * 100, 4).alias("ms_cut_pct"),
    )


def utilisation(samples: DataFrame) -> DataFrame:
    """Per run and system: mean, max and p95 CPU, mean memory, sample count."""
    keys = ["run_id", "system"]
    p95 = O.percentiles_floor_n(samples, keys, "cpu_pct", {"cpu_p95": 95.0}).drop("n")
    g = samples.groupBy(*keys).agg(
        F.round(F.avg("cpu_pct"), 1).alias("cpu_mean"),
        F.round(F.max("cpu_pct"), 1).alias("cpu_max"),
        F.round(F.avg("mem_mb"), 1).alias("mem_mean"),
        F.count("cpu_pct").alias("n"),
    )
    return g.join(p95.withColumn("cpu_p95", F.round("cpu_p95", 1)), keys)


def cpu_spread(util: DataFrame) -> DataFrame:
    """Spread of the backends' mean CPU per run (``sys1`` is the balancer)."""
    return (
        util.filter(F.col("system") != "sys1")
        .groupBy("run_id")
        .agg((F.max("cpu_mean") - F.min("cpu_mean")).alias("cpu_spread"))
    )


def run_utilisation(summaries: DataFrame, util: DataFrame) -> DataFrame:
    """Runs with their utilisation; a run may lack a trace and a trace may lack a summary."""
    return summaries.select("run_id", "rps", "total").join(util, "run_id", "full_outer")


def busy_window(samples: DataFrame, over: float = 20.0, pad: float = 5.0) -> DataFrame:
    """Per run and system inside first..last busy backend second ± ``pad``: means and maxima."""
    busy = (F.col("system") != "sys1") & (F.col("cpu_pct") > over)
    win = (
        samples.filter(busy)
        .groupBy("run_id")
        .agg((F.min("t") - pad).alias("_lo"), (F.max("t") + pad).alias("_hi"))
    )
    inside = attach(samples, win, ["run_id"]).filter(F.col("t").between(F.col("_lo"), F.col("_hi")))
    is_busy = F.when(F.col("cpu_pct") > over, F.col("cpu_pct"))
    return inside.groupBy("run_id", "system").agg(
        F.coalesce(F.avg(is_busy), F.lit(0.0)).alias("busy_mean"),
        F.max("cpu_pct").alias("cpu_max"),
        F.max("mem_mb").alias("mem_max"),
    )


def counter_rate(samples: DataFrame, cores: Column, cap: float | None = None) -> DataFrame:
    """CPU % between consecutive counter readings, clipped to ``[0, cap]`` where ``cap`` is given.

    ``clipped`` marks rates that lay outside, so that counter errors stay visible.
    """
    top = F.lit(float("inf") if cap is None else float(cap))
    keys = ["run_id", "system"]
    lagged = O.split_lag(samples, keys, F.floor(F.col("t") / 3600), ["t"], {"_t0": "t", "_u0": "usage"})
    rate = (F.col("usage") - F.col("_u0")) / (F.col("t") - F.col("_t0")) / cores * 100
    return (
        lagged.filter(F.col("_t0").isNotNull() & (F.col("t") > F.col("_t0")))
        .withColumn("clipped", (rate < 0) | (rate > top))
        .withColumn("cpu_pct", F.greatest(F.lit(0.0), F.least(top, rate)))
        .drop("_t0", "_u0")
    )


def busy_share(samples: DataFrame) -> DataFrame:
    """CPU % from busy and total tick counters of consecutive readings."""
    keys = ["run_id", "system"]
    lagged = O.split_lag(samples, keys, F.floor(F.col("t") / 3600), ["t"], {"_b0": "busy", "_n0": "total"})
    pct = F.try_divide((F.col("busy") - F.col("_b0")) * 100.0, F.col("total") - F.col("_n0"))
    return lagged.filter(F.col("_b0").isNotNull()).withColumn("cpu_pct", pct).drop("_b0", "_n0")


def change_points(series: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Seconds where the active count changes; the k-th change takes the k-th label."""
    rows = O.split_lag(
        series.filter(F.col("active") >= 0), ["run_id"], F.floor(F.col("t") / 3600), ["t"], {"_prev": "active"}
    )
    ev = rows.filter(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("active")))
    ev = O.split_row_number(ev, ["run_id"], F.floor(F.col("t") / 3600), ["t"], "k")
    auto = F.concat(F.lit("active "), F.col("_prev").cast("string"), F.lit("->"), F.col("active").cast("string"))
    if labels is None:
        return ev.select("run_id", "k", "t", "active", auto.alias("label"))
    return ev.join(labels.select("run_id", "k", F.col("label").alias("_l")), ["run_id", "k"], "left").select(
        "run_id", "k", "t", "active", F.coalesce("_l", auto).alias("label")
    )


def latency_cdf(records: DataFrame) -> DataFrame:
    """``i / n`` with ``i`` from 0 for every success, in latency order."""
    ok = records.filter(L.succeeded(F.col("status")))
    tie = [F.col("ms"), F.col("t"), F.col("backend")]
    rows = O.split_row_number(
        ok, ["run_id"], O.value_bucket(F.col("ms"), O.BUCKET_LEVELS[0]), tie, "_i", total="_n"
    )
    return rows.select("run_id", "ms", ((F.col("_i") - 1) / F.col("_n")).alias("cdf"))


def latency_histogram(records: DataFrame, keys: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """Cumulative fixed-bound histogram: how many values lie at or below each bound."""
    keys = list(keys)
    sums = records.groupBy(*keys).agg(
        *[F.count(F.when(F.col("ms") <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count("ms").alias("_all"),
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return sums.select(*keys, F.inline(F.array(*pairs)))


SWEPT = ("p50", "p95", "p99", "rps", "error_pct", "busiest")


def sweep_table(runs: DataFrame, keys=("config", "param"), values: Sequence[str] = SWEPT) -> DataFrame:
    """Threshold sweep: medians of ``values`` over repetitions with ranges; CPU columns can be among them."""
    keys = list(keys)
    med = O.medians(runs, keys, values)
    rng = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reps"),
        F.min("p95").alias("p95_lo"), F.max("p95").alias("p95_hi"),
        F.min("rps").alias("rps_lo"), F.max("rps").alias("rps_hi"),
    )
    return med.join(rng, keys)


def default_cost(p95: Column, best_p95: Column, rps: Column, best_rps: Column, err: Column) -> Column:
    """Relative latency, a weighted share of lost throughput, and the error per cent."""
    return p95 / best_p95 + 0.6 * (best_rps - rps) / best_rps + err


def sweep_cost(table: DataFrame, cost=default_cost) -> DataFrame:
    """Cost of every swept value against the best of its level; best of 0 counts as 1."""
    best = table.groupBy("config").agg(
        F.max("rps").alias("_tp"), F.min("p95").alias("_lat")
    ).select(
        "config",
        F.when(F.col("_tp") == 0, 1.0).otherwise(F.col("_tp")).alias("_tp"),
        F.when(F.col("_lat") == 0, 1.0).otherwise(F.col("_lat")).alias("_lat"),
    )
    c = cost(F.col("p95"), F.col("_lat"), F.col("rps"), F.col("_tp"), F.col("error_pct"))
    return table.join(best, "config").withColumn("cost", F.round(c, 4)).drop("_tp", "_lat")


def combine_levels(costed: DataFrame, first: str, second: str, digits: int = 4) -> DataFrame:
    """The first level's rows; cost averaged where the second level has the same value."""
    other = costed.filter(F.col("config") == second).select("param", F.col("cost").alias("_c2"))
    c = F.when(F.col("_c2").isNotNull(), F.round((F.col("cost") + F.col("_c2")) / 2, digits)).otherwise(F.col("cost"))
    rows = costed.filter(F.col("config") == first).join(other, "param", "left")
    return rows.withColumn("cost", c).drop("_c2")


def cheapest(costed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The value of lowest cost; the smaller value on ties."""
    order = F.struct("cost", F.col("param").cast("double"))
    return costed.groupBy(*keys).agg(F.min_by(F.struct("param", "cost"), order).alias("w")).select(*keys, "w.*")


def best_repetition(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The repetition of highest throughput per point, with the ranges over all of them."""
    keys = list(keys)
    order = F.struct(F.col("rps"), F.col("run_id"))
    best = F.max_by(F.struct("run_id", "rps", "p50", "p95", "p99", "error_pct"), order)
    return (
        runs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("reps"),
            best.alias("_b"),
            F.min("rps").alias("rps_lo"), F.max("rps").alias("rps_hi"),
            F.min("p95").alias("p95_lo"), F.max("p95").alias("p95_hi"),
        )
        .select(*keys, "reps", "_b.*", "rps_lo", "rps_hi", "p95_lo", "p95_hi")
    )


def completeness(accepted: DataFrame, delivered: DataFrame, keys: Sequence[str], on: str) -> DataFrame:
    """Accepted ids that reached the feed, and how many were lost, per key."""
    keys = list(keys)
    ids = accepted.select(*keys, on).distinct()
    seen = delivered.select(*keys, on).distinct().withColumn("_seen", F.lit(1))
    got = ids.join(seen, [*keys, on], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("accepted"), F.count("_seen").alias("delivered")
    )
    return got.select(
        *keys, "accepted", "delivered",
        (F.col("accepted") - F.col("delivered")).alias("lost"),
        F.round(F.col("delivered") / F.col("accepted"), 4).alias("completeness"),
    )


def mean_sd(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for one value) and coefficient of variation in per cent."""
    keys = list(keys)
    aggs = []
    for v in values:
        sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
        aggs += [
            F.round(F.avg(v), 4).alias(f"{v}_mean"),
            F.round(sd, 4).alias(f"{v}_sd"),
            F.round(F.try_divide(100 * sd, F.avg(v)), 4).alias(f"{v}_cv_pct"),
        ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def io_totals(directions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summed rates over the directions of a run; latency weighted by the number of IOs."""
    return directions.filter(F.col("ios") > 0).groupBy(*keys).agg(
        F.sum("ios").alias("ios"),
        F.sum("iops").alias("iops"),
        F.sum("bw_mib").alias("bw_mib"),
        (F.sum(F.col("lat_us") * F.col("ios")) / F.sum("ios")).alias("lat_us"),
        F.max("p99").alias("worst_p99"),
    )


def modal_bucket(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent bucket of a histogram (first in order on ties) and its share in per cent."""
    order = F.struct(F.col("n"), -F.col("pos"))
    g = levels.groupBy(*keys).agg(
        F.max_by("bucket", order).alias("bucket"), F.max("n").alias("_m"), F.sum("n").alias("_s")
    )
    return g.select(*keys, "bucket", F.round(F.col("_m") / F.col("_s") * 100, 4).alias("share_pct"))


def first_last_ratio(reps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Last over first repetition and the coefficient of variation over repetitions."""
    ratio = F.try_divide(F.max_by(value, "rep"), F.min_by(value, "rep"))
    cv = 100 * F.try_divide(F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.avg(value))
    return reps.groupBy(*keys).agg(F.round(ratio, 4).alias("last_over_first"), F.round(cv, 4).alias("cv_pct"))


def against_baseline(
    table: DataFrame, base: DataFrame, on: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """Ratios ``value / baseline value`` under new names; missing baselines stay null."""
    renamed = base.select(*on, *[F.col(v).alias(f"_b_{v}") for v in values])
    out = table.join(renamed, list(on), "left")
    for v, name in values.items():
        out = out.withColumn(name, F.round(F.try_divide(F.col(v), F.col(f"_b_{v}")), 4)).drop(f"_b_{v}")
    return out


def wal_summary(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sync-append report: mean ± deviation of rate and latencies, and microseconds per append."""
    out = mean_sd(runs, keys, ["iops", "lat_us", "sync_mean", "sync_p99"])
    return out.withColumn("us_per_append", F.round(1e6 / F.col("iops_mean"), 4))
