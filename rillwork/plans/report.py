"""The report on a set of runs: one scan of the request records, many tables.

``run_state`` reads the records once into a state that adds up: requests per run, time bucket, backend, kind,
outcome and latency, equal ones counted together. It is written to the checkpoint folder, and every table of the
report is rolled up from it, percentiles too, since the state keeps how often each latency occurred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import load as L
from rillwork.operators import ordered as O
from rillwork.operators import runs as R
from rillwork.session import attach, cut

#: Values whose medians over the repetitions are reported.
MEDIANS = ("total", "success", "errors", "error_pct", "rps", "offered", "mean", "p50", "p90", "p95", "p99", "max")

#: Columns that name a row of a table, in the order of its name.
NAMING = ("config", "param", "run_id", "phase", "t", "backend", "error_class", "input")


def run_state(records: DataFrame, width: float, warmup: float) -> tuple[DataFrame, DataFrame]:
    """The state of the records, and one row with the numbers of records read and left out.

    A record is ``unusable`` without run, time or status; a ``trial`` run is one that no report counts. Both are
    counted in the same scan, as rows of the state of their own.
    """
    usable = F.col("run_id").isNotNull() & F.col("t").isNotNull() & F.col("status").isNotNull()
    left_out = F.when(~usable, "unusable").when(L.ignored_run(F.col("run_id")), "trial")
    ok = L.succeeded(F.col("status"))
    keys = {
        "run_id": F.col("run_id"), "b": F.floor(F.col("t") / width).cast("long"), "warm": F.col("t") >= warmup, "backend": F.col("backend"),
        "ok": ok, "error_class": L.error_class(F.col("err"), F.col("status")), "ms": F.col("ms"),
    }
    tagged = records.withColumn("_out", left_out)
    state = tagged.groupBy("_out", *[F.when(F.col("_out").isNull(), c).alias(n) for n, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("dup"), 1)).alias("dups"),
        F.count(F.when((F.col("kind") == "send") & (F.col("attempts") > 1), 1)).alias("retried"),
        F.min(F.when(F.col("active") != 0, F.col("active"))).alias("active_min"),
        F.max("active").alias("active_max"),
    )
    state = cut(state)
    zero = F.lit(0).cast("long")
    counters = state.agg(
        F.lit("records").alias("input"), F.coalesce(F.sum("n"), zero).alias("records"),
        *[F.coalesce(F.sum(F.when(F.col("_out") == why, F.col("n"))), zero).alias(why) for why in ("unusable", "trial")],
    )
    return state.filter("_out is null").drop("_out"), counters


def _n(cond: Column | None = None, what: str = "n") -> Column:
    return F.sum(F.col(what) if cond is None else F.when(cond, F.col(what)).otherwise(0))


def summaries(state: DataFrame, duration: float, warmup: float, dropped: DataFrame | None = None) -> DataFrame:
    """The run summary from the state, with dropped arrivals (``run_id, dropped``) and the load really offered."""
    ok, span = F.col("ok"), duration - warmup
    warm = state.filter("warm")
    weight = F.when(ok & F.col("ms").isNotNull(), F.col("n"))
    mean = F.try_divide(F.sum(weight * F.col("ms")), F.sum(weight))
    spread = F.try_divide(F.sum(weight * F.col("ms") * F.col("ms")), F.sum(weight)) - mean * mean
    zero = F.lit(0.0)
    base = warm.groupBy("run_id").agg(
        _n().alias("total"), _n(ok).alias("success"), _n(~ok).alias("errors"), _n(what="retried").alias("retried"), _n(what="dups").alias("dups"),
        F.coalesce(mean, zero).alias("mean"), F.sqrt(F.greatest(F.coalesce(spread, zero), zero)).alias("stddev"),
        F.coalesce(F.min(F.when(ok, F.col("ms"))), zero).alias("min"), F.coalesce(F.max(F.when(ok, F.col("ms"))), zero).alias("max"),
        F.coalesce(F.min("active_min"), F.lit(0)).alias("active_min"),
        F.coalesce(F.max(F.nullif("active_max", F.lit(0))), F.lit(0)).alias("active_max"),
    )
    points = O.percentiles_floor_n(warm.filter("ok"), ["run_id"], "ms", R.LATENCY_POINTS, weight="n").drop("n")
    out = base.join(points, "run_id", "left")
    out = out.join(dropped.select("run_id", "dropped"), "run_id", "left") if dropped is not None else out.withColumn("dropped", F.lit(None).cast("long"))
    rps = F.round(F.col("success") / F.lit(span), 2) if span else zero
    offered = F.round((F.col("total") + F.coalesce("dropped", F.lit(0))) / F.lit(max(1.0, span)), 4)
    return out.select(
        "run_id", "total", "success", "errors", F.round(F.col("errors") / F.col("total") * 100, 3).alias("error_pct"), rps.alias("rps"), offered.alias("offered"),
        "retried", "dups", F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"), *[F.round(c, 2).alias(c) for c in ("mean", "stddev", "min", "max")],
        *[F.round(F.coalesce(c, zero), 2).alias(c) for c in R.LATENCY_POINTS], "active_min", "active_max",
    )


def buckets(state: DataFrame, duration: float, width: float, digits: int = 6) -> DataFrame:
    """Every bucket of every run, from the state."""
    ok = F.col("ok")
    weight = F.when(ok & F.col("ms").isNotNull(), F.col("n"))
    at = ["run_id", "b"]
    facts = state.groupBy(*at).agg(
        _n().alias("requests"), _n(ok).alias("ok"), _n(~ok).alias("errors"), _n(what="dups").alias("dups"),
        F.try_divide(F.sum(weight * F.col("ms")), F.sum(weight)).alias("mean"), F.max("active_max").alias("active"),
    )
    points = O.percentiles_floor_n(state.filter("ok"), at, "ms", {"p50": 50.0, "p95": 95.0}, weight="n").drop("n")
    share = state.groupBy(*at, "backend").agg(_n().alias("n")).groupBy(*at)
    share = share.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("backend", "n")))).alias("by_backend"))
    return R.fill_buckets(facts, points, share, duration, width, digits)


def machine_load(samples: DataFrame) -> DataFrame:
    """Per run: mean CPU of the balancer ``sys1``, of the backends, and their spread, from the utilisation samples."""
    mean = samples.groupBy("run_id", "system").agg(F.round(F.avg("cpu_pct"), 1).alias("cpu"))
    backend = F.when(F.col("system") != "sys1", F.col("cpu"))
    return mean.groupBy("run_id").agg(
        F.max(F.when(F.col("system") == "sys1", F.col("cpu"))).alias("sys1_cpu"), F.avg(backend).alias("backend_cpu"),
        (F.max(backend) - F.min(backend)).alias("cpu_spread"),
    )


def run_report(
    records: DataFrame, samples: DataFrame, duration: float, warmup: float = 0.0, width: float = 1.0,
    phases: DataFrame | None = None, dropped: DataFrame | None = None, family: str = "L", sweeps: tuple[str, str] = ("THR", "THRLOW"),
) -> dict[str, DataFrame]:
    """The tables of a report by name.

    ``counters`` (records read and left out), ``summary``, ``errors`` and ``distribution`` per run, ``medians`` and
    ``best`` over repetitions, ``speed_up`` of the ``family``, ``sweep`` with costs and CPU of the swept ``sweeps``, ``choice``,
    ``buckets`` and, with ``phases(run_id, phase, t0, t1)``, ``phases`` and ``phase_share``. A bucket belongs to the phase
    that its start lies in. Records are read once.
    """
    state, counters = run_state(records, width, warmup)
    machines = cut(machine_load(samples))
    dist = cut(state.groupBy("run_id", "backend").agg(_n().alias("n")))
    summary = summaries(state, duration, warmup, dropped).join(R.busiest_share(dist, ["run_id"]), "run_id", "left")
    summary = cut(summary.join(machines, "run_id", "left"))
    runs = cut(R.classify(summary))
    medians = cut(R.median_over_reps(runs, MEDIANS, ("retried", "dups", "dropped")))
    first, second = sweeps
    swept = R.sweep_table(runs.filter(F.col("config").isin(first, second)), values=(*R.SWEPT, "sys1_cpu", "backend_cpu"))
    costed = cut(R.combine_levels(R.sweep_cost(swept), first, second, digits=6))
    series = cut(buckets(state, duration, width))
    out = {
        "counters": counters,
        "summary": summary,
        "errors": state.filter("error_class is not null").groupBy("run_id", "error_class").agg(_n().alias("n")),
        "distribution": R.merge_distributions(dist, ["run_id"]),
        "medians": medians,
        "best": R.best_repetition(runs, ["config", "param"]),
        "speed_up": R.speed_up(medians, family).select("config", "param", "rps", "speed_up"),
        "sweep": costed,
        "choice": R.cheapest(costed).filter("param is not null"),
        "buckets": series.drop("by_backend"),
    }
    if phases is not None:
        out["phases"] = R.phase_table(series, phases)
        inside = (F.col("b") * F.lit(width) >= F.col("t0")) & (F.col("b") * F.lit(width) < F.col("t1"))
        hit = attach(state.groupBy("run_id", "b", "backend").agg(_n().alias("n")), phases.select("run_id", "phase", "t0", "t1"), ["run_id"])
        hit = hit.filter(inside).groupBy("run_id", "phase", "backend").agg(_n().alias("n"))
        out["phase_share"] = R.merge_distributions(hit, ["run_id", "phase"])
    return out


def long_form(tables: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """All tables under each other: ``section, item, metric, value``; texts name the item, numbers are metrics."""
    parts = []
    for name, df in tables.items():
        texts = [c for c in NAMING if c in df.columns and (c != "t" or name == "buckets")]
        numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double") and c not in texts]
        item = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in texts])
        value = lambda c: F.round(F.col(c).cast("double"), digits)
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), value(c).alias("value")) for c in numbers]))
        parts.append(df.select(F.lit(name).alias("section"), item.alias("item"), pairs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
