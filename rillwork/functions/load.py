"""Column functions over request records, load schedules and backend metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def succeeded(status: Column) -> Column:
    """Success as the run summaries count it."""
    return status == 200


def succeeded_2xx(status: Column) -> Column:
    """Success as the ladder counts it: any 2xx."""
    return (status >= 200) & (status < 300)


def error_class(err: Column, status: Column) -> Column:
    """The recorded error, else ``HTTP<status>``; null for a success."""
    name = F.coalesce(F.nullif(err, F.lit("")), F.concat(F.lit("HTTP"), status.cast("string")))
    return F.when(~succeeded(status), name)


def run_config(run_id: Column) -> Column:
    """``struct(config, param, rep)`` read from the run id; nulls where no family matches."""
    load = r"^(L\d|O\d)_[a-z]+(\d+)_rep(\d+)$"
    algo = r"^(ALGO|PALGO)_(.+)_rep(\d+)$"
    sweep = r"^(THR|THRLOW)_t([0-9.]+)_rep(\d+)$"
    public = r"^(P\d|PO\d)_[a-z]+(\d+)_rep(\d+)$"

    def part(group: int) -> Column:
        tries = [F.nullif(F.regexp_extract(run_id, p, group), F.lit("")) for p in (load, algo, sweep, public)]
        return F.coalesce(*tries)

    return F.struct(part(1).alias("config"), part(2).alias("param"), part(3).cast("int").alias("rep"))


def ignored_run(run_id: Column) -> Column:
    """Runs left out of every report."""
    return run_id.rlike("^(local_|smoke_|calibration)")


def real_backend(name: Column) -> Column:
    """Whether a backend label names a real server."""
    return ~(name.startswith("?") | name.startswith("ERR"))


def cpu_load(cpu_pct: Column, sys_cpu_pct: Column, cores: Column, loadavg: Column) -> Column:
    """Busy share of a backend's machine: the worst of CPU, machine CPU and load per core (≤ 4)."""
    cpu = F.greatest(F.coalesce(cpu_pct, F.lit(0.0)), F.coalesce(sys_cpu_pct, F.lit(0.0))) / 100
    per_core = F.coalesce(loadavg, F.lit(0.0)) / F.greatest(F.coalesce(cores, F.lit(1)), F.lit(1))
    return F.greatest(cpu, F.least(per_core, F.lit(4.0)))


def load_index(
    cpu: Column,
    in_flight: Column,
    ewma_ms: Column,
    degraded: Column,
    weight: Column,
    inflight_cap: float,
    rt_cap_ms: float,
    penalty: float = 1.5,
) -> Column:
    """0 idle … 1 saturated: the worst of CPU, queue and latency, penalised when degraded."""
    queue = in_flight / F.lit(max(1.0, inflight_cap))
    lat = F.coalesce(ewma_ms / F.lit(max(1.0, rt_cap_ms)), F.lit(0.0))
    worst = F.greatest(cpu, queue, lat) * F.when(degraded, penalty).otherwise(1.0)
    return worst / F.greatest(weight, F.lit(1))


def adaptive_score(
    cpu: Column, in_flight: Column, ewma_ms: Column, degraded: Column, weight: Column, load_weight: float
) -> Column:
    """Lower is better; a backend without a sample scores 0."""
    s = ewma_ms * (1 + in_flight) * (1 + F.lit(load_weight) * cpu)
    s = s * F.when(degraded, 2.0).otherwise(1.0) / F.greatest(weight, F.lit(1))
    return F.coalesce(s, F.lit(0.0))


def ramp_steps(spec: Column) -> Column:
    """``"25:40,50:40"`` to ``array<struct<step,users,t0,t1>>``."""
    parts = F.transform(
        F.split(spec, ","),
        lambda p, i: F.struct(
            i.cast("int").alias("step"),
            F.split(F.trim(p), ":")[0].cast("int").alias("users"),
            F.split(F.trim(p), ":")[1].cast("double").alias("secs"),
        ),
    )

    def start(step: Column) -> Column:
        earlier = F.filter(parts, lambda x: x["step"] < step)
        return F.aggregate(earlier, F.lit(0.0), lambda acc, x: acc + x["secs"])

    return F.transform(
        parts,
        lambda p: F.struct(
            p["step"].alias("step"),
            p["users"].alias("users"),
            start(p["step"]).alias("t0"),
            (start(p["step"]) + p["secs"]).alias("t1"),
        ),
    )


def users_at(t: Column, steps: Column, default: Column) -> Column:
    """Users of the last step that has started by second ``t``."""
    started = F.filter(steps, lambda s: s["t0"] <= t)
    return F.coalesce(F.try_element_at(started, F.lit(-1))["users"], default)
