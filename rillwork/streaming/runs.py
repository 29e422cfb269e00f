"""Live run analytics: buckets with bounded lateness, running metrics, health, counters, balance.

State functions read a key's rows of one micro-batch in order. How many that can be is set by
the source's ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``, never by the whole stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rillwork.functions.hydro import PAN_EVAPORATION


def request_buckets(stream: DataFrame, width: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Requests, successes, errors and mean latency per run and tumbling window of event time ``at``."""
    ok = F.col("status") == 200
    return (
        stream.withWatermark("at", late)
        .groupBy("run_id", F.window("at", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count(F.when(ok, 1)).alias("ok"),
            F.count(F.when(~ok, 1)).alias("errors"),
            F.avg(F.when(ok, F.col("ms"))).alias("mean"),
        )
        .select("run_id", F.col("w.start").alias("start"), "requests", "ok", "errors", "mean")
    )


def session_expiry(stream: DataFrame, ttl: str = "30 minutes") -> DataFrame:
    """Session windows per user: a session ends ``ttl`` after its last event, and its state with it."""
    return (
        stream.withWatermark("at", ttl)
        .groupBy("user_id", F.session_window("at", ttl).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    )


def _rows(pdfs: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of this micro-batch in order."""
    return pd.concat(list(pdfs), ignore_index=True).sort_values(order, kind="stable")


def backend_metrics(stream: DataFrame, alpha: float = 0.2, keep: int = 500) -> DataFrame:
    """Per backend and micro-batch: running EWMA, request count, p50/p95/p99 of the last ``keep``."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ewma, n, last = state.get if state.exists else (None, 0, [])
        ewma = None if n == 0 else ewma
        last = list(last)
        for ms in _rows(pdfs, ["t"])["ms"]:
            ewma = float(ms) if ewma is None else (1 - alpha) * ewma + alpha * float(ms)
            last.append(float(ms))
            n += 1
        last = last[-keep:]
        state.update((ewma, n, last))
        ranked = sorted(last)
        pick = [ranked[min(len(ranked) - 1, int(p / 100 * len(ranked)))] for p in (50, 95, 99)]
        yield pd.DataFrame({"backend": [key[0]], "n": [n], "ewma": [ewma], "p50": [pick[0]], "p95": [pick[1]], "p99": [pick[2]]})

    return stream.groupBy("backend").applyInPandasWithState(
        step,
        "backend string, n long, ewma double, p50 double, p95 double, p99 double",
        "ewma double, n long, last array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


UP, DEGRADED, DOWN = "UP", "DEGRADED", "DOWN"
#: What a state makes of an observation: next state and event; whatever is not listed changes nothing.
TRANSITIONS = {
    (UP, "slow"): (DEGRADED, "degraded"),
    (UP, "timeout"): (DEGRADED, "degraded"),
    (DEGRADED, "good"): (UP, "recovered"),
    (UP, "failed"): (DOWN, "ejected"),
    (DEGRADED, "failed"): (DOWN, "ejected"),
    (DOWN, "good again"): (UP, "readmitted"),
    (DOWN, "slow again"): (DEGRADED, "readmitted"),
}


def observe(probes: pd.DataFrame, before: dict[str, tuple[int, int]], fail: int, rise: int, slow_ms: float, hot_pct: float) -> pd.DataFrame:
    """Probes with their run lengths and what each says: good, slow, timeout, failing, failed.

    ``fine`` counts answers in a row, ``bad`` refusals since the last answer, both going on from
    ``before``; ``again`` marks an answer that completes ``rise``.
    """
    p = probes.reset_index(drop=True)
    ok, refused = p["outcome"].eq("ok"), ~p["outcome"].isin(["ok", "timeout"])
    who = p["backend"]
    start_fine, start_bad = (who.map(lambda b, i=i: before.get(b, (0, 0))[i]) for i in (0, 1))
    by = lambda mask: (~mask).groupby(who).cumsum()  # noqa: E731 - blocks that end where the mask fails
    block = by(ok)
    p["fine"] = ok.astype(int).groupby([who, block]).cumsum() + start_fine.where(block.eq(0), 0)
    p.loc[~ok, "fine"] = 0
    answers = ok.groupby(who).cumsum()
    p["bad"] = refused.astype(int).groupby([who, answers]).cumsum() + start_bad.where(answers.eq(0), 0)
    slow = (p["ms"] > slow_ms) | (p["cpu_pct"] >= hot_pct)
    said = pd.Series("failing", index=p.index)
    said[refused & (p["bad"] >= fail)] = "failed"
    said[p["outcome"].eq("timeout")] = "timeout"
    said[ok & slow], said[ok & ~slow] = "slow", "good"
    return p.assign(said=said, again=ok & (p["fine"] >= rise))


def apply_transitions(seen: pd.DataFrame, states: dict[str, str]) -> list[tuple[float, str, str, str]]:
    """Walk observed probes through ``TRANSITIONS``, keeping ``states`` up to date: (t, backend, event, state).

    An ejection needs another backend that still takes requests.
    """
    events = []
    for t, backend, said, again in zip(seen["t"], seen["backend"], seen["said"], seen["again"]):
        state = states.setdefault(backend, UP)
        if state == DOWN and again:
            said = f"{said} again"
        move = TRANSITIONS.get((state, said))
        if move and (move[0] != DOWN or any(s != DOWN for b, s in states.items() if b != backend)):
            states[backend] = move[0]
            events.append((t, backend, move[1], move[0]))
    return events


def health_events(
    stream: DataFrame, fail: int = 2, rise: int = 2, slow_ms: float = 1500.0, hot_pct: float = 95.0
) -> DataFrame:
    """Transition events from ``probes(pool, t, backend, outcome, ms, cpu_pct)``.

    Keyed by pool, since keeping the last routable backend needs the pool's other members. Run lengths
    are counted on whole columns; only the transitions themselves are walked.
    """

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, states, fine, bad = state.get if state.exists else ([], [], [], [])
        held = dict(zip(names, states))
        seen = observe(_rows(pdfs, ["t", "backend"]), dict(zip(names, zip(fine, bad))), fail, rise, slow_ms, hot_pct)
        out = [(key[0], *e) for e in apply_transitions(seen, held)]
        runs = dict(zip(names, zip(fine, bad))) | {r.backend: (int(r.fine), int(r.bad)) for r in seen.groupby("backend").tail(1).itertuples()}
        state.update((list(held), list(held.values()), [runs[b][0] for b in held], [runs[b][1] for b in held]))
        yield pd.DataFrame(out, columns=["pool", "t", "backend", "event", "state"])

    return stream.groupBy("pool").applyInPandasWithState(
        step,
        "pool string, t double, backend string, event string, state string",
        "names array<string>, states array<string>, fine array<int>, bad array<int>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def counter_rates(stream: DataFrame, cores: float, cap: float | None = None) -> DataFrame:
    """CPU % between consecutive readings of ``samples(run_id, system, t, usage)``.

    The state is the latest reading, so a late one never moves it back: it comes out with ``late`` and no
    rate. Rates are clipped to ``[0, cap]`` where ``cap`` is given, and then marked ``clipped``.
    """
    top = float("inf") if cap is None else cap

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _rows(pdfs, ["t"])
        t0, u0 = state.get if state.exists else (None, None)
        late = rows["t"] <= t0 if state.exists else rows["t"].isna()
        new = rows[~late].drop_duplicates("t")
        if len(new):
            was_t, was_u = (new[c].shift(fill_value=np.nan if x is None else x) for c, x in (("t", t0), ("usage", u0)))
            rate = (new["usage"] - was_u) / (new["t"] - was_t) / cores * 100
            made = pd.DataFrame({"t": new["t"], "cpu_pct": rate.clip(0.0, top), "late": False, "clipped": (rate < 0) | (rate > top)})[rate.notna()]
            state.update((float(new["t"].iloc[-1]), float(new["usage"].iloc[-1])))
            if len(made):
                yield made.assign(run_id=key[0], system=key[1])[["run_id", "system", "t", "cpu_pct", "late", "clipped"]]
        if late.any():
            yield pd.DataFrame({"run_id": key[0], "system": key[1], "t": rows.loc[late, "t"], "cpu_pct": np.nan, "late": True, "clipped": False})

    return stream.groupBy("run_id", "system").applyInPandasWithState(
        step,
        "run_id string, system string, t double, cpu_pct double, late boolean, clipped boolean",
        "t double, usage double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def water_levels(stream: DataFrame, seepage_mm: float = 2.0, slope: float = 2.0) -> DataFrame:
    """Storage after each day of ``days(site, day, inflow, length, width, depth)``, carried per site."""

    def area(length: float, width: float, depth: float, level: float) -> float:
        h = min(max(level, 0.0), depth)
        inset = 2 * slope * (depth - h)
        return (length - inset) * (width - inset)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = state.get[0] if state.exists else 0.0
        out = []
        for r in _rows(pdfs, ["day"]).itertuples():
            a1, a2 = r.length * r.width, max(r.length - 2 * slope * r.depth, 0) * max(r.width - 2 * slope * r.depth, 0)
            cap = r.depth / 3.0 * (a1 + a2 + (a1 * a2) ** 0.5)
            wet = area(r.length, r.width, r.depth, r.depth * (s / cap) ** 0.5) if s > 0 and cap > 0 else 0.0
            loss = (0.7 * PAN_EVAPORATION[r.day.month - 1] + seepage_mm) / 1000.0 * wet
            raw = max(s + r.inflow - loss, 0.0)
            s = min(raw, cap)
            out.append((key[0], r.day, s, raw - s))
        state.update((float(s),))
        yield pd.DataFrame(out, columns=["site", "day", "storage_m3", "overflow_m3"])

    return stream.groupBy("site").applyInPandasWithState(
        step, "site long, day date, storage_m3 double, overflow_m3 double", "storage double", "append", GroupStateTimeout.NoTimeout
    )


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run a stream over everything available into ``path``, one folder per micro-batch."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
