import pytest
from pyspark.sql import functions as F

from rillwork.operators import runs as R
from rillwork.plans import report as RP


def _records(spark):
    rows = []
    for rep in (1, 2):
        for k in range(60):
            status = 500 if k % 11 == 0 else 200
            rows.append((f"L1_c25_rep{rep}", k * 0.5, float(10 + (k * 7 + rep) % 20), status, f"sys{2 + k % 3}", "timeout" if k % 22 == 0 else "", 1 + k // 30, k % 10 == 0, 1 + (k % 6 == 0), "send"))
    rows += [("smoke_1", 1.0, 1.0, 200, "sys2", "", 1, False, 1, "send"), (None, 1.0, 1.0, 200, "sys2", "", 1, False, 1, "send"), ("L1_c25_rep1", None, 1.0, 200, "sys2", "", 1, False, 1, "send")]
    rows += rows[:5]
    return spark.createDataFrame(rows, "run_id string, t double, ms double, status int, backend string, err string, active int, dup boolean, attempts int, kind string")


def _samples(spark):
    rows = [(f"L1_c25_rep{r}", f"sys{s}", float(10 * s + r)) for r in (1, 2) for s in (1, 2, 3)]
    return spark.createDataFrame(rows, "run_id string, system string, cpu_pct double")


def test_report_counts_what_it_leaves_out_and_agrees_with_the_summary(spark):
    rec = _records(spark)
    tables = RP.run_report(rec, _samples(spark), 30.0, 5.0, 1.0)
    assert tuple(tables["counters"].first())[1:] == (rec.count(), 2, 1)
    clean = rec.filter("run_id like 'L%' and t is not null")
    want = {r["run_id"]: r.asDict() for r in R.run_summary(clean, 30.0, 5.0).collect()}
    got = {r["run_id"]: r.asDict() for r in tables["summary"].collect()}
    assert set(got) == set(want)
    for run, row in want.items():
        assert all(got[run][c] == (pytest.approx(v) if isinstance(v, float) else v) for c, v in row.items())
        assert got[run]["sys1_cpu"] == pytest.approx(10 + int(run[-1])) and got[run]["cpu_spread"] == pytest.approx(10.0)
    plain = {(r["run_id"], r["t"]): r for r in R.dense_buckets(clean, 30.0, 1.0, 6).collect()}
    for r in tables["buckets"].collect():
        assert all(r[c] == pytest.approx(plain[r["run_id"], r["t"]][c]) for c in ("requests", "ok", "errors", "dups", "active", "mean", "p50", "p95"))


def test_report_reads_the_records_once(spark, tmp_path):
    _records(spark).write.parquet(str(tmp_path / "r"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    source = spark.read.parquet(str(tmp_path / "r"))
    rec = source.mapInArrow(seen, source.schema)
    phases = source.filter("run_id like 'L%'").select("run_id").distinct().select("run_id", F.lit("all").alias("phase"), F.lit(0.0).alias("t0"), F.lit(30.0).alias("t1"))
    tables = RP.run_report(rec, _samples(spark), 30.0, 5.0, 1.0, phases)
    assert RP.long_form(tables).count() > 0
    assert read.value == source.count()


def test_report_of_no_records(spark):
    tables = RP.run_report(_records(spark).limit(0), _samples(spark).limit(0), 30.0)
    assert tuple(tables["counters"].first())[1:] == (0, 0, 0)
    assert all(tables[n].count() == 0 for n in tables if n != "counters")
