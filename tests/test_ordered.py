import numpy as np
from pyspark.sql import functions as F

from rillwork.operators import ordered as O


def _skewed(spark, n=3000):
    """One key with a third of the rows, many ties, negatives and zeros."""
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n))
    v = np.where(rng.random(n) < 0.3, 7.25, np.round(rng.normal(0, 50, n), 2))
    v[rng.random(n) < 0.02] = 0.0
    return keys, v, spark.createDataFrame(list(zip(keys.tolist(), range(n), v.tolist())), "k long, t long, v double")


def test_floor_percentiles_match_sorting(spark):
    keys, v, df = _skewed(spark)
    got = {r["k"]: r for r in O.percentiles_floor_n(df, ["k"], "v", {"p50": 50.0, "p95": 95.0, "p100": 100.0}).collect()}
    alt = {r["k"]: r for r in O.percentiles_floor_n1(df, ["k"], "v", {"p90": 0.9}).collect()}
    for k in set(keys.tolist()):
        s = np.sort(v[keys == k])
        n = len(s)
        assert got[k]["n"] == n
        for name, p in (("p50", 50), ("p95", 95), ("p100", 100)):
            assert got[k][name] == s[min(n - 1, int(p / 100 * n))]
        assert alt[k]["p90"] == s[int(0.9 * (n - 1))]


def test_linear_percentiles_match_numpy(spark):
    keys, v, df = _skewed(spark)
    for r in O.percentiles_linear(df, ["k"], "v", {"a": 0.02, "m": 0.5, "b": 0.98}).collect():
        want = np.percentile(v[keys == r["k"]], [2, 50, 98])
        assert np.allclose([r["a"], r["m"], r["b"]], want)


def test_row_number_running_sum_and_lag_across_buckets(spark):
    keys, v, df = _skewed(spark)
    b = F.floor(F.col("t") / 100)
    rn = O.split_row_number(df, ["k"], b, ["t"], "rn", total="n")
    out = O.split_running_sum(rn, ["k"], b, ["t"], F.col("rn"), "s")
    lag = {(r["k"], r["t"]): r["p"] for r in O.split_lag(df, ["k"], b, ["t"], {"p": "v"}).collect()}
    for k in set(keys.tolist()):
        idx = np.nonzero(keys == k)[0]
        rows = sorted(out.filter(F.col("k") == k).collect(), key=lambda r: r["t"])
        assert [r["rn"] for r in rows] == list(range(1, len(idx) + 1))
        assert rows[-1]["s"] == len(idx) * (len(idx) + 1) // 2 and rows[0]["n"] == len(idx)
        assert lag[(k, idx[0])] is None
        assert all(lag[(k, b_)] == v[a] for a, b_ in zip(idx, idx[1:]))


def test_moving_means_cross_block_borders(spark):
    n = 57
    v = [None if i % 9 == 4 else float(i * i % 23) for i in range(n)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, t long, v double")
    rn = O.split_row_number(df, ["k"], F.floor(F.col("t") / 10), ["t"], "i")
    from pyspark.sql.window import Window as W

    rows, keys = O.with_halo(rn, ["k"], "i", before=4, after=2, size=10)
    w = W.partitionBy(*keys).orderBy("i").rowsBetween(-4, 2)
    got = {r["t"]: r["m"] for r in rows.withColumn("m", F.avg("v").over(w)).filter("_own").collect()}
    assert len(got) == n
    for i in range(n):
        part = [x for x in v[max(0, i - 4) : i + 3] if x is not None]
        assert got[i] is None if not part else abs(got[i] - sum(part) / len(part)) < 1e-9


def test_ewma_equals_the_fold(spark):
    xs = [float((i * 37) % 101) for i in range(400)]
    y = xs[0]
    for x in xs[1:]:
        y = 0.7 * y + 0.3 * x
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(xs)], "k string, t long, x double")
    got = O.ewma(df, ["k"], F.floor(F.col("t") / 64), ["t"], "x", 0.3).first()
    assert abs(got["ewma"] - y) < 1e-9
