"""Order-dependent operators that never gather a whole group in one task.

``row_number`` or a running sum over ``PARTITION BY key`` sorts all rows of a key in one
task, which fails once a key holds a large share of the table. Everything here cuts a key
into ordered buckets first, aggregates per bucket, runs the cumulative step over the few
bucket rows, and finishes inside the buckets. Results are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.session import cut

#: Buckets per factor of two used to narrow an order statistic: coarse, then fine.
BUCKET_LEVELS = (64, 1 << 20)
_SHIFT = 1100


def value_bucket(value: Column, steps: int) -> Column:
    """Order-preserving bucket of a double: ``steps`` buckets per factor of two."""
    v = value.cast("double")
    size = F.floor((F.log2(F.abs(v)) + F.lit(_SHIFT)) * F.lit(steps))
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def split_row_number(
    df: DataFrame,
    part: Sequence[str],
    bucket: Column,
    order: Sequence,
    out: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Exact ``row_number() over (part order by order)``; ``bucket`` must grow with ``order``.

    ``total`` names an extra column with the size of the part, which the bucket counts give free.
    """
    part = list(part)
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*part).orderBy("_b")) - F.col("_n")
    size = [F.sum("_n").over(W.partitionBy(*part)).alias(total)] if total else []
    offsets = counts.select(*part, "_b", before.alias("_off"), *size)
    inner = F.row_number().over(W.partitionBy(*part, "_b").orderBy(*order))
    return (
        b.withColumn("_rn", inner)
        .join(offsets, [*part, "_b"])
        .withColumn(out, F.col("_off") + F.col("_rn"))
        .drop("_b", "_off", "_rn")
    )


def range_row_number(df: DataFrame, order: Sequence[str], out: str = "rn") -> DataFrame:
    """Exact ``row_number() over (order by order)``: rows are dealt in ranges of ``order`` and counted by range."""
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    return split_row_number(dealt, [], F.col("_range"), order, out).drop("_range")


def split_running_sum(
    df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence, value: Column, out: str
) -> DataFrame:
    """Exact running sum over ``part`` ordered by ``order``, cut into buckets."""
    part = list(part)
    b = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = b.groupBy(*part, "_b").agg(F.sum("_v").alias("_s"))
    wk = W.partitionBy(*part).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*part, "_b", F.coalesce(F.sum("_s").over(wk), F.lit(0)).alias("_off"))
    wi = W.partitionBy(*part, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        b.withColumn("_in", F.sum("_v").over(wi))
        .join(offsets, [*part, "_b"])
        .withColumn(out, F.col("_off") + F.col("_in"))
        .drop("_b", "_v", "_in", "_off")
    )


def with_halo(
    df: DataFrame, part: Sequence[str], rn: str, before: int, after: int, size: int = 65_536
) -> tuple[DataFrame, list[str]]:
    """Cut numbered rows into blocks that also hold their neighbours' edge rows.

    Returns the rows and the window keys. A frame reaching at most ``before`` rows back and
    ``after`` rows forward is then exact inside a block; keep rows where ``_own`` is true.
    """
    i = F.col(rn) - 1
    own = F.floor(i / size)
    first = F.floor((i - after) / size)
    last = F.floor((i + before) / size)
    out = df.withColumn("_blk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return out.withColumn("_own", F.col("_blk") == own), [*part, "_blk"]


def split_lag(
    df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence, cols: Mapping[str, str]
) -> DataFrame:
    """``lag(col)`` for each ``{out: col}`` over ``part`` ordered by ``order``, in blocks."""
    numbered = split_row_number(df, part, bucket, order, "_i")
    rows, keys = with_halo(numbered, part, "_i", before=1, after=0)
    w = W.partitionBy(*keys).orderBy("_i")
    for out, col in cols.items():
        rows = rows.withColumn(out, F.lag(col).over(w))
    return rows.filter("_own").drop("_own", "_blk", "_i")


def order_statistics(
    df: DataFrame,
    part: Sequence[str],
    value: str,
    picks: Mapping[str, Callable[[Column], Column]],
    levels: Sequence[int] = BUCKET_LEVELS,
    weight: str | None = None,
) -> DataFrame:
    """Exact order statistics per key.

    ``picks`` maps an output name to a function of the group size giving a 0-based index into
    the ascending values. One row per key with ``n`` and the picked values; nulls are skipped.
    Equal values are counted before the shuffle, and each narrowing level keeps only the
    buckets that hold a wanted index. Pass ``levels=()`` only for an input known to be small: it
    ranks each key directly. ``weight`` names a column with the number of times a row counts.
    """
    part = list(part)
    rows = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*part, F.col(value).alias("_os_x"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_os_c"))
    )
    if not levels:
        w = W.partitionBy(*part)
        ranked = rows.withColumn("n", F.sum("_os_c").over(w)).withColumn(
            "_os_hi", F.sum("_os_c").over(w.orderBy("_os_x"))
        )
        lo, hi = F.col("_os_hi") - F.col("_os_c"), F.col("_os_hi")
        hits = {name: fn(F.col("n")).cast("long") for name, fn in picks.items()}
        return ranked.groupBy(*part).agg(
            F.first("n").alias("n"),
            *[F.max(F.when((lo <= at) & (at < hi), F.col("_os_x"))).alias(name) for name, at in hits.items()],
        )
    keys: list[str] = []
    sized = rows
    for level, steps in enumerate(levels):
        col = f"_os_b{level}"
        sized = sized.withColumn(col, value_bucket(F.col("_os_x"), steps))
        counts = sized.groupBy(*part, *keys, col).agg(F.sum("_os_c").alias("_os_m"))
        if level:
            counts = counts.join(targets, [*part, *keys])  # noqa: F821 - bound on level 0
        tag = ["_os_pick"] if level else []
        w = W.partitionBy(*part, *keys, *tag)
        counts = counts.withColumn(
            "_os_lo", F.sum("_os_m").over(w.orderBy(col)) - F.col("_os_m")
        )
        if not level:
            counts = counts.withColumn("n", F.sum("_os_m").over(W.partitionBy(*part))).withColumn(
                "_os_p",
                F.explode(
                    F.array(
                        *[
                            F.struct(
                                F.lit(name).alias("pick"), fn(F.col("n")).cast("long").alias("at")
                            )
                            for name, fn in picks.items()
                        ]
                    )
                ),
            )
            counts = counts.select("*", F.col("_os_p.pick").alias("_os_pick"), F.col("_os_p.at").alias("_os_at"))
        targets = counts.filter(
            (F.col("_os_lo") <= F.col("_os_at")) & (F.col("_os_at") < F.col("_os_lo") + F.col("_os_m"))
        ).select(*part, *keys, col, "n", "_os_pick", (F.col("_os_at") - F.col("_os_lo")).alias("_os_at"))
        keys.append(col)
    w = W.partitionBy(*part, *keys, "_os_pick").orderBy("_os_x")
    hit = (
        sized.join(targets, [*part, *keys])
        .withColumn("_os_hi", F.sum("_os_c").over(w))
        .filter((F.col("_os_hi") > F.col("_os_at")) & (F.col("_os_hi") - F.col("_os_c") <= F.col("_os_at")))
    )
    return hit.groupBy(*part).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_os_pick") == name, F.col("_os_x"))).alias(name) for name in picks],
    )


def percentiles_floor_n(
    df: DataFrame, part: Sequence[str], value: str, points: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Percentile as ``sorted[min(n-1, int(p/100*n))]``."""
    picks = {
        name: (lambda n, p=p: F.least(n - 1, F.floor(F.lit(p) / F.lit(100) * n)))
        for name, p in points.items()
    }
    return order_statistics(df, part, value, picks, weight=weight)


def percentiles_floor_n1(
    df: DataFrame, part: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """Percentile as ``sorted[int(q*(n-1))]``."""
    picks = {name: (lambda n, q=q: F.floor(F.lit(q) * (n - 1))) for name, q in points.items()}
    return order_statistics(df, part, value, picks)


def percentiles_linear(
    df: DataFrame, part: Sequence[str], value: str, points: Mapping[str, float], levels: Sequence[int] = BUCKET_LEVELS
) -> DataFrame:
    """Percentile with linear interpolation between the two neighbouring ranks."""
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, q in points.items():
        picks[f"_{name}_lo"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1))
        picks[f"_{name}_hi"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    got = order_statistics(df, part, value, picks, levels)
    for name, q in points.items():
        at = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        got = got.withColumn(name, lo + (hi - lo) * (at - F.floor(at))).drop(lo, hi)
    return got.select(*part, "n", *points)


def medians(df: DataFrame, part: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Null-skipping median of several columns per key, in one pass over a long table.

    The input is materialised once, then narrowed bucket by bucket like every order statistic here.
    """
    part = list(part)
    df = cut(df.select(*part, *values))
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(v).alias("m"), F.col(v).cast("double").alias("x")) for v in values]
        )
    )
    long = df.select(*part, pairs.alias("_p")).select(*part, F.col("_p.m").alias("_m"), F.col("_p.x").alias("_v"))
    got = percentiles_linear(long, [*part, "_m"], "_v", {"_med": 0.5})
    return got.groupBy(*part).agg(
        *[F.max(F.when(F.col("_m") == v, F.col("_med"))).alias(v) for v in values]
    )


def trailing_mean(
    df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence, value: str, k: int, out: str
) -> DataFrame:
    """Mean of this row and up to ``k - 1`` before it, nulls skipped, empty counts as 0."""
    numbered = split_row_number(df, part, bucket, order, "_i")
    rows, keys = with_halo(numbered, part, "_i", before=k - 1, after=0)
    w = W.partitionBy(*keys).orderBy("_i").rowsBetween(-(k - 1), 0)
    rows = rows.withColumn(out, F.coalesce(F.avg(value).over(w), F.lit(0.0)))
    return rows.filter("_own").drop("_own", "_blk", "_i")


def centred_mean(
    df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence, value: str, k: int, out: str
) -> DataFrame:
    """Mean over ``k // 2`` rows each side; a series shorter than ``k`` stays as it is."""
    part = list(part)
    numbered = split_row_number(df, part, bucket, order, "_i", total="_len")
    rows, keys = with_halo(numbered, part, "_i", before=k // 2, after=k // 2)
    w = W.partitionBy(*keys).orderBy("_i").rowsBetween(-(k // 2), k // 2)
    rows = rows.withColumn("_mean", F.avg(value).over(w)).filter("_own")
    short = (F.col("_len") < k) | F.lit(k <= 1)
    return (
        rows.withColumn(out, F.when(short, F.col(value)).otherwise(F.col("_mean")))
        .drop("_own", "_blk", "_i", "_mean", "_len")
    )


def ewma(
    df: DataFrame, part: Sequence[str], bucket: Column, order: Sequence, value: str, alpha: float
) -> DataFrame:
    """Final exponentially weighted mean per key as a weighted sum.

    The recurrence ``y = (1-a)y + a x`` started at the first sample unrolls to fixed weights by
    distance from the last row, so it aggregates map-side instead of folding a sorted list.
    """
    part = list(part)
    rows = df.filter(F.col(value).isNotNull())
    numbered = split_row_number(rows, part, bucket, order, "_i", total="n")
    back = F.col("n") - F.col("_i")
    weight = F.pow(F.lit(1 - alpha), back) * F.when(F.col("_i") == 1, 1.0).otherwise(alpha)
    return (
        numbered.groupBy(*part).agg(F.sum(weight * F.col(value)).alias("ewma"), F.first("n").alias("n"))
    )
