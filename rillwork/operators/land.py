"""Land rules as named columns, parcels, suitability, and criterion weights."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.operators import tiles as TI
from rillwork.operators.ordered import split_row_number
from rillwork.session import attach, cut


@dataclass(frozen=True)
class Rule:
    """A boolean column with the names of the leaves it is made of."""

    column: Column
    leaves: tuple[tuple[str, Column], ...]

    @classmethod
    def of(cls, name: str, column: Column) -> Rule:
        """A single named rule."""
        return cls(column, ((name, column),))

    @property
    def names(self) -> list[str]:
        """Names of all leaves in order."""
        return [n for n, _ in self.leaves]

    def __and__(self, other: Rule) -> Rule:
        return Rule(self.column & other.column, self.leaves + other.leaves)

    def __or__(self, other: Rule) -> Rule:
        return Rule(self.column | other.column, self.leaves + other.leaves)

    def __invert__(self) -> Rule:
        return Rule(~self.column, tuple((f"not ({n})", ~c) for n, c in self.leaves))

    def rejected_by(self) -> Column:
        """Names of the leaves a row fails."""
        return F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in self.leaves]))


def slope_under(limit: float) -> Rule:
    """Slope at or below a limit in per cent."""
    return Rule.of(f"slope < {limit:g} %", F.col("slope_pct") <= limit)


def within_distance(column: str, metres: float, label: str) -> Rule:
    """Distance column at most ``metres``; a null distance means nothing is near."""
    return Rule.of(f"within {metres:g} m of {label}", F.coalesce(F.col(column) <= metres, F.lit(False)))


def distance_band(column: str, any_column: str, lo: float, hi: float) -> Rule:
    """Between ``lo`` and ``hi`` metres; everything passes when the map holds no such place."""
    inside = F.coalesce(F.col(column).between(lo, hi), F.lit(False))
    return Rule.of(f"{lo:g}-{hi:g} m from habitation", inside | ~F.col(any_column))


def class_in(codes: Sequence[int], label: str) -> Rule:
    """Land-cover class in a set."""
    return Rule.of(f"land cover in {label}", F.col("code").isin(*codes))


def min_upstream(area_m2: float, cell_size: float) -> Rule:
    """At least this much area drains through the cell."""
    cells = max(1, round(area_m2 / cell_size**2))
    return Rule.of(f"upstream area >= {area_m2 / 1e4:g} ha", F.col("acc") >= cells)


def open_ownership(column: str = "own") -> Rule:
    """Unknown, government or community land; no record counts as unknown."""
    return Rule.of(
        "government or community land (or ownership unknown)", F.coalesce(F.col(column), F.lit(0)).isin(0, 1, 2)
    )


def near_masks(cells: DataFrame, keys: Sequence[str], masks: dict[str, float], cell_size: float) -> DataFrame:
    """Add ``d_<mask>`` in metres (exact up to its reach, null beyond) and ``any_<mask>``."""
    keys = list(keys)
    out = cut(cells)
    flags = out.groupBy(*keys).agg(*[F.coalesce(F.max(m), F.lit(False)).alias(f"any_{m}") for m in masks])
    for m, reach in masks.items():
        steps = int(-(-reach // cell_size))
        d = TI.mask_distance(out.select(*keys, "row", "col", m), keys, m, steps).drop(m)
        out = out.join(d, [*keys, "row", "col"]).withColumn(f"d_{m}", F.sqrt("d2") * F.lit(cell_size)).drop("d2")
    return attach(out, flags, keys)


def contiguous(cells: DataFrame, keys: Sequence[str], rule: Rule, min_m2: float, cell_size: float) -> DataFrame:
    """Cells passing ``rule`` in groups of at least ``min_m2``, with their group ``label``."""
    ok = cells.filter(rule.column).select(*keys, "row", "col", "cell")
    lab = cut(TI.label_components(ok, keys))
    return TI.keep_large(lab, keys, min_m2 / cell_size**2)


def parcels(eligible: DataFrame, keys: Sequence[str], cell_area: float) -> DataFrame:
    """Facts per eligible group: number, area, mean slope, dominant class (lowest on ties)."""
    keys = list(keys)
    by_class = eligible.groupBy(*keys, "label", "code").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("slope_pct").alias("_s")
    )
    p = by_class.groupBy(*keys, "label").agg(
        F.sum("_n").alias("cells"),
        (F.sum("_s") / F.sum("_n")).alias("mean_slope_pct"),
        F.max_by("code", F.struct(F.col("_n"), -F.col("code"))).alias("code"),
    )
    p = split_row_number(p, keys, F.floor(F.col("label") / (1 << 20)), ["label"], "number")
    return p.withColumn("area_ha", F.col("cells") * F.lit(cell_area / 1e4))


#: Mean random consistency index by matrix size; larger matrices take the last.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}
ACCEPTABLE_CR = 0.10


def pairwise_weights(judgements: DataFrame, rounds: int = 100) -> DataFrame:
    """Weights of pairwise judgements for many judges at once.

    ``judgements(judge, i, j, a)``. The matrix of one judge is as large as its criteria list, so
    each is folded in place: power iteration over its rows. Gives ``criterion, weight, lambda_max,
    ci, cr`` per judge.
    """
    rows = judgements.groupBy("judge", "i").agg(F.sort_array(F.collect_list(F.struct("j", "a"))).alias("_r"))
    m = rows.groupBy("judge").agg(F.sort_array(F.collect_list(F.struct("i", F.transform("_r", lambda x: x["a"]).alias("a")))).alias("m"))
    n = F.size("m")
    start = F.transform("m", lambda _: F.lit(1.0) / n)

    def dot(row: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(row, v, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    def once(v: Column) -> Column:
        w = F.transform("m", lambda r: dot(r["a"], v))
        return F.transform(
            F.array(w), lambda q: F.transform(q, lambda x: x / F.aggregate(q, F.lit(0.0), lambda acc, y: acc + y))
        )[0]

    vec = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda v, _: once(v))
    out = m.withColumn("v", vec)
    # after normalising, the sum of M v is the eigenvalue
    lam = F.aggregate(F.transform("m", lambda r: dot(r["a"], F.col("v"))), F.lit(0.0), lambda acc, x: acc + x)
    table = F.array(*[F.lit(RANDOM_INDEX[k]) for k in sorted(RANDOM_INDEX)])
    ri = F.element_at(table, F.least(n, F.lit(len(RANDOM_INDEX))))
    ci = F.when(n > 1, (F.col("lambda_max") - n) / (n - 1)).otherwise(0.0)
    cr = F.when(ri > 0, F.col("ci") / ri).otherwise(0.0)
    # a vector that still moves is an error, not an answer
    off = F.aggregate(F.zip_with(F.transform("m", lambda r: dot(r["a"], F.col("v"))), "v", lambda x, y: F.abs(x - lam * y)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    lam = F.when(off <= 1e-6 * lam, lam).otherwise(F.raise_error(F.lit("the weights did not converge")).cast("double"))
    out = out.withColumn("lambda_max", lam).withColumn("ci", ci).withColumn("cr", cr)
    return out.select("judge", "lambda_max", "ci", "cr", F.posexplode("v").alias("_k", "weight"), "m").select(
        "judge", F.col("m")[F.col("_k")]["i"].alias("criterion"), "weight", "lambda_max", "ci", "cr"
    )


def valid_judgements(judgements: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Judges whose matrix is positive, reciprocal and has ones on the diagonal."""
    t = judgements.select("judge", F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("_t"))
    bad = judgements.join(t, ["judge", "i", "j"], "left").filter(
        (F.col("a") <= 0) | F.col("_t").isNull() | (F.abs(F.col("a") * F.col("_t") - 1) > tolerance)
    )
    return judgements.join(bad.select("judge").distinct(), "judge", "left_anti")


def otsu(pixels: DataFrame, keys: Sequence[str], byte: str) -> DataFrame:
    """Threshold of greatest between-class variance over the 256-bin histogram, per key."""
    keys = list(keys)
    h = pixels.groupBy(*keys, byte).agg(F.count(F.lit(1)).alias("_n"))  # at most 256 rows per key
    w = W.partitionBy(*keys)
    cum = w.orderBy(byte).rowsBetween(W.unboundedPreceding, 0)
    n, x = F.col("_n"), F.col(byte)
    h = h.select(
        *keys, byte,
        F.sum(n).over(cum).alias("_w0"), F.sum(n * x).over(cum).alias("_s0"),
        F.sum(n).over(w).alias("_n_all"), F.sum(n * x).over(w).alias("_s_all"),
    )
    w1 = F.col("_n_all") - F.col("_w0")
    gap = F.col("_s0") / F.col("_w0") - F.try_divide(F.col("_s_all") - F.col("_s0"), w1)
    between = F.when(w1 > 0, F.col("_w0") * w1 * gap * gap).otherwise(0.0)
    return h.withColumn("_v", between).groupBy(*keys).agg(
        F.max_by(byte, F.struct(F.round("_v", 6), -F.col(byte))).alias("threshold")
    )


def season_composite(bands: DataFrame, keys: Sequence[str], clearest: int = 3, bad_classes=(0, 1, 3, 8, 9, 10, 11), max_cloud: float = 20.0) -> DataFrame:
    """Per pixel median of green and near infrared over the clearest usable scenes."""
    keys = list(keys)
    usable = bands.filter(F.col("cloud") <= max_cloud)
    scenes = usable.groupBy(*keys, "scene").agg(F.first("cloud").alias("cloud"))  # one row per scene
    w = W.partitionBy(*keys).orderBy("cloud", "scene")
    top = scenes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= clearest).select(*keys, "scene")
    ok = ~F.col("scl").isin(*bad_classes) & (F.col("green") > 0) & (F.col("nir") > 0)
    px = usable.join(top, [*keys, "scene"], "left_semi")
    # at most `clearest` values per pixel, so the built-in median holds next to nothing
    return px.groupBy(*keys, "row", "col").agg(
        F.median(F.when(ok, F.col("green"))).alias("green"), F.median(F.when(ok, F.col("nir"))).alias("nir")
    )
