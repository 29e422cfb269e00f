"""Quantities with units and uncertainty bands, warnings and confidence, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The conversions that are defined; any other pair is an error.
FACTORS = {
    ("m2", "ha"): 1e-4, ("ha", "m2"): 1e4, ("m2", "km2"): 1e-6, ("km2", "m2"): 1e6, ("ha", "km2"): 1e-2,
    ("km2", "ha"): 1e2, ("mm", "m"): 1e-3, ("m", "mm"): 1e3, ("ratio", "%"): 1e2, ("%", "ratio"): 1e-2,
}


def quantity(value: Column, unit: str | Column, unc_pct: Column | float | None = None, method: str = "") -> Column:
    """``struct<value,unit,unc_pct,method>``; a negative uncertainty is an error."""
    pct = F.lit(unc_pct).cast("double") if not isinstance(unc_pct, Column) else unc_pct
    safe = F.when(pct < 0, F.raise_error(F.lit("uncertainty must not be negative")).cast("double")).otherwise(pct)
    u = F.lit(unit) if isinstance(unit, str) else unit
    return F.struct(value.alias("value"), u.alias("unit"), safe.alias("unc_pct"), F.lit(method).alias("method"))


def low(q: Column) -> Column:
    """Lower end of the band."""
    return q["value"] * (1 - F.coalesce(q["unc_pct"], F.lit(0.0)) / 100)


def high(q: Column) -> Column:
    """Upper end of the band."""
    return q["value"] * (1 + F.coalesce(q["unc_pct"], F.lit(0.0)) / 100)


def convert(q: Column, unit: str) -> Column:
    """Quantity in another unit; undefined pairs raise."""
    factor = F.when(q["unit"] == unit, F.lit(1.0))
    for (a, b), f in FACTORS.items():
        if b == unit:
            factor = factor.when(q["unit"] == a, F.lit(f))
    bad = F.raise_error(F.concat(F.lit("no conversion from "), q["unit"], F.lit(f" to {unit}"))).cast("double")
    return F.struct(
        (q["value"] * factor.otherwise(bad)).alias("value"), F.lit(unit).alias("unit"), q["unc_pct"].alias("unc_pct"),
        q["method"].alias("method"),
    )


def display(q: Column) -> Column:
    """Text with two decimals, unit and band."""
    base = F.concat(F.format_number(q["value"], 2), F.lit(" "), q["unit"])
    pct = q["unc_pct"]
    short = F.when(pct == F.floor(pct), pct.cast("long").cast("string")).otherwise(pct.cast("string"))
    return F.when(pct.isNull(), base).otherwise(F.concat(base, F.lit(" (±"), short, F.lit(" %)")))


def warning(code: str, message: Column | str, severity: str) -> Column:
    """``struct<code,message,severity>``."""
    m = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), m.alias("message"), F.lit(severity).alias("severity"))


def warnings(*rules: tuple[Column, Column]) -> Column:
    """The warnings whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, w) for cond, w in rules]))


def confidence(codes: Column, area_unc_pct: Column) -> Column:
    """Worst input wins: low for assumed inputs or a coarse catchment, else moderate."""
    assumed = F.arrays_overlap(codes, F.array(F.lit("landcover_assumed"), F.lit("soil_assumed")))
    return F.when(F.coalesce(assumed, F.lit(False)) | F.coalesce(area_unc_pct > 25, F.lit(False)), "low").otherwise("moderate")
