"""Daily rainfall series: statistics, runoff, curve numbers, source choice, water balance.

``rain(site, day, mm)`` holds at most one row per site and day, so any per-site list is bounded
by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rillwork.functions import hydro as H
from rillwork.functions import pond as P
from rillwork.functions.bind import let


def complete_years(rain: DataFrame, min_days: int = 350) -> DataFrame:
    """Per site and complete year: total, rainy days, maximum, monsoon total, valid days."""
    mm = F.col("mm")
    return (
        rain.withColumn("year", F.year("day"))
        .groupBy("site", "year")
        .agg(
            F.count("mm").alias("days"),
            F.sum("mm").alias("total"),
            F.count(F.when(mm >= H.RAINY_DAY_MM, 1)).alias("rainy"),
            F.max("mm").alias("peak"),
            F.coalesce(F.sum(F.when(F.month("day").isin(*H.MONSOON_MONTHS), mm)), F.lit(0.0)).alias("monsoon"),
        )
        .filter(F.col("days") >= min_days)
    )


def dependable(values: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """Value exceeded with each probability by plotting position ``m / (n + 1)``, interpolated.

    One value per key and year: the ranked group is as long as the record has years.
    """
    keys = list(keys)
    w = W.partitionBy(*keys)
    desc = w.orderBy(F.col(value).desc())
    r = values.select(
        *keys,
        F.col(value).alias("_v"),
        F.row_number().over(desc).alias("_m"),
        F.lead(value).over(desc).alias("_next"),
        F.count(F.lit(1)).over(w).alias("_n"),
    )
    aggs = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("_n") + 1)
        low = (at <= 1) & (F.col("_m") == 1)
        high = (at >= F.col("_n")) & (F.col("_m") == F.col("_n"))
        inner = (F.col("_m") <= at) & (at < F.col("_m") + 1) & (at > 1) & (at < F.col("_n"))
        # The same arithmetic as interpolating over m / (n + 1), so rounding agrees with it.
        x0 = F.col("_m") / (F.col("_n") + 1)
        x1 = (F.col("_m") + 1) / (F.col("_n") + 1)
        lerp = F.col("_v") + (F.col("_next") - F.col("_v")) / (x1 - x0) * (F.lit(p) - x0)
        aggs.append(F.max(F.when(low | high, F.col("_v")).when(inner, lerp)).alias(name))
    return r.groupBy(*keys).agg(*aggs)


def gumbel(mean: Column, sd: Column, n: Column, peak: Column, years: float) -> Column:
    """``struct<level,location,scale>`` of the annual maxima by moments."""
    import math

    alpha = sd * F.lit(math.sqrt(6.0) / math.pi)
    u = mean - 0.5772156649 * alpha
    y = -math.log(-math.log(1.0 - 1.0 / years))
    return F.when(
        n < 3, F.struct(peak.alias("level"), mean.alias("location"), F.lit(0.0).alias("scale"))
    ).otherwise(F.struct((u + alpha * y).alias("level"), u.alias("location"), alpha.alias("scale")))


def rainfall_statistics(rain: DataFrame, min_days: int = 350, years: float = 25.0) -> DataFrame:
    """One row per site with at least one complete year."""
    annual = complete_years(rain, min_days)
    whole = rain.groupBy("site").agg(
        F.round(100.0 * F.count("mm") / F.count(F.lit(1)), 6).alias("completeness_pct"),
        F.max("mm").alias("max_daily"),
        # first day of the maximum: largest mm, then earliest day
        F.max_by(
            F.col("day"),
            F.when(F.col("mm").isNotNull(), F.struct(F.col("mm"), -F.unix_date("day"))),
        ).alias("max_day"),
    )
    sd = F.coalesce(F.stddev_samp("total"), F.lit(0.0))
    stats = annual.groupBy("site").agg(
        F.count(F.lit(1)).alias("years"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.avg("total").alias("mean_annual"),
        sd.alias("std_annual"),
        F.try_divide(100.0 * sd, F.avg("total")).alias("cv_pct"),
        (100.0 * F.sum("monsoon") / F.sum("total")).alias("monsoon_pct"),
        F.avg("rainy").alias("rainy_days"),
        gumbel(F.avg("peak"), F.stddev_samp("peak"), F.count(F.lit(1)), F.max("peak"), years).alias("_g"),
        # years per site are few: an exact built-in median is safe here
        F.median("total").alias("median_annual"),
    )
    dep = dependable(annual, ["site"], "total", {"dependable_75": 0.75, "dependable_50": 0.50})
    return (
        stats.join(dep, "site")
        .join(whole, "site")
        .select("*", F.col("_g.level").alias("level_25y"), F.col("_g.location").alias("gumbel_location"),
                F.col("_g.scale").alias("gumbel_scale"))
        .drop("_g")
    )


def monthly_normals(rain: DataFrame, min_days: int = 350) -> DataFrame:
    """Twelve rows per site: rain and rainy days of all days over the number of complete years."""
    n = complete_years(rain, min_days).groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    sums = rain.groupBy("site", F.month("day").alias("month")).agg(
        F.sum("mm").alias("_mm"), F.count(F.when(F.col("mm") >= H.RAINY_DAY_MM, 1)).alias("_r")
    )
    spine = n.select("site", "_n", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return spine.join(sums, ["site", "month"], "left").select(
        "site",
        "month",
        (F.coalesce("_mm", F.lit(0.0)) / F.col("_n")).alias("mean_mm"),
        (F.coalesce("_r", F.lit(0)) / F.col("_n")).alias("rainy_days"),
    )


def record_window(rain: DataFrame, years: int, today: Column) -> DataFrame:
    """Rows of the last ``years`` complete calendar years before ``today``."""
    last = F.year(today) - 1
    return rain.filter(
        F.col("day").between(F.make_date(last - years + 1, F.lit(1), F.lit(1)), F.make_date(last, F.lit(12), F.lit(31)))
    )


def nearby_records(rain: DataFrame, sites: DataFrame, limit_deg: float = 0.5) -> DataFrame:
    """Recorded rows for the asked sites, refusing records more than ``limit_deg`` away."""
    near = (F.abs(F.col("lat") - F.col("rec_lat")) <= limit_deg) & (F.abs(F.col("lon") - F.col("rec_lon")) <= limit_deg)
    return rain.join(sites.filter(near).select("site", "start", "end"), "site").filter(
        F.col("day").between(F.col("start"), F.col("end"))
    ).drop("start", "end")


def display_series(rain: DataFrame) -> DataFrame:
    """Daily series without missing days."""
    return rain.filter(F.col("mm").isNotNull())


def curve_numbers(
    classes: DataFrame, keys: Sequence[str], group: str | Column, moisture: str = "II"
) -> DataFrame:
    """Area-weighted curve number and runoff coefficient per key.

    ``classes(keys, code)`` has one row per cell. Code 0 is ignored; unknown codes count as
    cropland. ``group`` is the soil group column. Keys with no usable cell get cropland.
    """
    keys = list(keys)
    grp = F.col(group) if isinstance(group, str) else group
    counts = classes.groupBy(*keys, grp.alias("hsg"), "code").agg(F.count(F.lit(1)).alias("_n"))
    i = F.array_position(F.array(*[F.lit(g) for g in "ABCD"]), F.col("hsg")).cast("int")
    cn = F.create_map(
        *[x for code, row in H.CURVE_NUMBERS.items() for x in (F.lit(code), F.array(*[F.lit(float(v)) for v in row]))]
    )
    co = F.create_map(*[x for code, v in H.COEFFICIENTS.items() for x in (F.lit(code), F.lit(v))])
    row = F.coalesce(F.try_element_at(cn, F.col("code")), F.try_element_at(cn, F.lit(H.DEFAULT_CLASS)))
    used = F.col("code") > 0
    priced = counts.select(
        *keys, "hsg",
        F.when(used, F.col("_n")).otherwise(0).alias("_n"),
        F.element_at(row, i).alias("_cn"),
        F.coalesce(F.try_element_at(co, F.col("code")), F.lit(H.DEFAULT_COEFFICIENT)).alias("_c"),
    )
    total = F.sum("_n")
    base = F.element_at(F.element_at(cn, F.lit(H.DEFAULT_CLASS)), i)
    g = priced.groupBy(*keys, "hsg").agg(
        F.try_divide(F.sum(F.col("_n") * F.col("_cn")), total).alias("_w"),
        F.try_divide(F.sum(F.col("_n") * F.col("_c")), total).alias("_wc"),
        total.alias("cells"),
    )
    return g.select(
        *keys, "hsg", "cells",
        H.moist_curve_number(F.coalesce("_w", base), F.lit(moisture)).alias("cn"),
        F.coalesce("_wc", F.lit(H.COEFFICIENTS[H.DEFAULT_CLASS])).alias("coefficient"),
    )


def class_shares(classes: DataFrame, keys: Sequence[str], top: int | None = None) -> DataFrame:
    """Share of each land-cover class (code 0 left out), optionally the ``top`` per key."""
    keys = list(keys)
    counts = classes.filter("code > 0").groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys)
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(w))
    if top is None:
        return out
    rank = F.row_number().over(w.orderBy(F.col("n").desc(), "code"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top)


def soil_texture(layers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Thickness-weighted clay and sand over soil layers, with the soil group."""
    t = F.sum("thickness")
    g = layers.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("clay") * F.col("thickness")), t).alias("clay"),
        F.try_divide(F.sum(F.col("sand") * F.col("thickness")), t).alias("sand"),
    )
    return g.withColumn("hsg", H.soil_group(F.col("clay"), F.col("sand")))


def annual_runoff(rain: DataFrame, params: DataFrame, min_days: int = 350, methods=None) -> DataFrame:
    """Rain and runoff depth per site, method and complete year; ``params(site, cn, coefficient)``."""
    methods = methods or H.METHODS
    r = rain.join(params.select("site", "cn", "coefficient"), "site").filter(F.col("mm").isNotNull())
    depths = [
        F.sum(fn(F.col("mm"), F.col("cn"), F.col("coefficient"))).alias(name) for name, fn in methods.items()
    ]
    g = r.groupBy("site", F.year("day").alias("year")).agg(
        F.count(F.lit(1)).alias("_d"), F.sum("mm").alias("rain"), *depths
    )
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("runoff")) for m in methods]))
    return g.filter(F.col("_d") >= min_days).select("site", "year", "rain", pairs)


def runoff_methods(annual: DataFrame) -> DataFrame:
    """Per site and method: years, mean depth, mean coefficient, 75 % dependable depth."""
    g = annual.groupBy("site", "method").agg(
        F.count(F.lit(1)).alias("years"),
        F.avg("runoff").alias("mean_depth"),
        F.try_divide(F.sum("runoff"), F.sum("rain")).alias("mean_coefficient"),
    )
    return g.join(dependable(annual, ["site", "method"], "runoff", {"dependable_75": 0.75}), ["site", "method"])


def runoff_range(methods: DataFrame, areas: DataFrame) -> DataFrame:
    """Per site: spread of the volumes in per cent of their mean and the recommended method."""
    v = methods.join(areas, "site").withColumn("volume", F.col("mean_depth") / 1000 * F.col("area_m2"))
    prefer = F.struct((F.col("method") != "scs_cn").cast("int"), F.col("method"))
    mean = F.greatest(F.avg("volume"), F.lit(1e-9))
    return v.groupBy("site").agg(
        (100.0 * (F.max("volume") - F.min("volume")) / mean).alias("spread_pct"),
        F.min_by("method", prefer).alias("method"),
        F.min_by("volume", prefer).alias("volume_m3"),
        F.min_by("dependable_75", prefer).alias("dependable_75"),
    )


def first_source(rows: DataFrame, key: str, priority: Mapping[str, int]) -> DataFrame:
    """Each key's rows from the first source that has any, with a label of what was used."""
    rank = F.create_map(*[x for s, p in priority.items() for x in (F.lit(s), F.lit(p))])[F.col("source")]
    best = rows.groupBy(key).agg(F.min(rank).alias("_best"))
    first = min(priority.values())
    label = F.when(F.col("_best") == first, "none").otherwise("secondary_provider")
    return (
        rows.withColumn("_rank", rank)
        .join(best.withColumn("fallback", label), key)
        .filter("_rank = _best")
        .drop("_rank", "_best")
    )


def freshest(cache: DataFrame, key: str, now: Column, ttl_s: float) -> DataFrame:
    """Newest cached row per key, flagged stale once older than ``ttl_s`` seconds."""
    g = cache.groupBy(key).agg(F.max("stored_at").alias("stored_at"), F.max_by("payload", "stored_at").alias("payload"))
    return g.withColumn("stale", (now - F.col("stored_at")) > ttl_s)


_YEAR = "struct<year:int,spill:double,evap:double,seep:double,inflow:double,filled:boolean,mask:int,last:double>"


def balance_years(days: DataFrame, ponds: DataFrame, seepage_mm: float = 2.0, slope: float = 2.0) -> DataFrame:
    """Daily storage recurrence per site, summed by year.

    ``days(site, day, inflow)`` in m3; ``ponds(site, length, width, depth)``. One list per site,
    as long as its calendar; the fold stays in the JVM.
    """
    per_day = days.groupBy("site", "day").agg(F.sum("inflow").alias("inflow"))
    runs = per_day.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("day", "inflow"))).alias("days"))
    return balance_runs(runs.join(ponds, "site"), seepage_mm, slope)


def balance_runs(runs: DataFrame, seepage_mm: float = 2.0, slope: float = 2.0) -> DataFrame:
    """``balance_years`` of ``runs(site, length, width, depth, days)``: ``days`` holds a site's ``(day, inflow)`` by day."""
    L, Wd, D = F.col("length"), F.col("width"), F.col("depth")
    r = runs.withColumn("cap", P.storage(L, Wd, D, slope))
    cap = F.col("cap")
    zero_year = F.lit(None).cast(_YEAR)
    acc0 = F.struct(F.lit(0.0).alias("s"), zero_year.alias("y"), F.expr(f"cast(array() as array<{_YEAR}>)").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        def with_surface(surface: Column) -> Column:
            evap = F.lit(0.7) * H.pan_evaporation(F.month(x["day"])) / 1000.0 * surface
            seep = F.lit(seepage_mm) / 1000.0 * surface

            def with_raw(raw: Column) -> Column:
                over = F.greatest(raw["v"] - cap, F.lit(0.0))
                s = raw["v"] - over
                same = acc["y"]["year"] == F.year(x["day"])

                def keep(field: str, zero) -> Column:
                    return F.when(same, acc["y"][field]).otherwise(zero)

                bit = F.when(s > P.DEAD_STORAGE * cap, F.expr("1")).otherwise(0)
                month_bit = bit * F.pow(F.lit(2), F.month(x["day"]) - 1).cast("int")
                year = F.struct(
                    F.year(x["day"]).alias("year"),
                    (keep("spill", 0.0) + over).alias("spill"),
                    (keep("evap", 0.0) + raw["e"]).alias("evap"),
                    (keep("seep", 0.0) + raw["p"]).alias("seep"),
                    (keep("inflow", 0.0) + x["inflow"]).alias("inflow"),
                    (keep("filled", F.lit(False)) | (s >= 0.9 * cap)).alias("filled"),
                    keep("mask", 0).bitwiseOR(month_bit).alias("mask"),
                    s.alias("last"),
                )
                done = F.when(same | acc["y"].isNull(), acc["done"]).otherwise(
                    F.concat(acc["done"], F.array(acc["y"]))
                )
                return F.struct(s.alias("s"), year.cast(_YEAR).alias("y"), done.alias("done"))

            raw = F.struct(
                F.greatest(acc["s"] + x["inflow"] - evap - seep, F.lit(0.0)).alias("v"),
                evap.alias("e"),
                seep.alias("p"),
            )
            return let(raw, with_raw)

        level = F.when(cap > 0, D * F.sqrt(acc["s"] / cap)).otherwise(0.0)
        return let(F.when(acc["s"] > 0, P.area_at(L, Wd, D, slope, level)).otherwise(0.0), with_surface)

    end = F.aggregate(F.col("days"), acc0, step, lambda a: F.concat(a["done"], F.array(a["y"])))
    return r.select("site", "cap", F.inline(end)).select(
        "site", "cap", "year", "spill", "evap", "seep", "inflow", "filled",
        F.bit_count("mask").alias("months"), F.col("last").alias("end_storage"),
    )


def balance_summary(years: DataFrame) -> DataFrame:
    """Reliability, months with water, mean annual fluxes and year-end fraction per site."""
    return years.groupBy("site").agg(
        F.count(F.lit(1)).alias("years"),
        (F.count(F.when(F.col("filled"), 1)) / F.count(F.lit(1))).alias("fill_reliability"),
        F.avg("months").alias("months_with_water"),
        F.avg("spill").alias("spill_m3"),
        F.avg("evap").alias("evaporation_m3"),
        F.avg("seep").alias("seepage_m3"),
        F.avg("inflow").alias("inflow_m3"),
        F.coalesce(F.try_divide(F.avg("end_storage"), F.max("cap")), F.lit(0.0)).alias("end_fraction"),
    )
