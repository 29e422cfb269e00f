"""Climate series over ``orders`` (sites, daily rain) and ``part`` (land cover, soil)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import query, table
from rillwork.functions import hydro as H
from rillwork.operators import climate as C

MIN_DAYS = 150  # the tables hold few orders per day, so a year counts as complete sooner


def rain(spark, d, unit=1e5):
    """Eight sites; a day's rain is that day's order value over ``unit``."""
    o = table(spark, d, "orders")
    return o.groupBy(
        (F.col("o_custkey") % 8).alias("site"), F.to_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("day")
    ).agg(F.round(F.sum("o_totalprice") / unit, 4).alias("mm"))


RAIN = """rain AS (SELECT o_custkey%8 AS site, CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice)/1e5,4) AS mm
      FROM orders GROUP BY 1,2)"""
ANNUAL = f"""{RAIN}, ann AS (SELECT site, CAST(year(day) AS INTEGER) AS year, count(mm) AS days, sum(mm) AS total,
      count(*) FILTER (mm>=2.5) AS rainy, max(mm) AS peak, coalesce(sum(mm) FILTER (month(day) IN (6,7,8,9)),0) AS monsoon
      FROM rain GROUP BY 1,2 HAVING count(mm)>={MIN_DAYS})"""


def _dep(src: str, keys: str, value: str, points: dict[str, float]) -> str:
    """SQL for plotting-position values."""
    outs = []
    for name, p in points.items():
        outs.append(
            f"""max(CASE WHEN {p}*(n+1)<=1 AND m=1 OR {p}*(n+1)>=n AND m=n THEN v
            WHEN m<={p}*(n+1) AND {p}*(n+1)<m+1 AND {p}*(n+1)>1 AND {p}*(n+1)<n
            THEN v+(nx-v)*({p}::DOUBLE*(n+1)-m) END) AS {name}"""
        )
    return f"""(SELECT {keys}, {", ".join(outs)} FROM (SELECT {keys}, {value} AS v, row_number() OVER w AS m,
      lead({value}) OVER w AS nx, count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {value} DESC)) GROUP BY {keys})"""


def rnd(df, digits=4, skip=()):
    """Round every double column."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query(
    "rainfall_complete_years",
    f"WITH {ANNUAL} SELECT site, year, days, round(total,4) AS total, rainy, peak, round(monsoon,4) AS monsoon FROM ann",
)
def rainfall_complete_years(spark, d):
    return rnd(C.complete_years(rain(spark, d), MIN_DAYS))


@query(
    "rainfall_statistics",
    f"""WITH {ANNUAL}, st AS (SELECT site, count(*) AS years, min(year) AS first_year, max(year) AS last_year, avg(total) AS mean_annual,
      coalesce(stddev_samp(total),0) AS std_annual, 100*coalesce(stddev_samp(total),0)/avg(total) AS cv_pct, 100*sum(monsoon)/sum(total) AS monsoon_pct,
      avg(rainy) AS rainy_days, median(total) AS median_annual, avg(peak) AS pm, stddev_samp(peak)*sqrt(6.0)/pi() AS al, max(peak) AS px FROM ann GROUP BY 1),
    wh AS (SELECT site, 100.0*count(mm)::DOUBLE/count(*) AS completeness_pct, max(mm) AS max_daily FROM rain GROUP BY 1),
    md AS (SELECT r.site, min(day) AS max_day FROM rain r JOIN wh ON wh.site=r.site AND r.mm=wh.max_daily GROUP BY 1)
    SELECT st.site, years, first_year, last_year, round(mean_annual,7) AS mean_annual, round(std_annual,7) AS std_annual, round(cv_pct,7) AS cv_pct,
      round(monsoon_pct,7) AS monsoon_pct, round(rainy_days,7) AS rainy_days, round(median_annual,7) AS median_annual,
      round(dependable_75,7) AS dependable_75, round(dependable_50,7) AS dependable_50, round(completeness_pct,7) AS completeness_pct, max_daily, max_day,
      round(CASE WHEN years<3 THEN px ELSE pm-0.5772156649*al+al*(-ln(-ln(1-1/25.0::DOUBLE))) END,7) AS level_25y,
      round(CASE WHEN years<3 THEN pm ELSE pm-0.5772156649*al END,7) AS gumbel_location, round(CASE WHEN years<3 THEN 0 ELSE al END,7) AS gumbel_scale
    FROM st JOIN {_dep("ann", "site", "total", {"dependable_75": 0.75, "dependable_50": 0.5})} dp USING (site) JOIN wh USING (site) JOIN md USING (site)""",
)
def rainfall_statistics(spark, d):
    return rnd(C.rainfall_statistics(rain(spark, d), MIN_DAYS), 7)


@query(
    "monthly_normals",
    f"""WITH {ANNUAL}, n AS (SELECT site, count(*) AS n FROM ann GROUP BY 1), mo AS (SELECT n.site, n, CAST(unnest(range(1,13)) AS INTEGER) AS month FROM n),
    s AS (SELECT site, CAST(month(day) AS INTEGER) AS month, sum(mm) AS mm, count(*) FILTER (mm>=2.5) AS r FROM rain GROUP BY 1,2)
    SELECT mo.site, mo.month, round(coalesce(mm,0)/n,7) AS mean_mm, round(coalesce(r,0)::DOUBLE/n,7) AS rainy_days FROM mo LEFT JOIN s ON s.site=mo.site AND s.month=mo.month""",
)
def monthly_normals(spark, d):
    return rnd(C.monthly_normals(rain(spark, d), MIN_DAYS), 7)


@query(
    "record_window",
    f"WITH {RAIN} SELECT site, day, mm FROM rain WHERE day BETWEEN DATE '1998-01-01' AND DATE '2000-12-31' AND mm IS NOT NULL",
)
def record_window(spark, d):
    return C.display_series(C.record_window(rain(spark, d), 3, F.lit("2001-05-01").cast("date")))


@query(
    "recorded_sites_near",
    f"""WITH {RAIN}, s AS (SELECT CAST(s_nationkey%8 AS BIGINT) AS site, avg(s_acctbal)/10000 AS off FROM supplier GROUP BY 1)
    SELECT rain.* FROM rain JOIN s USING (site) WHERE abs(off)<=0.5 AND day BETWEEN DATE '1996-03-01' AND DATE '1999-02-28'""",
)
def recorded_sites_near(spark, d):
    s = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 8).cast("long").alias("site")).agg(
        (F.avg("s_acctbal") / 10000).alias("off")
    )
    sites = s.select(
        "site", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("off").alias("rec_lat"), F.lit(0.0).alias("rec_lon"),
        F.lit("1996-03-01").cast("date").alias("start"), F.lit("1999-02-28").cast("date").alias("end"),
    )
    return C.nearby_records(rain(spark, d), sites)


def cover(spark, d):
    """Land-cover reading of ``part``: one catchment per brand, class from the size."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_brand").alias("site"),
        ((F.col("p_size") % 12) * 10).alias("code"),
        F.col("p_type").alias("kind"),
        F.when(F.length("p_name") % 4 == 0, "A").when(F.length("p_name") % 4 == 1, "B").when(F.length("p_name") % 4 == 2, "C").otherwise("D").alias("soil"),
    )


_CN = " ".join(f"WHEN {k} THEN [{','.join(map(str, v))}]" for k, v in H.CURVE_NUMBERS.items())
_CO = " ".join(f"WHEN {k} THEN {v}" for k, v in H.COEFFICIENTS.items())
COVER = f"""cov AS (SELECT p_brand AS site, (p_size%12)*10 AS code, substr('ABCD', CAST(length(p_name)%4+1 AS INTEGER), 1) AS soil FROM part),
    cw AS (SELECT *, CASE code {_CN} ELSE [{",".join(map(str, H.CURVE_NUMBERS[40]))}] END AS cns, (CASE code {_CO} ELSE 0.35 END)::DOUBLE AS co, CAST(position(soil IN 'ABCD') AS INTEGER) AS gi FROM cov),
    cn2 AS (SELECT site, soil AS hsg, count(*) FILTER (code>0) AS cells, sum(cns[gi]) FILTER (code>0)::DOUBLE/count(*) FILTER (code>0) AS cn,
      sum(co) FILTER (code>0)/count(*) FILTER (code>0) AS coefficient FROM cw GROUP BY 1,2)"""


@query(
    "composite_curve_number",
    f"WITH {COVER} SELECT site, hsg, cells, round(4.2*cn/(10-0.058*cn),6) AS cn, round(coefficient,6) AS coefficient FROM cn2",
)
def composite_curve_number(spark, d):
    return rnd(C.curve_numbers(cover(spark, d), ["site"], "soil", "I"), 6)


@query(
    "land_cover_top_classes",
    f"""WITH {COVER}, n AS (SELECT site, code, count(*) AS n FROM cov WHERE code>0 GROUP BY 1,2)
    SELECT * FROM (SELECT site, code, n, round(n::DOUBLE/sum(n) OVER (PARTITION BY site),6) AS share,
      CAST(row_number() OVER (PARTITION BY site ORDER BY n DESC, code) AS INTEGER) AS rank FROM n) WHERE rank<=4""",
)
def land_cover_top_classes(spark, d):
    return rnd(C.class_shares(cover(spark, d), ["site"], top=4), 6)


@query(
    "soil_texture",
    """WITH l AS (SELECT p_brand AS site, 5*(1+p_size%3) AS th, (p_retailprice-900)*0.6 AS clay, p_size*2.0 AS sand FROM part),
    t AS (SELECT site, sum(clay*th)/sum(th) AS clay, sum(sand*th)/sum(th) AS sand FROM l GROUP BY 1)
    SELECT site, round(clay,6) AS clay, round(sand::DOUBLE,6) AS sand,
      CASE WHEN sand>=70 AND clay<15 THEN 'A' WHEN clay>=40 THEN 'D' WHEN clay>=27 THEN 'C' ELSE 'B' END AS hsg FROM t""",
)
def soil_texture(spark, d):
    layers = table(spark, d, "part").select(
        F.col("p_brand").alias("site"),
        (5 * (1 + F.col("p_size") % 3)).alias("thickness"),
        ((F.col("p_retailprice") - 900) * 0.6).alias("clay"),
        (F.col("p_size") * 2.0).alias("sand"),
    )
    return rnd(C.soil_texture(layers, ["site"]), 6)


def runoff_params(spark, d):
    """Curve number and coefficient of each rain site, from the order priorities it sees."""
    o = table(spark, d, "orders")
    return o.groupBy((F.col("o_custkey") % 8).alias("site")).agg(
        (F.lit(70.0) + 2 * F.max(F.col("o_custkey") % 8)).alias("cn"),
        (F.lit(0.25) + 0.05 * F.max(F.col("o_custkey") % 8)).alias("coefficient"),
    )


def _strange_sql(p: str) -> str:
    knots = [(0.0, 0.0), *[(r[0], float(r[2])) for r in H.STRANGE]]
    out = f"CASE WHEN {p}<=0 THEN 0 "
    for (a, ya), (b, yb) in zip(knots, knots[1:]):
        out += f"WHEN {p}<={b} THEN {ya}::DOUBLE+({p}-{a}::DOUBLE)*{(yb - ya) / (b - a)!r}::DOUBLE "
    return out + f"ELSE {knots[-1][1]} END"


_S = "(25400.0::DOUBLE/(70.0+2*site)-254.0)"
RUNOFF = f"""{RAIN}, dd AS (SELECT site, year(day) AS year, mm, CASE WHEN mm-0.2::DOUBLE*{_S}>0 THEN pow(mm-0.2::DOUBLE*{_S},2)/(mm-0.2::DOUBLE*{_S}+{_S}) ELSE 0 END AS q1,
      mm*(0.25::DOUBLE+0.05::DOUBLE*site) AS q2, mm*({_strange_sql("mm")})/100 AS q3 FROM rain WHERE mm IS NOT NULL),
    ya AS (SELECT site, CAST(year AS INTEGER) AS year, sum(mm) AS rain, sum(q1) AS q1, sum(q2) AS q2, sum(q3) AS q3 FROM dd GROUP BY 1,2 HAVING count(*)>={MIN_DAYS}),
    ar AS (SELECT site, year, rain, unnest(['scs_cn','rational','empirical_strange']) AS method, unnest([q1,q2,q3]) AS runoff FROM ya),
    ms AS (SELECT g.*, dependable_75 FROM (SELECT site, method, count(*) AS years, avg(runoff) AS mean_depth, sum(runoff)/sum(rain) AS mean_coefficient FROM ar GROUP BY 1,2) g
      JOIN {_dep("ar", "site, method", "runoff", {"dependable_75": 0.75})} d USING (site,method))"""


@query("annual_runoff", f"WITH {RUNOFF} SELECT site, year, method, round(rain,7) AS rain, round(runoff,7) AS runoff FROM ar")
def annual_runoff(spark, d):
    return rnd(C.annual_runoff(rain(spark, d), runoff_params(spark, d), MIN_DAYS), 7)


@query(
    "runoff_by_method",
    f"WITH {RUNOFF} SELECT site, method, years, round(mean_depth,4) AS mean_depth, round(mean_coefficient,6) AS mean_coefficient, round(dependable_75,4) AS dependable_75 FROM ms",
)
def runoff_by_method(spark, d):
    m = C.runoff_methods(C.annual_runoff(rain(spark, d), runoff_params(spark, d), MIN_DAYS))
    return rnd(m, 4, skip=("mean_coefficient",)).withColumn("mean_coefficient", F.round("mean_coefficient", 6))


@query(
    "runoff_range",
    f"""WITH {RUNOFF}, v AS (SELECT *, mean_depth/1000*(1+site)*10000 AS vol FROM ms)
    SELECT site, round(100*(max(vol)-min(vol))/greatest(avg(vol),1e-9),4) AS spread_pct, 'scs_cn' AS method,
      round(max(vol) FILTER (method='scs_cn'),4) AS volume_m3, round(max(dependable_75) FILTER (method='scs_cn'),4) AS dependable_75 FROM v GROUP BY 1""",
)
def runoff_range(spark, d):
    m = C.runoff_methods(C.annual_runoff(rain(spark, d), runoff_params(spark, d), MIN_DAYS))
    areas = runoff_params(spark, d).select("site", ((1 + F.col("site")) * 10000).alias("area_m2"))
    return rnd(C.runoff_range(m, areas))


@query(
    "rain_source_choice",
    """WITH r AS (SELECT o_custkey AS site, CAST(o_orderdate AS DATE) AS day, o_totalprice/1e5 AS mm,
      CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'backup' ELSE 'static' END AS source FROM orders),
    b AS (SELECT site, min(CASE source WHEN 'live' THEN 1 WHEN 'backup' THEN 2 ELSE 3 END) AS best FROM r GROUP BY 1)
    SELECT r.*, CASE WHEN best=1 THEN 'none' ELSE 'secondary_provider' END AS fallback FROM r JOIN b USING (site)
    WHERE (CASE source WHEN 'live' THEN 1 WHEN 'backup' THEN 2 ELSE 3 END)=best""",
)
def rain_source_choice(spark, d):
    src = F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "backup").otherwise("static")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("site"),
        F.to_date(F.col("o_orderdate").cast("timestamp_ntz")).alias("day"),
        (F.col("o_totalprice") / 1e5).alias("mm"),
        src.alias("source"),
    )
    return C.first_source(rows, "site", {"live": 1, "backup": 2, "static": 3})


@query(
    "freshest_cached_record",
    """WITH c AS (SELECT o_custkey AS site, epoch_us(o_orderdate)/1000000 AS stored_at, o_orderkey FROM orders),
    m AS (SELECT site, max(stored_at) AS s FROM c GROUP BY 1)
    SELECT m.site, CAST(m.s AS BIGINT) AS stored_at, max(o_orderkey) AS payload, m.s < 996624000-31536000 AS stale
    FROM m JOIN c ON c.site=m.site AND c.stored_at=m.s GROUP BY ALL""",
)
def freshest_cached_record(spark, d):
    from rillwork.catalog.base import micros

    # two rows stored in the same second: the later order key is the fresher one
    rows = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("site"), (micros(F.col("o_orderdate")) / 1_000_000).cast("long").alias("stored_at")
    ).agg(F.max("o_orderkey").alias("payload"))
    return C.freshest(rows, "site", F.lit(996_624_000), 31_536_000)


def balance(spark, d):
    """Yearly water balance of one pond per rain site."""
    r = rain(spark, d).join(runoff_params(spark, d), "site")
    q = H.curve_number_runoff(F.col("mm"), F.col("cn"))
    days = r.select("site", "day", (q / 1000.0 * (20000.0 * (1 + F.col("site"))) * 0.6).alias("inflow"))
    ponds = runoff_params(spark, d).select(
        "site", (40.0 + 5 * F.col("site")).alias("length"), F.lit(30.0).alias("width"), F.lit(2.5).alias("depth")
    )
    return C.balance_years(days, ponds)


_BAL = f"""{RAIN}, pq AS (SELECT site, day, CASE WHEN mm-0.2::DOUBLE*{_S}>0 THEN pow(mm-0.2::DOUBLE*{_S},2)/(mm-0.2::DOUBLE*{_S}+{_S}) ELSE 0.0 END AS q,
      row_number() OVER (PARTITION BY site ORDER BY day) AS i FROM rain),
    pd AS (SELECT site, day, i, q/1000.0::DOUBLE*(20000.0*(1+site))*0.6::DOUBLE AS inflow, 40.0+5*site AS len FROM pq),
    pc AS (SELECT site, i, day, inflow, len::DOUBLE AS len, 2.5/3.0::DOUBLE*(len*30.0+(len-10)*20.0+sqrt(len*30.0*((len-10)*20.0))) AS cap,
      [3.2,4.5,6.8,9.5,11.0,8.0,4.6,4.0,4.4,4.8,3.6,3.0][month(day)]::DOUBLE AS pan FROM pd),
    bal AS (SELECT site, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS day, 0.0::DOUBLE AS s, 0.0::DOUBLE AS over, 0.0::DOUBLE AS evap, 0.0::DOUBLE AS seep, 0.0::DOUBLE AS inflow, max(cap) AS cap FROM pc GROUP BY site
      UNION ALL SELECT site, i, day, raw-greatest(raw-cap,0), greatest(raw-cap,0), evap, seep, inflow, cap FROM (
        SELECT site, i, day, inflow, cap, evap, seep, greatest(s+inflow-evap-seep,0) AS raw FROM (
          SELECT pc.site, pc.i, pc.day, pc.inflow, pc.cap, s, 0.7::DOUBLE*pan/1000.0::DOUBLE*surf AS evap, 2.0::DOUBLE/1000.0::DOUBLE*surf AS seep FROM (
            SELECT bal.site, bal.i, bal.s, CASE WHEN s>0 THEN (30.0+5*site+4*least(greatest(2.5*sqrt(s/cap),0),2.5))*(20.0+4*least(greatest(2.5*sqrt(s/cap),0),2.5)) ELSE 0 END AS surf FROM bal) b
          JOIN pc ON pc.site=b.site AND pc.i=b.i+1))),
    by_ AS (SELECT site, max(cap) AS cap, CAST(year(day) AS INTEGER) AS year, sum(over) AS spill, sum(evap) AS evap, sum(seep) AS seep, sum(inflow) AS inflow,
      bool_or(s>=0.9*cap) AS filled, CAST(count(DISTINCT month(day)) FILTER (s>0.15*cap) AS INTEGER) AS months, max_by(s,day) AS end_storage FROM bal WHERE i>0 GROUP BY site, year(day))"""


@query(
    "water_balance_years",
    f"WITH RECURSIVE {_BAL} SELECT site, year, filled, months, " + ",".join(f"round({c},3) AS {c}" for c in ("cap", "spill", "evap", "seep", "inflow", "end_storage")) + " FROM by_",
)
def water_balance_years(spark, d):
    return rnd(balance(spark, d), 3)


@query(
    "water_balance_summary",
    f"""WITH RECURSIVE {_BAL} SELECT site, count(*) AS years, round((count(*) FILTER (filled))::DOUBLE/count(*),4) AS fill_reliability, round(avg(months),4) AS months_with_water,
      round(avg(spill),3) AS spill_m3, round(avg(evap),3) AS evaporation_m3, round(avg(seep),3) AS seepage_m3, round(avg(inflow),3) AS inflow_m3,
      round(avg(end_storage)/max(cap),4) AS end_fraction FROM by_ GROUP BY 1""",
)
def water_balance_summary(spark, d):
    s = C.balance_summary(balance(spark, d))
    m3 = ("spill_m3", "evaporation_m3", "seepage_m3", "inflow_m3")
    return rnd(rnd(s, 4, skip=m3), 3, skip=("fill_reliability", "months_with_water", "end_fraction"))
