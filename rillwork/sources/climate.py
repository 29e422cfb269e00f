"""Rainfall documents to daily rows, and contour maps to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = "struct<daily:struct<time:array<string>,precipitation_sum:array<double>>>"
KEYED = "struct<properties:struct<parameter:struct<PRECTOTCORR:map<string,double>>>>"


def archive_rain(docs: DataFrame, doc: str) -> DataFrame:
    """Parallel arrays ``daily.time`` and ``daily.precipitation_sum`` to ``day, mm`` rows."""
    keep = [c for c in docs.columns if c != doc]
    d = docs.select(*keep, F.from_json(doc, ARCHIVE).alias("_d"))
    z = F.arrays_zip(F.col("_d.daily.time").alias("t"), F.col("_d.daily.precipitation_sum").alias("v"))
    return d.select(*keep, F.explode(z).alias("_z")).select(
        *keep, F.to_date("_z.t").alias("day"), F.col("_z.v").alias("mm")
    )


def keyed_rain(docs: DataFrame, doc: str) -> DataFrame:
    """Map ``yyyymmdd → mm`` to ``day, mm`` rows; negative values are missing."""
    keep = [c for c in docs.columns if c != doc]
    d = docs.select(*keep, F.from_json(doc, KEYED).alias("_d"))
    m = d.select(*keep, F.explode("_d.properties.parameter.PRECTOTCORR").alias("_k", "_v"))
    return m.select(*keep, F.to_date("_k", "yyyyMMdd").alias("day"), F.when(F.col("_v") >= 0, F.col("_v")).alias("mm"))


PLACEMARK = (
    "name string, description string, LineString struct<coordinates:string>, "
    "Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>, "
    "Point struct<coordinates:string>, "
    "ExtendedData struct<Data:array<struct<_name:string,value:string>>,"
    "SchemaData:struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>"
)
#: Field names that carry an elevation, and what counts as a number.
ELEVATION_FIELD = r"(?i)(elev|contour|level|height|altitude|^z$)"
NUMBER = r"^\s*-?\d+(\.\d+)?\s*$"


def _vertices(text: Column) -> Column:
    """``array<struct<x,y,z>>`` from KML coordinate text."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: F.size(F.split(t, ",")) >= 2)

    def point(t: Column) -> Column:
        p = F.split(t, ",")
        z = F.nullif(F.try_element_at(p, F.lit(3)), F.lit(""))
        return F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y"), z.cast("double").alias("z"))

    return F.transform(tokens, point)


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks of KML files, namespaces ignored; one map per file."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").schema(PLACEMARK).load(path)
    return raw.withColumn("map_id", F.col("_metadata.file_name"))


def contour_lines(placemarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, facts)``: contour lines by elevation, and per map the skipped count and AOI ring.

    Elevation comes from a constant Z, else a known field, else a numeric name; ``source`` says
    which. Lines with under two vertices or no elevation are skipped and counted.
    """
    data = F.coalesce(F.col("ExtendedData.Data"), F.expr("cast(array() as array<struct<_name:string,value:string>>)"))
    simple = F.coalesce(
        F.transform(F.col("ExtendedData.SchemaData.SimpleData"), lambda s: F.struct(s["_name"].alias("_name"), s["_VALUE"].alias("value"))),
        F.expr("cast(array() as array<struct<_name:string,value:string>>)"),
    )
    fields = F.filter(
        F.concat(data, simple),
        lambda f: f["_name"].rlike(ELEVATION_FIELD) & F.coalesce(f["value"].rlike(NUMBER), F.lit(False)),
    )
    p = placemarks.withColumn("_v", _vertices(F.col("LineString.coordinates")))
    zs = F.transform("_v", lambda v: v["z"])
    flat = (F.size("_v") > 0) & ~F.exists("_v", lambda v: v["z"].isNull()) & (F.array_max(zs) - F.array_min(zs) <= 1e-6)
    from_z = F.when(flat, F.get(zs, F.lit(0)))
    from_field = F.trim(F.get(fields, F.lit(0))["value"]).cast("double")
    from_name = F.when(F.col("name").rlike(NUMBER), F.trim("name").cast("double"))
    p = p.withColumns({"_z": from_z, "_f": from_field, "_n": from_name})
    p = p.withColumn("elevation", F.coalesce("_z", "_f", "_n")).withColumn(
        "source", F.when(F.col("_z").isNotNull(), "z").when(F.col("_f").isNotNull(), "extended_data").when(F.col("_n").isNotNull(), "name")
    )
    is_line = F.col("LineString").isNotNull()
    good = is_line & (F.size("_v") >= 2) & F.col("elevation").isNotNull()
    ring = _vertices(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates"))
    facts = p.withColumn("_ring", F.when(F.size(ring) >= 4, ring)).groupBy("map_id").agg(
        F.count(F.when(is_line & ~good, 1)).alias("skipped"), F.first("_ring", ignorenulls=True).alias("aoi")
    )
    lines = p.filter(good).select(
        "map_id", "elevation", "source", F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("vertices")
    )
    return lines, facts
