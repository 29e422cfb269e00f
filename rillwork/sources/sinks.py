"""Writers: result tables as CSV, plot series, GeoJSON features, proposal sheets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Maps, structs and arrays as JSON text, so any table fits a CSV file."""
    deep = ("map<", "struct<", "array<")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(deep) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """Result table with a header."""
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_series(df: DataFrame, path: str) -> None:
    """Plot series: space-separated, ``nan`` for missing values."""
    df.write.mode("overwrite").option("header", True).option("sep", " ").option("nullValue", "nan").csv(path)


def point(lon: Column, lat: Column) -> Column:
    """GeoJSON point."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def line(vertices: Column) -> Column:
    """GeoJSON line from an array of ``struct<lon,lat>``."""
    xy = F.transform(vertices, lambda v: F.array(v["lon"], v["lat"]))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates")))


def polygon(ring: Column) -> Column:
    """GeoJSON polygon from one closed ring."""
    xy = F.transform(ring, lambda v: F.array(v["lon"], v["lat"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(xy).alias("coordinates")))


def ring_features(vertices: DataFrame, facts: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """One GeoJSON feature per ring from the corners and facts of ``operators.outline``.

    ``x`` and ``y`` turn a corner's ``row`` and ``col`` into coordinates. A ring's corners gather in its own row, as the
    format asks for; the first is repeated at the end. The properties are the keys and facts.
    """
    corners = F.sort_array(F.collect_list(F.struct("pos", x.alias("lon"), y.alias("lat"))))
    open_ = vertices.groupBy(*keys, "ring").agg(corners.alias("_v"))
    closed = open_.join(facts, [*keys, "ring"]).withColumn("_v", F.concat("_v", F.slice("_v", 1, 1)))
    props = {c: F.col(c) for c in facts.columns}
    return closed.select(*facts.columns, feature(polygon(F.col("_v")), props).alias("feature"))


def feature(geometry: Column, properties: Mapping[str, Column]) -> Column:
    """GeoJSON feature text around a geometry text."""
    props = F.to_json(F.struct(*[c.alias(n) for n, c in properties.items()]))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}"))


def write_features(df: DataFrame, column: str, path: str) -> None:
    """One feature per line."""
    df.select(column).write.mode("overwrite").text(path)


def proposal_rows(df: DataFrame, key: str, items: Mapping[str, Column]) -> DataFrame:
    """Figures of a wide row un-pivoted to ``item, value`` rows."""
    pairs = [F.struct(F.lit(n).alias("item"), c.alias("value")) for n, c in items.items()]
    return df.select(key, F.inline(F.array(*pairs)))


def write_proposal(df: DataFrame, key: str, items: Mapping[str, Column], path: str) -> None:
    """Proposal sheets as CSV, one folder per key."""
    proposal_rows(df, key, items).write.mode("overwrite").partitionBy(key).option("header", True).csv(path)
