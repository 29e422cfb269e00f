"""Vectors as whole numbers: what the search and the whitening read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an entry is multiplied with before it is floored.
SCALE = 256


def scaled(vector: Column) -> Column:
    """Entries, as double, times ``SCALE``, floored, as longs (a long's limits where they lie beyond them)."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def whole_vectors(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, an array of longs, of every row of ``table`` whose vector can be used."""
    got = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    return got.where(usable(F.col("e"))).select("vec_id", scaled(F.col("e")).alias("x"))
