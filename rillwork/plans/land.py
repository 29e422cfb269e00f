"""Composite land jobs: water masks, seasons, available land, and agreement between sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions import terrain as T
from rillwork.operators import focal as FO
from rillwork.operators import land as L
from rillwork.operators import tiles as TI
from rillwork.session import attach, cut


def water_mask(index: DataFrame, keys: Sequence[str], cell_size: float, min_area: float) -> tuple[DataFrame, DataFrame]:
    """Water cells with their group label, and per-raster facts.

    ``index(<keys>, row, col, cell, ix)``. The threshold splits the 256-bin histogram; a negative
    one gives way to 0, so a scene without water stays dry. Then open, close, and drop groups
    under ``min_area``.
    """
    keys = list(keys)
    valid = cut(index.filter(F.col("ix").isNotNull()).withColumn("_b", T.byte_scale(F.col("ix"))))
    cut_at = L.otsu(valid, keys, "_b")
    v = attach(valid, cut_at, keys)
    otsu = F.col("threshold") / 127.5 - 1
    wet = F.when(otsu < 0, F.col("ix") > 0).otherwise(F.col("_b") > F.col("threshold"))
    binary = cut(v.select(*keys, "row", "col", "cell", wet.cast("int").alias("m"), otsu.alias("_o")))
    closed = cut(FO.open_close(binary.select(*keys, "row", "col", "cell", "m"), keys, "m"))
    before = TI.label_components(binary.filter("m = 1").select(*keys, "row", "col", "cell"), keys)
    after = TI.label_components(closed.filter("m = 1").select(*keys, "row", "col", "cell"), keys)
    need = max(1, round(min_area / cell_size**2))
    kept = cut(TI.keep_large(after, keys, need))
    facts = (
        binary.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.greatest(F.first("_o"), F.lit(0.0)).alias("threshold"))
        .join(before.groupBy(*keys).agg(F.count_distinct("label").alias("components_before")), keys, "left")
        .join(
            kept.groupBy(*keys).agg(F.count_distinct("label").alias("components_after"), F.count(F.lit(1)).alias("_w")),
            keys,
            "left",
        )
    )
    zero = F.lit(0)
    return kept, facts.select(
        *keys, "threshold",
        F.coalesce("components_before", zero).alias("components_before"),
        F.coalesce("components_after", zero).alias("components_after"),
        (F.coalesce("_w", zero) / F.col("_n")).alias("water_fraction"),
    )


def combine_seasons(dry: DataFrame, wet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Water of the wet season, ``perennial`` where the dry season has it too."""
    spot = [*keys, "row", "col"]
    seen = dry.select(*spot).withColumn("_d", F.lit(1))
    label = F.when(F.col("_d") == 1, "perennial").otherwise("seasonal")
    return wet.join(seen, spot, "left").withColumn("season", label).drop("_d")


def seasonal_water(
    dry: DataFrame, wet: DataFrame, keys: Sequence[str], cols: Column, cell_size: float, min_area: float
) -> tuple[DataFrame, DataFrame]:
    """Water of the wet season, perennial or seasonal, from the scenes of both; and facts per raster and season.

    ``dry`` and ``wet`` are bands as ``operators.land.season_composite`` takes them. Each season's clearest scenes make
    a composite, its index a mask with its own threshold, and the masks are laid over each other.
    """
    keys = list(keys)
    masks, told = {}, []
    for name, bands in (("dry", dry), ("wet", wet)):
        shot = L.season_composite(bands, keys).withColumn("ix", T.ndwi(F.col("green"), F.col("nir")))
        shot = shot.withColumn("cell", (F.col("row") * cols + F.col("col")).cast("long"))
        masks[name], facts = water_mask(shot.select(*keys, "row", "col", "cell", "ix"), keys, cell_size, min_area)
        told.append(facts.withColumn("season", F.lit(name)))
    return combine_seasons(masks["dry"], masks["wet"], keys), told[0].unionByName(told[1])


def mask_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared over joint cells of two masks, and their difference in size."""
    spot = [*keys, "row", "col"]
    j = a.select(*spot).withColumn("_a", F.lit(1)).join(b.select(*spot).withColumn("_b", F.lit(1)), spot, "full_outer")
    return j.groupBy(*keys).agg(
        (F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)) / F.count(F.lit(1))).alias("jaccard"),
        (F.count("_a") - F.count("_b")).alias("size_delta"),
    )


def surface_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bias, RMSE, RMSE without the bias and correlation on cells both surfaces have."""
    spot = [*keys, "row", "col"]
    j = a.select(*spot, "z").join(b.select(*spot, F.col("z").alias("y")), spot).filter("z IS NOT NULL AND y IS NOT NULL")
    d = F.col("y") - F.col("z")
    return j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.stddev_pop(d).alias("rmse_unbiased"), F.corr("z", "y").alias("r"),
    )


def channel_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """Share of the cells of ``a`` with a cell of ``b`` within ``reach`` rows and columns."""
    keys = list(keys)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    # dilate along rows, then along columns: 2·(2k+1) copies per cell, not (2k+1)²
    wide = b.select(*keys, (F.col("row")).alias("row"), F.explode(steps).alias("_s"), "col")
    wide = wide.select(*keys, "row", (F.col("col") + F.col("_s")).alias("col")).distinct()
    tall = wide.select(*keys, "row", "col", F.explode(steps).alias("_s"))
    tall = tall.select(*keys, (F.col("row") + F.col("_s")).alias("row"), "col").distinct().withColumn("_hit", F.lit(1))
    j = a.select(*keys, "row", "col").join(tall, [*keys, "row", "col"], "left")
    return j.groupBy(*keys).agg((F.count("_hit") / F.count(F.lit(1))).alias("share"))


def available_land(
    cells: DataFrame, keys: Sequence[str], rule: L.Rule, min_parcel: float, cell_size: float
) -> tuple[DataFrame, DataFrame]:
    """Eligible cells with their parcel label, and one row of facts per parcel."""
    keys = list(keys)
    c = cut(cells)
    big = L.contiguous(c, keys, rule, min_parcel, cell_size)
    chosen = cut(c.join(big.select(*keys, "cell", "label"), [*keys, "cell"]))
    return chosen, L.parcels(chosen, keys, cell_size**2)
