"""Measurements of tiles whose pixels are rows (tile, i, r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.optics import is_brown, optical_density, optical_density_max


def measures(px: DataFrame, white: float = 235.0) -> DataFrame:
    """Per tile: tissue fraction, share, mean and maximum of optical density, brown share, mean, spread and correlation."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    od = optical_density(F.col("r")) + optical_density(F.col("g")) + optical_density(F.col("b"))
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return px.groupBy("tile").agg(
        share(mean < white).alias("tissue_fraction"), share(od > 0.15).alias("od_share"), F.round(F.avg(od), 6).alias("od_mean"), F.round(F.max(optical_density_max(F.col("r"), F.col("g"), F.col("b"))), 6).alias("od_max"),
        share(is_brown(F.col("r"), F.col("g"), F.col("b"))).alias("brown_share"),
        F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.stddev_pop("r"), 6).alias("std_r"), F.round(F.corr("r", "g"), 6).alias("ncc_rg"),
    )


def otsu(px: DataFrame) -> DataFrame:
    """Per tile the grey threshold of largest variance between classes, the smallest on a tie."""
    counts = px.groupBy("tile", "r").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("tile").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("tile")
    v, n = F.col("r").cast("double"), F.col("n").cast("double")
    rows = counts.select("tile", "r", F.sum(n).over(up).alias("w0"), F.sum(n * v).over(up).alias("s0"), F.sum(n).over(every).alias("w"), F.sum(n * v).over(every).alias("s"))
    w1 = F.col("w") - F.col("w0")
    between = F.round(F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0.0)), 2), 3)
    best = rows.withColumn("between", F.coalesce(between, F.lit(0.0))).groupBy("tile").agg(F.max(F.struct("between", (-F.col("r")).alias("r"))).alias("best"))
    return best.select("tile", (-F.col("best.r")).cast("int").alias("threshold"))


def density(px: DataFrame, microns: float, threshold: int) -> DataFrame:
    """Per tile: dark pixels' area in square mm and dark red ones per area (null where there is no area)."""
    area = F.sum((F.col("r") < threshold).cast("int")) * (microns / 1000.0) ** 2
    cells = F.sum((F.col("b") < threshold - 40).cast("int"))
    return px.groupBy("tile").agg(F.round(area, 6).alias("area_mm2"), cells.alias("cells"), F.round(cells / F.nullif(area, F.lit(0.0)), 4).alias("density"))
