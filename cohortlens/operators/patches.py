"""Stages over tiles that keep their pixels as arrays: a row per tile (slide_uid, x0, y0, r, g, b), never one per pixel.

Measures are higher-order functions on the arrays, so that a tile is measured where it lies, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import shapes
from cohortlens.functions.optics import hsv, is_brown, optical_density


def _pixels() -> Column:
    return F.arrays_zip("r", "g", "b")


def _share(of) -> Column:
    """The share of a tile's pixels for which of(r, g, b) holds; null for a tile without pixels."""
    n = F.size("r")
    return F.size(F.filter(_pixels(), lambda p: of(p["r"], p["g"], p["b"]))) / F.when(n > 0, n)


def grey_share(white: float = 235.0) -> Column:
    """Share of pixels whose mean is below white."""
    return _share(lambda r, g, b: (r + g + b) / 3.0 < white)


def density_share(least: float = 0.15) -> Column:
    """Share of pixels whose optical density, summed over channels, is above least."""
    return _share(lambda r, g, b: optical_density(r) + optical_density(g) + optical_density(b) > least)


def saturated_share(brightest: float = 230.0, saturation: int = 15) -> Column:
    """Share of pixels that are darker than brightest and more saturated than saturation."""

    def keep(r: Column, g: Column, b: Column) -> Column:
        _, s, v = hsv(r, g, b)
        return (v < brightest) & (s > saturation)

    return _share(keep)


def brown_share() -> Column:
    return _share(is_brown)


def marker_mask(hues: tuple[int, int], saturation: int, least: int = 10) -> Column:
    """Per pixel whether a marker of these hues (ends included) and at least that saturation stains it.

    Of the pixels that have its colour those darker than their own threshold of largest variance between classes; all of them
    if they are equally dark, none if there are fewer than least.
    """

    def inverse(p: Column) -> Column:
        h, s, v = hsv(p["r"], p["g"], p["b"])
        return F.when(h.between(*hues) & (s >= saturation), 255 - v)

    def masked(dark: Column) -> Column:
        own = F.array_sort(F.filter(dark, lambda v: v.isNotNull()))
        threshold = F.transform(F.array(own), lambda x: F.when(F.size(x) >= least, _otsu(x)))[0]
        return F.transform(F.array(threshold), lambda t: F.transform(dark, lambda v: F.coalesce(v > t, F.lit(False))))[0]

    # Arrays are bound as lambda variables, so each is computed once.
    return F.transform(F.array(F.transform(_pixels(), inverse)), masked)[0]


def _otsu(ranked: Column) -> Column:
    """The threshold of sorted values in one pass over them, the smallest on a tie; -1 where they are all equal."""

    def up(state: Column, x: Column) -> Column:
        count, below = state["n"] + 1, state["s"] + x["v"]
        rest = F.size(ranked) - count
        between = F.when(x["ends"], F.round(count * rest * F.pow(below / count - (state["all"] - below) / rest, 2), 3)).otherwise(F.lit(0.0))
        better = between > state["most"]
        return F.struct(count.alias("n"), below.alias("s"), state["all"].alias("all"), F.when(better, between).otherwise(state["most"]).alias("most"), F.when(better, x["v"]).otherwise(state["t"]).alias("t"))

    steps = F.transform(ranked, lambda v, k: F.struct(v.cast("double").alias("v"), F.coalesce(F.get(ranked, k + 1) > v, F.lit(False)).alias("ends")))
    total = F.aggregate(ranked, F.lit(0.0), lambda s, v: s + v)
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), total.alias("all"), F.lit(0.0).alias("most"), F.lit(-1.0).alias("t"))
    return F.aggregate(steps, start, up)["t"]


#: Gates by name: the share of tissue that a threshold is held against.
GATES = {"grey": grey_share, "density": density_share, "saturation": saturated_share}


def is_tissue(gate: str = "grey", threshold: float = 0.5) -> Column:
    """Whether a tile has the share of tissue, the threshold included."""
    return F.coalesce(GATES[gate]() >= threshold, F.lit(False))


def sharpness(side: Column) -> Column:
    """Variance of the differences of neighbouring greys in a row, as a measure of blur."""
    grey = F.transform(_pixels(), lambda p: (p["r"] + p["g"] + p["b"]) / 3.0)
    steps = F.transform(F.filter(F.transform(grey, lambda v, k: F.struct(v.alias("v"), F.get(grey, k + 1).alias("w"), ((k + 1) % side).alias("edge"))), lambda x: (x["edge"] != 0) & x["w"].isNotNull()), lambda x: x["w"] - x["v"])
    n = F.size(steps)
    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda s, x: s + f(x))
    return F.when(n > 0, total(lambda x: x * x) / n - (total(lambda x: x) / n) ** 2)


def tissue(tiles: DataFrame, threshold: float = 0.005, gate: str = "grey") -> DataFrame:
    """Per slide: tiles, those with tissue, mean tissue fraction and the box of its tissue tiles."""
    rows = tiles.select("slide_uid", "x0", "y0", GATES[gate]().alias("share"))
    has = F.col("share") >= threshold
    box = {"left": F.min(F.when(has, F.col("x0"))), "top": F.min(F.when(has, F.col("y0"))), "right": F.max(F.when(has, F.col("x0"))), "bottom": F.max(F.when(has, F.col("y0")))}
    return rows.groupBy("slide_uid").agg(F.count(F.lit(1)).alias("n_tiles"), F.count_if(has).alias("n_tissue"), F.avg("share").alias("tissue_fraction"), *(v.alias(k) for k, v in box.items()))


def patches(tiles: DataFrame, pairs: DataFrame, threshold: float = 0.5, gate: str = "grey") -> DataFrame:
    """Tiles of paired slides, measured but not filtered: uid, case_id, stain, role, place, tissue_fraction, passes.

    pairs is (case_id, stain, moving_uid, reference_uid); a reference that several pairs have gives its tiles once.
    """
    moving = pairs.select(F.col("moving_uid").alias("slide_uid"), "case_id", "stain", F.lit("moving").alias("role"))
    reference = pairs.select(F.col("reference_uid").alias("slide_uid"), "case_id", F.lit("he").alias("stain"), F.lit("reference").alias("role"))
    if "reference_stain" in pairs.columns:
        reference = pairs.select(F.col("reference_uid").alias("slide_uid"), "case_id", F.col("reference_stain").alias("stain"), F.lit("reference").alias("role"))
    slides = moving.unionByName(reference).dropDuplicates(["slide_uid"])
    uid = F.format_string("%s__x%06d_y%06d", "slide_uid", "x0", "y0")
    out = tiles.join(slides, "slide_uid").select(uid.alias("uid"), "case_id", "stain", "role", "slide_uid", "x0", "y0", GATES[gate]().alias("tissue_fraction"), density_share().alias("od_fraction"))
    return out.withColumn("passes", F.coalesce(F.col("tissue_fraction") >= threshold, F.lit(False)))


def stain_fits(tiles: DataFrame, patch_rows: DataFrame, least: float = 0.1) -> DataFrame:
    """Per stain: mean and spread of each channel's optical density over the patches with enough tissue.

    Every tile gives its sums; spreads follow from the sums, so no tile's pixels are shuffled.
    """
    own = patch_rows.where(F.col("tissue_fraction") >= least).select("slide_uid", "x0", "y0", "stain")
    sums = []
    for c in "rgb":
        od = F.transform(c, lambda v: optical_density(v))
        sums += [F.aggregate(od, F.lit(0.0), lambda s, x: s + x).alias(f"s_{c}"), F.aggregate(od, F.lit(0.0), lambda s, x: s + x * x).alias(f"q_{c}")]
    rows = tiles.select("slide_uid", "x0", "y0", F.size("r").alias("n"), *sums).join(own, ["slide_uid", "x0", "y0"])
    out = rows.groupBy("stain").agg(F.count(F.lit(1)).alias("n_patches"), F.sum("n").alias("n"), *(F.sum(f"{k}_{c}").alias(f"{k}_{c}") for c in "rgb" for k in "sq"))
    mean = {c: F.col(f"s_{c}") / F.col("n") for c in "rgb"}
    spread = {c: F.sqrt(F.greatest(F.col(f"q_{c}") / F.col("n") - mean[c] * mean[c], F.lit(0.0))) for c in "rgb"}
    return out.select("stain", "n_patches", *(mean[c].alias(f"mean_{c}") for c in "rgb"), *(spread[c].alias(f"std_{c}") for c in "rgb"))


def counts(tiles: DataFrame, patch_rows: DataFrame, side: int, stains: list[str] | None = None, least: int = 50, most: int | None = None, threshold: float = 0.0, gate: str = "grey") -> DataFrame:
    """Per patch of the stains: tissue_fraction, brown_fraction and positive_cells; below the threshold no cells are counted."""
    rows = patch_rows.where("role = 'moving'").select("uid", "case_id", "stain", "slide_uid", "x0", "y0")
    rows = rows if stains is None else rows.where(F.col("stain").isin(list(stains)))
    joined = tiles.join(rows, ["slide_uid", "x0", "y0"]).select("uid", "case_id", "stain", GATES[gate]().alias("tissue_fraction"), brown_share().alias("brown_fraction"), F.transform(_pixels(), lambda p: F.greatest(p["r"], p["g"], p["b"])).alias("value"), F.transform(_pixels(), lambda p: is_brown(p["r"], p["g"], p["b"])).alias("brown"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cells = []
            for share, value, brown in zip(frame["tissue_fraction"], frame["value"], frame["brown"], strict=True):
                usable = len(value) and len(value) % side == 0 and share is not None and share >= threshold
                cells.append(shapes.cells(np.asarray(value, np.int64).reshape(-1, side), np.asarray(brown, bool).reshape(-1, side), least, most)[0] if usable else 0)
            yield frame.drop(columns=["value", "brown"]).assign(positive_cells=cells)

    return joined.mapInPandas(run, "uid string, case_id string, stain string, tissue_fraction double, brown_fraction double, positive_cells long")
