"""The stages of a study over tiles with pixels as arrays; each returns its manifest."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import images, patches

if TYPE_CHECKING:
    from cohortlens.plans.study import Study


def usable_pairs(study: Study, settings: dict) -> DataFrame:
    """Pairs of the stage's stains without slides that the recipe can't use."""
    pairs = study.pairs(settings.get("moving_stains"))
    out = list(getattr(study, "unusable", ()))
    return pairs.where(~F.col("moving_uid").isin(out) & ~F.col("reference_uid").isin(out)) if out else pairs


def tissue(study: Study, recipe: dict) -> DataFrame:
    return patches.tissue(study.tiles(), recipe["stages"]["tissue"]["min_area_fraction"])


def alignment(study: Study, recipe: dict) -> DataFrame:
    """Pairs registered by their overviews; a pair that can't be is a row with its error."""
    settings = recipe["stages"]["alignment"]
    view = study.overviews().select("slide_uid", F.flatten(F.transform(F.arrays_zip("r", "g", "b"), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("image"))
    pairs = usable_pairs(study, settings)
    rows = pairs.join(view.select(F.col("slide_uid").alias("reference_uid"), F.col("image").alias("ref")), "reference_uid").join(view.select(F.col("slide_uid").alias("moving_uid"), F.col("image").alias("moving")), "moving_uid")
    found = images.registered(rows.select(F.col("pair_uid").alias("pair"), "ref", "moving"), int(settings.get("overview_side", 0)) or side_of(study.overviews()), refine=True)
    return pairs.join(found.withColumnRenamed("pair", "pair_uid"), "pair_uid", "left")


def side_of(squares: DataFrame) -> int:
    """The side of tiles, which are squares."""
    row = squares.select(F.sqrt(F.size("r")).cast("int").alias("side")).first()
    return row["side"] if row else 1


def cut(study: Study, recipe: dict) -> DataFrame:
    settings = recipe["stages"]["patches"]
    return patches.patches(study.tiles(), usable_pairs(study, settings), settings["tissue_threshold"])


def stain(study: Study, recipe: dict) -> DataFrame:
    return patches.stain_fits(study.tiles(), study.manifest("patches"), recipe["stages"]["stain"]["fit_min_tissue"])


def counts(study: Study, recipe: dict) -> DataFrame:
    settings = recipe["stages"]["counts"]
    return patches.counts(study.tiles(), study.manifest("patches"), side_of(study.tiles()), settings["chromogen_stains"] or None, settings["min_cell_area"], settings["max_cell_area"], settings["tissue_threshold"])


DEFAULT_STAGES = {"tissue": tissue, "alignment": alignment, "patches": cut, "stain": stain, "counts": counts}
