"""Regions and cores of whole cohorts: found on overviews, listed in manifests, cut out at the target magnification."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import shapes
from cohortlens.operators import cores, grid, regions
from cohortlens.plans import recipe as plans
from cohortlens.sources import slides

if TYPE_CHECKING:
    from cohortlens.plans.study import Study


def detected(survey: DataFrame, overviews: DataFrame, share: float, round_only: bool = False, roundness: float = 0.0, enhance: bool = False) -> DataFrame:
    """Boxes (slide_uid, box, rx, ry, rw, rh as shares of the slide) on overviews that are square and white beyond the slide.

    Boxes are numbered in reading order.  A slide that fails, or has none, has no rows; the others go on.
    """
    rows = overviews.join(survey.where("readable").select("slide_uid", "width", "height"), "slide_uid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for uid, w, h, *colours in frame[["slide_uid", "width", "height", "r", "g", "b"]].itertuples(index=False, name=None):
                side = round(len(colours[0]) ** 0.5)
                high, wide = (max(1, round(n * side / max(w, h))) for n in (h, w))
                view = np.stack([np.asarray(c, np.uint8).reshape(side, side) for c in colours], 2)[:high, :wide]
                try:
                    found = shapes.regions(shapes.enhanced(view) if enhance else view, share, round_only, roundness)
                except ValueError:  # too small to hold an outline
                    found = []
                out += [(uid, k, *box) for k, box in enumerate(found)]
            yield pd.DataFrame(out, columns=["slide_uid", "id", "x", "y", "w", "h"])

    found = rows.mapInPandas(run, "slide_uid string, id int, x double, y double, w double, h double")
    # Reading order works on whole numbers; millionths of a side stand for the shares.
    scaled = found.select("slide_uid", "id", *(F.round(F.col(c) * 1e6).cast("long").alias(c) for c in "xywh"))
    order = grid.in_reading_order(scaled, "slide_uid").select("slide_uid", "id", F.col("place").alias("box"))
    return found.join(order, ["slide_uid", "id"]).select("slide_uid", "box", *(F.col(c).alias(f"r{c}") for c in "xywh"))


def tissue_regions(survey: DataFrame, overviews: DataFrame, share: float = 0.005) -> DataFrame:
    """A manifest row per tissue region of every slide."""
    boxes = detected(survey, overviews, share).join(survey.select("slide_uid", "path", "width", "height"), "slide_uid")
    return regions.region_manifests(boxes.withColumnRenamed("slide_uid", "slide"), "tissue")


def core_regions(survey: DataFrame, overviews: DataFrame, records: DataFrame, share: float = 0.0005, roundness: float = 0.6, scale: float = 1.0, fall_back: bool = True) -> DataFrame:
    """A row per core (slide_uid, path, box, x, y, w, h, detection_source); slides whose count differs from their reference's take its boxes.

    records is (slide_uid, case_id, role); a case with several references uses the first by uid.
    """
    known = survey.where("readable").select("slide_uid", "path", "width", "height")
    found = detected(survey, overviews, share, True, roundness, enhance=True)
    plain = detected(survey, overviews, share, True, roundness)
    first = records.where("role = 'reference'").groupBy("case_id").agg(F.min("slide_uid").alias("slide_uid"))
    of_case = plain.join(first, "slide_uid").drop("slide_uid")
    moving = records.where("role = 'moving'").select(F.col("slide_uid").alias("slide"), "case_id")
    chosen = cores.chosen_boxes(moving, found.withColumnRenamed("slide_uid", "slide"), of_case, fall_back)
    own = of_case.join(first.withColumnRenamed("slide_uid", "slide"), "case_id").withColumn("detection_source", F.lit("he_reference"))
    rows = chosen.unionByName(own).join(known.withColumnRenamed("slide_uid", "slide"), "slide")
    placed = cores.scaled_boxes(rows, scale)
    return placed.join(rows.select("slide", "box", "path", "detection_source"), ["slide", "box"]).withColumnRenamed("slide", "slide_uid").select("slide_uid", "path", "box", "x", "y", "w", "h", "detection_source")


def region_survey(survey: DataFrame, boxes: DataFrame, tag: str) -> DataFrame:
    """Regions (slide_uid, box, x, y, w, h) as rows that slides.windows() reads, each with a uid of its own."""
    uid = F.format_string(f"%s__{tag}_%03d", "slide_uid", "box")
    rows = boxes.select("slide_uid", "box", "x", "y", "w", "h").join(survey.drop("width", "height"), "slide_uid")
    return rows.withColumns({"slide_uid": uid, "left": F.col("x"), "top": F.col("y"), "width": F.col("w"), "height": F.col("h")})


def thumbnails(overviews: DataFrame) -> DataFrame:
    return overviews.select(F.concat("slide_uid", F.lit(".png")).alias("output"), "r", "g", "b")


def export(study: Study, folder: str, share: float = 0.005, size: int = 512, of_cores: bool = False) -> DataFrame:
    """Write every region, or every core, of a study as a pyramid of its own below a folder; gives slide_uid, path, n_tiles, bytes."""
    target = float(study.descriptor.get("default_magnification", plans.DEFAULTS["default_magnification"]))
    seen, views = study._table("survey"), study.overviews()
    if of_cores:
        boxes = core_regions(seen, views, study.records(), share)
    else:
        boxes = tissue_regions(seen, views, share).select(F.col("sample_id").alias("slide_uid"), F.col("region_number").alias("box"), "coordinates.absolute_pixels.*")
    boxes = study._put(boxes, "cores" if of_cores else "regions")
    rows = region_survey(seen, boxes, "core" if of_cores else "region")
    sizes = rows.select("slide_uid", *(F.greatest(F.bround(F.col(c) * target / F.col("base"), 0), F.lit(1)).cast("int").alias(c) for c in ("width", "height")), F.when(F.col("mpp_x") > 0, F.col("mpp_x") * F.col("base") / target).alias("mpp"), F.lit(target).alias("magnification"))
    return slides.write_pyramids(slides.tiles(rows, target, size), sizes, folder, size, study._path("work"), levels=2)
