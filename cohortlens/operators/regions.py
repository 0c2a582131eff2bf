"""Manifests of extracted regions, and the names under which a stage's files are laid out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.naming import base_name


def region_manifests(boxes: DataFrame, pipeline: str, order: str = "box", detection: str = "otsu") -> DataFrame:
    """A manifest row per region of boxes (slide, path, width, height, rx, ry, rw, rh as shares), numbered by order within its slide.

    A region has at least one pixel and lies inside its slide.
    """
    scaled = lambda share, full: (F.col(share) * F.col(full)).cast("int")
    low = lambda share, full: F.greatest(F.lit(0), F.least(scaled(share, full), F.col(full) - 1))
    length = lambda share, full, start: F.greatest(F.lit(1), F.least(scaled(share, full), F.col(full) - F.col(start)))
    rows = boxes.withColumn("region_number", F.row_number().over(Window.partitionBy("slide").orderBy(order))).withColumns({"x": low("rx", "width"), "y": low("ry", "height")})
    rows = rows.withColumns({"w": length("rw", "width", "x"), "h": length("rh", "height", "y")})
    return rows.select(
        F.lit(pipeline).alias("pipeline"), F.col("slide").alias("sample_id"), "region_number", F.format_string("region_%03d", "region_number").alias("region_tag"), base_name(F.col("path")).alias("source_file"), F.lit(detection).alias("detection_source"),
        F.struct(F.struct("rx", "ry", "rw", "rh").alias("relative"), F.struct("x", "y", "w", "h").alias("absolute_pixels")).alias("coordinates"), F.struct("width", "height").alias("full_slide_dims"),
    )


def slide_manifests(slides: DataFrame, regions: DataFrame, pipeline: str) -> DataFrame:
    """A manifest row per slide (slide, path) with its regions in order; a slide without regions has none."""
    region = F.struct("region_number", "region_tag", F.col("coordinates.relative").alias("relative_box"), F.col("coordinates.absolute_pixels").alias("absolute_box"))
    own = regions.groupBy("sample_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    out = slides.select(F.lit(pipeline).alias("pipeline"), F.col("slide").alias("sample_id"), base_name(F.col("path")).alias("source_file")).join(own, "sample_id", "left")
    none = F.array().cast(own.schema["regions"].dataType)
    return out.select("pipeline", "sample_id", "source_file", F.coalesce(F.size("regions"), F.lit(0)).alias("n_regions"), F.coalesce("regions", none).alias("regions"))


def _suffix(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def staged_slides(records: DataFrame) -> DataFrame:
    """(name, path) of slides (slide_uid, path, excluded) laid out flat by uid; excluded ones are left out."""
    return records.where(~F.coalesce("excluded", F.lit(False))).select(F.concat("slide_uid", _suffix(F.col("path"))).alias("name"), "path")


def staged_pairs(pairs: DataFrame, slides: DataFrame, reference: str = "reference", moving: str = "moving") -> DataFrame:
    """(name, path) of pairs (case_id, stain, reference_uid, moving_uid), laid out as stain/role/case_role.

    Slides of one case and stain share a name; the last by uid has it.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(uid).alias("slide_uid")) for role, uid in ((reference, "reference_uid"), (moving, "moving_uid")))))
    rows = pairs.select("case_id", "stain", sides.alias("side")).select("case_id", "stain", "side.*").join(slides.select("slide_uid", "path"), "slide_uid")
    place = F.concat(F.concat_ws("/", "stain", "role", "case_id"), F.lit("_"), "role")
    return rows.groupBy(F.concat(place, _suffix(F.col("path"))).alias("name")).agg(F.max_by("path", "slide_uid").alias("path"))
