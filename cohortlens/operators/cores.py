"""Boxes of cores and random regions, choices among patch files, and figures of a registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen_boxes(slides: DataFrame, own: DataFrame, reference: DataFrame, fall_back: bool = True, detect: bool = True) -> DataFrame:
    """
    Boxes (slide, case_id, box, rx, ry, rw, rh, detection_source) of each slide (slide, case_id).

    Its own where it has as many as its case's reference (case_id, box, rx, ry, rw, rh), else the reference's; without fall_back its own,
    if it has any; without detect always the reference's.  A slide whose source has no boxes has no rows.
    """
    n_own = own.groupBy("slide").agg(F.count(F.lit(1)).alias("n_own"))
    n_ref = reference.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_ref"))
    rows = slides.select("slide", "case_id").join(n_own, "slide", "left").join(n_ref, "case_id", "left").fillna(0, ["n_own", "n_ref"])
    if not detect:
        source = F.lit("he_reference")
    elif fall_back:
        source = F.when((F.col("n_own") == 0) | (F.col("n_own") != F.col("n_ref")), "he_fallback").otherwise("per_stain_otsu")
    else:
        source = F.when(F.col("n_own") == 0, "otsu_empty").otherwise("per_stain_otsu")
    rows = rows.select("slide", "case_id", source.alias("detection_source"))
    box = ["box", "rx", "ry", "rw", "rh"]
    from_own = rows.where("detection_source = 'per_stain_otsu'").join(own.select("slide", *box), "slide")
    from_ref = rows.where("detection_source LIKE 'he%'").join(reference.select("case_id", *box), "case_id")
    return from_own.unionByName(from_ref).select("slide", "case_id", *box, "detection_source")


def scaled_boxes(boxes: DataFrame, scale: float = 1.0) -> DataFrame:
    """boxes (slide, box, width, height, rx, ry, rw, rh as shares) in pixels, scaled about their centres, inside their slides, a pixel at least."""
    whole = lambda share, full: (F.col(share) * F.col(full)).cast("int")
    out = boxes.withColumns({"x": whole("rx", "width"), "y": whole("ry", "height"), "w": whole("rw", "width"), "h": whole("rh", "height")})
    if scale != 1.0:
        half = lambda c: F.floor(F.col(c) / 2).cast("int")
        out = out.withColumns({"cx": F.col("x") + half("w"), "cy": F.col("y") + half("h"), "w": (F.col("w") * scale).cast("int"), "h": (F.col("h") * scale).cast("int")})
        out = out.withColumns({"x": F.col("cx") - half("w"), "y": F.col("cy") - half("h")})
    out = out.withColumns({c: F.greatest(F.lit(0), F.least(F.col(c), F.col(full) - 1)) for c, full in (("x", "width"), ("y", "height"))})
    end = {n: F.greatest(F.lit(1), F.least(F.col(n), F.col(full) - F.col(c))).cast("int") for n, c, full in (("w", "x", "width"), ("h", "y", "height"))}
    return out.withColumns(end).select("slide", "box", "x", "y", "w", "h")


#: Fixed values of the search for random regions: inset share, darkest and palest that count as tissue, tries.
EDGE, BRIGHTEST, LEAST_SATURATION, TRIES = 0.05, 220 / 255, 0.05, 200


def candidate_regions(slides: DataFrame, size: int, regions: int, seed: int, tries: int = TRIES) -> DataFrame:
    """
    Places (slide, region, attempt, x0, y0, x1, y1) to look for tissue at, uniform inside each slide's inset.

    They follow from the seed, the slide, the region and the attempt alone, so that a rerun on any cluster gives the same.
    A slide too small for the inset has one, in its middle.
    """
    inset = {c: F.greatest((F.col(c) * EDGE).cast("int"), F.lit(size // 2)) for c in ("width", "height")}
    rows = slides.select("slide", "width", "height", *(v.alias(f"in_{c}") for c, v in inset.items()))
    room = {c: F.col(c) - 2 * F.col(f"in_{c}") - size for c in ("width", "height")}
    tight = (room["width"] <= 0) | (room["height"] <= 0)
    rows = rows.withColumn("region", F.explode(F.sequence(F.lit(1), F.lit(regions)))).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.when(tight, F.lit(1)).otherwise(F.lit(tries)))))

    def start(c: str) -> Column:
        key = F.concat_ws("|", F.lit(str(seed)), F.col("slide").cast("string"), F.col("region").cast("string"), F.col("attempt").cast("string"), F.lit(c))
        draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
        free = F.greatest(F.lit(0), F.floor((F.col(c) - size) / 2))
        low = F.when(tight, free).otherwise(F.col(f"in_{c}") + draw % (room[c] + 1))
        return F.greatest(F.lit(0), F.least(low + size, F.col(c)) - size).cast("int")

    rows = rows.withColumns({"x0": start("width"), "y0": start("height")})
    return rows.select("slide", "region", "attempt", "x0", "y0", F.least(F.col("x0") + size, F.col("width")).alias("x1"), F.least(F.col("y0") + size, F.col("height")).alias("y1"))


def random_regions(candidates: DataFrame) -> DataFrame:
    """Of candidates (..., brightness, saturation as shares) the first with tissue per slide and region, else the darkest; `tissue` says which."""
    has = (F.col("brightness") <= BRIGHTEST) & (F.col("saturation") >= LEAST_SATURATION)
    order = F.struct(F.when(has, 0).otherwise(1), F.when(has, 0.0).otherwise(F.col("brightness")), F.col("attempt"))
    row = F.struct("attempt", "x0", "y0", "x1", "y1", F.coalesce(has, F.lit(False)).alias("tissue"))
    return candidates.groupBy("slide", "region").agg(F.min_by(row, order).alias("row")).select("slide", "region", "row.*")


def crop_scores() -> tuple[Column, Column]:
    """Mean brightness and mean saturation of a tile's pixels (r, g, b arrays) as shares."""
    n = F.size("r")
    mean = lambda of: F.aggregate(F.transform(F.arrays_zip("r", "g", "b"), of), F.lit(0.0), lambda s, x: s + x) / F.when(n > 0, n) / 255.0
    grey = lambda p: F.shiftright(p["r"] * 19595 + p["g"] * 38470 + p["b"] * 7471 + 32768, 16).cast("double")

    def saturation(p: Column) -> Column:
        most, least = F.greatest(p["r"], p["g"], p["b"]), F.least(p["r"], p["g"], p["b"])
        return F.when(most > 0, F.floor(255.0 * (most - least) / most)).otherwise(F.lit(0)).cast("double")

    return mean(grey), mean(saturation)


def same_regions(stored: dict, seed: int, zooms: dict[str, int], regions: int, size: tuple[int, int]) -> bool:
    """Whether stored regions may be used again: the same seed, slide size, zooms and number of regions of each."""
    have = stored.get("regions", {})
    return stored.get("seed") == seed and tuple(stored.get("size", ())) == tuple(size) and stored.get("zooms") == zooms and set(have) == set(zooms) and all(len(v) == regions for v in have.values())


#: Endings of patch images.
PATCH_ENDINGS = (".png", ".jpg", ".jpeg", ".tif", ".tiff")


def patch_files(paths: DataFrame) -> DataFrame:
    """(patch_id, path): image files under every six-digit token of their names."""
    name = F.element_at(F.split("path", "/"), -1)
    images = paths.select("path", name.alias("name")).where(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in PATCH_ENDINGS) + ")$"))
    return images.select(F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(r"(\d{6})"), 1))).alias("patch_id"), "path", "name")


def picked_patches(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (patch_id, case_id, tag) with the first of its files (by path) that names its case or tag, else the first; null without any."""
    fits = F.contains(F.lower("name"), F.lower("case_id")) | F.contains(F.lower("name"), F.col("tag"))
    keys = ["patch_id", "case_id", "tag"]
    return wanted.join(files, "patch_id", "left").groupBy(*keys).agg(F.min_by("path", F.struct(~F.coalesce(fits, F.lit(False)), F.col("path"))).alias("path"), F.count("path").alias("n_files"))


def registration_error(errors: DataFrame, longest: int, processed: int, limit: float | None = None) -> DataFrame:
    """
    One row: error (mean), unit (um or px), column and accepted.

    The first column of a non-rigid distance counts, else the first distance (names that end in D).  With a resolution the mean goes from
    pixels of the processed image to micrometres; without one it stays in pixels and no limit applies.  No distance, no row.
    """
    ends = [c for c in errors.columns if c.endswith("D")]
    named = [c for c in ends if "non_rigid" in c] or ends
    if not named:
        return errors.sparkSession.createDataFrame([], "error double, unit string, column string, accepted boolean")
    resolution = F.avg(F.nanvl("resolution", F.lit(None))) if "resolution" in errors.columns else F.lit(None).cast("double")
    rows = errors.agg(F.avg(named[0]).alias("px"), resolution.alias("resolution"))
    um = F.col("px") * (longest / processed) * F.col("resolution")
    over = F.lit(False) if limit is None else F.coalesce(um > limit, F.lit(False))
    return rows.where("px IS NOT NULL").select(F.coalesce(um, F.col("px")).alias("error"), F.when(um.isNull(), "px").otherwise("um").alias("unit"), F.lit(named[0]).alias("column"), (~over).alias("accepted"))


def field_ratio(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The larger of the two side ratios of two canvases, one at least."""
    sides = [F.greatest(x, y) / F.greatest(F.lit(1), F.least(x, y)) for x, y in zip(a, b, strict=True)]
    return F.greatest(*sides)


def grid_is_viable(width: Column, height: Column, density: int, patch: int) -> Column:
    """Whether a cell of a density x density grid holds a patch at all."""
    return (width / density >= patch) & (height / density >= patch)


def bar_length(width: Column, microns: float, mpp: Column) -> Column:
    """Pixels of a scale bar: at most two fifths of the image, 20 at least."""
    return F.greatest(F.least((F.lit(microns) / mpp).cast("int"), (width * 0.40).cast("int")), F.lit(20))


def centre_window(width: Column, height: Column, downsample: Column, length: int) -> dict[str, Column]:
    """Where to read a centred square of `length` full-resolution pixels at a level: x0, y0 there, w and h on the level."""
    out = {}
    for c, size, full in (("x0", "w", width), ("y0", "h", height)):
        start = F.greatest(F.lit(0), F.floor(full / 2) - length // 2).cast("int")
        on_level = (full / downsample).cast("int")
        out[c] = start
        wanted = F.greatest(F.lit(1), F.bround(F.lit(length) / downsample, 0)).cast("int")
        out[size] = F.least(wanted, F.greatest(F.lit(1), on_level - (start / downsample).cast("int")))
    return out


def level_matrix(matrix: Column, reference: tuple[Column, Column], moving: tuple[Column, Column], reference_downsample: Column, moving_downsample: Column) -> Column:
    """
    Six numbers of the affine map from a level of the moving slide to one of the reference.

    matrix holds the six of the map from the reference's overview to the moving slide's; reference and moving are the full-resolution
    pixels per overview pixel.  Null where the map has no inverse.
    """
    a, b, c, d, e, f = (F.get(matrix, k) for k in range(6))
    det = a * e - b * d
    inverse = [[e / det, -b / det, (b * f - c * e) / det], [-d / det, a / det, (c * d - a * f) / det]]
    rows = []
    for k, row in enumerate(inverse):
        out = reference[k] / reference_downsample
        rows += [out * row[0] * moving_downsample / moving[0], out * row[1] * moving_downsample / moving[1], out * row[2]]
    return F.when(det != 0, F.array(*rows))


def painted(base: list[Column], layers: list[tuple[Column, tuple[int, int, int]]]) -> list[Column]:
    """r, g and b of a pixel under layers (mask, colour) in the order in which they are painted: the last one that holds is seen."""
    return [F.coalesce(*(F.when(mask, F.lit(colour[k])) for mask, colour in reversed(layers)), v) for k, v in enumerate(base)]


def first_magnifications(records: DataFrame) -> DataFrame:
    """(stain, source_magnification): the first that a stain's slides declare, in order of their uids."""
    declared = records.where("source_magnification > 0")
    return declared.groupBy("stain").agg(F.min_by("source_magnification", "slide_uid").alias("source_magnification"))


def aligned_manifest(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """Every pair with its alignment result by case and stain; a pair without one has status missing."""
    out = pairs.join(results, ["case_id", "stain"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("missing")))
