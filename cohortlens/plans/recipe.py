"""Recipes: what each stage does with a cohort, resolved from its descriptor, with a hash of the decisions."""

from __future__ import annotations

import copy
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.manifests import recipe_hash

#: Stages in order, and those that must have run before each.
STAGES = {"tissue": (), "alignment": (), "patches": ("alignment",), "stain": ("patches",), "counts": ("patches",)}

#: Defaults of descriptors.
DEFAULTS = {"default_magnification": 20.0, "detection_magnification": 1.25, "patch_size": 512, "stride": None, "alignment_method": "valis", "normalizer": "macenko"}

#: Settings of stages that no descriptor changes.
SETTINGS = {
    "tissue": {"min_area_fraction": 0.005, "preview_scale": 0.2, "tif_compression": "lzw", "tif_quality": 99, "skip_existing": True, "mode": "wsi"},
    "alignment": {
        "patch_size": 1024, "grid_density": 1, "qc_enabled": True, "keep_diagnostics": True, "aligned_wsi_level": 0,
        "valis_feature_detector": "disk", "valis_norm_method": "img_stats", "valis_num_features": 2000, "valis_non_rigid_dim": 2048, "valis_check_reflections": False, "valis_max_error_um": None,
        "qc_reference_read_level": None, "qc_moving_read_level": None,
    },
    "patches": {"dimension_tolerance": 0.01, "max_workers": 1, "tissue_threshold": 0.5},
    "stain": {"fit_min_tissue": 0.1, "max_train_patches": 1000},
    "counts": {"min_cell_area": 50, "max_cell_area": None, "tissue_threshold": 0.0},
    "selection": {"default": "all", "suggested_rule": "tissue_fraction >= 0.5"},
}


class PlanError(ValueError):
    """A descriptor, stage or setting that can't be used."""


def with_role(descriptor: dict, role: str) -> list[str]:
    return sorted(k for k, s in descriptor.get("stains", {}).items() if s.get("role") == role)


def problems(descriptor: dict) -> list[str]:
    """What keeps a descriptor from being used, in words."""
    d = DEFAULTS | {k: v for k, v in descriptor.items() if v is not None}
    references = with_role(d, "reference")
    checks = [
        (not d.get("sources"), "no sources are declared"),
        (not d.get("stains"), "no stains are declared"),
        (bool(d.get("stains")) and not references, "no stain has the role reference"),
        (len(references) > 1, f"more than one reference stain: {', '.join(references)}"),
        (d["default_magnification"] <= 0, "default_magnification must be above zero"),
        (d["detection_magnification"] <= 0, "detection_magnification must be above zero"),
        (d["detection_magnification"] > d["default_magnification"], "detection_magnification is above default_magnification"),
        (d["patch_size"] <= 0, "patch_size must be above zero"),
        (d["stride"] is not None and d["stride"] <= 0, "stride must be above zero"),
        (d["alignment_method"] not in ("valis", "orb"), f"unknown alignment_method {d['alignment_method']!r}"),
    ]
    return [text for bad, text in checks if bad]


#: Which stages have a setting that a cohort decides, and under what name.
SHARED = {
    "target_magnification": ("tissue", "alignment", "patches", "counts"),
    "detection_magnification": ("tissue",),
    "method": ("alignment",),
    "reference_stain": ("alignment", "patches"),
    "moving_stains": ("alignment", "patches"),
    "stride": ("patches",),
    "normalizer": ("stain",),
    "stains": ("stain",),
    "chromogen_stains": ("counts",),
}
#: Stages that need a moving stain, and those that cut patches.
PAIRED, CUT = ("alignment", "patches", "counts"), ("patches", "counts")


def build(descriptor: dict, overrides: dict[str, dict] | None = None, survey: DataFrame | None = None) -> dict:
    """The resolved recipe; overrides by stage come last.

    survey (slide_uid, case_id, stain, base, origin, readable) adds an entry per slide and a note for each that can't
    be used; these go into a file, so the driver gets one small row per slide.
    """
    d = DEFAULTS | {k: v for k, v in descriptor.items() if v is not None}
    reference, moving = (with_role(d, "reference") or ["he"])[0], with_role(d, "moving")
    target, size = float(d["default_magnification"]), int(d["patch_size"])
    dab = sorted(k for k, s in d.get("stains", {}).items() if (s.get("chromogen") or "").lower() == "dab")
    values = {"target_magnification": target, "detection_magnification": float(d["detection_magnification"]), "method": d["alignment_method"], "reference_stain": reference, "moving_stains": moving}
    values |= {"stride": int(d["stride"] or size), "normalizer": d["normalizer"], "stains": [reference, *moving], "chromogen_stains": dab}
    stages = copy.deepcopy(SETTINGS)
    for key, where in SHARED.items():
        for stage in where:
            stages[stage][key] = copy.copy(values[key])
    for stage in STAGES:
        stages[stage]["enabled"] = bool(moving) if stage in PAIRED else True
    for stage in CUT:
        stages[stage]["patch_size"] = size
    slides, notes = surveyed(survey, target) if survey is not None else ({}, [])
    for name, own in (overrides or {}).items():
        if name not in stages:
            raise PlanError(f"unknown stage {name!r}; known are {', '.join(sorted(stages))}")
        stages[name].update(own)
    notes += ["overrides were applied"] if overrides else []
    recipe = {"study": d.get("name", ""), "generated_at": datetime.now(UTC).isoformat(), "stages": stages, "slides": slides, "notes": notes}
    return recipe | {"recipe_hash": recipe_hash(recipe)}


def stage_of(recipe: dict, name: str) -> dict:
    """A stage's settings."""
    if name not in recipe["stages"]:
        raise PlanError(f"the recipe has no stage {name!r}")
    return recipe["stages"][name]


def surveyed(survey: DataFrame, target: float) -> tuple[dict, list[str]]:
    """An entry per slide and the notes on those that can't be used."""
    rows = usable_slides(survey, target)
    for c in ("case_id", "stain", "origin"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    advice = {"unreadable": "can't be read", "no magnification": "has no magnification; set one under its overrides", "below target": f"was scanned below {target:g}x, which is not made up"}
    slides, notes = {}, []
    for r in rows.select("slide_uid", "case_id", "stain", "base", "origin", "usable", "reason").orderBy("slide_uid").toLocalIterator():
        own = r["base"] if r["origin"] == "override" else None
        slides[r["slide_uid"]] = {"case": r["case_id"], "stain": r["stain"], "base_magnification": r["base"], "magnification_source": r["origin"], "source_magnification": own, "usable": r["usable"]}
        if not r["usable"]:
            notes.append(f"{r['slide_uid']} {advice[r['reason']]}")
    return slides, notes


def source_magnifications(pairs: DataFrame, survey: DataFrame) -> DataFrame:
    """pairs with the magnification of the reference and of the moving slide, and whether either is unknown."""
    own = lambda uid, name: survey.select(F.col("slide_uid").alias(uid), F.col("base").alias(name))
    out = pairs.join(own("reference_uid", "reference_magnification"), "reference_uid", "left").join(own("moving_uid", "moving_magnification"), "moving_uid", "left")
    return out.withColumn("missing", F.col("reference_magnification").isNull() | F.col("moving_magnification").isNull())


def shared_magnification(pairs: DataFrame, column: str) -> Column:
    """The one value that all rows of a group agree on, else null; for use in an aggregation."""
    return F.when(F.count_distinct(column) == 1, F.max(column))


def usable_slides(survey: DataFrame, target: float) -> DataFrame:
    """survey (slide_uid, base, readable) with usable and, for the others, the reason."""
    reason = F.when(~F.coalesce("readable", F.lit(False)), "unreadable").when(F.col("base").isNull(), "no magnification").when(F.col("base") + 1e-9 < target, "below target")
    return survey.withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())


def ordered(names: list[str] | None = None) -> list[str]:
    """The named stages (all by default) in the order they run in."""
    unknown = sorted(set(names or []) - set(STAGES))
    if unknown:
        raise PlanError(f"unknown stages: {', '.join(unknown)}; known are {', '.join(STAGES)}")
    return [s for s in STAGES if names is None or s in names]
