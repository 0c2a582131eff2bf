"""Names of files, samples and outputs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords of stains in file names.
HE_KEYWORDS = ("hne", "h&e", "he")
IHC_KEYWORDS = ("cd8", "cd31", "caix", "meca79", "cd3", "cd56", "cd68", "cd163", "mhc1", "pdl1")

#: Endings of whole-slide images, the compound ones first.
SLIDE_ENDINGS = (".ome.tiff", ".ome.tif", ".svs", ".ndpi", ".tif", ".tiff", ".mrxs", ".scn", ".svslide", ".bif", ".vms", ".czi")


def _longest_first(words: tuple[str, ...]) -> list[str]:
    return sorted(words, key=lambda w: (-len(w), w))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slide_format(name: Column) -> Column:
    """The ending of a slide's name, compound ones whole; null for other files."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.endswith(e), F.lit(e)) for e in SLIDE_ENDINGS))


def image_stem(name: Column) -> Column:
    """A name without its slide ending."""
    return F.regexp_replace(name, r"(?i)(\.ome)?\.[^.]+$", "")


def safe_name(value: Column) -> Column:
    """Runs outside letters, digits, dot, underscore and dash as one underscore; dots and underscores trimmed; null if nothing is left."""
    runs = F.regexp_replace(F.trim(value), r"[^A-Za-z0-9._-]+", "_")
    return F.nullif(F.regexp_replace(runs, r"^[._]+|[._]+$", ""), F.lit(""))


def natural_key(name: Column) -> Column:
    """Sort key by runs: numbers by value and before text, text without case."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda t: t.try_cast("decimal(38,0)")
    return F.transform(runs, lambda t: F.struct(F.when(t.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.when(t.rlike(r"^\d"), number(t)).alias("number"), F.lower(t).alias("text")))


def sample_id(name: Column, extra: tuple[str, ...] = ()) -> Column:
    """A name's stem without stain keywords and without empty places between underscores."""
    words = "|".join(f"\\Q{w}\\E" for w in _longest_first(HE_KEYWORDS + IHC_KEYWORDS + extra))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(stem, f"(?i)[-_]?(?:{words})[-_]?", "_"), "_+", "_"), "^_|_$", "")


def stain_class(name: Column) -> Column:
    """(kind, label) of a name: markers before haematoxylin, longer keywords first; null if none is there."""
    low = F.lower(name)
    markers = [F.when(low.contains(w), F.struct(F.lit("IHC").alias("kind"), F.lit(w.upper()).alias("label"))) for w in _longest_first(IHC_KEYWORDS)]
    plain = [F.when(low.contains(w), F.struct(F.lit("HE").alias("kind"), F.lit("HnE").alias("label"))) for w in HE_KEYWORDS]
    return F.coalesce(*markers, *plain)


def role_of(name: Column, reference: str = "reference", moving: str = "moving") -> tuple[Column, Column]:
    """(sample, role) of names such as sample_role.ext; nulls where they don't fit."""
    pattern = rf"^(.+?)_(\Q{reference}\E|\Q{moving}\E)(?:\.[^.]+)+$"
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lower(F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")))
