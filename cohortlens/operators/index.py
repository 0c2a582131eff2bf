"""Slides from file names, their pairs, and checks of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.naming import SLIDE_ENDINGS

#: case, stain and an optional section of a slide's file name, with any ending that slides have.
NAME = r"^(.+?)_([A-Za-z0-9]+?)(?:_s(\d+))?(?i:" + "|".join(e.replace(".", r"\.") for e in SLIDE_ENDINGS) + ")$"


def decoded(files: DataFrame, pattern: str = NAME) -> DataFrame:
    """files (path, name) with case_id, stain, section and slide_uid; all null where a name doesn't fit."""
    fits = F.col("name").rlike(pattern)
    part = lambda k: F.when(fits, F.nullif(F.regexp_extract("name", pattern, k), F.lit("")))
    out = files.withColumns({"case_id": part(1), "stain": F.lower(part(2)), "section": F.when(fits, F.coalesce(part(3).cast("int"), F.lit(1)))})
    return out.withColumn("slide_uid", F.when(fits, F.format_string("%s__%s__s%02d", "case_id", "stain", "section")))


def slides(files: DataFrame) -> DataFrame:
    """Decoded slides, the first path of each uid, in one shuffle."""
    known = decoded(files).where("slide_uid IS NOT NULL")
    rest = [c for c in known.columns if c != "slide_uid"]
    first = known.groupBy("slide_uid").agg(F.min_by(F.struct(*rest), F.col("path")).alias("row"))
    return first.select(*(F.col("slide_uid") if c == "slide_uid" else F.col("row")[c].alias(c) for c in known.columns))


def declared(slide_rows: DataFrame, stains: dict[str, dict], overrides: DataFrame | None = None) -> DataFrame:
    """Slides with role, source_magnification, excluded and note.

    stains is what a descriptor says of each stain (role, source_magnification); others are moving.  overrides is
    (slide_uid, source_magnification, exclude, note), any of the last three may be missing; a null there decides nothing.
    """
    rows = slide_rows
    table = [(k, v.get("role") or "moving", v.get("source_magnification")) for k, v in sorted(stains.items())]
    known = rows.sparkSession.createDataFrame([(k, r, None if m is None else float(m)) for k, r, m in table], "stain string, role string, stain_magnification double")
    rows = rows.join(F.broadcast(known), "stain", "left")  # as many rows as a descriptor has stains
    given = dict.fromkeys(("source_magnification", "exclude", "note"))
    if overrides is not None:
        given = {c: F.col(f"own.{c}") if c in overrides.columns else None for c in given}
        rows = rows.join(overrides.select("slide_uid", F.struct(*(c for c in given if c in overrides.columns)).alias("own")), "slide_uid", "left")
    own = {c: F.lit(None) if v is None else v for c, v in given.items()}
    out = {"role": F.coalesce("role", F.lit("moving")), "source_magnification": F.coalesce(own["source_magnification"].cast("double"), "stain_magnification"), "excluded": F.coalesce(own["exclude"].cast("boolean"), F.lit(False)), "note": own["note"].cast("string")}
    return rows.select(*slide_rows.columns, *(v.alias(c) for c, v in out.items()))


def pairs_of(records: DataFrame, biomarkers: list[str] | None = None, include_excluded: bool = False) -> DataFrame:
    """(pair_uid, case_id, stain, moving_uid, reference_uid) of declared slides: each moving one with its case's first reference.

    The first is by stain and section among references that are not excluded; cases without one give no pair.
    """
    usable = records if include_excluded else records.where("NOT excluded")
    ref = usable.where("role = 'reference'").groupBy("case_id").agg(F.min(F.struct("stain", "section", "slide_uid")).alias("r"))
    moving = usable.where("role = 'moving'")
    if biomarkers:
        moving = moving.where(F.col("stain").isin([b.strip().lower() for b in biomarkers]))
    out = moving.join(ref, "case_id").select("case_id", "stain", F.col("slide_uid").alias("moving_uid"), F.col("r.slide_uid").alias("reference_uid"), F.col("r.stain").alias("reference_stain"))
    return out.withColumn("pair_uid", F.concat_ws("__", "reference_uid", "moving_uid"))


def cases(records: DataFrame) -> DataFrame:
    """Per case its number of slides and their uids by stain and section."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("stain", "section", "slide_uid"))), lambda x: x["slide_uid"])
    return records.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_slides"), listed.alias("slide_uids"))


def warnings(files: DataFrame, stains: list[str]) -> DataFrame:
    """(kind, path): names that don't fit, stains that aren't declared, later files of a uid."""
    rows = decoded(files)
    bad = rows.where("slide_uid IS NULL").select(F.lit("name").alias("kind"), "path")
    unknown = rows.where("slide_uid IS NOT NULL").where(~F.col("stain").isin(stains)).select(F.lit("stain").alias("kind"), "path")
    later = rows.where("slide_uid IS NOT NULL").join(slides(files), ["slide_uid", "path"], "left_anti").select(F.lit("duplicate").alias("kind"), "path")
    return bad.unionByName(unknown).unionByName(later)


def pairs(slide_rows: DataFrame, reference: str = "he") -> DataFrame:
    """A row per moving slide with its case's first reference (by section)."""
    ref = slide_rows.where(F.col("stain") == reference).groupBy("case_id").agg(F.min(F.struct("section", "slide_uid")).alias("r"))
    moving = slide_rows.where(F.col("stain") != reference)
    return moving.join(ref.select("case_id", F.col("r.slide_uid").alias("reference_uid")), "case_id").select("case_id", "stain", F.col("slide_uid").alias("moving_uid"), "reference_uid")


def issues(slide_rows: DataFrame, reference: str = "he") -> DataFrame:
    """(severity, scope): cases without a reference are errors, cases with nothing else are warnings."""
    own = slide_rows.groupBy("case_id").agg(F.bool_or(F.col("stain") == reference).alias("ref"), F.bool_or(F.col("stain") != reference).alias("other"))
    kind = F.when(~F.col("ref"), "error").when(~F.col("other"), "warning")
    return own.select(kind.alias("severity"), F.col("case_id").alias("scope")).where("severity IS NOT NULL")


def findings(slide_rows: DataFrame, files: DataFrame, survey: DataFrame, stains: dict[str, str], target: float) -> DataFrame:
    """
    (severity, scope, kind) of a cohort before a run.

    survey (slide_uid, base, readable) is compared with the slides; of its checks the first that fails
    counts. stains gives each declared stain's role; with no slides at all that is one finding.
    """
    roles = F.create_map(*(F.lit(x) for k, r in sorted(stains.items()) for x in (k, r))) if stains else F.create_map().cast("map<string,string>")
    rows = slide_rows.withColumn("role", roles[F.col("stain")])
    row = lambda df, severity, kind, scope: df.select(F.lit(severity).alias("severity"), scope.alias("scope"), F.lit(kind).alias("kind"))
    named = row(warnings(files, list(stains)).where("kind <> 'stain'"), "warning", "file", F.lit("index"))
    found = rows.select("stain").distinct()
    declared = slide_rows.sparkSession.createDataFrame([(k,) for k in sorted(stains)], "stain string")
    odd = row(found.join(declared, "stain", "left_anti"), "warning", "undeclared", F.lit("descriptor")).unionByName(row(declared.join(found, "stain", "left_anti"), "warning", "unused", F.lit("descriptor")))
    case = rows.groupBy("case_id").agg(F.coalesce(F.bool_or(F.col("role") == "reference"), F.lit(False)).alias("ref"), F.coalesce(F.bool_or(F.col("role") == "moving"), F.lit(False)).alias("other"))
    lone = row(case.where("NOT ref"), "error", "no reference", F.col("case_id")).unionByName(row(case.where("NOT other"), "warning", "no moving", F.col("case_id")))
    seen = rows.join(survey.select("slide_uid", "base", "readable", F.lit(True).alias("measured")), "slide_uid", "left")
    kind = F.when(F.col("measured").isNull(), "not measured").when(~F.coalesce("readable", F.lit(False)), "unreadable").when(F.col("base").isNull(), "no magnification").when(F.col("base") + 1e-9 < target, "below target")
    slides_ = seen.select(F.when(F.col("measured").isNull(), "warning").otherwise("error").alias("severity"), F.col("slide_uid").alias("scope"), kind.alias("kind")).where("kind IS NOT NULL")
    none = row(rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "error", "no slides", F.lit("index"))
    return named.unionByName(odd).unionByName(lone).unionByName(slides_).unionByName(none)


def by_role(paths: DataFrame, reference: str = "he") -> DataFrame:
    """(sample, role) of files by stain keywords, the smallest path each, as columns reference and moving per label."""
    from cohortlens.functions.naming import base_name, sample_id, stain_class

    name = base_name(F.col("path"))
    rows = paths.select("path", sample_id(name).alias("sample"), stain_class(name).alias("s")).where("s IS NOT NULL")
    own = rows.groupBy("sample", F.col("s.kind").alias("kind"), F.col("s.label").alias("label")).agg(F.min("path").alias("path"))
    ref = own.where("kind = 'HE'").select("sample", F.col("path").alias("reference"))
    return own.where("kind <> 'HE'").join(ref, "sample", "full").select("sample", "label", "reference", F.col("path").alias("moving"))
