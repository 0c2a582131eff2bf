"""Finding and pairing files, from a listing (path) instead of a walk over folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.naming import base_name, natural_key, role_of, slide_format


def folder_of(path: Column, up: int = 1) -> Column:
    """The name of the folder that many levels above a file."""
    return F.element_at(F.split(path, "/"), -1 - up)


def matching(paths: DataFrame, endings: tuple[str, ...], folder: str | None = None) -> DataFrame:
    """Files with one of these endings, in any case, below folder."""
    low = F.lower(base_name(F.col("path")))
    keep = F.lit(False)
    for e in endings:
        keep = keep | low.endswith(e.lower())
    return paths.where(keep if folder is None else keep & F.col("path").startswith(folder.rstrip("/") + "/"))


def pair_folders(paths: DataFrame, reference: str = "reference", moving: str = "moving") -> DataFrame:
    """(folder) of pairs: folders with a subfolder of either name that holds files."""
    rows = paths.where(folder_of(F.col("path")).isin(reference, moving))
    return rows.select(folder_of(F.col("path"), 2).alias("folder")).where("folder IS NOT NULL AND folder <> ''").distinct()


def indexed_pairs(paths: DataFrame, reference: str = "reference", moving: str = "moving") -> DataFrame:
    """(folder, sample, role, path): slides below folder/role whose name says the same role; the first path of each key."""
    sample, named = role_of(base_name(F.col("path")), reference, moving)
    label = folder_of(F.col("path"))
    rows = paths.where(slide_format(base_name(F.col("path"))).isNotNull()).select("path", label.alias("label"), folder_of(F.col("path"), 2).alias("folder"), sample.alias("sample"), named.alias("named"))
    rows = rows.where(F.col("label").isin(reference, moving) & (F.col("named") == F.lower("label")))
    role = F.when(F.col("label") == reference, "reference").otherwise("moving")
    return rows.groupBy("folder", "sample", role.alias("role")).agg(F.min("path").alias("path"))


def sample_pairs(indexed: DataFrame) -> DataFrame:
    """(folder, sample, reference, moving, missing) of indexed_pairs; missing names the role that isn't there."""
    own = indexed.groupBy("folder", "sample").agg(*(F.max(F.when(F.col("role") == r, F.col("path"))).alias(r) for r in ("reference", "moving")))
    return own.withColumn("missing", F.when(F.col("reference").isNull(), "reference").when(F.col("moving").isNull(), "moving"))


def patch_pairs(paths: DataFrame, reference: str = "_reference.png", moving: str = "_moving.png") -> DataFrame:
    """(reference, moving, name): patches of one folder whose names differ in the ending alone."""
    side = lambda end, name: paths.where(F.col("path").endswith(end)).select(F.expr(f"left(path, length(path) - {len(end)})").alias("stem"), F.col("path").alias(name))
    return side(reference, "reference").join(side(moving, "moving"), "stem").select("reference", "moving", base_name(F.col("reference")).alias("name"))


def folder_patch_pairs(paths: DataFrame, reference: str = "HnE", moving: str = "IHC", ending: str = ".png") -> DataFrame:
    """(reference, moving, name): patches of one name in two folders beside each other."""
    rows = paths.where(F.col("path").endswith(ending)).select("path", base_name(F.col("path")).alias("name"), folder_of(F.col("path")).alias("label"), F.regexp_replace("path", r"/[^/]*/[^/]*$", "").alias("root"))
    side = lambda label, name: rows.where(F.col("label") == label).select("root", "name", F.col("path").alias(name))
    return side(reference, "reference").join(side(moving, "moving"), ["root", "name"]).select("reference", "moving", "name")


def aligned(requests: DataFrame, paths: DataFrame, reference: str = "he", keywords: tuple[str, ...] = ("moving", "ihc", "aligned")) -> DataFrame:
    """requests (sample, biomarker) with path and ambiguous: the aligned slide of each, null if there is none.

    Looked for in the folders sample_biomarker (lower case, then as given) and biomarker/sample_reference, the first with
    files; of several files the one that alone has the biomarker or a keyword in its name, else the first in natural order.
    """
    files = paths.where(F.lower(base_name(F.col("path"))).rlike(r"\.ome\.tif[^/]*$")).select("path", base_name(F.col("path")).alias("name"), folder_of(F.col("path")).alias("near"), folder_of(F.col("path"), 2).alias("far"))
    low = F.concat_ws("_", "sample", F.lower("biomarker"))
    places = [(low, F.lit(None).cast("string")), (F.concat_ws("_", "sample", "biomarker"), F.lit(None).cast("string")), (F.concat_ws("_", "sample", F.lit(reference)), F.col("biomarker"))]
    asked = requests.select("sample", "biomarker", F.explode(F.array(*(F.struct(F.lit(k).alias("rank"), near.alias("near"), far.alias("upper")) for k, (near, far) in enumerate(places)))).alias("p")).select("sample", "biomarker", "p.*")
    hits = asked.join(files, "near").where("upper IS NULL OR upper = far")
    lists = hits.groupBy("sample", "biomarker", "rank").agg(F.collect_set(F.struct("name", "path")).alias("files"))
    first = lists.groupBy("sample", "biomarker").agg(F.min_by("files", "rank").alias("files"))

    def named(word: Column) -> Column:
        return F.filter("files", lambda x: F.contains(F.lower(x["name"]), word))

    alone = [named(word) for word in (F.lower("biomarker"), *map(F.lit, keywords))]
    chosen = F.coalesce(*(F.when(F.size(x) == 1, x[0]["path"]) for x in (F.col("files"), *alone)))
    natural = F.array_min(F.transform("files", lambda x: F.struct(natural_key(x["name"]).alias("key"), x["path"].alias("path"))))["path"]
    found = first.select("sample", "biomarker", F.coalesce(chosen, natural).alias("path"), chosen.isNull().alias("ambiguous"))
    return requests.join(found, ["sample", "biomarker"], "left")
