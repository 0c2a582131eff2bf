"""Selections over manifests, and result tables from what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.ranks import exact_percentiles
from cohortlens.functions.rules import compile_rule, thresholds_to_rule


def select(manifest: DataFrame, rule: str | None = None, **thresholds: float) -> DataFrame:
    """uids of the rows that a rule and thresholds keep; a saved selection is this table."""
    text = " and ".join(x for x in ((rule or "").strip(), thresholds_to_rule(**thresholds)) if x)
    return manifest.where(compile_rule(manifest, text)).select("uid")


def apply(manifest: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of manifest that a selection holds."""
    return manifest.join(selection, "uid", "left_semi")


def statistics(manifest: DataFrame, fields: list[str]) -> DataFrame:
    """A row per field: count, min, max, mean and median of its numbers."""
    middle = exact_percentiles(manifest, [(f, 50.0) for f in fields])
    median = F.coalesce(*(F.when(F.col("field") == f, F.lit(v).cast("double")) for (f, _), v in middle.items()))
    rows = manifest.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields))).alias("r")).select("r.*")
    return rows.where("x IS NOT NULL").groupBy("field").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.avg("x"), 6).alias("mean")).withColumn("median", F.round(median, 6))


def fraction(manifest: DataFrame, selection: DataFrame) -> DataFrame:
    """n_input, n_selected and their ratio."""
    marked = manifest.join(selection.withColumn("kept", F.lit(1)), "uid", "left")
    n, k = F.count(F.lit(1)), F.count("kept")
    return marked.agg(n.alias("n_input"), k.alias("n_selected"), F.round(k / F.nullif(n, F.lit(0)), 6).alias("ratio"))


def results(rows: DataFrame, by: list[str], field: str, total: bool = False) -> DataFrame:
    """n, sum and mean of field by keys (null is a key); total adds the row over all."""
    own = [F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(field).cast("double")), 6).alias("total"), F.round(F.avg(field), 6).alias("mean")]
    out = rows.groupBy(*by).agg(*own)
    if total:
        out = out.unionByName(rows.agg(*own), allowMissingColumns=True)
    return out.select(*by, "n", "total", "mean")


def summary(rows: DataFrame, by: str, field: str) -> DataFrame:
    """The seven statistics of field by key."""
    x = F.col(field).cast("double")
    own = {"n": F.count(x), "total": F.sum(x), "mean": F.avg(x), "median": F.percentile(x, F.lit(0.5)), "std": F.stddev_pop(x), "least": F.min(x), "most": F.max(x)}
    return rows.groupBy(by).agg(*((v if k == "n" else F.round(v, 6)).alias(k) for k, v in own.items()))


def aggregate(rows: DataFrame, by: list[str], sums: list[str] = (), means: list[str] = ()) -> DataFrame:
    """n, the sums and the means (as field_mean) of fields by keys; what is no number counts as missing."""
    numeric = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
    x = lambda f: F.col(f).cast("double") if f in numeric else F.lit(None).cast("double")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(x(f)).alias(f) for f in sums), *(F.avg(x(f)).alias(f"{f}_mean") for f in means))
