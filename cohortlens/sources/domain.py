"""Domain tables as deterministic projections of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch manifest from lineitem; blur is null where l_tax is 0."""
    stain = F.when(F.col("l_returnflag") == "A", "cd8").when(F.col("l_returnflag") == "N", "cd31").otherwise("he")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("uid"), F.concat(F.lit("CASE-"), (F.col("l_orderkey") % 500).cast("string")).alias("case_id"), stain.alias("stain"),
        (F.col("l_quantity") / 50).alias("tissue_fraction"), F.when(F.col("l_tax") != 0, F.col("l_extendedprice") / 1000).alias("blur"), F.col("l_linenumber").alias("positive_cells"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of slide files from orders; every 97th has a name that doesn't fit."""
    stain = F.when(F.col("o_orderstatus") == "F", "he").when(F.col("o_orderstatus") == "O", "CD8").otherwise("cd31")
    section = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("_s0"), (F.col("o_orderkey") % 4).cast("string")))
    name = F.when(F.col("o_orderkey") % 97 == 0, F.lit("scan.tmp")).otherwise(F.concat(F.lit("CASE-"), (F.col("o_custkey") % 300).cast("string"), F.lit("_"), stain, section, F.lit(".svs")))
    out = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    return out.select(F.concat(F.lit("/archive/"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("/"), "name").alias("path"), "name")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides with magnification, size and pyramid from part; every 11th magnification is missing."""
    p = F.col("p_partkey")
    mag = F.when(p % 11 != 0, F.element_at(F.array(*(F.lit(x) for x in (39.5, 20.0, 80.0, 41.5, 13.0))), (p % 5 + 1).cast("int")))
    width = (F.col("p_retailprice") * 2).cast("int")
    down = F.when(p % 2 == 0, F.array(*(F.lit(float(x)) for x in (1, 2, 4, 8, 16)))).otherwise(F.array(*(F.lit(float(x)) for x in (1, 2, 8))))
    return table(spark, sf_dir, "part").select(p.alias("slide"), mag.alias("base"), width.alias("width"), (width / 2 + F.col("p_size")).cast("int").alias("height"), down.alias("downsamples"), F.col("p_size").alias("size"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles of three channels from embeddings, a row per pixel."""
    grey = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v.cast("double") * 400 + 160, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), grey.alias("v")).select("tile", "v", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    return rows.select("tile", "i", F.get("v", F.col("i")).alias("r"), F.get("v", (F.col("i") + 7) % 64).alias("g"), F.get("v", (F.col("i") + 13) % 64).alias("b"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of pixels() with arrays, a row per tile, as tiles of slides: 20 slides, four tiles in a row."""
    grey = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v.cast("double") * 400 + 160, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), grey.alias("r"))
    turned = lambda k: F.concat(F.slice("r", k + 1, 64 - k), F.slice("r", 1, k))
    t = F.col("tile")
    return rows.select("tile", F.format_string("S%02d", t % 20).alias("slide_uid"), (F.floor(t / 20) % 4 * 8).cast("int").alias("x0"), (F.floor(t / 80) * 8).cast("int").alias("y0"), "r", turned(7).alias("g"), turned(13).alias("b"))
