"""The registered queries over cohorts, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import naming
from cohortlens.functions.optics import level_for, output_length, read_length, snapped, to_level0
from cohortlens.functions.rules import compile_rule
from cohortlens.operators import cores, discovery, grid, images, index, patches, pixels, reassembly, regions, selection, stain
from cohortlens.plans.recipe import source_magnifications, usable_slides
from cohortlens.sources import domain
from cohortlens.streaming.manifests import cell_counts

M = """m AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS uid, 'CASE-' || (l_orderkey % 500) AS case_id,
  CASE l_returnflag WHEN 'A' THEN 'cd8' WHEN 'N' THEN 'cd31' ELSE 'he' END AS stain, l_quantity / 50 AS tissue_fraction,
  CASE WHEN l_tax <> 0 THEN l_extendedprice / 1000 END AS blur, l_linenumber AS positive_cells FROM lineitem)"""
FILES = """f0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'scan.tmp' ELSE 'CASE-' || (o_custkey % 300) || '_' ||
  CASE o_orderstatus WHEN 'F' THEN 'he' WHEN 'O' THEN 'CD8' ELSE 'cd31' END || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '_s0' || (o_orderkey % 4) END || '.svs' END AS name FROM orders),
f AS (SELECT '/archive/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '/' || name AS path, name FROM f0),
d0 AS (SELECT path, name, regexp_matches(name, '^.+_[A-Za-z0-9]+?(_s[0-9]+)?\\.svs$') AS fits,
  regexp_extract(name, '^(.+?)_([A-Za-z0-9]+?)(_s([0-9]+))?\\.svs$', 1) AS c, lower(regexp_extract(name, '^(.+?)_([A-Za-z0-9]+?)(_s([0-9]+))?\\.svs$', 2)) AS s,
  regexp_extract(name, '^(.+?)_([A-Za-z0-9]+?)(_s([0-9]+))?\\.svs$', 4) AS n FROM f),
d AS (SELECT path, name, CASE WHEN fits THEN c END AS case_id, CASE WHEN fits THEN s END AS stain, CASE WHEN fits THEN coalesce(CAST(nullif(n, '') AS INT), 1) END AS section,
  CASE WHEN fits THEN c || '__' || s || '__s' || lpad(CAST(coalesce(CAST(nullif(n, '') AS INT), 1) AS VARCHAR), 2, '0') END AS slide_uid FROM d0),
s AS (SELECT * FROM d WHERE slide_uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slide_uid ORDER BY path) = 1)"""
SURVEY = """v AS (SELECT p_partkey AS slide, CASE WHEN p_partkey % 11 <> 0 THEN CASE p_partkey % 5 WHEN 0 THEN 39.5 WHEN 1 THEN 20 WHEN 2 THEN 80 WHEN 3 THEN 41.5 ELSE 13 END::DOUBLE END AS base,
  trunc(p_retailprice * 2)::INT AS width, trunc(trunc(p_retailprice * 2) / 2 + p_size)::INT AS height, p_size AS size, p_partkey % 2 = 0 AS even FROM part)"""
PX = """e AS (SELECT vec_id AS tile, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
g AS (SELECT tile, i, floor(least(greatest(v * 400 + 160, 0), 255))::INT AS v FROM e),
px AS (SELECT a.tile, a.i, a.v AS r, b.v AS g, c.v AS b FROM g a JOIN g b ON a.tile = b.tile AND b.i = (a.i + 7) % 64 JOIN g c ON a.tile = c.tile AND c.i = (a.i + 13) % 64)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _ruled(name: str, rule: str, where: str) -> None:
    """A query that counts and sums what a rule keeps."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = domain.manifest(spark, sf_dir)
        return selection.results(m.where(compile_rule(m, rule)), ["stain"], "positive_cells")

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {M} SELECT stain, count(*) AS n, round(sum(positive_cells::DOUBLE), 6) AS total, round(avg(positive_cells), 6) AS mean FROM m WHERE {where} GROUP BY stain"


_ruled("rule_threshold", "tissue_fraction >= 0.6 and blur > 10", "tissue_fraction >= 0.6 AND coalesce(blur > 10, false)")
_ruled("rule_chain_bool", "0.5 <= tissue_fraction < 0.8 and not blur > 40 or positive_cells == 7", "(tissue_fraction >= 0.5 AND tissue_fraction < 0.8 AND NOT coalesce(blur > 40, false)) OR positive_cells = 7")
_ruled("rule_membership_null", "stain in ['cd8', 'he'] and (blur in [None] or blur not in [1.0]) and blur != None", "stain IN ('cd8', 'he') AND blur IS NOT NULL AND blur <> 1.0")
_ruled("rule_arith", "positive_cells * 2 - 1 > 5 and (positive_cells - 5) % 3 == 1 and not blur / (positive_cells - 4) > 2", "positive_cells * 2 - 1 > 5 AND (positive_cells - 5) - 3 * floor((positive_cells - 5) / 3.0::DOUBLE) = 1 AND NOT coalesce(blur / nullif(positive_cells - 4, 0) > 2, false)")
_ruled("rule_conditional", "(blur if tissue_fraction > 0.5 else positive_cells) > 4", "coalesce(CASE WHEN tissue_fraction > 0.5 THEN blur ELSE positive_cells END > 4, false)")
_ruled("rule_percentile", "blur >= percentile('blur', 75)", "coalesce(blur >= (SELECT quantile_cont(blur, 0.75) FROM m), false)")
_ruled("rule_lower_isnull", "is_null(blur) or lower(stain) == 'cd8' and 'ASE-1' in case_id and missing == None", "blur IS NULL OR (lower(stain) = 'cd8' AND contains(case_id, 'ASE-1'))")
_ruled("rule_mixed_types", "stain > 3 or stain == 3 or positive_cells", "positive_cells <> 0")

RULE = 'tissue_fraction >= 0.5 and blur >= percentile("blur", 10)'
KEPT = f"{M}, k AS (SELECT uid FROM m WHERE tissue_fraction >= 0.5 AND coalesce(blur >= (SELECT quantile_cont(blur, 0.1) FROM m), false)), r AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM k WHERE k.uid = m.uid))"
RESULT = "count(*) AS n, round(sum(positive_cells::DOUBLE), 6) AS total, round(avg(positive_cells), 6) AS mean"


@query(f"WITH {KEPT} SELECT case_id, stain, {RESULT} FROM r GROUP BY case_id, stain")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain.manifest(spark, sf_dir)
    return selection.results(selection.apply(m, selection.select(m, RULE)), ["case_id", "stain"], "positive_cells")


@query(f"WITH {KEPT} SELECT uid, case_id, positive_cells FROM r")
def selection_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain.manifest(spark, sf_dir)
    return selection.apply(m, selection.select(m, RULE)).select("uid", "case_id", "positive_cells")


@query(f"WITH {M} SELECT uid FROM m WHERE tissue_fraction >= 0.4 AND coalesce(blur >= 10.0, false)")
def selection_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select(domain.manifest(spark, sf_dir), tissue_fraction=0.4, blur=10.0)


@query(f"WITH {KEPT} SELECT (SELECT count(*) FROM m) AS n_input, (SELECT count(*) FROM r) AS n_selected, round((SELECT count(*) FROM r) / (SELECT count(*) FROM m)::DOUBLE, 6) AS ratio")
def selection_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain.manifest(spark, sf_dir)
    return selection.fraction(m, selection.select(m, RULE))


STATS = ["tissue_fraction", "blur", "positive_cells"]


@query(f"WITH {M}, u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::DOUBLE AS x FROM m" for f in STATS) + ") SELECT field, count(x) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median FROM u WHERE x IS NOT NULL GROUP BY field")
def selection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.statistics(domain.manifest(spark, sf_dir), STATS)


@query(f"WITH {M} SELECT case_id, stain, {RESULT} FROM m GROUP BY case_id, stain")
def results_by_case_stain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.results(domain.manifest(spark, sf_dir), ["case_id", "stain"], "positive_cells")


@query(f"WITH {M} SELECT stain, {RESULT} FROM m GROUP BY stain UNION ALL SELECT NULL, {RESULT} FROM m")
def results_total_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.results(domain.manifest(spark, sf_dir), ["stain"], "positive_cells", total=True)


@query(f"WITH {M} SELECT case_id, count(blur) AS n, round(sum(blur), 6) AS total, round(avg(blur), 6) AS mean, round(quantile_cont(blur, 0.5), 6) AS median, round(stddev_pop(blur), 6) AS std, round(min(blur), 6) AS least, round(max(blur), 6) AS most FROM m GROUP BY case_id")
def summary_7stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.summary(domain.manifest(spark, sf_dir), "case_id", "blur")


@query(f"WITH {FILES} SELECT path, case_id, stain, section, slide_uid FROM d")
def index_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.decoded(domain.files(spark, sf_dir)).select("path", "case_id", "stain", "section", "slide_uid")


@query(f"WITH {FILES} SELECT slide_uid, path FROM s")
def index_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.slides(domain.files(spark, sf_dir)).select("slide_uid", "path")


@query(f"WITH {FILES} SELECT 'name' AS kind, path FROM d WHERE slide_uid IS NULL UNION ALL SELECT 'stain', path FROM d WHERE slide_uid IS NOT NULL AND stain NOT IN ('he', 'cd8') UNION ALL SELECT 'duplicate', path FROM d WHERE slide_uid IS NOT NULL AND path NOT IN (SELECT path FROM s)")
def index_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.warnings(domain.files(spark, sf_dir), ["he", "cd8"])


@query(f"WITH {FILES} SELECT stain, count(*) AS n_slides, count(DISTINCT case_id) AS n_cases FROM s GROUP BY stain")
def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.slides(domain.files(spark, sf_dir)).groupBy("stain").agg(F.count(F.lit(1)).alias("n_slides"), F.countDistinct("case_id").alias("n_cases"))


PAIRS = "r AS (SELECT case_id, slide_uid FROM s WHERE stain = 'he' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY section, slide_uid) = 1), p AS (SELECT s.case_id, s.stain, s.slide_uid AS moving_uid, r.slide_uid AS reference_uid FROM s JOIN r USING (case_id) WHERE stain <> 'he')"


@query(f"WITH {FILES}, {PAIRS} SELECT * FROM p")
def pairs_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pairs(index.slides(domain.files(spark, sf_dir)))


@query(f"WITH {FILES}, {PAIRS} SELECT * FROM p WHERE stain = 'cd8' AND case_id NOT IN (SELECT 'CASE-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 300)")
def pairs_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = domain.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_custkey < 300").select(F.concat(F.lit("CASE-"), F.col("c_custkey").cast("string")).alias("case_id"))
    return index.pairs(index.slides(domain.files(spark, sf_dir))).where("stain = 'cd8'").join(out, "case_id", "left_anti")


@query(f"WITH {FILES}, a AS (SELECT case_id, bool_or(stain = 'he') AS ref, bool_or(stain <> 'he') AS other FROM s GROUP BY case_id) SELECT CASE WHEN NOT ref THEN 'error' ELSE 'warning' END AS severity, case_id AS scope FROM a WHERE NOT ref OR NOT other")
def verify_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.issues(index.slides(domain.files(spark, sf_dir)))


@query(f"WITH {FILES} SELECT stain, 'undeclared' AS kind FROM (SELECT DISTINCT stain FROM s EXCEPT SELECT * FROM (VALUES ('he'), ('pdl1'))) UNION ALL SELECT c0, 'unused' FROM (SELECT * FROM (VALUES ('he'), ('pdl1')) AS t(c0) EXCEPT SELECT stain FROM s)")
def stains_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = index.slides(domain.files(spark, sf_dir)).select("stain").distinct()
    declared = spark.sql("SELECT * FROM VALUES ('he'), ('pdl1') AS t(stain)")
    return used.join(declared, "stain", "left_anti").withColumn("kind", F.lit("undeclared")).unionByName(declared.join(used, "stain", "left_anti").withColumn("kind", F.lit("unused")))


@query(f"WITH {FILES}, a AS (SELECT case_id, count(*) AS n_ref FROM s WHERE stain = 'he' GROUP BY 1), b AS (SELECT case_id, count(*) AS n_moving FROM s WHERE stain = 'cd31' GROUP BY 1) SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(n_ref, 0) AS n_ref, coalesce(n_moving, 0) AS n_moving FROM a FULL JOIN b ON a.case_id = b.case_id")
def pair_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.slides(domain.files(spark, sf_dir))
    side = lambda stain, name: s.where(F.col("stain") == stain).groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    out = side("he", "n_ref").join(side("cd31", "n_moving"), "case_id", "full")
    return out.select("case_id", F.coalesce("n_ref", F.lit(0)).cast("long").alias("n_ref"), F.coalesce("n_moving", F.lit(0)).cast("long").alias("n_moving"))


@query(f"WITH {FILES} SELECT case_id, section FROM s WHERE stain IN ('he', 'cd8') GROUP BY case_id, section HAVING count(*) FILTER (stain = 'he') = 1 AND count(*) FILTER (stain = 'cd8') = 1")
def suffix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index.slides(domain.files(spark, sf_dir)).groupBy("case_id", "section").agg(F.count_if(F.col("stain") == "he").alias("a"), F.count_if(F.col("stain") == "cd8").alias("b"))
    return s.where("a = 1 AND b = 1").select("case_id", "section")


@query(f"WITH {M} SELECT case_id FROM m WHERE stain = 'cd8' INTERSECT SELECT case_id FROM m WHERE stain = 'cd31' INTERSECT SELECT case_id FROM m WHERE stain = 'he'")
def marker_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = domain.manifest(spark, sf_dir)
    of = lambda s: m.where(F.col("stain") == s).select("case_id")
    return of("cd8").intersect(of("cd31")).intersect(of("he"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = domain.table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return domain.table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


OBJ = "o AS (SELECT unnest([1, 2, 2.5, 4, 5, 10, 20, 40, 60, 100])::DOUBLE AS o)"


@query(f"WITH {SURVEY}, {OBJ}, z AS (SELECT slide, base, o, row_number() OVER (PARTITION BY slide ORDER BY abs(base - o) / o, o) AS k FROM v CROSS JOIN o) SELECT slide, CASE WHEN base IS NULL THEN 20.0::DOUBLE WHEN abs(base - o) / o <= 0.05::DOUBLE THEN o ELSE base END AS magnification, CASE WHEN base IS NULL THEN 'default' ELSE 'slide' END AS origin FROM z WHERE k = 1")
def mag_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.survey(spark, sf_dir)
    return v.select("slide", F.coalesce(snapped(F.col("base")), F.lit(20.0)).alias("magnification"), F.when(F.col("base").isNull(), "default").otherwise("slide").alias("origin"))


@query(f"WITH {SURVEY}, l AS (SELECT slide, base, unnest(CASE WHEN even THEN [1, 2, 4, 8, 16] ELSE [1, 2, 8] END)::DOUBLE AS d, unnest(CASE WHEN even THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2] END) AS level FROM v WHERE base IS NOT NULL) SELECT slide, level FROM l QUALIFY row_number() OVER (PARTITION BY slide ORDER BY round(abs(ln(base / d / 10)), 9), level) = 1")
def mag_plan_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.survey(spark, sf_dir).where("base IS NOT NULL").select("slide", level_for(F.col("base"), 10.0, F.col("downsamples")).alias("level"))


@query(f"WITH {SURVEY} SELECT slide, greatest(round_even(width * 10 / base, 0), 1)::INT AS out_width, greatest(round_even(height * 10 / base, 0), 1)::INT AS out_height, base + 1e-9 >= 20 AS supported FROM v WHERE base IS NOT NULL")
def mag_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.survey(spark, sf_dir).where("base IS NOT NULL")
    return v.select("slide", *(output_length(F.col(c), F.col("base"), 10.0).alias(f"out_{c}") for c in ("width", "height")), (F.col("base") + 1e-9 >= 20).alias("supported"))


@query(f"WITH {SURVEY} SELECT CASE WHEN base IS NULL THEN 'missing' ELSE regexp_replace(CAST(base AS VARCHAR), '\\.0$', '') || 'x' END AS label, count(*) AS n FROM v GROUP BY 1")
def mag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.coalesce(F.concat(F.regexp_replace(F.col("base").cast("string"), r"\.0$", ""), F.lit("x")), F.lit("missing"))
    return domain.survey(spark, sf_dir).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SURVEY}, t AS (SELECT *, unnest(generate_series(0, height - 1, 512)) AS y0 FROM v), q AS (SELECT *, unnest(generate_series(0, width - 1, 512)) AS x0 FROM t) SELECT slide, x0::INT AS x0, y0::INT AS y0, least(512, width - x0)::INT AS w, least(512, height - y0)::INT AS h, lpad(CAST((y0 // 512) * ceil(width / 512.0)::INT + x0 // 512 + 1 AS VARCHAR), 6, '0') AS tile_id FROM q")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tiles(domain.survey(spark, sf_dir), 512)


PLACES = "w AS (SELECT * FROM (VALUES ('center', 0, 0), ('top_left', -1, -1), ('top_right', 1, -1), ('bottom_left', -1, 1), ('bottom_right', 1, 1)) AS t(region, sx, sy))"


def _start(length: str, side: str) -> str:
    edge = f"(trunc({length} * 0.05::DOUBLE)::INT + 200)"
    return f"(CASE {side} WHEN 0 THEN {length} // 2 WHEN -1 THEN {edge} ELSE {length} - {edge} END - 200)"


@query(f"WITH {SURVEY}, {PLACES}, c AS (SELECT slide, region, least(width, {_start('width', 'sx')} + 400) AS x1, least(height, {_start('height', 'sy')} + 400) AS y1 FROM v CROSS JOIN w) SELECT slide, region, greatest(0, x1 - 400) AS x0, greatest(0, y1 - 400) AS y0, x1, y1 FROM c")
def region_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.named_boxes(domain.survey(spark, sf_dir), 400)


@query(f"WITH {SURVEY} SELECT slide, trunc(0.5::DOUBLE * width - 0.25::DOUBLE * height + 10)::INT AS x, trunc(0.25::DOUBLE * width + 0.5::DOUBLE * height - 3)::INT AS y FROM v")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = domain.survey(spark, sf_dir).select("slide", F.col("width").alias("x"), F.col("height").alias("y"))
    return grid.moved(points, [[0.5, -0.25, 10.0], [0.25, 0.5, -3.0], [0.0, 0.0, 1.0]])


BOXES = "b AS (SELECT p_size AS size, p_partkey AS id, (p_partkey * 37 % 1000)::INT AS x, (p_partkey * 91 % 1000)::INT AS y, (p_partkey % 30 + 1)::INT AS w, (p_partkey % 50 + 1)::INT AS h FROM part)"


@query(f"WITH {BOXES}, z AS (SELECT *, x + w // 2 AS cx, y + h // 2 AS cy, avg(h) OVER (PARTITION BY size) * 0.5::DOUBLE AS tall FROM b), g AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY size ORDER BY cy, id) >= tall THEN 1 ELSE 0 END AS fresh FROM z), r AS (SELECT *, sum(fresh) OVER (PARTITION BY size ORDER BY cy, id ROWS UNBOUNDED PRECEDING) AS line FROM g) SELECT size, id, line::BIGINT AS line, row_number() OVER (PARTITION BY size ORDER BY line, cx, cy, id) AS place FROM r")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    box = {"x": p * 37 % 1000, "y": p * 91 % 1000, "w": p % 30 + 1, "h": p % 50 + 1}
    boxes = domain.table(spark, sf_dir, "part").select(F.col("p_size").alias("size"), p.alias("id"), *(v.cast("int").alias(k) for k, v in box.items()))
    return grid.in_reading_order(boxes, "size").select("size", "id", F.col("row").alias("line"), F.col("place").cast("long").alias("place"))


OD = "(" + " + ".join(f"-ln(({c} + 1) / 255.0::DOUBLE + 1e-6::DOUBLE)" for c in "rgb") + ")"
OD_MAX = "greatest(" + ", ".join(f"-ln(greatest({c}, 1) / 255.0::DOUBLE)" for c in "rgb") + ")"
HUE = "CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 30 * (g - b) / nullif(hi - lo, 0)::DOUBLE WHEN hi = g THEN 60 + 30 * (b - r) / nullif(hi - lo, 0)::DOUBLE ELSE 120 + 30 * (r - g) / nullif(hi - lo, 0)::DOUBLE END"
BROWN = f"h AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px), q AS (SELECT *, floor({HUE} + 0.5::DOUBLE) AS u FROM h), z AS (SELECT *, CASE WHEN u < 0 THEN u + 180 ELSE u END BETWEEN 5 AND 20 AND coalesce(floor(255 * (hi - lo) / nullif(hi, 0)::DOUBLE + 0.5::DOUBLE), 0) >= 30 AND hi <= 220 AS brown FROM q)"


@query(
    f"WITH {PX}, {BROWN} SELECT tile, round(avg(((r + g + b) / 3.0::DOUBLE < 235)::INT), 6) AS tissue_fraction, round(avg(({OD} > 0.15::DOUBLE)::INT), 6) AS od_share, round(avg({OD}), 6) AS od_mean, round(max({OD_MAX}), 6) AS od_max, round(avg(brown::INT), 6) AS brown_share, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, round(corr(r, g), 6) AS ncc_rg FROM z GROUP BY tile"
)
def tile_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.measures(domain.pixels(spark, sf_dir))


@query(
    f"WITH {PX}, n AS (SELECT tile, r, count(*)::DOUBLE AS n FROM px GROUP BY tile, r), w AS (SELECT tile, r, sum(n) OVER u AS w0, sum(n * r) OVER u AS s0, sum(n) OVER (PARTITION BY tile) AS w, sum(n * r) OVER (PARTITION BY tile) AS s FROM n WINDOW u AS (PARTITION BY tile ORDER BY r ROWS UNBOUNDED PRECEDING)), "
    "b AS (SELECT tile, r, coalesce(round(w0 * (w - w0) * pow(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 3), 0) AS between_classes FROM w) SELECT tile, r AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY tile ORDER BY between_classes DESC, r) = 1"
)
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.otsu(domain.pixels(spark, sf_dir))


@query(f"WITH {PX} SELECT tile, round(sum((r < 150)::INT) * 0.0025::DOUBLE, 6) AS area_mm2, sum((b < 110)::INT)::BIGINT AS cells, round(sum((b < 110)::INT) / nullif(sum((r < 150)::INT) * 0.0025::DOUBLE, 0), 4) AS density FROM px GROUP BY tile")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.density(domain.pixels(spark, sf_dir), 50.0, 150)


@query(f"WITH {PX}, a AS (SELECT tile, sum((r < 150)::INT)::BIGINT AS gt, sum((g < 140)::INT)::BIGINT AS pred FROM px GROUP BY tile) SELECT tile, abs(gt - pred) AS absolute, round(abs(gt - pred) / nullif(gt, 0)::DOUBLE, 6) AS relative FROM a")
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = domain.pixels(spark, sf_dir)
    own = px.groupBy("tile").agg(F.count_if(F.col("r") < 150).alias("gt"), F.count_if(F.col("g") < 140).alias("pred"))
    far = F.abs(F.col("gt") - F.col("pred"))
    return own.select("tile", far.alias("absolute"), F.round(far / F.nullif(F.col("gt"), F.lit(0).cast("long")), 6).alias("relative"))


@query(f"WITH {PX} SELECT (tile % 20) AS slide, (tile // 20 % 3) * 4 + i % 8 AS x, i // 8 AS y, trunc(sum(r) / count(*)::DOUBLE)::INT AS value, count(*) AS n FROM px GROUP BY 1, 2, 3")
def reconstruct_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = F.col("i"), F.col("tile")
    place = domain.pixels(spark, sf_dir).select((t % 20).alias("slide"), (F.floor(t / 20) % 3 * 4 + i % 8).alias("x"), F.floor(i / 8).alias("y"), "r")
    return place.groupBy("slide", "x", "y").agg((F.sum("r") / F.count(F.lit(1))).cast("int").alias("value"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {PX} SELECT (tile % 20) AS slide, i, arg_max(r, tile) AS value FROM px GROUP BY 1, 2")
def reconstruct_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.pixels(spark, sf_dir).groupBy((F.col("tile") % 20).alias("slide"), "i").agg(F.max_by("r", "tile").alias("value"))


@query("SELECT date_trunc('hour', ts) AS start, user_id % 16 AS cell, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell_counts(domain.table(spark, sf_dir, "events"), F.col("user_id") % 16).withColumn("start", F.col("start").cast("timestamp_ntz"))


P90 = "n AS (SELECT tile, quantile_cont(v, 0.9) AS p90 FROM (SELECT tile, unnest([r, g, b]) AS v FROM px) GROUP BY tile)"
_LINEAR = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END"
_F = lambda t: f"(CASE WHEN {t} > 0.008856 THEN pow({t}, 1 / 3.0::DOUBLE) ELSE 7.787::DOUBLE * {t} + 16 / 116.0::DOUBLE END)"
LAB = f"""sd AS (SELECT px.tile, i, {", ".join(f"CASE WHEN p90 > 0 THEN trunc(least(255, {c} * 255.0::DOUBLE / p90))::INT ELSE {c} END AS {c}" for c in "rgb")} FROM px JOIN n ON n.tile = px.tile),
  li AS (SELECT tile, i, {", ".join(f"{_LINEAR(c)} AS {c}" for c in "rgb")} FROM sd),
  xyz AS (SELECT tile, i, (0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b) / 0.950456::DOUBLE AS x, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS y, (0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b) / 1.088754::DOUBLE AS z FROM li),
  la AS (SELECT tile, i, floor((CASE WHEN y > 0.008856 THEN 116 * pow(y, 1 / 3.0::DOUBLE) - 16 ELSE 903.3::DOUBLE * y END) * 2.55::DOUBLE + 0.5) / 2.55::DOUBLE AS l, floor(500 * ({_F("x")} - {_F("y")}) + 128.5) - 128 AS a, floor(200 * ({_F("y")} - {_F("z")}) + 128.5) - 128 AS bb FROM xyz)"""


@query(f"WITH {PX}, {P90} SELECT tile, round(p90, 6) AS p90 FROM n")
def brightness_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stain.brightness(domain.pixels(spark, sf_dir)).select("tile", F.round("p90", 6).alias("p90"))


@query(f"WITH {PX}, {P90}, {LAB} SELECT tile, " + ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for c in ("l", "a", "bb")) + " FROM la GROUP BY tile")
def reinhard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = stain.reinhard_fit(domain.pixels(spark, sf_dir), ("tile",))
    return fit.select("tile", *(F.round(c, 6).alias(c) for c in fit.columns if c != "tile"))


@query(f"WITH {PX}, c AS (SELECT tile, CASE WHEN i // 8 >= 5 THEN 2 WHEN i // 8 >= 2 THEN 1 ELSE 0 END AS cy, CASE WHEN i % 8 >= 5 THEN 2 WHEN i % 8 >= 2 THEN 1 ELSE 0 END AS cx, r FROM px), s AS (SELECT tile, cy * 3 + cx AS cell, avg((r < 110)::INT) AS fraction FROM c GROUP BY 1, 2) SELECT tile, cell::INT AS cell, round(fraction, 6) AS fraction FROM s WHERE fraction > 0.05")
def grid_valid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = domain.pixels(spark, sf_dir).select("tile", "i", F.col("r").alias("grey"))
    return grid.valid_cells(px, 8, 3, dark=110).select("tile", F.col("cell").cast("int").alias("cell"), F.round("fraction", 6).alias("fraction"))


@query(f"WITH {SURVEY}, t AS (SELECT *, unnest(generate_series(0, height - 1, 512)) AS y0 FROM v), q AS (SELECT *, unnest(generate_series(0, width - 1, 512)) AS x0 FROM t) SELECT slide, x0::INT AS x0, y0::INT AS y0, lpad(CAST(row_number() OVER (PARTITION BY slide ORDER BY y0, x0) AS VARCHAR), 6, '0') AS patch_id FROM q WHERE (slide + x0 + y0) % 3 <> 0")
def grid_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = grid.tiles(domain.survey(spark, sf_dir), 512)
    return grid.kept_ids(tiles, (F.col("slide") + F.col("x0") + F.col("y0")) % 3 != 0).select("slide", "x0", "y0", "patch_id")


@query("WITH s AS (SELECT o_orderkey, ' ' || o_orderpriority || ' / ' || o_orderstatus || '&E.' AS v FROM orders) SELECT o_orderkey, nullif(regexp_replace(regexp_replace(trim(v), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), '') AS name FROM s")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit(" "), "o_orderpriority", F.lit(" / "), "o_orderstatus", F.lit("&E."))
    return domain.table(spark, sf_dir, "orders").select("o_orderkey", naming.safe_name(v).alias("name"))


@query(f"WITH {FILES}, k AS (SELECT path, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(name) AS low FROM f) SELECT path, regexp_replace(regexp_replace(regexp_replace(stem, '[-_]?(meca79|cd163|caix|cd31|cd56|cd68|mhc1|pdl1|cd3|cd8|h&e|hne|he)[-_]?', '_', 'gi'), '_+', '_', 'g'), '^_|_$', '', 'g') AS sample, CASE WHEN contains(low, 'cd31') THEN 'CD31' WHEN contains(low, 'cd8') THEN 'CD8' WHEN contains(low, 'he') THEN 'HnE' END AS label FROM k")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.files(spark, sf_dir).select("path", naming.sample_id(F.col("name")).alias("sample"), naming.stain_class(F.col("name"))["label"].alias("label"))


@query("SELECT p_partkey AS slide, z.zoom, z.size, r.region, 'out/' || p_brand || '/' || z.zoom || '/' || r.region || '.png' AS output FROM part CROSS JOIN (VALUES ('x10', 512), ('x20', 256)) AS z(zoom, size) CROSS JOIN (VALUES ('center'), ('top_left')) AS r(region)")
def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide"), F.lit("out").alias("root"), "p_brand")
    return grid.composed(rows, ["root", "p_brand"], {"x10": 512, "x20": 256}, ["center", "top_left"], ".png").select("slide", "zoom", "size", "region", "output")


SEEN = "m AS (SELECT slide_uid, CASE WHEN section = 2 THEN NULL WHEN section = 3 THEN 10.0 ELSE 40.0 END::DOUBLE AS base, case_id NOT LIKE '%7' AS readable FROM s WHERE case_id NOT LIKE '%9')"


@query(
    f"WITH {FILES}, {SEEN}, r AS (SELECT *, CASE stain WHEN 'he' THEN 'reference' WHEN 'cd8' THEN 'moving' WHEN 'pdl1' THEN 'moving' END AS role FROM s), c AS (SELECT case_id, coalesce(bool_or(role = 'reference'), false) AS ref, coalesce(bool_or(role = 'moving'), false) AS other FROM r GROUP BY case_id), "
    "k AS (SELECT s.slide_uid, CASE WHEN m.slide_uid IS NULL THEN 'not measured' WHEN NOT m.readable THEN 'unreadable' WHEN m.base IS NULL THEN 'no magnification' WHEN m.base + 1e-9 < 20 THEN 'below target' END AS kind FROM s LEFT JOIN m USING (slide_uid)) "
    "SELECT 'warning' AS severity, 'index' AS scope, 'file' AS kind FROM d WHERE slide_uid IS NULL OR path NOT IN (SELECT path FROM s) "
    "UNION ALL SELECT 'warning', 'descriptor', 'undeclared' FROM (SELECT DISTINCT stain FROM s WHERE stain NOT IN ('he', 'cd8', 'pdl1')) UNION ALL SELECT 'warning', 'descriptor', 'unused' FROM (VALUES ('he'), ('cd8'), ('pdl1')) AS t(c0) WHERE c0 NOT IN (SELECT stain FROM s) "
    "UNION ALL SELECT 'error', case_id, 'no reference' FROM c WHERE NOT ref UNION ALL SELECT 'warning', case_id, 'no moving' FROM c WHERE NOT other "
    "UNION ALL SELECT CASE kind WHEN 'not measured' THEN 'warning' ELSE 'error' END, slide_uid, kind FROM k WHERE kind IS NOT NULL"
)
def verify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = domain.files(spark, sf_dir)
    rows = index.slides(files)
    base = F.when(F.col("section") == 3, 10.0).when(F.col("section") != 2, 40.0)
    survey = rows.where("case_id NOT LIKE '%9'").select("slide_uid", base.alias("base"), (~F.col("case_id").like("%7")).alias("readable"))
    return index.findings(rows, files, survey, {"he": "reference", "cd8": "moving", "pdl1": "moving"}, 20.0)


@query()
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "pages").select("url").orderBy(naming.natural_key(F.col("url")))


@query(f"WITH RECURSIVE {PX}, d AS (SELECT tile, i FROM px WHERE r < 150), nb AS (SELECT a.tile, a.i, b.i AS j FROM d a JOIN d b ON a.tile = b.tile AND abs(a.i // 8 - b.i // 8) + abs(a.i % 8 - b.i % 8) = 1), w AS (SELECT tile, i, i AS j FROM d UNION SELECT w.tile, w.i, nb.j FROM w JOIN nb ON nb.tile = w.tile AND nb.i = w.j), l AS (SELECT tile, i, min(j) AS root FROM w GROUP BY tile, i), k AS (SELECT tile, root, count(*) AS n FROM l GROUP BY tile, root) SELECT t.tile, count(root)::INT AS regions, coalesce(max(n), 0)::INT AS largest FROM (SELECT DISTINCT tile FROM px) t LEFT JOIN k ON k.tile = t.tile GROUP BY t.tile")
def components_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.components(domain.pixels(spark, sf_dir), 150)


@query()
def phase_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.phase_shift(domain.pixels(spark, sf_dir))


@query()
def topk_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.contours(domain.pixels(spark, sf_dir), 150)


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.matches(domain.pixels(spark, sf_dir), 150)


@query()
def cell_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.cell_counts(domain.pixels(spark, sf_dir), least=2)


@query()
def macenko_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stain.macenko_fit(domain.pixels(spark, sf_dir))


@query()
def vahadane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stain.vahadane_fit(domain.pixels(spark, sf_dir))


_ruled("rule_set", "stain in {'cd8', 'he'} and positive_cells not in {1, 2}", "stain IN ('cd8', 'he') AND positive_cells NOT IN (1, 2)")
_ruled("rule_in_chain", "'d' in stain in ['cd8'] and 'c' in stain not in ('cd31',)", "stain = 'cd8'")
_ruled("rule_two_percentiles", "percentile('blur', 10) <= blur < percentile('blur', 90) and blur > percentile('blur', 10)", "coalesce(blur > (SELECT quantile_cont(blur, 0.1) FROM m) AND blur < (SELECT quantile_cont(blur, 0.9) FROM m), false)")

STAINS = {"he": {"role": "reference"}, "cd8": {"role": "moving", "source_magnification": 40}}
RECORDS = """o AS (SELECT slide_uid, CASE WHEN section = 2 THEN 80.0::DOUBLE END AS mag, section = 3 AND case_id LIKE '%5' AS ex FROM s WHERE section IN (2, 3)),
x AS (SELECT s.slide_uid, case_id, stain, section, CASE stain WHEN 'he' THEN 'reference' ELSE 'moving' END AS role, coalesce(o.mag, CASE stain WHEN 'cd8' THEN 40.0::DOUBLE END) AS source_magnification, coalesce(o.ex, false) AS excluded FROM s LEFT JOIN o ON o.slide_uid = s.slide_uid)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.slides(domain.files(spark, sf_dir))
    own = rows.where("section IN (2, 3)").select("slide_uid", F.when(F.col("section") == 2, 80.0).alias("source_magnification"), ((F.col("section") == 3) & F.col("case_id").like("%5")).alias("exclude"))
    return index.declared(rows, STAINS, own)


@query(f"WITH {FILES}, {RECORDS} SELECT slide_uid, role, source_magnification, excluded FROM x")
def index_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("slide_uid", "role", "source_magnification", "excluded")


@query(f"WITH {FILES}, {RECORDS}, r AS (SELECT case_id, slide_uid FROM x WHERE role = 'reference' AND NOT excluded QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY stain, section) = 1) SELECT r.slide_uid || '__' || x.slide_uid AS pair_uid, x.case_id, x.stain, x.slide_uid AS moving_uid, r.slide_uid AS reference_uid FROM x JOIN r ON r.case_id = x.case_id WHERE role = 'moving' AND NOT excluded")
def pairs_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.pairs_of(_records(spark, sf_dir)).drop("reference_stain")


@query(f"WITH {FILES} SELECT case_id, count(*) AS n_slides, string_agg(slide_uid, ',' ORDER BY stain, section, slide_uid) AS slide_uids FROM s GROUP BY case_id")
def cases_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.cases(index.slides(domain.files(spark, sf_dir))).withColumn("slide_uids", F.concat_ws(",", "slide_uids"))


def _surveyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = index.slides(domain.files(spark, sf_dir))
    base = F.when(F.col("section") == 3, 10.0).when(F.col("section") != 2, 40.0)
    return rows, rows.where("case_id NOT LIKE '%9'").select("slide_uid", base.alias("base"), (~F.col("case_id").like("%7")).alias("readable"))


@query(f"WITH {FILES}, {SEEN}, z AS (SELECT slide_uid, CASE WHEN NOT readable THEN 'unreadable' WHEN base IS NULL THEN 'no magnification' WHEN base + 1e-9 < 20 THEN 'below target' END AS reason FROM m) SELECT slide_uid, reason, reason IS NULL AS usable FROM z")
def recipe_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_slides(_surveyed(spark, sf_dir)[1], 20.0).select("slide_uid", "reason", "usable")


@query(f"WITH {FILES}, {PAIRS}, {SEEN} SELECT moving_uid, reference_uid, a.base AS reference_magnification, b.base AS moving_magnification, a.base IS NULL OR b.base IS NULL AS missing FROM p LEFT JOIN m a ON a.slide_uid = reference_uid LEFT JOIN m b ON b.slide_uid = moving_uid")
def pair_magnifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, survey = _surveyed(spark, sf_dir)
    return source_magnifications(index.pairs(rows), survey).select("moving_uid", "reference_uid", "reference_magnification", "moving_magnification", "missing")


@query(f"WITH {M} SELECT case_id, stain, count(*) AS n, sum(positive_cells)::DOUBLE AS positive_cells, round(avg(positive_cells), 6) AS positive_cells_mean, round(avg(tissue_fraction), 6) AS tissue_fraction_mean FROM m GROUP BY case_id, stain")
def results_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.aggregate(domain.manifest(spark, sf_dir), ["case_id", "stain"], ["positive_cells"], ["positive_cells", "tissue_fraction"])
    return out.withColumns({c: F.round(c, 6) for c in ("positive_cells_mean", "tissue_fraction_mean")})


@query(f"WITH {SURVEY} SELECT slide, round_even(size * (base / 10), 0)::INT AS x0, greatest(round_even(size * (base / 2 / 10), 0), 1)::INT AS n_read FROM v WHERE base IS NOT NULL")
def mag_read_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = domain.survey(spark, sf_dir).where("base IS NOT NULL")
    return v.select("slide", to_level0(F.col("size"), F.col("base"), 10.0).alias("x0"), read_length(F.col("size"), F.col("base") / 2, 10.0).alias("n_read"))


LISTED = """l AS (SELECT '/cohort/P' || (o_custkey % 50) || '/' || lab || '/S' || (o_orderkey % 40) || '_' || CASE WHEN o_orderkey % 23 = 0 THEN 'moving' ELSE lab END || '.svs' AS path, 'P' || (o_custkey % 50) AS folder, 'S' || (o_orderkey % 40) AS sample, lab, o_orderkey % 23 = 0 AND lab <> 'moving' AS odd
  FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'reference' WHEN 'O' THEN 'moving' ELSE 'other' END AS lab FROM orders))"""


@query(f"WITH {LISTED}, k AS (SELECT folder, sample, max(path) FILTER (lab = 'reference') AS reference, max(path) FILTER (lab = 'moving') AS moving FROM l WHERE lab <> 'other' AND NOT odd GROUP BY folder, sample) SELECT *, CASE WHEN reference IS NULL THEN 'reference' WHEN moving IS NULL THEN 'moving' END AS missing FROM k")
def sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", "reference").when(F.col("o_orderstatus") == "O", "moving").otherwise("other")
    text = lambda c, n: (F.col(c) % n).cast("string")
    path = F.concat(F.lit("/cohort/P"), text("o_custkey", 50), F.lit("/"), label, F.lit("/S"), text("o_orderkey", 40), F.lit("_"), F.when(F.col("o_orderkey") % 23 == 0, "moving").otherwise(label), F.lit(".svs"))
    return discovery.sample_pairs(discovery.indexed_pairs(domain.table(spark, sf_dir, "orders").select(path.alias("path"))))


@query("SELECT '/out/' || (p_size % 7) || '/p' || p_partkey || '_reference.png' AS reference, '/out/' || (p_size % 7) || '/p' || p_partkey || '_moving.png' AS moving, 'p' || p_partkey || '_reference.png' AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def patch_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    stem = F.concat(F.lit("/out/"), (F.col("p_size") % 7).cast("string"), F.lit("/p"), p.cast("string"))
    files = F.filter(F.array(F.when(p % 5 != 0, F.concat(stem, F.lit("_reference.png"))), F.when(p % 3 != 0, F.concat(stem, F.lit("_moving.png")))), lambda x: x.isNotNull())
    return discovery.patch_pairs(domain.table(spark, sf_dir, "part").select(F.explode(files).alias("path")))


@query(f"WITH {PX}, {BROWN}, k AS (SELECT tile, avg(((r + g + b) / 3.0::DOUBLE < 235)::INT) AS grey, avg(({OD} > 0.15::DOUBLE)::INT) AS density, avg(brown::INT) AS brown FROM z GROUP BY tile) SELECT tile, round(grey, 6) AS grey, round(density, 6) AS density, round(brown, 6) AS brown, grey >= 0.9::DOUBLE AS tissue FROM k")
def tile_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {"grey": patches.grey_share(), "density": patches.density_share(), "brown": patches.brown_share()}
    return domain.tiles(spark, sf_dir).select("tile", *(F.round(v, 6).alias(k) for k, v in shares.items()), patches.is_tissue("grey", 0.9).alias("tissue"))


@query(f"WITH {PX}, k AS (SELECT tile, avg(((r + g + b) / 3.0::DOUBLE < 235)::INT) AS share FROM px GROUP BY tile), n AS (SELECT printf('S%02d', tile % 20) AS slide_uid, ((tile // 20) % 4 * 8)::INT AS x0, ((tile // 80) * 8)::INT AS y0, share FROM k) SELECT slide_uid, count(*) AS n_tiles, count(*) FILTER (share >= 0.9::DOUBLE) AS n_tissue, round(avg(share), 6) AS tissue_fraction, min(x0) FILTER (share >= 0.9::DOUBLE) AS \"left\", min(y0) FILTER (share >= 0.9::DOUBLE) AS top, max(x0) FILTER (share >= 0.9::DOUBLE) AS \"right\", max(y0) FILTER (share >= 0.9::DOUBLE) AS bottom FROM n GROUP BY slide_uid")
def stage_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.tissue(domain.tiles(spark, sf_dir), 0.9).withColumn("tissue_fraction", F.round("tissue_fraction", 6))


def _tile_pairs(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(10).select(F.concat(F.lit("C"), k.cast("string")).alias("case_id"), F.when(k % 2 == 0, "cd8").otherwise("cd31").alias("stain"), F.format_string("S%02d", k * 2 + 1).alias("moving_uid"), F.format_string("S%02d", k * 2).alias("reference_uid"))


CUT = f"{PX}, k AS (SELECT tile, avg(((r + g + b) / 3.0::DOUBLE < 235)::INT) AS share FROM px GROUP BY tile), c AS (SELECT tile, 'C' || (tile % 20 // 2) AS case_id, CASE WHEN tile % 2 = 0 THEN 'he' WHEN tile % 20 // 2 % 2 = 0 THEN 'cd8' ELSE 'cd31' END AS stain, share, printf('S%02d__x%06d_y%06d', tile % 20, (tile // 20) % 4 * 8, (tile // 80) * 8) AS uid FROM k)"


@query(f"WITH {CUT} SELECT uid, case_id, stain, round(share, 6) AS tissue_fraction, share >= 0.9::DOUBLE AS passes FROM c")
def stage_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patches.patches(domain.tiles(spark, sf_dir), _tile_pairs(spark), 0.9)
    return rows.select("uid", "case_id", "stain", F.round("tissue_fraction", 6).alias("tissue_fraction"), "passes")


@query(f"WITH {CUT}, q AS (SELECT stain, " + ", ".join(f"-ln(({x} + 1) / 255.0::DOUBLE + 1e-6::DOUBLE) AS {x}" for x in "rgb") + " FROM px JOIN c ON c.tile = px.tile WHERE share >= 0.8) SELECT stain, " + ", ".join(f"round({f}({x}), 6) AS {n}_{x}" for n, f in (("mean", "avg"), ("std", "stddev_pop")) for x in "rgb") + " FROM q GROUP BY stain")
def stage_stain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = domain.tiles(spark, sf_dir)
    fit = patches.stain_fits(tiles, patches.patches(tiles, _tile_pairs(spark)), 0.8)
    return fit.select("stain", *(F.round(f"{n}_{x}", 6).alias(f"{n}_{x}") for n in ("mean", "std") for x in "rgb"))


@query()
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = domain.tiles(spark, sf_dir)
    return patches.counts(tiles, patches.patches(tiles, _tile_pairs(spark)), 8, least=2)


REGIONS = """b AS (SELECT slide, width, height, k, (slide * 37 + k * 13) % 120 / 100::DOUBLE AS rx, (slide * 91 + k * 7) % 110 / 100::DOUBLE AS ry, (slide + k) % 40 / 100::DOUBLE AS rw, (slide * 3 + k) % 50 / 100::DOUBLE AS rh FROM (SELECT *, unnest(range(size % 4)) AS k FROM v)),
a AS (SELECT *, greatest(0, least(trunc(rx * width)::INT, width - 1)) AS x, greatest(0, least(trunc(ry * height)::INT, height - 1)) AS y FROM b),
n AS (SELECT slide, (k + 1)::INT AS region_number, 'region_' || lpad((k + 1)::VARCHAR, 3, '0') AS region_tag, x, y, greatest(1, least(trunc(rw * width)::INT, width - x)) AS w, greatest(1, least(trunc(rh * height)::INT, height - y)) AS h FROM a)"""


def _slides_with_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.survey(spark, sf_dir).withColumn("path", F.format_string("/archive/%d.svs", "slide"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three boxes on each slide of the survey, some of them over its edge."""
    k = F.explode(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), F.col("size") % 4))
    share = lambda a, b, m: (F.col("slide") * a + F.col("box") * b) % m / F.lit(100.0)
    boxes = _slides_with_path(spark, sf_dir).withColumn("box", k).withColumns({"rx": share(37, 13, 120), "ry": share(91, 7, 110), "rw": share(1, 1, 40), "rh": share(3, 1, 50)})
    return regions.region_manifests(boxes, "tissue")


@query(f"WITH {SURVEY}, {REGIONS} SELECT slide AS sample_id, slide || '.svs' AS source_file, region_number, region_tag, x, y, w, h FROM n")
def region_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("sample_id", "source_file", "region_number", "region_tag", "coordinates.absolute_pixels.*")


@query(f"WITH {SURVEY}, {REGIONS}, l AS (SELECT slide, count(*)::INT AS n_regions, string_agg(concat_ws(' ', region_tag, x, y, w, h), ',' ORDER BY region_number) AS regions FROM n GROUP BY slide) SELECT v.slide AS sample_id, v.slide || '.svs' AS source_file, coalesce(n_regions, 0) AS n_regions, coalesce(regions, '') AS regions FROM v LEFT JOIN l ON l.slide = v.slide")
def slide_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.slide_manifests(_slides_with_path(spark, sf_dir), _regions(spark, sf_dir), "tissue")
    line = F.transform("regions", lambda r: F.concat_ws(" ", r["region_tag"], *(r["absolute_box"][c].cast("string") for c in "xywh")))
    return rows.select("sample_id", "source_file", "n_regions", F.concat_ws(",", line).alias("regions"))


@query(f"WITH {FILES} SELECT slide_uid || '.svs' AS name, path FROM s WHERE section <> 3")
def staged_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.staged_slides(index.slides(domain.files(spark, sf_dir)).withColumn("excluded", F.col("section") == 3))


@query(f"WITH {FILES}, {PAIRS}, u AS (SELECT case_id, stain, 'reference' AS role, reference_uid AS uid FROM p UNION ALL SELECT case_id, stain, 'moving', moving_uid FROM p) SELECT u.stain || '/' || role || '/' || u.case_id || '_' || role || '.svs' AS name, max_by(path, uid) AS path FROM u JOIN s ON s.slide_uid = uid GROUP BY 1")
def staged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = index.slides(domain.files(spark, sf_dir))
    return regions.staged_pairs(index.pairs(slides), slides)


#: Colours of markers: hues and least saturation.
MARKERS = {"brown": ((5, 20), 30), "magenta": ((140, 175), 40)}
MASKS = """x AS (SELECT tile, i, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d, r, g, b FROM px),
y AS (SELECT *, floor(coalesce(CASE WHEN v = r THEN 30 * (g - b) / nullif(d, 0)::DOUBLE WHEN v = g THEN 60 + 30 * (b - r) / nullif(d, 0)::DOUBLE ELSE 120 + 30 * (r - g) / nullif(d, 0)::DOUBLE END, 0) + 0.5) AS turn, coalesce(floor(255 * d::DOUBLE / nullif(v, 0) + 0.5), 0) AS sat FROM x),
k(marker, low, high, least_sat) AS (VALUES ('brown', 5, 20, 30), ('magenta', 140, 175, 40)),
z AS (SELECT tile, marker, (255 - v)::DOUBLE AS dark FROM (SELECT *, CASE WHEN turn < 0 THEN turn + 180 ELSE turn END AS hue FROM y) JOIN k ON hue BETWEEN low AND high AND sat >= least_sat),
h AS (SELECT tile, marker, dark, count(*) AS n FROM z GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS n0, sum(n * dark) OVER u AS s0, sum(n) OVER e AS n1, sum(n * dark) OVER e AS s1 FROM h WINDOW u AS (PARTITION BY tile, marker ORDER BY dark ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY tile, marker)),
t AS (SELECT tile, marker, coalesce(arg_max(dark, (between_, -dark)) FILTER (between_ > 0), -1) AS t FROM (SELECT *, CASE WHEN n1 > n0 THEN round(n0 * (n1 - n0) * pow(s0 / n0 - (s1 - s0) / (n1 - n0), 2), 3) END AS between_ FROM c) GROUP BY ALL),
w AS (SELECT z.tile, z.marker, CASE WHEN count(*) >= 10 THEN count(*) FILTER (dark > t) ELSE 0 END AS n FROM z JOIN t ON t.tile = z.tile AND t.marker = z.marker GROUP BY ALL)"""


@query(f"WITH {PX}, {MASKS} SELECT tile, coalesce(max(n) FILTER (marker = 'brown'), 0)::INT AS brown, coalesce(max(n) FILTER (marker = 'magenta'), 0)::INT AS magenta FROM (SELECT DISTINCT tile FROM px) LEFT JOIN w USING (tile) GROUP BY tile")
def marker_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = {name: patches.marker_mask(*colour) for name, colour in MARKERS.items()}
    return domain.tiles(spark, sf_dir).select("tile", *(F.size(F.filter(m, lambda x: x)).alias(name) for name, m in masks.items()))


CORES = """o AS (SELECT *, unnest(range(size % 4)) AS box FROM v WHERE slide % 3 <> 0), o1 AS (SELECT slide, slide // 3 AS case_id, width, height, box, (slide * 37 + box * 13) % 120 / 100::DOUBLE AS rx, (slide * 91 + box * 7) % 110 / 100::DOUBLE AS ry, (slide + box) % 40 / 100::DOUBLE AS rw, (slide * 3 + box) % 50 / 100::DOUBLE AS rh FROM o),
f AS (SELECT *, unnest(range(2)) AS box FROM v WHERE slide % 3 = 0), f1 AS (SELECT slide // 3 AS case_id, box, (slide * 37 + box * 13) % 120 / 100::DOUBLE AS rx, (slide * 91 + box * 7) % 110 / 100::DOUBLE AS ry, (slide + box) % 40 / 100::DOUBLE AS rw, (slide * 3 + box) % 50 / 100::DOUBLE AS rh FROM f),
c AS (SELECT slide, slide // 3 AS case_id, width, height, (SELECT count(*) FROM o1 WHERE o1.slide = v.slide) = 2 AS own FROM v WHERE slide % 3 <> 0),
b AS (SELECT c.slide, c.width, c.height, box, rx, ry, rw, rh, 'per_stain_otsu' AS detection_source FROM c JOIN o1 ON o1.slide = c.slide WHERE own UNION ALL SELECT c.slide, c.width, c.height, box, rx, ry, rw, rh, 'he_fallback' FROM c JOIN f1 ON f1.case_id = c.case_id WHERE NOT own)"""


def _core_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of slides whose number 3 doesn't divide, and two on each slide that it does, the reference of the next two."""
    v = domain.survey(spark, sf_dir).withColumn("case_id", F.floor(F.col("slide") / 3))
    share = lambda a, b, m: (F.col("slide") * a + F.col("box") * b) % m / F.lit(100.0)
    shares = {"rx": share(37, 13, 120), "ry": share(91, 7, 110), "rw": share(1, 1, 40), "rh": share(3, 1, 50)}
    own = v.where("slide % 3 <> 0").withColumn("box", F.explode(F.slice(F.array(*map(F.lit, range(3))), F.lit(1), F.col("size") % 4))).withColumns(shares)
    reference = v.where("slide % 3 = 0").withColumn("box", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(shares)
    return cores.chosen_boxes(v.where("slide % 3 <> 0"), own, reference).join(v.select("slide", "width", "height"), "slide")


@query(f"WITH {SURVEY}, {CORES} SELECT slide, box::INT AS box, detection_source, rx, ry FROM b")
def core_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _core_boxes(spark, sf_dir).select("slide", "box", "detection_source", "rx", "ry")


@query(
    f"WITH {SURVEY}, {CORES}, a AS (SELECT *, trunc(rx * width)::INT AS x, trunc(ry * height)::INT AS y, trunc(rw * width)::INT AS w, trunc(rh * height)::INT AS h FROM b), s AS (SELECT slide, box, width, height, x + w // 2 AS cx, y + h // 2 AS cy, trunc(w * 1.2::DOUBLE)::INT AS w, trunc(h * 1.2::DOUBLE)::INT AS h FROM a), "
    "t AS (SELECT slide, box, width, height, w, h, greatest(0, least(cx - w // 2, width - 1)) AS x, greatest(0, least(cy - h // 2, height - 1)) AS y FROM s) SELECT slide, box::INT AS box, x::INT AS x, y::INT AS y, greatest(1, least(w, width - x))::INT AS w, greatest(1, least(h, height - y))::INT AS h FROM t"
)
def core_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cores.scaled_boxes(_core_boxes(spark, sf_dir), 1.2)


def _draw(length: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '5', slide, region, attempt, '{length}')), 1, 8))::BIGINT)"


RANDOM = f"""m AS (SELECT slide, width, height, greatest(trunc(width * 0.05::DOUBLE)::INT, 300) AS iw, greatest(trunc(height * 0.05::DOUBLE)::INT, 300) AS ih FROM v), k AS (SELECT *, width - 2 * iw - 600 AS rw, height - 2 * ih - 600 AS rh, width - 2 * iw - 600 <= 0 OR height - 2 * ih - 600 <= 0 AS tight FROM m),
n AS (SELECT *, unnest([1, 2]) AS region FROM k), q AS (SELECT *, unnest(generate_series(1, CASE WHEN tight THEN 1 ELSE 20 END)) AS attempt FROM n),
d AS (SELECT *, CASE WHEN tight THEN greatest(0, floor((width - 600) / 2.0)) ELSE iw + {_draw("width")} % (rw + 1) END AS left_, CASE WHEN tight THEN greatest(0, floor((height - 600) / 2.0)) ELSE ih + {_draw("height")} % (rh + 1) END AS top_ FROM q),
e AS (SELECT slide, region, attempt::INT AS attempt, greatest(0, least(left_ + 600, width) - 600)::INT AS x0, greatest(0, least(top_ + 600, height) - 600)::INT AS y0, width, height FROM d),
s AS (SELECT *, (attempt * 37 + slide * 11 + x0) % 60 / 100::DOUBLE + 0.4 AS brightness, (y0 + attempt) % 20 / 100::DOUBLE AS saturation FROM e),
t AS (SELECT *, brightness <= 220 / 255::DOUBLE AND saturation >= 0.05::DOUBLE AS tissue FROM s)"""


@query(f"WITH {SURVEY}, {RANDOM} SELECT slide, region, attempt, x0, y0, least(x0 + 600, width)::INT AS x1, least(y0 + 600, height)::INT AS y1, tissue FROM t QUALIFY row_number() OVER (PARTITION BY slide, region ORDER BY NOT tissue, CASE WHEN tissue THEN 0 ELSE brightness END, attempt) = 1")
def random_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = cores.candidate_regions(domain.survey(spark, sf_dir), 600, 2, 5, tries=20)
    scores = {"brightness": (F.col("attempt") * 37 + F.col("slide") * 11 + F.col("x0")) % 60 / F.lit(100.0) + 0.4, "saturation": (F.col("y0") + F.col("attempt")) % 20 / F.lit(100.0)}
    return cores.random_regions(places.withColumns(scores))


@query(f"WITH {PX} SELECT tile, round(avg(((r * 19595 + g * 38470 + b * 7471 + 32768)::INT >> 16)) / 255, 6) AS brightness, round(avg(CASE WHEN greatest(r, g, b) > 0 THEN floor(255.0::DOUBLE * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) ELSE 0 END) / 255, 6) AS saturation FROM px GROUP BY tile")
def crop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    brightness, saturation = cores.crop_scores()
    return domain.tiles(spark, sf_dir).select("tile", F.round(brightness, 6).alias("brightness"), F.round(saturation, 6).alias("saturation"))


PATCH_NAMES = """f AS (SELECT '/patches/' || CASE o_orderkey % 3 WHEN 0 THEN 'case-' || (o_custkey % 20) WHEN 1 THEN 'he' ELSE 'x' END || '_' || lpad((o_orderkey % 500)::VARCHAR, 6, '0') || '_' || lpad((o_orderkey % 7)::VARCHAR, 6, '0') || CASE WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.PNG' END AS path FROM orders),
g AS (SELECT DISTINCT path, unnest(regexp_extract_all(path, '\\d{6}')) AS patch_id FROM f WHERE path LIKE '%.PNG')"""


def _patch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.when(k % 3 == 0, F.concat(F.lit("case-"), (c % 20).cast("string"))).when(k % 3 == 1, "he").otherwise("x")
    path = F.concat(F.lit("/patches/"), start, F.format_string("_%06d_%06d", k % 500, k % 7), F.when(k % 11 == 0, ".txt").otherwise(".PNG"))
    return cores.patch_files(domain.table(spark, sf_dir, "orders").select(path.alias("path")).distinct())


@query(f"WITH {PATCH_NAMES} SELECT patch_id, count(*) AS n_files, min(path) AS first FROM g GROUP BY patch_id")
def patch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patch_files(spark, sf_dir).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first"))


@query(f"WITH {PATCH_NAMES}, w AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS patch_id, 'CASE-' || (c_custkey % 20) AS case_id, 'he' AS tag FROM customer) SELECT patch_id, case_id, path FROM w LEFT JOIN g USING (patch_id) QUALIFY row_number() OVER (PARTITION BY patch_id, case_id ORDER BY NOT coalesce(contains(lower(path), lower(case_id)) OR contains(lower(split_part(path, '/', 3)), tag), false), path) = 1")
def patch_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    wanted = domain.table(spark, sf_dir, "customer").select(F.format_string("%06d", key).alias("patch_id"), F.concat(F.lit("CASE-"), (key % 20).cast("string")).alias("case_id"), F.lit("he").alias("tag"))
    return cores.picked_patches(wanted, _patch_files(spark, sf_dir)).select("patch_id", "case_id", "path")


@query("SELECT round(avg(l_quantity)::DOUBLE * (8112 / 1024::DOUBLE) * (SELECT avg(l_discount)::DOUBLE FROM lineitem WHERE l_linenumber <> 3), 4) AS error, 'um' AS unit, 'non_rigid_D' AS column, avg(l_quantity)::DOUBLE * (8112 / 1024::DOUBLE) * (SELECT avg(l_discount)::DOUBLE FROM lineitem WHERE l_linenumber <> 3) <= 5 AS accepted FROM lineitem")
def registration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.table(spark, sf_dir, "lineitem").select(F.col("l_tax").cast("double").alias("rigid_D"), F.col("l_quantity").cast("double").alias("non_rigid_D"), F.when(F.col("l_linenumber") != 3, F.col("l_discount").cast("double")).alias("resolution"))
    return cores.registration_error(rows, 8112, 1024, 5.0).withColumn("error", F.round("error", 4))


@query(
    f"WITH {SURVEY} SELECT slide, round(greatest(greatest(width, size * 100) / greatest(1, least(width, size * 100))::DOUBLE, greatest(height, size * 90) / greatest(1, least(height, size * 90))::DOUBLE), 6) AS ratio, width / 20.0::DOUBLE >= 128 AND height / 20.0::DOUBLE >= 128 AS viable, greatest(least(trunc(50 / (size / 10::DOUBLE))::INT, trunc(width * 0.4::DOUBLE)::INT), 20) AS bar FROM v"
)
def slide_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, size = F.col("width"), F.col("height"), F.col("size")
    ratio = F.round(cores.field_ratio((w, h), (size * 100, size * 90)), 6)
    return domain.survey(spark, sf_dir).select("slide", ratio.alias("ratio"), cores.grid_is_viable(w, h, 20, 128).alias("viable"), cores.bar_length(w, 50, size / 10).alias("bar"))


@query(
    f"WITH {SURVEY}, l AS (SELECT slide, width, height, CASE WHEN even THEN 4 ELSE 8 END AS d FROM v), x AS (SELECT *, greatest(0, width // 2 - 500) AS x0, greatest(0, height // 2 - 500) AS y0 FROM l) SELECT slide, x0::INT AS x0, y0::INT AS y0, least(greatest(1, round_even(1000 / d::DOUBLE, 0)), greatest(1, width // d - x0 // d))::INT AS w, least(greatest(1, round_even(1000 / d::DOUBLE, 0)), greatest(1, height // d - y0 // d))::INT AS h FROM x"
)
def centre_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = cores.centre_window(F.col("width"), F.col("height"), F.get("downsamples", F.lit(2)), 1000)
    return domain.survey(spark, sf_dir).select("slide", *(v.alias(k) for k, v in window.items()))


@query(
    f"WITH {SURVEY}, m AS (SELECT slide, 1 + size / 100::DOUBLE AS a, size / 200::DOUBLE AS b, size::DOUBLE AS c, -size / 300::DOUBLE AS d, 1::DOUBLE AS e, -size / 2::DOUBLE AS f FROM v), i AS (SELECT *, a * e - b * d AS det FROM m), "
    "j AS (SELECT slide, [12 / 4.0::DOUBLE * (e / det) * 2 / 10, 12 / 4.0::DOUBLE * (-b / det) * 2 / 11, 12 / 4.0::DOUBLE * ((b * f - c * e) / det), 13 / 4.0::DOUBLE * (-d / det) * 2 / 10, 13 / 4.0::DOUBLE * (a / det) * 2 / 11, 13 / 4.0::DOUBLE * ((c * d - a * f) / det)] AS m FROM i) "
    "SELECT slide, unnest([0, 1, 2, 3, 4, 5]) AS k, round(unnest(m), 6) AS v FROM j"
)
def level_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size").cast("double")
    matrix = F.array(1 + size / 100, size / 200, size, -size / 300, F.lit(1.0), -size / 2)
    n = lambda v: F.lit(float(v))
    out = cores.level_matrix(matrix, (n(12), n(13)), (n(10), n(11)), n(4), n(2))
    return domain.survey(spark, sf_dir).select("slide", F.posexplode(out).alias("k", "v")).select("slide", "k", F.round("v", 6).alias("v"))


@query(f"WITH {PX} SELECT tile, i::INT AS i, CASE WHEN g > 200 THEN 0 WHEN r > 170 THEN 255 ELSE r END AS red, CASE WHEN g > 200 THEN 114 WHEN r > 170 THEN 0 ELSE g END AS green, CASE WHEN g > 200 THEN 178 WHEN r > 170 THEN 0 ELSE b END AS blue FROM px")
def painted_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = [(F.col("r") > 170, (255, 0, 0)), (F.col("g") > 200, (0, 114, 178))]
    out = cores.painted([F.col(c) for c in "rgb"], layers)
    return domain.pixels(spark, sf_dir).select("tile", "i", *(v.alias(n) for v, n in zip(out, ("red", "green", "blue"), strict=True)))


@query(f"WITH {FILES}, m AS (SELECT *, CASE WHEN section % 3 = 1 THEN 20 WHEN section % 3 = 2 THEN 40 END::DOUBLE AS source_magnification FROM s) SELECT stain, arg_min(source_magnification, slide_uid) AS source_magnification FROM m WHERE source_magnification > 0 GROUP BY stain")
def first_magnifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("section") % 3
    return cores.first_magnifications(index.slides(domain.files(spark, sf_dir)).withColumn("source_magnification", F.when(s == 1, 20.0).when(s == 2, 40.0)))


@query(f"WITH {FILES}, {PAIRS}, a AS (SELECT DISTINCT case_id, stain FROM s WHERE stain = 'cd8') SELECT p.case_id, p.stain, p.moving_uid, CASE WHEN a.case_id IS NULL THEN 'missing' ELSE 'aligned' END AS status FROM p LEFT JOIN a ON a.case_id = p.case_id AND a.stain = p.stain")
def alignment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    slides = index.slides(domain.files(spark, sf_dir))
    results = slides.where("stain = 'cd8'").select("case_id", "stain").distinct().withColumn("status", F.lit("aligned"))
    return cores.aligned_manifest(index.pairs(slides), results).select("case_id", "stain", "moving_uid", "status")


@query(f"WITH {PX}, q AS (SELECT 'S' || lpad((tile % 20)::VARCHAR, 2, '0') AS slide_uid, tile // 20 % 4 * 4 + i % 8 AS x, tile // 80 * 4 + i // 8 AS y, r FROM px) SELECT slide_uid, x::INT AS x, y::INT AS y, trunc(avg(r))::INT AS r FROM q GROUP BY ALL HAVING trunc(avg(r)) > 0")
def reassembled_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = domain.tiles(spark, sf_dir).withColumns({c: (F.col(c) / 2).cast("int") for c in ("x0", "y0")})
    rows = reassembly.reassembled(cut, 8, 4, 16).select("slide_uid", "x0", "y0", F.posexplode("r").alias("i", "r")).where("r > 0")
    return rows.select("slide_uid", (F.col("x0") + F.col("i") % 16).alias("x"), (F.col("y0") + F.floor(F.col("i") / 16)).cast("int").alias("y"), "r")


def _turns() -> str:
    middle = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)]
    rows = [(f"'{name}'", sx, sy, k, tx, ty) for name, (sx, sy) in grid.PLACES.items() for k, (tx, ty) in enumerate(middle if name == "center" else [(-sx, -sy)])]
    return "u(region, sx, sy, turn, tx, ty) AS (VALUES " + ", ".join(f"({', '.join(map(str, r))})" for r in rows) + ")"


def _end(length: str, side: str, turn: str, away: str) -> str:
    anchor = f"CASE {side} WHEN 0 THEN {length} // 2 WHEN -1 THEN trunc({length} * 0.05::DOUBLE) + 150 ELSE {length} - trunc({length} * 0.05::DOUBLE) - 150 END"
    return f"least({length}, {anchor} + {turn} * {away} + 150)"


SEARCH = f"""{_turns()}, a AS (SELECT slide, width, height, u.*, unnest(generate_series(0, trunc(width * 0.15::DOUBLE)::INT, greatest(1, trunc(width * 0.02::DOUBLE)::INT))) AS dx FROM v CROSS JOIN u), b AS (SELECT *, unnest(generate_series(0, trunc(height * 0.15::DOUBLE)::INT, greatest(1, trunc(height * 0.02::DOUBLE)::INT))) AS dy FROM a),
c AS (SELECT slide, region, turn, dx, dy, {_end("width", "sx", "tx", "dx")}::INT AS x1, {_end("height", "sy", "ty", "dy")}::INT AS y1 FROM b), d AS (SELECT *, greatest(0, x1 - 300) AS x0, greatest(0, y1 - 300) AS y0 FROM c QUALIFY row_number() OVER (PARTITION BY slide, region, x1, y1 ORDER BY turn, dx, dy) = 1),
e AS (SELECT *, (x0 * 7 + y0 * 13) % 97 / 100::DOUBLE AS fraction FROM d)"""


@query(f"WITH {SURVEY}, {SEARCH} SELECT slide, region, x0, y0, x1, y1, fraction, fraction >= 0.9::DOUBLE AS found FROM e QUALIFY row_number() OVER (PARTITION BY slide, region ORDER BY fraction < 0.9::DOUBLE, CASE WHEN fraction < 0.9::DOUBLE THEN -fraction END, dx * dx + dy * dy, turn, dx, dy) = 1")
def nearest_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassembly.found_tissue(domain.survey(spark, sf_dir), 300, lambda x0, y0, x1, y1: (x0 * 7 + y0 * 13) % 97 / 100.0, 0.9)
