"""A study: a folder with a descriptor, and the tables derived from it. Every table is Parquet, so any step can be taken up again."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.checks import number_or_none, text_or_none
from cohortlens.functions.rules import thresholds_to_rule
from cohortlens.operators import grid, index, selection
from cohortlens.plans import recipe as plans
from cohortlens.plans.stages import DEFAULT_STAGES
from cohortlens.sources import slides as images
from cohortlens.sources.manifests import load_descriptor, read_listing

TEMPLATE = """# What is known about the cohort {name}.
name = {name_text}
default_magnification = {magnification}

{sources}
{stains}
"""


@dataclass
class StageResult:
    """What a stage did: completed, planned (dry run), skipped or failed."""

    stage: str
    status: str
    recipe_hash: str = ""
    n_rows: int | None = None
    error: str | None = None
    warnings: list[str] = field(default_factory=list)


def file_stem(name: str) -> str:
    stem = re.sub(r"^[._]+|[._]+$", "", re.sub(r"[^A-Za-z0-9._-]+", "_", name.strip()))
    if not stem:
        raise plans.PlanError(f"no file can be named {name!r}")
    return stem


class Study:
    """
    A study below a home folder on a file system that driver and executors share.

    Stages are functions (study, recipe) -> DataFrame put in `stages`; the result is the stage's manifest.  Those of
    stages.py work on the study's tiles (read_tiles() or put_tiles()); put your own in for other images.
    """

    def __init__(self, spark: SparkSession, home: str, name: str):
        self.spark, self.folder = spark, Path(home) / file_stem(name)
        if not (self.folder / "study.toml").is_file():
            raise FileNotFoundError(f"no study in {self.folder}")
        self.descriptor = {"name": name} | load_descriptor((self.folder / "study.toml").read_text())
        self.stages: dict[str, Callable[[Study, dict], DataFrame]] = dict(DEFAULT_STAGES)

    @classmethod
    def create(cls, spark: SparkSession, home: str, name: str, sources: list[str] = (), stains: list[str] = ("he", "cd8"), magnification: float = 20.0, overwrite: bool = False) -> Study:
        """A new study from a template; an existing one is kept unless overwrite. The first stain is the reference."""
        path = Path(home) / file_stem(name) / "study.toml"
        if path.exists() and not overwrite:
            raise FileExistsError(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        roots = "\n".join(f"[[sources]]\nroot = {json.dumps(s)}\n" for s in sources)
        roles = "\n".join(f"[stains.{json.dumps(s.lower())}]\nrole = {json.dumps('moving' if k else 'reference')}\n" for k, s in enumerate(stains))
        path.write_text(TEMPLATE.format(name=file_stem(name), name_text=json.dumps(name), magnification=float(magnification), sources=roots, stains=roles))
        return cls(spark, home, name)

    @staticmethod
    def list(home: str) -> list[str]:
        return sorted(p.parent.name for p in Path(home).glob("*/study.toml"))

    def _path(self, *parts: str) -> str:
        return str(self.folder.joinpath(*parts))

    def _table(self, *parts: str) -> DataFrame:
        if not self.folder.joinpath(*parts).exists():
            raise FileNotFoundError(f"{'/'.join(parts)} is not there yet")
        return self.spark.read.parquet(self._path(*parts))

    def _put(self, df: DataFrame, *parts: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(*parts))
        return self._table(*parts)

    def listing(self) -> DataFrame:
        """Slide files below all sources."""
        found = [read_listing(self.spark, s["root"]).select("path", "name") for s in self.descriptor["sources"]]
        out = self.spark.createDataFrame([], "path string, name string")
        for rows in found:
            out = out.unionByName(rows)
        return out

    def index(self) -> DataFrame:
        return self._put(index.slides(self.listing()), "index")

    def slides(self) -> DataFrame:
        return self._table("index")

    def records(self) -> DataFrame:
        """Slides with role, magnification, exclusion and note, as the descriptor declares and overrides them."""
        given = [(uid, number_or_none(o.get("source_magnification")), bool(o.get("exclude", False)), text_or_none(o.get("note"))) for uid, o in sorted(self.descriptor.get("overrides", {}).items())]
        own = self.spark.createDataFrame(given, "slide_uid string, source_magnification double, exclude boolean, note string")
        return index.declared(self.slides(), self.descriptor["stains"], own)

    def pairs(self, stains: list[str] | None = None, include_excluded: bool = False) -> DataFrame:
        return index.pairs_of(self.records(), stains, include_excluded)

    def cases(self) -> DataFrame:
        return index.cases(self.records())

    def summary(self) -> dict:
        """What there is: slides, cases and pairs, stages that have run, selections."""
        have = (self.folder / "index").exists()
        facts = {"name": self.descriptor["name"], "folder": str(self.folder), "n_slides": self.slides().count() if have else 0, "n_cases": self.cases().count() if have else 0, "n_pairs": self.pairs().count() if have else 0}
        return facts | {"stages": [s for s in plans.STAGES if (self.folder / "manifests" / s).exists()], "selections": self.selections()}

    def put_tiles(self, tiles: DataFrame) -> DataFrame:
        """Keep tiles (slide_uid, x0, y0, r, g, b as flat arrays) for the stages that read pixels."""
        return self._put(tiles.select("slide_uid", "x0", "y0", "r", "g", "b"), "tiles")

    def tiles(self) -> DataFrame:
        return self._table("tiles")

    def survey(self, measure: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Measured slides (slide_uid, base, readable, ...): what measure finds, else what the files' TIFF headers say."""
        return self._put((measure or images.surveyed)(self.records()), "survey")

    def read_tiles(self, size: int = 512, magnification: float | None = None, overview: int = 512) -> DataFrame:
        """Tiles and overviews of the surveyed slides from their files, kept for the stages; what can't be decoded is in unread()."""
        target = magnification or float(self.descriptor.get("default_magnification", plans.DEFAULTS["default_magnification"]))
        seen = self._table("survey")
        self._put(images.overviews(seen, overview).select("slide_uid", "r", "g", "b", "error"), "overviews")
        read = self._put(images.read(images.windows(seen, target, size)), "read")
        self._put(read.where("error IS NOT NULL").select("slide_uid", "x0", "y0", "error"), "unread")
        return self.put_tiles(read.where("error IS NULL"))

    def unread(self) -> DataFrame:
        return self._table("unread")

    def overviews(self) -> DataFrame:
        """A square picture per slide: those of read_tiles(), else the tiles at the origin."""
        if (self.folder / "overviews").exists():
            return self._table("overviews").where("error IS NULL").select("slide_uid", "r", "g", "b")
        return self.tiles().where("x0 = 0 AND y0 = 0").select("slide_uid", "r", "g", "b")

    def crops(self, zooms: dict[str, int], margin: float = 0.05) -> DataFrame:
        """Both slides of every pair at the five named places and each zoom (label to side in pixels), with the path that each crop is laid out at.

        Places are shares of each slide, so sides of a pair that differ in size are cut where they correspond.
        """
        sides = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("slide_uid")) for r, c in (("reference", "reference_uid"), ("moving", "moving_uid")))))
        pairs = self.pairs().select("pair_uid", sides.alias("side")).select("pair_uid", "side.*")
        seen = self._table("survey").where("readable")
        rows = None
        for zoom, size in sorted(zooms.items()):
            boxes = grid.named_boxes(seen.select(F.col("slide_uid").alias("slide"), "width", "height"), size, margin).withColumnRenamed("slide", "slide_uid").withColumns({"zoom": F.lit(zoom), "side": F.lit(size)})
            rows = boxes if rows is None else rows.unionByName(boxes)
        one = seen.select("slide_uid", "path").join(rows, "slide_uid").repartition("slide_uid", "zoom", "region")
        names = {"x_full": F.col("x0"), "y_full": F.col("y0"), "level": F.lit(0), "downsample": F.lit(1.0), "read": F.col("side")}
        pixels = images.read(one.withColumns(names).select("slide_uid", "path", "x0", "y0", *names, "side"))
        place = F.concat(F.concat_ws("/", "pair_uid", "zoom", "region", "role"), F.lit(".png")).alias("output")
        spots = rows.select("slide_uid", "zoom", "region", "side", "x0", "y0").join(pairs, "slide_uid")
        return spots.join(pixels.withColumn("side", F.sqrt(F.size("r")).cast("int")).dropDuplicates(["slide_uid", "side", "x0", "y0"]), ["slide_uid", "side", "x0", "y0"], "left").select("pair_uid", "role", "slide_uid", "zoom", "region", "x0", "y0", "side", place, "r", "g", "b")

    def verify(self) -> DataFrame:
        """Findings, errors first; without a survey, slides count as measured."""
        rows = self.slides() if (self.folder / "index").exists() else index.slides(self.listing().limit(0))
        unmeasured = rows.select("slide_uid", F.lit(float("inf")).alias("base"), F.lit(True).alias("readable"))
        seen = self._table("survey") if (self.folder / "survey").exists() else unmeasured
        roles = {k: s.get("role", "") for k, s in self.descriptor["stains"].items()}
        target = float(self.descriptor.get("default_magnification", plans.DEFAULTS["default_magnification"]))
        found = index.findings(rows, self.listing(), seen, roles, target)
        own = self.spark.createDataFrame([("error", "descriptor", p) for p in plans.problems(self.descriptor)], "severity string, scope string, kind string")
        return own.unionByName(found).orderBy(F.col("severity") != "error", "scope", "kind")

    def plan(self, overrides: dict[str, dict] | None = None) -> dict:
        seen = self._table("survey") if (self.folder / "survey").exists() else None
        made = plans.build(self.descriptor, overrides, seen)
        (self.folder / "recipe.json").write_text(json.dumps(made, indent=2, sort_keys=True))
        return made

    def recipe(self) -> dict:
        path = self.folder / "recipe.json"
        return json.loads(path.read_text()) if path.exists() else self.plan()

    def run(self, names: list[str] | None = None, dry_run: bool = False, stop_on_error: bool = True) -> list[StageResult]:
        """Run stages in order; a failure is a result, and ends the run unless stop_on_error is false."""
        made, out = self.recipe(), []
        for stage in plans.ordered(names):
            result = self._run(stage, made, dry_run)
            out.append(result)
            if result.status == "failed" and stop_on_error:
                break
        return out

    def _run(self, stage: str, made: dict, dry_run: bool) -> StageResult:
        key = made["recipe_hash"]
        self.unusable = [uid for uid, x in made.get("slides", {}).items() if not x["usable"]]
        if not made["stages"].get(stage, {}).get("enabled", True):
            return StageResult(stage, "skipped", key, warnings=[f"{stage} is disabled in the recipe"])
        missing = [s for s in plans.STAGES[stage] if not (self.folder / "manifests" / s).exists()]
        notes = [f"{s} has not run" for s in missing]
        if dry_run:
            return StageResult(stage, "planned", key, warnings=notes)
        if stage not in self.stages:
            return StageResult(stage, "failed", key, error=f"no function is registered for {stage}", warnings=notes)
        try:
            rows = self._put(self.stages[stage](self, made), "manifests", stage)
            return StageResult(stage, "completed", key, rows.count(), warnings=notes)
        except Exception as e:  # a stage's failure is reported, later stages may not depend on it
            return StageResult(stage, "failed", key, error=f"{type(e).__name__}: {e}", warnings=notes)

    def manifest(self, stage: str) -> DataFrame:
        return self._table("manifests", file_stem(stage))

    def select(self, name: str, rule: str = "", stage: str = "patches", stat_fields: tuple[str, ...] = ("tissue_fraction", "blur"), **thresholds: float) -> dict:
        """Save the uids that a rule and thresholds keep; the returned facts are stored beside them."""
        rows = self.manifest(stage)
        kept = self._put(selection.select(rows, rule, **thresholds), "selections", file_stem(name), "uids")
        n, k = rows.count(), kept.count()
        fields = [f for f in stat_fields if f in rows.columns]
        stats = {r["field"]: r.asDict() for r in selection.statistics(selection.apply(rows, kept), fields).collect()} if fields else {}
        text = " and ".join(t for t in (rule.strip(), thresholds_to_rule(**thresholds)) if t)
        facts = {"name": name, "stage": stage, "rule": text, "recipe_hash": self.recipe()["recipe_hash"], "n_input": n, "n_selected": k, "fraction_kept": k / n if n else 0.0, "stats": stats}
        self.folder.joinpath("selections", file_stem(name), "facts.json").write_text(json.dumps(facts, indent=2, sort_keys=True))
        return facts

    def selections(self) -> list[str]:
        return sorted(p.parent.name for p in (self.folder / "selections").glob("*/facts.json"))

    def selection(self, name: str) -> DataFrame:
        if file_stem(name) not in self.selections():
            raise FileNotFoundError(f"no selection {name!r}; there are: {', '.join(self.selections()) or 'none'}")
        return self._table("selections", file_stem(name), "uids")

    def results(self, field_: str, by: tuple[str, ...] = ("case_id", "stain"), stage: str = "counts", kept: str | None = None, total: bool = False) -> DataFrame:
        """n, sum and mean of a field by keys, of all rows or of a selection."""
        rows = self.manifest(stage)
        return selection.results(selection.apply(rows, self.selection(kept)) if kept else rows, list(by), field_, total)
