"""Command line: python -m cohortlens HOME COMMAND NAME [...]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from cohortlens.functions.checks import REQUIRED, diagnostics
from cohortlens.plans import batches
from cohortlens.plans.study import Study
from cohortlens.sources.files import write_images, write_workbook
from cohortlens.sources.manifests import as_text, write_csv


def _settings(pairs: list[str]) -> dict[str, dict]:
    """STAGE.KEY=VALUE as nested overrides; values are JSON, or text where they aren't."""
    out: dict[str, dict] = {}
    for pair in pairs:
        key, sep, text = pair.partition("=")
        stage, dot, name = key.partition(".")
        if not (sep and dot and name):
            raise SystemExit(f"not STAGE.KEY=VALUE: {pair}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        out.setdefault(stage, {})[name] = value
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cohortlens")
    top.add_argument("home")
    sub = top.add_subparsers(dest="command", required=True)
    add = {c: sub.add_parser(c) for c in "init index survey tiles pairs verify plan run select results show align extract stain count compare thumbnails regions".split()}
    for p in add.values():
        p.add_argument("name")
    sub.add_parser("list")
    sub.add_parser("doctor").add_argument("--json", action="store_true")
    add["tiles"].add_argument("--size", type=int, default=512)
    add["tiles"].add_argument("--magnification", type=float)
    add["tiles"].add_argument("--overview", type=int, default=512)
    add["compare"].add_argument("--zoom", action="append", default=[], help="LABEL=SIDE")
    add["compare"].add_argument("--to")
    add["compare"].add_argument("--images")
    for c in ("thumbnails", "regions"):
        add[c].add_argument("--to", required=True)
    add["regions"].add_argument("--cores", action="store_true")
    add["regions"].add_argument("--share", type=float, default=0.005)
    add["regions"].add_argument("--size", type=int, default=512)
    add["results"].add_argument("--xlsx")
    add["init"].add_argument("--source", action="append", default=[])
    add["init"].add_argument("--stain", action="append")
    add["init"].add_argument("--magnification", type=float, default=20.0)
    add["init"].add_argument("--overwrite", action="store_true")
    add["verify"].add_argument("--json", action="store_true")
    add["plan"].add_argument("--set", action="append", default=[], dest="settings")
    add["run"].add_argument("stages", nargs="*")
    add["run"].add_argument("--dry-run", action="store_true")
    add["run"].add_argument("--continue-on-error", action="store_true")
    add["select"].add_argument("selection")
    add["select"].add_argument("--rule", default="")
    add["select"].add_argument("--stage", default="patches")
    add["results"].add_argument("--field", default="positive_cells")
    add["results"].add_argument("--group-by", default="case_id,stain")
    add["results"].add_argument("--stage", default="counts")
    add["results"].add_argument("--selection")
    add["results"].add_argument("--csv")
    add["results"].add_argument("--limit", type=int, default=20)
    return top


#: Commands that run one stage.
STAGE_COMMANDS = {"align": "alignment", "extract": "patches", "stain": "stain", "count": "counts"}


def _ran(done: list) -> int:
    print("\n".join(f"{r.stage}: {r.status} {r.error or '; '.join(r.warnings)}".rstrip() for r in done))
    return int(any(r.status == "failed" for r in done))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; 1 if verify finds errors or a stage fails."""
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(Study.list(a.home)))
        return 0
    if a.command == "doctor":
        facts = diagnostics()
        print(json.dumps(facts) if a.json else "\n".join(f"{k}: {v or 'missing'}" for k, v in facts.items()))
        return int(any(facts[k] is None for k in REQUIRED))
    spark = spark or SparkSession.builder.appName("cohortlens").getOrCreate()
    if a.command == "init":
        print(Study.create(spark, a.home, a.name, a.source, a.stain or ["he", "cd8"], a.magnification, a.overwrite).folder)
        return 0
    study = Study(spark, a.home, a.name)
    if a.command in ("index", "pairs"):
        print(getattr(study, a.command)().count())
    elif a.command == "verify":
        found = study.verify()
        print(json.dumps([r.asDict() for r in found.collect()]) if a.json else as_text(found, 1000))
        return int(found.where("severity = 'error'").count() > 0)
    elif a.command == "plan":
        print(study.plan(_settings(a.settings))["recipe_hash"])
    elif a.command == "run":
        return _ran(study.run(a.stages or None, a.dry_run, not a.continue_on_error))
    elif a.command in STAGE_COMMANDS:
        return _ran(study.run([STAGE_COMMANDS[a.command]]))
    elif a.command == "survey":
        print(as_text(study.survey().select("slide_uid", "width", "height", "base", "origin", "error").orderBy("slide_uid"), 1000))
    elif a.command == "tiles":
        print(study.read_tiles(a.size, a.magnification, a.overview).count(), study.unread().count())
    elif a.command == "thumbnails":
        print(as_text(write_images(batches.thumbnails(study.overviews()), a.to).orderBy("output"), 1000))
    elif a.command == "regions":
        print(as_text(batches.export(study, a.to, a.share, a.size, a.cores).orderBy("slide_uid"), 1000))
    elif a.command == "compare":
        zooms = {k: int(v) for k, _, v in (z.partition("=") for z in a.zoom or ["full=512"])}
        rows = study.crops(zooms)
        if a.to:
            rows.write.mode("overwrite").parquet(a.to)
        if a.images:
            print(as_text(write_images(rows.where("r IS NOT NULL"), a.images).groupBy("status").count()))
        print(as_text(rows.select("output", "slide_uid", "x0", "y0", "side").orderBy("output"), 1000))
    elif a.command == "select":
        print(json.dumps(study.select(a.selection, a.rule, a.stage)))
    elif a.command == "results":
        table = study.results(a.field, tuple(a.group_by.split(",")), a.stage, a.selection)
        if a.csv:
            write_csv(table, a.csv)
        if a.xlsx:
            write_workbook({a.field: table}, a.xlsx)
        print(as_text(table.orderBy(*a.group_by.split(",")), a.limit))
    else:
        print(json.dumps({"descriptor": study.descriptor, "selections": study.selections()}, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
