import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import checks
from cohortlens.functions.rules import RuleError, compile_rule
from cohortlens.operators import discovery, index, patches, selection
from cohortlens.plans import recipe as plans
from cohortlens.plans.study import Study
from cohortlens.sources import manifests

NAMES = ["CASE-1_he.svs", "CASE-1_cd8.svs", "CASE-1_cd8_s02.svs", "CASE-1_cd31.svs", "CASE-2_cd8.svs", "CASE-1_pdl1.svs"]
STAINS = {"he": {"role": "reference"}, "cd8": {"role": "moving", "source_magnification": 40}, "cd31": {"role": "moving"}}


@pytest.fixture(scope="module")
def slides(spark):
    return index.slides(spark.createDataFrame([(f"/a/{n}", n) for n in NAMES], "path string, name string"))


def test_roles_overrides_and_exclusions(spark, slides):
    own = spark.createDataFrame([("CASE-1__cd8__s01", 80.0, False, "rescan"), ("CASE-1__cd31__s01", None, True, None)], "slide_uid string, source_magnification double, exclude boolean, note string")
    rows = index.declared(slides, STAINS, own)
    got = {r.slide_uid: (r.role, r.source_magnification, r.excluded, r.note) for r in rows.collect()}
    assert got["CASE-1__cd8__s01"] == ("moving", 80.0, False, "rescan") and got["CASE-1__cd8__s02"] == ("moving", 40.0, False, None)
    assert got["CASE-1__pdl1__s01"][0] == "moving" and got["CASE-1__he__s01"][0] == "reference" and got["CASE-1__cd31__s01"][2]
    pairs = {(r.moving_uid, r.reference_uid) for r in index.pairs_of(rows, ["CD8 "]).collect()}
    assert pairs == {("CASE-1__cd8__s01", "CASE-1__he__s01"), ("CASE-1__cd8__s02", "CASE-1__he__s01")}
    assert index.pairs_of(rows).count() == 3 and index.pairs_of(rows, include_excluded=True).count() == 4
    gone = index.declared(slides, STAINS, spark.createDataFrame([("CASE-1__he__s01", True)], "slide_uid string, exclude boolean"))
    assert index.pairs_of(gone).isEmpty()
    assert {r.case_id: r.n_slides for r in index.cases(rows).collect()} == {"CASE-1": 5, "CASE-2": 1}


@pytest.mark.parametrize(("rule", "kept"), [("stain in {'cd8'}", "a"), ("'d' in stain in ['cd8']", "a"), ("x not in {1, 2}", "c"), ("x in ()", ""), ("1 if [] else 0", ""), ("[1] and x == 1", "a"), ("percentile('x', 0) < x < percentile('x', 100)", "b")])
def test_sets_and_chains(spark, rule, kept):
    df = spark.createDataFrame([("a", "cd8", 1.0), ("b", "cd31", 2.0), ("c", None, 3.0)], "uid string, stain string, x double")
    assert "".join(sorted(r.uid for r in df.where(compile_rule(df, rule)).collect())) == kept


def test_sets_are_checked(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(RuleError):
        compile_rule(df, "x in {lambda: 1}")


def test_recipe_with_survey(spark):
    rows = [("s1", "C1", "he", 40.0, "override", True), ("s2", "C1", "cd8", 10.0, "property", True), ("s3", "C2", "cd8", None, "missing", True), ("s4", "C2", "he", 40.0, "property", False)]
    survey = spark.createDataFrame(rows, "slide_uid string, case_id string, stain string, base double, origin string, readable boolean")
    made = plans.build({"name": "x", "sources": ["a"], "stains": STAINS}, survey=survey)
    assert {k: v["usable"] for k, v in made["slides"].items()} == {"s1": True, "s2": False, "s3": False, "s4": False}
    assert made["slides"]["s1"]["source_magnification"] == 40.0 and made["slides"]["s4"]["source_magnification"] is None and len(made["notes"]) == 3
    assert plans.stage_of(made, "alignment")["qc_reference_read_level"] is None and made["stages"]["patches"]["stride"] == 512
    with pytest.raises(plans.PlanError):
        plans.stage_of(made, "nothing")
    pairs = spark.createDataFrame([("s2", "s1"), ("s3", "s9")], "moving_uid string, reference_uid string")
    got = {r.moving_uid: (r.reference_magnification, r.moving_magnification, r.missing) for r in plans.source_magnifications(pairs, survey).collect()}
    assert got == {"s2": (40.0, 10.0, False), "s3": (None, None, True)}


def test_discovery(spark):
    names = ["/w/P1/reference/S1_reference.svs", "/w/P1/moving/S1_moving.svs", "/w/P1/moving/S1_moving.tif", "/w/P1/moving/S2_moving.svs", "/w/P1/moving/S3_reference.svs", "/w/P1/moving/notes.txt", "/w/none/a.svs"]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.sample: (r.reference, r.moving, r.missing) for r in discovery.sample_pairs(discovery.indexed_pairs(paths)).collect()}
    assert got == {"S1": (names[0], names[1], None), "S2": (None, names[3], "reference")}
    assert [r.folder for r in discovery.pair_folders(paths).collect()] == ["P1"]
    assert discovery.matching(paths, (".SVS",), "/w/P1").count() == 4
    tiles = spark.createDataFrame([(f"/o/{x}",) for x in ("p1_reference.png", "p1_moving.png", "p2_reference.png", "HnE/a.png", "IHC/a.png", "IHC/b.png")], "path string")
    assert [r.name for r in discovery.patch_pairs(tiles).collect()] == ["p1_reference.png"]
    assert [(r.reference, r.moving) for r in discovery.folder_patch_pairs(tiles).collect()] == [("/o/HnE/a.png", "/o/IHC/a.png")]


def test_aligned_slides(spark):
    names = ["/al/s1_cd8/a.ome.tiff", "/al/s1_cd8/x_cd8.ome.tiff", "/al/s1_cd8/z_aligned.ome.tiff", "/al/cd31/s1_he/b10.ome.tif", "/al/cd31/s1_he/b2.ome.tif", "/al/s2_cd8/only.ome.tif", "/al/s2_cd8/no.png"]
    requests = spark.createDataFrame([("s1", "CD8"), ("s1", "cd31"), ("s2", "cd8"), ("s3", "cd8")], "sample string, biomarker string")
    got = {(r["sample"], r.biomarker): (r.path, r.ambiguous) for r in discovery.aligned(requests, spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {("s1", "CD8"): (names[1], False), ("s1", "cd31"): (names[4], True), ("s2", "cd8"): (names[5], False), ("s3", "cd8"): (None, None)}


def tile(share, n=64):
    """A tile whose first share of pixels is brown, the rest white."""
    k = int(share * n)
    return [120] * k + [255] * (n - k), [80] * k + [255] * (n - k), [40] * k + [255] * (n - k)


def test_tile_stages(spark, tmp_path):
    rows = [(f"CASE-1__{s}__s01", x, 0, *tile(share)) for s, share in (("he", 0.5), ("cd8", 0.75)) for x in (0, 8)] + [("CASE-1__cd8__s01", 16, 0, *tile(0)), ("CASE-9__he__s01", 0, 0, [], [], [])]
    tiles = spark.createDataFrame(rows, "slide_uid string, x0 int, y0 int, r array<int>, g array<int>, b array<int>")
    (tmp_path / "in").mkdir()
    for n in ("CASE-1_he.svs", "CASE-1_cd8.svs"):
        (tmp_path / "in" / n).write_bytes(n.encode())
    study = Study.create(spark, str(tmp_path / "home"), "one", [str(tmp_path / "in")], overwrite=True)
    study.index()
    study.put_tiles(tiles)
    study.plan({"counts": {"min_cell_area": 2}, "patches": {"tissue_threshold": 0.5}})
    results = {r.stage: r for r in study.run()}
    assert {k: r.status for k, r in results.items()} == dict.fromkeys(plans.STAGES, "completed"), [r.error for r in results.values()]
    cut = {(r.uid, r.tissue_fraction, r.passes) for r in study.manifest("patches").collect()}
    assert ("CASE-1__he__s01__x000000_y000000", 0.5, True) in cut and ("CASE-1__cd8__s01__x000016_y000000", 0.0, False) in cut and len(cut) == 5
    count = {r.uid: (r.brown_fraction, r.positive_cells) for r in study.manifest("counts").collect()}
    assert count["CASE-1__cd8__s01__x000016_y000000"] == (0.0, 0) and count["CASE-1__cd8__s01__x000000_y000000"][0] == 0.75 and len(count) == 3
    tissue = {r.slide_uid: (r.n_tiles, r.n_tissue) for r in study.manifest("tissue").collect()}
    assert tissue == {"CASE-1__he__s01": (2, 2), "CASE-1__cd8__s01": (3, 2), "CASE-9__he__s01": (1, 0)}
    fit = study.manifest("stain").where("stain = 'he'").first()
    od = -np.log(([121 / 255] * 32 + [256 / 255] * 32) + np.float64(1e-6))
    assert fit.mean_r == pytest.approx(od.mean()) and fit.std_r == pytest.approx(od.std()) and fit.n_patches == 2
    assert study.summary()["n_pairs"] == 1 and study.summary()["stages"] == list(plans.STAGES)


def test_gates(spark):
    row = spark.createDataFrame([tile(0.5), ([], [], [])], "r array<int>, g array<int>, b array<int>")
    got = [tuple(r) for r in row.select(patches.is_tissue("grey", 0.5), patches.is_tissue("grey", 0.5001), patches.is_tissue("saturation", 0.5), patches.density_share(), patches.sharpness(F.lit(8))).collect()]
    assert got[0][:4] == (True, False, True, 0.5) and got[0][4] >= 0 and got[1] == (False, False, False, None, None)


def test_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0, 2, "x"), ("a", None, 4, "y"), (None, None, None, "z")], "k string, u double, v int, t string")
    got = {r["k"]: (r["n"], r["v"], r["u_mean"], r["t_mean"]) for r in selection.aggregate(df, ["k"], ["v"], ["u", "t"]).collect()}
    assert got == {"a": (2, 6.0, 1.0, None), None: (1, None, None, None)}


def test_manifest_writer(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "uid string, n int")
    path = str(tmp_path / "m")
    with manifests.ManifestWriter(spark, path, "patches", {"a": 1}) as out:
        out.write(rows)
        out.write(rows.withColumn("more", F.lit(2)))
    info = manifests.read_manifest_info(spark, path)
    assert info["n_rows"] == 4 and info["fields"] == ["uid", "n", "more"] and info["recipe_hash"] == manifests.recipe_hash({"a": 1})
    with pytest.raises(ValueError), manifests.ManifestWriter(spark, path, "patches", append=True) as out:
        out.write(rows)
        raise ValueError("stop")
    info = manifests.read_manifest_info(spark, path)
    assert info["n_rows"] == 6 and info["error"] == "ValueError: stop"


def test_head_digests(spark, tmp_path):
    import hashlib

    body = bytes(range(256)) * 5000
    (tmp_path / "a.svs").write_bytes(body)
    got = manifests.head_digests(spark, str(tmp_path)).first()
    assert got.digest == hashlib.sha256(body[: 1 << 20]).hexdigest()[:16]


def test_checks(tmp_path):
    import dataclasses

    assert checks.text_or_none("  ") is None and checks.number_or_none("1.5") == 1.5 and checks.number_or_none("x") is None and checks.whole_or_none("3.0") == 3
    for bad in (lambda: checks.positive_number(0, "n"), lambda: checks.fraction(1.1, "n"), lambda: checks.choice("a", "n", ("b",)), lambda: checks.directory(tmp_path / "none", "n"), lambda: checks.module("no_such_module", "this")):
        with pytest.raises(checks.ConfigError):
            bad()
    kind = dataclasses.make_dataclass("Kind", [("a", int)])
    assert checks.from_mapping(kind, {"a": 1}).a == 1 and checks.directory(tmp_path / "new", "n", create=True).is_dir() and checks.module("json", "this") is json
    with pytest.raises(checks.ConfigError):
        checks.from_mapping(kind, {"a": 1, "b": 2})
