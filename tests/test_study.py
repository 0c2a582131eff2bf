import pytest

from cohortlens.__main__ import main
from cohortlens.plans import recipe
from cohortlens.plans.study import Study
from cohortlens.sources.manifests import as_text, head_digests, write_csv

NAMES = ["CASE-1_he.svs", "CASE-1_cd8.svs", "CASE-1_cd8_s02.svs", "CASE-2_cd8.svs", "CASE-1_pdl1.svs", "notes.svs"]


@pytest.fixture
def study(spark, tmp_path):
    (tmp_path / "archive").mkdir()
    for n in NAMES:
        (tmp_path / "archive" / n).write_bytes(b"placeholder")
    made = Study.create(spark, str(tmp_path), "one study", [str(tmp_path / "archive")])
    made.index()
    return made


def test_study_from_index_to_results(spark, study, tmp_path):
    assert {r.slide_uid for r in study.slides().collect()} >= {"CASE-1__he__s01", "CASE-1__cd8__s02"}
    assert study.pairs(["cd8"]).count() == 2
    found = [(r.severity, r.scope, r.kind) for r in study.verify().collect()]
    assert ("error", "CASE-2", "no reference") in found and ("warning", "descriptor", "undeclared") in found
    assert [s for s, _, _ in found] == sorted((s for s, _, _ in found), key=lambda s: s != "error")

    assert [r.status for r in study.run(dry_run=True)] == ["planned"] * 5
    rows = [("p1", "C1", "cd8", 0.90, 40.0), ("p2", "C1", "cd8", 0.55, 12.0), ("p3", "C2", "cd31", None, 5.0)]
    study.stages["patches"] = lambda s, r: spark.createDataFrame(rows, "uid string, case_id string, stain string, tissue_fraction double, blur double")
    assert [r.status for r in study.run(["patches", "counts"])] == ["completed", "failed"]
    facts = study.select("good ones", "tissue_fraction >= 0.6")
    assert (facts["n_input"], facts["n_selected"]) == (3, 1) and study.selections() == ["good_ones"]
    assert [tuple(r) for r in study.results("blur", ("case_id",), "patches", "good ones").collect()] == [("C1", 1, 40.0, 40.0)]
    with pytest.raises(FileNotFoundError, match="good_ones"):
        study.selection("other")
    write_csv(study.manifest("patches"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_create_keeps_what_is_there(spark, study, tmp_path):
    with pytest.raises(FileExistsError):
        Study.create(spark, str(tmp_path), "one study")
    assert Study.list(str(tmp_path)) == ["one_study"]
    with pytest.raises(FileNotFoundError):
        Study(spark, str(tmp_path), "none")
    assert len({r.digest for r in head_digests(spark, str(tmp_path / "archive")).collect()}) == 1


def test_command_line(spark, study, tmp_path, capsys):
    home = str(tmp_path)
    assert main([home, "pairs", "one study"], spark) == 0 and capsys.readouterr().out.strip() == "3"
    assert main([home, "verify", "one study"], spark) == 1
    assert main([home, "plan", "one study", "--set", "patches.patch_size=256"], spark) == 0
    assert study.recipe()["stages"]["patches"]["patch_size"] == 256
    assert main([home, "run", "one study", "patches"], spark) == 1
    with pytest.raises(recipe.PlanError):
        main([home, "plan", "one study", "--set", "nothing.x=1"], spark)


def test_recipe_hash_follows_decisions():
    cohort = {"name": "n", "sources": [{"root": "/x"}], "stains": {"he": {"role": "reference"}, "cd8": {"role": "moving", "chromogen": "DAB"}}}
    a, b = recipe.build(cohort), recipe.build(cohort)
    assert a["recipe_hash"] == b["recipe_hash"] != recipe.build(cohort, {"patches": {"stride": 9}})["recipe_hash"]
    assert a["stages"]["counts"]["chromogen_stains"] == ["cd8"] and a["stages"]["patches"]["stride"] == 512
    assert recipe.problems(cohort) == [] and len(recipe.problems({"patch_size": 0})) == 3
    assert recipe.ordered(["counts", "tissue"]) == ["tissue", "counts"]


def test_table_as_text(spark):
    df = spark.createDataFrame([("a", 1.23456), ("b", None)], "k string, v double")
    assert as_text(df, 1) == "k  v    \n-  -----\na  1.235\n... 1 more row(s)"
    assert as_text(df.limit(0)) == "(no rows)"
