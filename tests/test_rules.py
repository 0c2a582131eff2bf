import pytest

from cohortlens.functions.rules import RuleError, compile_rule, thresholds_to_rule
from cohortlens.operators import selection

ROWS = [("p1", "C1", "cd8", 0.90, 40.0), ("p2", "C1", "cd8", 0.55, 12.0), ("p3", "C1", "cd8", 0.10, 80.0), ("p4", "C2", "cd31", 0.70, 5.0)]


@pytest.fixture(scope="module")
def patches(spark):
    return spark.createDataFrame(ROWS, "uid string, case_id string, stain string, tissue_fraction double, blur double")


@pytest.mark.parametrize(
    ("rule", "kept"),
    [
        ("tissue_fraction >= 0.6", {"p1", "p4"}),
        ("0.5 <= tissue_fraction < 0.8 and blur > 10", {"p2"}),
        ("stain in ['cd31']", {"p4"}),
        ("blur >= percentile('blur', 50)", {"p1", "p3"}),
        ("", {"p1", "p2", "p3", "p4"}),
        ("missing >= 1", set()),
        ("missing != 'x'", {"p1", "p2", "p3", "p4"}),
        ("not missing and blur / 0 == None", {"p1", "p2", "p3", "p4"}),
        ("stain < 3", set()),
        ("-7 % 3 == 2 and 7 % -3 == -2", {"p1", "p2", "p3", "p4"}),
        ("'d3' in stain", {"p4"}),
    ],
)
def test_rules(patches, rule, kept):
    assert {r.uid for r in selection.select(patches, rule).collect()} == kept


@pytest.mark.parametrize("rule", ["stain.upper()", "open('x')", "lambda: 1", "[x for x in y]", "blur is None", "~blur", "blur ** 2 > 1", "blur >"])
def test_hostile_rules_are_rejected(patches, rule):
    with pytest.raises(RuleError):
        compile_rule(patches, rule)


def test_results_and_thresholds(patches):
    assert thresholds_to_rule(tissue_fraction=0.6, blur=10) == "blur >= 10 and tissue_fraction >= 0.6"
    kept = selection.apply(patches, selection.select(patches, "blur >= 10", tissue_fraction=0.6))
    assert [r.uid for r in kept.collect()] == ["p1"]
    got = {r.case_id: (r.n, round(r["mean"], 2)) for r in selection.results(patches, ["case_id"], "tissue_fraction").collect()}
    assert got["C1"][0] == 3 and got["C2"] == (1, 0.70)
    assert selection.fraction(patches.limit(0), selection.select(patches.limit(0), "blur > 1")).first().n_input == 0
