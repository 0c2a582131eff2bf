import numpy as np
import pytest

from cohortlens.functions import ranks

WANTED = [(f, q) for f in ("ties", "spread", "skewed", "none", "one") for q in (0.0, 10.0, 37.5, 50.0, 90.0, 99.9, 100.0)]


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(11)
    n = 30_000
    spread = rng.normal(size=n).tolist()
    return {
        "ties": np.where(rng.random(n) < 0.7, 5, rng.integers(0, 10, n)).astype(float).tolist(),
        "spread": [None if k % 7 == 0 else v for k, v in enumerate(spread)],
        "skewed": (10.0 ** rng.integers(-300, 300, n)).tolist(),
        "none": [None] * n,
        "one": [3.25] + [None] * (n - 1),
    }


@pytest.mark.parametrize("at_once", [5, 100, 20_000])
def test_percentiles_equal_numpy_at_every_bound(spark, columns, at_once):
    rows = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(5)
    got = ranks.exact_percentiles(rows, WANTED, at_once)
    for f, q in WANTED:
        own = sorted(v for v in columns[f] if v is not None)
        if not own:
            assert got[f, q] is None
            continue
        p = q / 100 * (len(own) - 1)
        low, high = int(np.floor(p)), int(np.ceil(p))
        assert got[f, q] == (own[low] if low == high or own[low] == own[high] else (high - p) * own[low] + (p - low) * own[high]), (f, q)


def test_percentiles_of_odd_values_and_nothing(spark):
    rows = spark.createDataFrame([(float(v),) for v in ("nan", "inf", "-inf", "1", "2")], "`odd name` double")
    for at_once in (1, 100):
        got = ranks.exact_percentiles(rows, [("odd name", q) for q in (0.0, 25.0, 50.0, 75.0, 100.0)], at_once)
        v = [got["odd name", q] for q in (0.0, 25.0, 50.0, 75.0, 100.0)]
        assert v[:4] == [float("-inf"), 1.0, 2.0, float("inf")] and v[4] != v[4]
    assert ranks.exact_percentiles(rows.limit(0), [("odd name", 50.0)]) == {("odd name", 50.0): None}
    assert ranks.exact_percentiles(rows, []) == {}


def test_statistics_of_a_field_without_values(spark):
    from cohortlens.operators import selection

    rows = spark.createDataFrame([("a", None, 1.0), ("b", None, 4.0)], "uid string, v double, w double")
    assert [(r.field, r.median) for r in selection.statistics(rows, ["v", "w"]).collect()] == [("w", 2.5)]
    assert selection.statistics(rows, ["v"]).collect() == []
