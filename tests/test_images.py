import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import naming, shapes
from cohortlens.functions.optics import lab, magnification, rgb
from cohortlens.operators import images, stain


@pytest.fixture(scope="module")
def squares():
    mask = np.zeros((100, 100), bool)
    mask[50:90, 50:90] = mask[5:25, 5:25] = True
    return mask


def test_outlines_of_squares(squares):
    found = shapes.outlines(squares, 8, 0.001)
    assert [o.area for o in found] == [1521.0, 361.0]
    assert [tuple(round(v, 6) for v in o.centre) for o in found] == [(69.5, 69.5), (14.5, 14.5)]
    assert [(i, j) for i, j, _ in shapes.matched(found, found, squares.shape, squares.shape)] == [(0, 0), (1, 1)]
    assert shapes.outlines(np.zeros((4, 4), bool)) == []
    assert len(shapes.outlines(np.eye(5, dtype=bool))) == 1


def test_phase_shift_of_a_rolled_block():
    block = np.zeros((64, 64))
    block[20:40, 20:40] = 200
    assert shapes.phase_shift(block, np.roll(block, (-3, 5), (0, 1))) == (-5.0, 3.0)


def test_alignment_by_number_of_pairs():
    assert shapes.alignment([], [], (2.0, -3.0)).tolist() == [[1, 0, 2], [0, 1, -3]]
    assert shapes.alignment([(0, 0), (2, 2)], [(1, 1), (5, 3)], (0, 0)).tolist() == [[1, 0, 2], [0, 1, 1]]
    src = np.array([(0, 0), (100, 0), (0, 80), (50, 50), (30, 10)], float)
    dst = src @ np.array([[0, 1], [-1, 0]]) * 2 + (5, 7)
    dst[4] += 500
    got = shapes.alignment(src, dst, (0, 0))
    assert np.allclose(src[:4] @ got[:, :2].T + got[:, 2], dst[:4])


@pytest.mark.parametrize("diagonal", [True, False])
def test_labels_equal_a_flood_fill(diagonal):
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((9, 13)) < 0.5
        own, n = shapes.labels(mask, diagonal)
        seen, count = np.zeros(mask.shape, int), 0
        for y, x in np.argwhere(mask):
            if not seen[y, x]:
                count, stack = count + 1, [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < 9 and 0 <= b < 13 and mask[a, b] and not seen[a, b]:
                        seen[a, b] = count
                        stack += [(a + p, b + q) for p in (-1, 0, 1) for q in (-1, 0, 1) if diagonal or not (p and q)]
        assert n == count and len(set(zip(own.ravel(), seen.ravel(), strict=True))) == n + (not mask.all())


def test_tissue_of_a_block():
    image = np.full((128, 128, 3), 255, np.uint8)
    image[32:96, 32:96] = 100
    assert shapes.tissue(image).sum() == 3904


def test_cells_drop_small_things_and_fill_holes():
    value, brown = np.full((40, 40), 200), np.ones((40, 40), bool)
    value[5:15, 5:15] = 60
    value[8, 8] = 200
    value[30:32, 30:32] = 60
    assert shapes.cells(value, brown, least=20)[0] == 1
    assert shapes.cells(value, np.zeros((40, 40), bool)) == (0, 0.0)


def test_registration_of_pairs(spark):
    a = np.full((200, 200, 3), 250, np.uint8)
    for y, x, h, w in ((30, 30, 50, 30), (110, 30, 40, 70), (120, 140, 30, 25)):
        a[y : y + h, x : x + w] = (150, 80, 120)
    b = np.full_like(a, 250)
    b[7:, 12:] = a[:-7, :-12]
    rows = [("p", a.ravel().tolist(), b.ravel().tolist()), ("bad", [1, 2], None)]
    got = {r.pair: r for r in images.registered(spark.createDataFrame(rows, "pair string, ref array<int>, moving array<int>"), 200).collect()}
    assert got["p"].status == "aligned" and got["p"].n_matched == 3 and got["p"].ncc > 0.95
    assert np.allclose(got["p"].matrix, [1, 0, 12, 0, 1, 7], atol=1e-6)
    assert got["bad"].status == "failed" and got["bad"].error


def pixels(spark, tiles):
    rows = [(t, i, *map(int, v)) for t, image in tiles.items() for i, v in enumerate(image.reshape(-1, 3))]
    return spark.createDataFrame(rows, "tile long, i int, r int, g int, b int")


def two_stains(seed, h=(0.65, 0.70, 0.29), e=(0.07, 0.99, 0.11)):
    rng = np.random.default_rng(seed)
    c = rng.random((400, 2)) * (1.0, 0.8)
    c[:20, 1], c[20:40, 0] = 0, 0
    unit = np.array([np.array(v) / np.linalg.norm(v) for v in (h, e)])
    image = np.clip(255 * np.exp(-c @ unit), 1, 255).astype(int)
    image[-60:] = 255
    return image


def test_stain_vectors_are_found_again(spark):
    px = pixels(spark, {1: two_stains(0), 2: two_stains(3), 3: np.full((4, 3), 255)})
    fit = {r.tile: r for r in stain.macenko_fit(px).collect()}
    assert set(fit) == {1, 2}
    for r in fit.values():
        assert np.allclose(r.h, np.array([0.65, 0.70, 0.29]) / np.linalg.norm([0.65, 0.70, 0.29]), atol=0.06)
        assert np.allclose(r.e, np.array([0.07, 0.99, 0.11]) / np.linalg.norm([0.07, 0.99, 0.11]), atol=0.06)
    own = {r.i: r for r in stain.macenko(px.where("tile = 1"), fit[1].asDict()).collect()}
    was = two_stains(0)
    assert np.mean([abs(own[i][c] - was[i][k]) for i in own for k, c in enumerate("rgb")]) < 4
    sparse = {r.tile: r for r in stain.vahadane_fit(px.where("tile < 3")).collect()}
    assert all(r.h[0] > r.e[0] and abs(np.linalg.norm(r.h) - 1) < 1e-6 for r in sparse.values())


def test_reinhard_reaches_the_target(spark):
    px = pixels(spark, {1: two_stains(0), 2: two_stains(5)})
    target = {k: v for k, v in stain.reinhard_fit(px, ("tile",)).where("tile = 2").first().asDict().items() if k != "tile"}
    out = stain.reinhard(px.where("tile = 1"), target)
    l, a, b = lab(F.col("r"), F.col("g"), F.col("b"))
    got = out.select(l.alias("l"), a.alias("a"), b.alias("b")).agg(F.avg("l").alias("l"), F.avg("a").alias("a"), F.avg("b").alias("b")).first()
    assert abs(got.l - target["mean_l"]) < 3 and abs(got.a - target["mean_a"]) < 3 and abs(got.b - target["mean_bb"]) < 3


def test_lab_and_back(spark):  # dark channels of vivid colours lose more to the 8-bit steps
    colours = spark.createDataFrame([(0, 0, 0), (255, 255, 255), (120, 60, 200), (90, 200, 80)], "r int, g int, b int")
    parts = lab(F.col("r"), F.col("g"), F.col("b"))
    rows = colours.select("*", *(p.alias(n) for p, n in zip(parts, ("light", "red", "yellow"), strict=True))).select("*", *(v.alias(f"{n}2") for v, n in zip(rgb(F.col("light"), F.col("red"), F.col("yellow")), "rgb", strict=True))).collect()
    assert rows[0].light == 0 and abs(rows[1].light - 100) < 1e-9
    assert max(abs(r[c] - r[f"{c}2"]) for r in rows for c in "rgb") <= 4


def test_names(spark):
    rows = ["slide10.svs", "slide2.svs", "Z.ndpi", "sample.ome.tiff", "Patient 01 / H&E", "...", "Sample_0001_CD8.tif", "A_HE_reference.ome.tiff"]
    df = spark.createDataFrame([(r,) for r in rows], "n string")
    assert [r.n for r in df.limit(4).orderBy(naming.natural_key(F.col("n"))).collect()] == ["sample.ome.tiff", "slide2.svs", "slide10.svs", "Z.ndpi"]
    n = F.col("n")
    got = {r.n: r for r in df.select("n", naming.safe_name(n).alias("safe"), naming.sample_id(n).alias("sample"), naming.slide_format(n).alias("format"), naming.role_of(n)[1].alias("role")).collect()}
    assert got["Patient 01 / H&E"].safe == "Patient_01_H_E" and got["..."].safe is None
    assert got["Sample_0001_CD8.tif"].sample == "Sample_0001" and got["sample.ome.tiff"].format == ".ome.tiff"
    assert got["A_HE_reference.ome.tiff"].role == "reference" and got["Z.ndpi"].role is None


def test_magnification_comes_from_the_first_that_is_known(spark):
    rows = [(None, "40X", "0.5", None), (80.0, "40", None, None), (None, "x", "0.2525", 5.0), (None, None, "-1", 5.0), (None, "inf", None, None)]
    df = spark.createDataFrame(rows, "o double, p string, m string, f double")
    value, origin = magnification(F.col("o"), [F.col("p")], [F.col("m")], F.col("f"))
    assert [tuple(r) for r in df.select(value, origin).collect()] == [(40.0, "property 0"), (80.0, "override"), (40.0, "mpp 0"), (5.0, "fallback"), (None, "missing")]


def test_random_regions_are_repeatable_and_stay_inside(spark):
    from cohortlens.operators import cores

    slides = spark.createDataFrame([("a", 3000, 2000), ("tiny", 40, 30), ("narrow", 5000, 90)], "slide string, width int, height int")
    rows = sorted(cores.candidate_regions(slides, 100, 2, 7, tries=5).collect())
    assert rows == sorted(cores.candidate_regions(slides.repartition(7), 100, 2, 7, tries=5).collect())
    assert {r.slide: sum(x.slide == r.slide for x in rows) for r in rows} == {"a": 10, "tiny": 2, "narrow": 2}
    assert all(0 <= r.x0 < r.x1 <= 5000 and 0 <= r.y0 < r.y1 for r in rows)
    assert {(r.x0, r.y0, r.x1, r.y1) for r in rows if r.slide == "tiny"} == {(0, 0, 40, 30)}
    stored = {"seed": 7, "size": [3000, 2000], "zooms": {"near": 100}, "regions": {"near": [[1], [2]]}}
    assert cores.same_regions(stored, 7, {"near": 100}, 2, (3000, 2000)) and not cores.same_regions(stored, 8, {"near": 100}, 2, (3000, 2000)) and not cores.same_regions(stored, 7, {"near": 100}, 3, (3000, 2000))


def test_registration_error_prefers_non_rigid_columns_and_knows_its_unit(spark):
    from cohortlens.operators import cores

    rows = spark.createDataFrame([(1.0, 2.0, float("nan")), (3.0, 6.0, 0.5)], "rigid_D double, non_rigid_D double, resolution double")
    assert cores.registration_error(rows, 2048, 1024, 3.0).collect() == [(4.0, "um", "non_rigid_D", False)]
    assert cores.registration_error(rows.drop("resolution"), 2048, 1024, 3.0).collect() == [(4.0, "px", "non_rigid_D", True)]
    assert cores.registration_error(rows.select("resolution"), 2048, 1024).collect() == []
    assert cores.registration_error(rows.limit(0), 2048, 1024).collect() == []


def test_boxes_come_from_the_slide_or_its_reference(spark):
    from cohortlens.operators import cores

    box = "box int, rx double, ry double, rw double, rh double"
    slides = spark.createDataFrame([("s1", "c"), ("s2", "c"), ("s3", "none")], "slide string, case_id string")
    own = spark.createDataFrame([("s1", 0, 0.1, 0.1, 0.2, 0.2)], "slide string, " + box)
    reference = spark.createDataFrame([("c", 0, 0.3, 0.3, 0.2, 0.2)], "case_id string, " + box)
    found = lambda **k: sorted((r.slide, r.rx, r.detection_source) for r in cores.chosen_boxes(slides, own, reference, **k).collect())
    assert found() == [("s1", 0.1, "per_stain_otsu"), ("s2", 0.3, "he_fallback")]
    assert found(fall_back=False) == [("s1", 0.1, "per_stain_otsu")]
    assert found(detect=False) == [("s1", 0.3, "he_reference"), ("s2", 0.3, "he_reference")]
