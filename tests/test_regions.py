"""Region manifests, staged names and marker masks on planted rows."""

import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions import shapes
from cohortlens.operators import patches, regions


def test_regions_lie_inside_their_slides(spark):
    boxes = [("a", "/x/a.ome.tif", 100, 50, 2, 0.5, 0.5, 0.9, 0.9), ("a", "/x/a.ome.tif", 100, 50, 1, -0.2, 1.4, 0.0, 0.001), ("b", "/x/b", 1, 1, 7, 0.0, 0.0, 1.0, 1.0)]
    rows = spark.createDataFrame(boxes, "slide string, path string, width int, height int, box int, rx double, ry double, rw double, rh double")
    got = regions.region_manifests(rows, "tissue")
    found = {(r.sample_id, r.region_tag): tuple(r.coordinates.absolute_pixels) for r in got.collect()}
    assert found == {("a", "region_001"): (0, 49, 1, 1), ("a", "region_002"): (50, 25, 50, 25), ("b", "region_001"): (0, 0, 1, 1)}
    slides = spark.createDataFrame([("a", "/x/a.ome.tif"), ("b", "/x/b"), ("c", None)], "slide string, path string")
    manifests = {r.sample_id: r for r in regions.slide_manifests(slides, got, "tissue").collect()}
    assert [r.region_number for r in manifests["a"].regions] == [1, 2] and manifests["a"].source_file == "a.ome.tif"
    assert manifests["a"].regions[1].relative_box.rw == 0.9 and manifests["c"].n_regions == 0 and manifests["c"].regions == []
    assert regions.slide_manifests(slides, got.limit(0), "tissue").count() == 3 and regions.region_manifests(rows.limit(0), "tissue").count() == 0


def test_staged_names(spark):
    records = spark.createDataFrame([("u1", "/x/1.ome.tif", False), ("u2", "/y.z/2", None), ("u3", "/x/3.svs", True)], "slide_uid string, path string, excluded boolean")
    assert {tuple(r) for r in regions.staged_slides(records).collect()} == {("u1.tif", "/x/1.ome.tif"), ("u2", "/y.z/2")}
    pairs = spark.createDataFrame([("c", "cd8", "u1", "u2"), ("c", "cd8", "u1", "u3"), ("c", "cd31", "u1", "u2")], "case_id string, stain string, reference_uid string, moving_uid string")
    want = {("cd8/reference/c_reference.tif", "/x/1.ome.tif"), ("cd8/moving/c_moving", "/y.z/2"), ("cd8/moving/c_moving.svs", "/x/3.svs"), ("cd31/reference/c_reference.tif", "/x/1.ome.tif"), ("cd31/moving/c_moving", "/y.z/2")}
    assert {tuple(r) for r in regions.staged_pairs(pairs, records).collect()} == want


def test_marker_masks(spark):
    """Brown pixels of two shades on white; few, equal, none, and a tile of many pixels against its histogram."""
    light, dark, white = (200, 140, 90), (120, 70, 40), (255, 255, 255)
    tiles = {"two": [light] * 30 + [dark] * 20 + [white] * 14, "few": [dark] * 9 + [white], "equal": [dark] * 12 + [white], "none": [white] * 20, "empty": []}
    shades = np.random.default_rng(4).integers(60, 230, 40_000)
    tiles["many"] = [(int(v), int(v) * 6 // 10, int(v) * 3 // 10) for v in shades]
    rows = spark.createDataFrame([(k, *([p[c] for p in v] for c in range(3))) for k, v in tiles.items()], "tile string, r array<int>, g array<int>, b array<int>")
    got = {r.tile: r.mask for r in rows.select("tile", patches.marker_mask((5, 20), 30).alias("mask")).collect()}
    assert got["two"] == [False] * 30 + [True] * 20 + [False] * 14 and got["few"] == [False] * 10 and got["equal"] == [True] * 12 + [False]
    assert got["none"] == [False] * 20 and got["empty"] == []
    assert got["many"] == (255 - shades > shapes.otsu(255 - shades)).tolist()
    assert rows.where(F.lit(False)).select(patches.marker_mask((5, 20), 30)).count() == 0
