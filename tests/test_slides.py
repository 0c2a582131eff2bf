import struct
import zlib

import numpy as np
import pytest

from cohortlens.sources import slides, tiff


def image_of(width, height):
    y, x = np.mgrid[:height, :width]
    return np.stack([x % 251, y % 241, (x * 3 + y * 7) % 256], 2).astype(np.uint8)


def tile_rows(image, side, uid):
    h, w = image.shape[:2]
    for y in range(0, h, side):
        for x in range(0, w, side):
            tile = np.full((side, side, 3), 255, np.uint8)
            part = image[y : y + side, x : x + side]
            tile[: part.shape[0], : part.shape[1]] = part
            yield (uid, x, y, *(tile[..., k].ravel().tolist() for k in range(3)))


def plain_tiff(path, image, order="<", rows=5, deflate=False, predictor=1, text=b"Aperio Image|AppMag = 20|MPP = 0.5\0"):
    """A striped file of classic format, put together by hand."""
    h, w = image.shape[:2]
    strips = []
    for y in range(0, h, rows):
        v = image[y : y + rows]
        if predictor == 2:
            v = np.concatenate([v[:, :1], np.diff(v, axis=1)], 1)
        strips.append(zlib.compress(v.tobytes()) if deflate else v.tobytes())
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    fields = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8, 8, 8]), (259, 3, [8 if deflate else 1]), (262, 3, [2]), (270, 2, text), (273, 4, offsets), (277, 3, [3]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
    extra, past, body = b"", at + 2 + 12 * len(fields) + 4, b""
    for tag, code, values in fields:
        data = values if code == 2 else struct.pack(f"{order}{len(values)}{tiff.TYPES[code]}", *values)
        body += struct.pack(order + "HHI", tag, code, len(values))
        if len(data) <= 4:
            body += data.ljust(4, b"\0")
        else:
            body += struct.pack(order + "I", past + len(extra))
            extra += data
    mark = b"II" if order == "<" else b"MM"
    path.write_bytes(mark + struct.pack(order + "HI", 42, at) + b"".join(strips) + struct.pack(order + "H", len(fields)) + body + struct.pack(order + "I", 0) + extra)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("deflate", "predictor"), [(False, 1), (True, 1), (True, 2)])
def test_strips_of_either_byte_order(tmp_path, order, deflate, predictor):
    image = image_of(37, 23)
    plain_tiff(tmp_path / "a.tif", image, order, deflate=deflate, predictor=predictor)
    with tiff.opened(str(tmp_path / "a.tif")) as f:
        tags = tiff.directories(f)
        (level,) = tiff.levels_of(tags)
        assert (level.window(f, 0, 0, 37, 23) == image).all()
        got = level.window(f, -3, 20, 10, 9)
        assert (got[:3, 3:] == image[20:23, :7]).all() and (got[3:] == 255).all() and (got[:, :3] == 255).all()
        assert tiff.properties_of(tags[0])["openslide.mpp-x"] == "0.5"


def test_resizing_keeps_flat_images_and_means():
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (tiff.resized(flat, 11, 17) == 77).all() and (tiff.two_step(flat, 5) == 77).all()
    ramp = np.repeat(np.arange(64, dtype=np.uint8)[None, :, None], 64, 0).repeat(3, 2)
    small = tiff.resized(ramp, 16, 16).astype(float)
    assert np.abs(small[8, 2:-2, 0] - (np.arange(16) * 4 + 1.5)[2:-2]).max() <= 1


def test_pyramid_round_trip_and_survey(spark, tmp_path):
    side, uid = 32, "C1__he__s01"
    image = image_of(150, 90)
    rows = spark.createDataFrame(list(tile_rows(image, side, uid)), "slide_uid string, x0 int, y0 int, r array<int>, g array<int>, b array<int>")
    sizes = spark.createDataFrame([(uid, 150, 90, 0.5, 20.0)], "slide_uid string, width int, height int, mpp double, magnification double")
    (made,) = slides.write_pyramids(rows, sizes, str(tmp_path / "out"), side, str(tmp_path / "work"), levels=3).collect()
    assert made.n_tiles == 15 + 6 + 2 and made.bytes == (tmp_path / "out" / f"{uid}.ome.tif").stat().st_size
    assert [p.name for p in (tmp_path / "out").iterdir()] == [f"{uid}.ome.tif"]
    with tiff.opened(made.path) as f:
        pyramid = tiff.levels_of(tiff.directories(f))
        assert [(x.width, x.height) for x in pyramid] == [(150, 90), (75, 45), (38, 23)]
        assert (pyramid[0].window(f, 0, 0, 150, 90) == image).all()
        half = np.rint(image.reshape(45, 2, 75, 2, 3).mean((1, 3))).astype(np.uint8)
        assert (pyramid[1].window(f, 0, 0, 75, 45) == half).all()

    again = slides.write_pyramids(rows, sizes, str(tmp_path / "one"), side, str(tmp_path / "work")).collect()
    assert [r.n_tiles for r in again] == [15]

    (tmp_path / "bad.tif").write_bytes(b"placeholder")
    listed = spark.createDataFrame([(uid, made.path), ("bad", str(tmp_path / "bad.tif")), ("gone", str(tmp_path / "gone.tif"))], "slide_uid string, path string")
    seen = {r.slide_uid: r for r in slides.surveyed(listed).collect()}
    assert seen[uid].base == 20.0 and seen[uid].mpp_x == 0.5 and (seen[uid].width, seen[uid].height) == (150, 90) and len(seen[uid].downsamples) == 3
    assert not seen["bad"].readable and "ValueError" in seen["bad"].error and "NotFound" in seen["gone"].error and seen["gone"].base is None

    survey = slides.surveyed(listed)
    same = {(r.x0, r.y0): r for r in slides.tiles(survey, 20.0, side).collect()}
    assert len(same) == 15
    for _, x, y, r, g, b in tile_rows(image, side, uid):
        assert (same[x, y].r, same[x, y].g, same[x, y].b) == (r, g, b)
    half_tiles = slides.tiles(survey, 10.0, side).collect()
    assert len(half_tiles) == 6
    first = next(r for r in half_tiles if (r.x0, r.y0) == (0, 0))
    assert (np.array(first.r).reshape(side, side) == half[:side, :side, 0]).all()
    assert slides.tiles(survey, 40.0, side).count() == 0
    (view,) = slides.overviews(survey, 40).collect()
    assert len(view.r) == 1600 and view.r[-1] == 255 and view.error is None


def test_what_cannot_be_decoded_is_a_row_with_its_error(spark, tmp_path):
    image = image_of(37, 23)
    plain_tiff(tmp_path / "a.tif", image)
    data = (tmp_path / "a.tif").read_bytes()
    (tmp_path / "j.tif").write_bytes(data.replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0)))
    survey = slides.surveyed(spark.createDataFrame([("j", str(tmp_path / "j.tif"))], "slide_uid string, path string"))
    rows = slides.read(slides.windows(survey, 20.0, 16)).collect()
    assert len(rows) == 6 and all(r.r is None and "compression 7" in r.error for r in rows)
    assert slides.surveyed(spark.createDataFrame([], "slide_uid string, path string")).count() == 0


def test_study_from_files_through_every_stage(spark, tmp_path):
    from cohortlens.__main__ import main
    from cohortlens.plans.study import Study

    side, rows, sizes = 64, [], []
    rng = np.random.default_rng(3)
    for uid, shift in (("K1_he", 0), ("K1_cd8", 8)):
        image = np.full((192, 256, 3), 245, np.uint8)
        for k, (cx, cy, radius) in enumerate(((60, 60, 40), (170, 120, 50), (70, 150, 25))):
            y, x = np.mgrid[:192, :256]
            image[(x - cx - shift) ** 2 + (y - cy) ** 2 < radius**2] = (150, 90 + 9 * k, 60)
        image = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
        rows += list(tile_rows(image, side, uid))
        sizes.append((uid, 256, 192, 0.5, 20.0))
    made = spark.createDataFrame(rows, "slide_uid string, x0 int, y0 int, r array<int>, g array<int>, b array<int>")
    known = spark.createDataFrame(sizes, "slide_uid string, width int, height int, mpp double, magnification double")
    slides.write_pyramids(made, known, str(tmp_path / "archive"), side, str(tmp_path / "work"), levels=2).collect()
    (tmp_path / "archive" / "K2_cd8.tif").write_bytes(b"broken")

    Study.create(spark, str(tmp_path), "films", [str(tmp_path / "archive")]).index()
    run = lambda *a: main([str(tmp_path), *a], spark)
    assert run("survey", "films") == 0 and run("tiles", "films", "--size", "64", "--overview", "128") == 0
    study = Study(spark, str(tmp_path), "films")
    assert study.tiles().count() == 24 and study.overviews().count() == 2
    study.plan()
    assert [run(c, "films") for c in ("align", "extract", "stain", "count")] == [0, 0, 0, 0]
    (pair,) = study.manifest("alignment").collect()
    assert pair.status == "aligned" and abs(pair.matrix[2] - 4) < 1.5 and abs(pair.matrix[5]) < 1.5
    assert study.manifest("patches").count() == 24 and study.manifest("counts").count() == 12
    crops = {(r.role, r.region): r for r in study.crops({"near": 64}).collect()}
    assert len(crops) == 10 and crops["moving", "center"].output.endswith("near/center/moving.png") and len(crops["moving", "center"].r) == 4096
    assert run("compare", "films", "--zoom", "near=64", "--to", str(tmp_path / "crops")) == 0
    assert run("thumbnails", "films", "--to", str(tmp_path / "thumbs")) == 0 and len(list((tmp_path / "thumbs").glob("*.png"))) == 2
    assert run("regions", "films", "--to", str(tmp_path / "regions"), "--size", "32") == 0
    assert len(list((tmp_path / "regions").glob("*.ome.tif"))) == 6
    for place in study._table("regions").where("slide_uid LIKE '%he%' AND box = 1").collect():
        with tiff.opened(str(tmp_path / "regions" / f"{place.slide_uid}__region_001.ome.tif")) as f:
            level = tiff.levels_of(tiff.directories(f))[0]
            assert (level.width, level.height) == (place.w, place.h)
            with tiff.opened(str(tmp_path / "archive" / "K1_he.ome.tif")) as g:
                whole = tiff.levels_of(tiff.directories(g))[0].window(g, place.x, place.y, place.w, place.h)
            assert (level.window(f, 0, 0, place.w, place.h) == whole).all()
    assert run("regions", "films", "--to", str(tmp_path / "cores"), "--size", "32", "--cores") == 0
    sources = {(r.slide_uid, r.detection_source) for r in study._table("cores").collect()}
    assert ("K1__he__s01", "he_reference") in sources and {s for s, _ in sources} == {"K1__he__s01", "K1__cd8__s01"}
    assert len(list((tmp_path / "cores").glob("*core_*.ome.tif"))) == study._table("cores").count() >= 4
    assert run("doctor") == 0 and run("doctor", "--json") == 0


def test_patches_that_overlap_make_the_slide_again(spark, tmp_path):
    from cohortlens.operators import reassembly

    side, uid = 32, "K1__he__s01"
    image = image_of(128, 96)
    schema = "slide_uid string, x0 int, y0 int, r array<int>, g array<int>, b array<int>"
    sizes = spark.createDataFrame([(uid, 128, 96, 0.5, 20.0)], "slide_uid string, width int, height int, mpp double, magnification double")
    (made,) = slides.write_pyramids(spark.createDataFrame(list(tile_rows(image, side, uid)), schema), sizes, str(tmp_path / "out"), side, str(tmp_path / "work")).collect()
    survey = slides.surveyed(spark.createDataFrame([(uid, made.path)], "slide_uid string, path string"))
    patches = slides.read(slides.windows(survey, 20.0, 32, stride=16, whole=True)).drop("error")
    assert patches.count() == 7 * 5
    got = {(r.x0, r.y0): r for r in reassembly.reassembled(patches, 32, 16, 64).collect()}
    assert len(got) == 4
    for (x, y), r in got.items():
        tile = np.stack([np.array(v).reshape(64, 64) for v in (r.r, r.g, r.b)], 2)
        part = image[y : y + 64, x : x + 64]
        assert (tile[: part.shape[0], : part.shape[1]] == part).all() and (tile[part.shape[0] :] == 0).all()
    apart = reassembly.reassembled(patches.where("x0 = 0 AND y0 = 0"), 32, 32, 64).collect()
    assert len(apart) == 1 and apart[0].r[-1] == 255

    matrix = spark.createDataFrame([(uid, uid, [1.0, 0.0, 5.0, 0.0, 1.0, -3.0])], "reference_uid string, moving_uid string, matrix array<double>")
    shifted = {(r.x0, r.y0): r for r in slides.aligned(survey, survey, matrix, 20.0, side).collect()}
    assert len(shifted) == 12 and all(r.error is None for r in shifted.values())
    tile = np.array(shifted[32, 32].r).reshape(side, side)
    assert (tile == image[29:61, 37:69, 0]).all() and shifted[96, 0].r[31] == 255
    huge = matrix.withColumn("matrix", __import__("pyspark").sql.functions.expr("transform(matrix, x -> x * 50)"))
    assert all("ValueError" in r.error for r in slides.aligned(survey, survey, huge, 20.0, side).collect())


def test_search_boxes_against_a_plain_walk(spark):
    from cohortlens.operators import reassembly

    def walk(width, height, size, region):
        half, mx, my = size // 2, int(width * 0.05), int(height * 0.05)
        ax = {"left": mx + half, "right": width - mx - half, "": width // 2}[region.partition("_")[2]]
        ay = {"top": my + half, "bottom": height - my - half, "center": height // 2}[region.partition("_")[0]]
        inward = {"top_left": (1, 1), "top_right": (-1, 1), "bottom_left": (1, -1), "bottom_right": (-1, -1)}
        turns = [inward[region]] if region in inward else [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1)]
        out = {}
        for tx, ty in turns:
            for dx in range(0, int(width * 0.15) + 1, max(1, int(width * 0.02))):
                for dy in range(0, int(height * 0.15) + 1, max(1, int(height * 0.02))):
                    x1, y1 = min(width, ax + tx * dx - half + size), min(height, ay + ty * dy - half + size)
                    out.setdefault((max(0, x1 - size), max(0, y1 - size), x1, y1), dx * dx + dy * dy)
        return [box for box, _ in sorted(out.items(), key=lambda item: item[1])]

    shapes = {"a": (1000, 700), "b": (333, 90), "c": (50, 60)}
    rows = reassembly.search_boxes(spark.createDataFrame([(k, *v) for k, v in shapes.items()], "slide string, width int, height int"), 64).collect()
    for slide, (w, h) in shapes.items():
        for region in ("center", "top_left", "top_right", "bottom_left", "bottom_right"):
            got = [(r.x0, r.y0, r.x1, r.y1) for r in sorted((r for r in rows if (r.slide, r.region) == (slide, region)), key=lambda r: r.place)]
            assert got == walk(w, h, 64, region), (slide, region)


def test_refinement_enhancement_and_equalisation():
    from cohortlens.functions import shapes

    rng = np.random.default_rng(5)
    base = np.full((120, 120), 240.0)
    base[30:80, 40:90] = 90 + rng.integers(0, 60, (50, 50))
    other = np.roll(base, (4, 7), (0, 1))
    coarse = np.array([[1.0, 0, 2.0], [0, 1.0, 1.0]])
    fine = shapes.refined(coarse, base, other, 2.0)
    assert np.allclose(fine[:, 2], (3.5, 2.0)) and np.allclose(fine[:, :2], np.eye(2))
    assert np.allclose(shapes.refined(fine, base, other, 2.0), fine)
    grey = np.tile(np.arange(100, 140, dtype=np.uint8), (64, 2))
    even = shapes.equalised(grey, 4.0, (2, 2))
    assert even.shape == grey.shape and even.max() - even.min() > grey.max() - grey.min()
    brown = np.full((40, 40, 3), 235, np.uint8)
    brown[10:30, 10:30] = (140, 100, 70)
    out = shapes.enhanced(brown).astype(int)
    inside, before = out[20, 20], np.array((140, 100, 70))
    assert (inside.max() - inside.min()) / inside.max() > (before.max() - before.min()) / before.max()
    assert out[0, 0].max() - out[0, 0].min() == 0


def test_magnification_from_a_manifest_beside_the_file(spark, tmp_path):
    image = image_of(37, 23)
    for folder, names in {"a": {"s_manifest.json": '{"output_magnification": 10}'}, "b": {"s_manifest.json": "[]", "s.ome_manifest.json": '{"output_magnification": "5"}'}, "c": {"s_manifest.json": "no", "manifest.json": '{"output_magnification": 40}'}, "d": {"manifest.json": '{"output_magnification": -1}'}}.items():
        (tmp_path / folder).mkdir()
        plain_tiff(tmp_path / folder / "s.ome.tif", image, text=b"nothing known\0")
        for name, text in names.items():
            (tmp_path / folder / name).write_text(text)
    (tmp_path / "e").mkdir()
    plain_tiff(tmp_path / "e" / "s.ome.tif", image)
    (tmp_path / "e" / "manifest.json").write_text('{"output_magnification": 40}')
    rows = spark.createDataFrame([(k, str(tmp_path / k / "s.ome.tif")) for k in "abcde"], "slide_uid string, path string")
    assert {r.slide_uid: r.base for r in slides.surveyed(rows).collect()} == {"a": 10.0, "b": 5.0, "c": 40.0, "d": None, "e": 20.0}
    assert {r.base for r in slides.surveyed(rows.withColumn("source_magnification", __import__("pyspark").sql.functions.lit(2.5))).collect()} == {2.5}


def test_found_tissue_makes_no_boxes_that_leave_their_task(spark, tmp_path):
    import duckdb

    from cohortlens.plans import catalog

    rng = np.random.default_rng(11)
    prices = [*rng.uniform(450, 2500, 300).round(2).tolist(), *rng.uniform(0, 120, 60).round(2).tolist(), -1.0, -2.5, -400.0, 0.0, None]
    rows = [(k, v, int(rng.integers(1, 51))) for k, v in enumerate(prices)] + [(400, 1000.0, None), (None, 900.5, 7)]
    keys = "p_partkey long, p_retailprice double, p_size int"
    spark.createDataFrame(rows, keys).write.parquet(str(tmp_path / "one/part.parquet"))
    # Slides that come twice, with the same size or with another, near or far from the first.
    again = [*rows[:40], *((k, v + 1, s) for k, v, s in rows[40:60]), *((k, v * 1.01, s + 9) for k, v, s in rows[60:90]), *((k, v / 3, 50) for k, v, s in rows[90:110]), *((k, v + 3.5, s) for k, v, s in rows[80:100]), (None, 907.0, 7)]
    spark.createDataFrame(rows + again, keys).write.parquet(str(tmp_path / "two/part.parquet"))

    def shuffled():
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    for name in ("one", "two"):
        before = shuffled()
        got = [tuple(r) for r in catalog.QUERIES["nearest_tissue"](spark, str(tmp_path / name)).collect()]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        if name == "one":
            assert shuffled() - before <= 2 * len(rows)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/{name}/part.parquet/*.parquet'")
        want = con.execute(catalog.ORACLE_SQL["nearest_tissue"]).fetchall()
        # Boxes of two sizes of one slide can be as near and met alike; then the SQL takes any of them.
        head, _, tail = catalog.ORACLE_SQL["nearest_tissue"].rpartition("row_number()")
        equal = con.execute(f"{head}rank(){tail}").fetchall()
        assert len(got) == len(want) > 1500 and {r[:2] for r in got} == {r[:2] for r in want} and set(got) <= set(equal), name
        assert len(set(got) - set(want)) <= (0 if name == "one" else len(equal) - len(want)), name


def test_found_tissue_is_nearest_of_search_boxes(spark):
    from pyspark.sql import functions as F

    from cohortlens.operators import reassembly

    shapes = [("a", 1000, 700), ("b", 333, 90), ("c", 50, 60), ("d", 5, 3000), ("e", 640, 640), ("e", 650, 640), ("e", 650, 640), ("f", 64, 64), ("g", 40000, 30011)]
    table = spark.createDataFrame(shapes, "slide string, width int, height int")
    share = lambda x0, y0, x1, y1: np.where((x0 + y0) % 5 == 0, np.nan, (x0 * 7 + y0 * 13 + x1) % 19 / 20.0)
    column = F.when((F.col("x0") + F.col("y0")) % 5 != 0, (F.col("x0") * 7 + F.col("y0") * 13 + F.col("x1")) % 19 / F.lit(20.0))
    for size, radius, step, threshold in ((64, 0.15, 0.02, 0.9), (64, 0.15, 0.02, 0.2), (901, 0.4, 0.07, 2.0), (10, 0.0, 0.0, 0.5)):
        boxes = reassembly.search_boxes(table, size, 0.05, radius, step).withColumn("fraction", column)
        want = {tuple(r) for r in reassembly.nearest_tissue(boxes, threshold).collect()}
        got = [tuple(r) for r in reassembly.found_tissue(table, size, share, threshold, 0.05, radius, step).collect()]
        assert len(got) == len(want) == 5 * 7 and set(got) == want, (size, threshold)
    none = reassembly.found_tissue(table, 64, lambda x0, *_: np.nan).collect()
    assert len(none) == 35 and all(r.fraction is None and r.found is False for r in none)
