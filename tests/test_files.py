import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest

from cohortlens.functions import figures
from cohortlens.sources import files, png


def filtered(image, kind):
    """Lines under one of the format's five filters, written the plain way."""
    h, w, n = image.shape
    v, out = image.reshape(h, w * n).astype(int), []
    for y in range(h):
        line = [kind]
        for k in range(w * n):
            left = v[y, k - n] if k >= n else 0
            up = v[y - 1, k] if y else 0
            corner = v[y - 1, k - n] if y and k >= n else 0
            near = min((abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner))[2]
            line.append(int(v[y, k] - (0, left, up, (left + up) // 2, near)[kind]) % 256)
        out.append(bytes(line))
    return b"".join(out)


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize(("samples", "colours"), [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_png_of_every_filter(kind, samples, colours):
    image = np.random.default_rng(kind).integers(0, 256, (7, 5, samples)).astype(np.uint8)
    head = png._chunk(b"IHDR", __import__("struct").pack(">IIBBBBB", 5, 7, 8, colours, 0, 0, 0))
    got = png.decoded(png.MAGIC + head + png._chunk(b"IDAT", zlib.compress(filtered(image, kind))) + png._chunk(b"IEND", b"")).astype(float)
    rgb = image[..., :1].repeat(3, 2) if samples < 3 else image[..., :3]
    share = image[..., -1:] / 255 if samples in (2, 4) else 1.0
    assert np.abs(got - (rgb * share + 255 * (1 - share))).max() <= 0.5


def test_images_are_written_once_and_read_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    flat = {n: rng.integers(0, 256, (3, 36)).tolist() for n in ("a/x.png", "b.png")}
    rows = spark.createDataFrame([(n, *v) for n, v in flat.items()] + [("bad.png", [1, 2], [1], [1])], "output string, r array<int>, g array<int>, b array<int>")
    status = lambda df: {r.output: r.status for r in df.collect()}
    assert status(files.write_images(rows, str(tmp_path))) == {"a/x.png": "written", "b.png": "written", "bad.png": "failed"}
    assert status(files.write_images(rows, str(tmp_path)))["b.png"] == "exists"
    (tmp_path / "no.png").write_bytes(b"text")
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in (*flat, "no.png", "gone.tif")], "path string")
    got = {r.path.removeprefix(str(tmp_path) + "/"): r for r in files.read_images(paths).collect()}
    assert all([got[n].r, got[n].g, got[n].b] == v and got[n].width == 6 for n, v in flat.items())
    assert "ValueError" in got["no.png"].error and got["gone.tif"].r is None
    assert not list(tmp_path.rglob("*.partial"))


@pytest.mark.parametrize("copy", [False, True])
def test_staging(spark, tmp_path, copy):
    (tmp_path / "one.svs").write_bytes(b"1")
    rows = spark.createDataFrame([("he/one.svs", f"file:{tmp_path}/one.svs"), ("he/two.svs", str(tmp_path / "two.svs"))], "name string, path string")
    status = lambda: {r.name: r.status for r in files.stage(rows, str(tmp_path / "out"), copy).collect()}
    assert status() == {"he/one.svs": "copied" if copy else "linked", "he/two.svs": "failed"}
    assert status()["he/one.svs"] == "exists"
    made = tmp_path / "out" / "he" / "one.svs"
    assert made.is_symlink() != copy and made.read_bytes() == b"1"


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([("a <&> b", 1.5, 2, True, None), ("\x01x", float("nan"), -3, False, "end")], "name string, v double, n int, ok boolean, last string")
    path = str(tmp_path / "out.xlsx")
    assert files.write_workbook({"per case": rows, "none/at all": rows.limit(0)}, path) == {"per case": 2, "none/at all": 0}
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        cells = {c.get("r"): "".join(c.itertext()) for c in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iterfind(".//m:c", ns)}
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)]
    assert cells == {"A1": "name", "B1": "v", "C1": "n", "D1": "ok", "E1": "last", "A2": "a <&> b", "B2": "1.5", "C2": "2", "D2": "1", "A3": "x", "C3": "-3", "D3": "0", "E3": "end"}
    assert sheets == ["per case", "none_at all"] and files._column(28) == "AB"
    with pytest.raises(ValueError, match="more rows"):
        files.write_workbook({"t": rows}, path, most=1)


def test_figures():
    a, b = np.zeros((10, 6, 3), np.uint8), np.full((4, 5, 3), 9, np.uint8)
    row = figures.side_by_side([a, b], 2)
    assert row.shape == (10, 13, 3) and (row[:, 6:8] == 255).all() and (row[:4, 8:] == 9).all() and (row[4:, 8:] == 255).all()
    bar = figures.with_scale_bar(np.zeros((200, 300, 3), np.uint8), 50, 0.5)
    lit = np.flatnonzero(bar.any((0, 2)))
    assert (lit.min(), lit.max() - lit.min() + 1) == (15, 100)
    long = figures.with_scale_bar(np.zeros((200, 300, 3), np.uint8), 5000, 0.5, "top_right")
    assert long.any((0, 2)).sum() == 120 and long[:100].any()
    assert figures.with_scale_bar(np.zeros((8, 12, 3), np.uint8), 50, 0.5).any()
    grid = figures.with_grid(np.zeros((40, 40, 3), np.uint8), 4, {0, 5})
    assert grid[0, 0].any() and grid[10, 10].any() and not grid[25:, 25:].any() and not grid[3, 3].any()
