"""Slides as a source and a sink: a survey of headers, tiles at any magnification, overviews, and pyramids written from tiles.

Files are opened where their rows are; no file is read whole.  A slide that can't be opened or decoded is a row with its error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import optics
from cohortlens.functions.naming import SLIDE_ENDINGS
from cohortlens.sources import tiff

#: Properties that name an objective, the first positive one counts.
OBJECTIVE_KEYS = ("openslide.objective-power", "aperio.AppMag", "hamamatsu.SourceLens", "objective-power", "objective_power")

#: The property that a manifest beside the file gives; it counts after objectives, before the pixel size.
SIDECAR = "manifest.output_magnification"

HEADER = "width int, height int, downsamples array<double>, properties map<string,string>, readable boolean, error string"


def surveyed(slides: DataFrame, default: float | None = None) -> DataFrame:
    """slides (slide_uid, path, ...) with size, downsamples, properties, base magnification, its origin, mpp, readable and error.

    A declared source_magnification comes before what the file says, default after it.
    """
    extra = [F.col("source_magnification")] if "source_magnification" in slides.columns else [F.lit(None).cast("double")]
    rows = slides.select("slide_uid", "path", extra[0].cast("double").alias("declared"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_header(*row) for row in frame.itertuples(index=False, name=None)], columns=["slide_uid", "path", "declared", "width", "height", "downsamples", "properties", "readable", "error"])

    seen = rows.mapInPandas(run, "slide_uid string, path string, declared double, " + HEADER)
    own = lambda k: F.get_json_object(F.to_json("properties"), f"$['{k}']")
    mpp = [own("openslide.mpp-x"), own("openslide.mpp-y")]
    base, origin = optics.magnification(F.col("declared"), [own(k) for k in (*OBJECTIVE_KEYS, SIDECAR)], mpp, F.lit(default).cast("double"))
    size = lambda c: F.coalesce(optics.positive(c), F.lit(0.0))
    return seen.select("slide_uid", "path", "width", "height", "downsamples", "properties", F.when(F.col("readable"), base).alias("base"), F.when(F.col("readable"), origin).alias("origin"), size(mpp[0]).alias("mpp_x"), size(mpp[1]).alias("mpp_y"), "readable", "error")


def _beside(path: str) -> str | None:
    """The positive output_magnification of the first manifest beside a file that has one: of its name without any ending, without the last one, of its folder."""
    system, name = tiff.located(path)
    folder, _, file = name.rpartition("/")
    ending = next((e for e in SLIDE_ENDINGS if file.lower().endswith(e)), "")
    stems = dict.fromkeys((file.removesuffix(file[len(file) - len(ending) :]) if ending else file, file.rpartition(".")[0] or file))
    for each in (*(f"{stem}_manifest.json" for stem in stems), "manifest.json"):
        try:
            with system.open_input_file(f"{folder}/{each}") as f:
                value = float(json.loads(f.read()).get("output_magnification"))
            if 0 < value < float("inf"):
                return repr(value)
        except (OSError, ValueError, TypeError, AttributeError):
            continue  # a manifest that isn't there, or says nothing of it
    return None


def _header(uid: str, path: str, declared: float | None) -> tuple:
    try:
        with tiff.opened(path) as f:
            tags = tiff.directories(f)
            pyramid = tiff.levels_of(tags)
            first, facts = pyramid[0], tiff.properties_of(tags[0])
            if not any(k in facts for k in OBJECTIVE_KEYS) and (found := _beside(path)):
                facts[SIDECAR] = found
            return uid, path, declared, first.width, first.height, [(first.width / x.width + first.height / x.height) / 2 for x in pyramid], facts, True, None
    except Exception as e:  # any failure is the row's, not the job's
        return uid, path, declared, None, None, None, None, False, f"{type(e).__name__}: {e}"


def windows(survey: DataFrame, target: float, size: int, band: int = 8, stride: int | None = None, whole: bool = False) -> DataFrame:
    """A row per tile of a slide's grid at the target magnification, with where to read it; slides that would be enlarged have none.

    Tiles overlap where stride is less than their size; whole leaves out those that reach over the slide's edge.  A survey row with left and top
    is a region of a slide: its width and height count from there.

    Bands of tile rows are dealt to tasks, so that one slide keeps many tasks busy and a task opens few files.
    """
    base = F.col("base")
    rows = survey.where("readable AND base IS NOT NULL").withColumn("level", optics.level_for(base, target, F.col("downsamples"))).where("level IS NOT NULL")
    rows = rows.withColumns({"out_width": optics.output_length(F.col("width"), base, target), "out_height": optics.output_length(F.col("height"), base, target), "native": base / F.get("downsamples", F.col("level"))})
    step, edge = F.lit(stride or size), size if whole else 1
    rows = rows.where((F.col("out_width") >= edge) & (F.col("out_height") >= edge))
    rows = rows.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("out_height") - edge, step))).repartition("slide_uid", F.floor(F.col("y0") / (size * band)))
    rows = rows.withColumn("x0", F.explode(F.sequence(F.lit(0), F.col("out_width") - edge, step)))
    start = {"x": F.col("left"), "y": F.col("top")} if {"left", "top"} <= set(survey.columns) else {"x": F.lit(0), "y": F.lit(0)}
    place = {f"{c}_full": (optics.to_level0(F.col(f"{c}0"), base, target) + start[c]).cast("int") for c in "xy"}
    return rows.select("slide_uid", "path", "x0", "y0", "level", F.get("downsamples", F.col("level")).alias("downsample"), *(v.alias(k) for k, v in place.items()), optics.read_length(F.lit(size), F.col("native"), target).alias("read"), F.lit(size).alias("side"))


TILES = pa.schema([("slide_uid", pa.string()), ("x0", pa.int32()), ("y0", pa.int32()), *((c, pa.list_(pa.int32())) for c in "rgb"), ("error", pa.string())])


def read(rows: DataFrame, at_once: int = 1 << 22) -> DataFrame:
    """The tiles that windows() names: slide_uid, x0, y0, r, g, b as flat arrays; white outside the slide, error where one can't be decoded.

    A batch holds at most at_once pixels, or one tile.
    """
    schema = "slide_uid string, x0 int, y0 int, r array<int>, g array<int>, b array<int>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, path, pyramid, held, pixels = None, None, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["path"] != path:
                        if f is not None:
                            f.close()
                        f, path = tiff.opened(row["path"]), None
                        pyramid, path = tiff.levels_of(tiff.directories(f)), row["path"]
                    side, d = row["side"], row["downsample"]
                    image = pyramid[row["level"]].shrunk(f, round(row["x_full"] / d), round(row["y_full"] / d), row["read"], side)
                    flat = image.reshape(-1, 3).astype(np.int32)
                    held.append((row["slide_uid"], row["x0"], row["y0"], *(flat[:, k] for k in range(3)), None))
                except Exception as e:  # any failure is the row's, not the job's
                    held.append((row["slide_uid"], row["x0"], row["y0"], None, None, None, f"{type(e).__name__}: {e}"))
                pixels += row["side"] ** 2
                if pixels >= at_once:
                    yield _batch(held)
                    held, pixels = [], 0
        if f is not None:
            f.close()
        if held:
            yield _batch(held)

    return rows.mapInArrow(run, schema)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*held, strict=True), TILES, strict=True)], schema=TILES)


def tiles(survey: DataFrame, target: float, size: int) -> DataFrame:
    """Decoded tiles of all readable slides at the target magnification; size is their side there."""
    return read(windows(survey, target, size)).where("error IS NULL").drop("error")


def overviews(survey: DataFrame, longest: int) -> DataFrame:
    """One white-padded square per slide, its longer side being `longest` pixels, from the smallest level that is large enough."""
    full = F.greatest("width", "height")
    fit = F.filter(F.transform("downsamples", lambda d, k: F.struct(d.alias("d"), k.cast("int").alias("level"))), lambda x: full / x["d"] >= longest)
    best = F.coalesce(F.array_max(fit), F.struct(F.lit(1.0).alias("d"), F.lit(0).alias("level")))
    rows = survey.where("readable").withColumn("best", best)
    return read(rows.select("slide_uid", "path", F.lit(0).alias("x0"), F.lit(0).alias("y0"), "best.level", F.col("best.d").alias("downsample"), F.lit(0).alias("x_full"), F.lit(0).alias("y_full"), F.ceil(full / F.col("best.d")).cast("int").alias("read"), F.lit(longest).alias("side")).repartition("slide_uid"))


def aligned(reference: DataFrame, moving: DataFrame, matrices: DataFrame, target: float, size: int) -> DataFrame:
    """
    Tiles of moving slides on the grid of their references at the target magnification: slide_uid (the moving one's), x0, y0, r, g, b, error.

    reference and moving are surveys, matrices is (reference_uid, moving_uid, matrix): six numbers that take a place on the reference's grid to
    one on the moving slide's.  Only what a tile shows is read, and sampled between its four nearest pixels; white outside the slide.
    """
    base = F.col("base")
    mov = moving.where("readable AND base IS NOT NULL").withColumn("level", optics.level_for(base, target, F.col("downsamples"))).where("level IS NOT NULL")
    mov = mov.select(F.col("slide_uid").alias("moving_uid"), F.col("path").alias("moving_path"), F.col("level").alias("moving_level"), (base / F.get("downsamples", F.col("level")) / target).alias("zoom"))
    grid = windows(reference, target, size).select(F.col("slide_uid").alias("reference_uid"), "x0", "y0")
    rows = grid.join(matrices.join(mov, "moving_uid"), "reference_uid")
    rows = rows.repartition("moving_uid", F.floor(F.col("y0") / (8 * size))).select("moving_uid", "moving_path", "moving_level", "zoom", "matrix", "x0", "y0")
    schema = "slide_uid string, x0 int, y0 int, r array<int>, g array<int>, b array<int>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, path, pyramid = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["moving_path"] != path:
                        if f is not None:
                            f.close()
                        f, path = tiff.opened(row["moving_path"]), None
                        pyramid, path = tiff.levels_of(tiff.directories(f)), row["moving_path"]
                    pixels = _warped(f, pyramid[row["moving_level"]], np.array(row["matrix"], float).reshape(2, 3) * row["zoom"], row["x0"], row["y0"], size)
                    flat = pixels.reshape(-1, 3).astype(np.int32)
                    yield _batch([(row["moving_uid"], row["x0"], row["y0"], *(flat[:, k] for k in range(3)), None)])
                except Exception as e:  # any failure is the row's, not the job's
                    yield _batch([(row["moving_uid"], row["x0"], row["y0"], None, None, None, f"{type(e).__name__}: {e}")])
        if f is not None:
            f.close()

    return rows.mapInArrow(run, schema)


def _warped(f, level: tiff.Level, matrix: np.ndarray, x0: int, y0: int, side: int) -> np.ndarray:
    y, x = np.mgrid[y0 : y0 + side, x0 : x0 + side]
    tx, ty = (row[0] * x + row[1] * y + row[2] for row in matrix)
    left, top = int(np.floor(tx.min())), int(np.floor(ty.min()))
    w, h = int(np.floor(tx.max())) - left + 2, int(np.floor(ty.max())) - top + 2
    if w * h > 64 * side * side:
        raise ValueError(f"a tile would show {w} x {h} pixels")
    part = level.window(f, left, top, w, h).astype(float)
    ix, iy = np.floor(tx).astype(int) - left, np.floor(ty).astype(int) - top
    ax, ay = (tx - left - ix)[..., None], (ty - top - iy)[..., None]
    upper, lower = (part[iy + k, ix] * (1 - ax) + part[iy + k, ix + 1] * ax for k in (0, 1))
    return np.rint(upper * (1 - ay) + lower * ay).astype(np.uint8)


def _coded(rows: DataFrame, side: int) -> DataFrame:
    """Tiles (slide_uid, level, x, y, pixels as bytes) with the bytes that a file holds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(data=[tiff.encoded(np.frombuffer(v, np.uint8).reshape(side, side, 3)) for v in frame["pixels"]]).drop(columns="pixels")

    return rows.mapInPandas(run, "slide_uid string, level int, x int, y int, data binary")


def _as_bytes(rows: DataFrame, side: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pixels = [np.stack([np.asarray(c, np.uint8) for c in v], 1).tobytes() for v in zip(frame["r"], frame["g"], frame["b"], strict=True)]
            yield pd.DataFrame({"slide_uid": frame["slide_uid"], "level": np.int32(0), "x": frame["x0"] // side, "y": frame["y0"] // side, "pixels": pixels})

    return rows.select("slide_uid", "x0", "y0", "r", "g", "b").mapInPandas(run, "slide_uid string, level int, x int, y int, pixels binary")


def _halved(rows: DataFrame, side: int) -> DataFrame:
    """The next level: four tiles at most become one, of means of 2 x 2 pixels; what is missing is white."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        whole = np.full((2 * side, 2 * side, 3), 255, np.uint8)
        for x, y, v in zip(frame["x"], frame["y"], frame["pixels"], strict=True):
            whole[y % 2 * side :, x % 2 * side :][:side, :side] = np.frombuffer(v, np.uint8).reshape(side, side, 3)
        half = np.rint(whole.reshape(side, 2, side, 2, 3).mean((1, 3))).astype(np.uint8)
        return pd.DataFrame({"slide_uid": [key[0]], "level": [frame["level"].iloc[0] + 1], "x": [key[1]], "y": [key[2]], "pixels": [half.tobytes()]})

    keys = ["slide_uid", F.floor(F.col("x") / 2).cast("int").alias("px"), F.floor(F.col("y") / 2).cast("int").alias("py")]
    return rows.groupBy(*keys).applyInPandas(run, "slide_uid string, level int, x int, y int, pixels binary")


def write_pyramids(tile_rows: DataFrame, sizes: DataFrame, folder: str, side: int, work: str, levels: int = 1) -> DataFrame:
    """Write each slide's tiles as folder/slide_uid.ome.tif, a tiled pyramid of `levels`; gives slide_uid, path, n_tiles, bytes.

    tile_rows are square tiles of a side (a multiple of 16) at multiples of it, sizes is (slide_uid, width, height, mpp, magnification),
    the last two may be null.  Missing tiles are white.  Levels are made tile by tile and kept, compressed, below work;
    a writer streams one slide's tiles in order, and a file appears under its name when it is whole, so a task may be run again.
    """
    spark = tile_rows.sparkSession
    now = _as_bytes(tile_rows, side)
    for k in range(levels):
        now.write.mode("overwrite").parquet(f"{work}/pixels_{k}")
        now = spark.read.parquet(f"{work}/pixels_{k}")
        _coded(now, side).write.mode("overwrite").parquet(f"{work}/coded/level_{k}")
        now = _halved(now, side)
    coded = spark.read.parquet(*(f"{work}/coded/level_{k}" for k in range(levels)))
    total = coded.groupBy("slide_uid").agg(F.sum(F.length("data")).cast("long").alias("total"))
    facts = sizes.select("slide_uid", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("mpp").cast("double").alias("mpp"), F.col("magnification").cast("double").alias("magnification"))
    rows = coded.join(facts.join(total, "slide_uid"), "slide_uid").repartition("slide_uid").sortWithinPartitions("slide_uid", "level", "y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None or writer.uid != row["slide_uid"]:
                    if writer is not None:
                        done.append(writer.close())
                    writer = _Writer(folder, side, levels, row)
                writer.put(row)
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("slide_uid", pa.string()), ("path", pa.string()), ("n_tiles", pa.int64()), ("bytes", pa.int64())]))

    return rows.mapInArrow(run, "slide_uid string, path string, n_tiles long, bytes long")


class _Writer:
    """One slide's file: tiles as they come, then the directories at the place that the head has named."""

    def __init__(self, folder: str, side: int, levels: int, row: dict):
        import uuid

        self.uid, self.side, self.row, self.n = row["slide_uid"], side, row, 0
        self.system, self.path = tiff.located(f"{folder.rstrip('/')}/{self.uid}.ome.tif")
        self.partial = f"{self.path}.{uuid.uuid4().hex}.partial"
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.at = self.system.open_output_stream(self.partial), 16
        self.out.write(tiff.head(row["total"]))
        self.levels = []
        for k in range(levels):
            w, h = (max(1, -(-row[c] // 2**k)) for c in ("width", "height"))
            self.levels.append((w, h, [(0, 0)] * (-(-w // side) * -(-h // side))))

    def put(self, row: dict) -> None:
        w, h, places = self.levels[row["level"]]
        across = -(-w // self.side)
        if row["x"] < across and row["y"] * across + row["x"] < len(places):
            places[row["y"] * across + row["x"]] = (self.at, len(row["data"]))
        self.out.write(row["data"])
        self.at += len(row["data"])
        self.n += 1

    def close(self) -> dict:
        mpp = None if self.row["mpp"] is None else (self.row["mpp"], self.row["mpp"])
        w, h, _ = self.levels[0]
        end = tiff.tail(self.at, self.levels, self.side, tiff.ome_xml(w, h, self.uid, mpp, self.row["magnification"]))
        self.out.write(end)
        self.out.close()
        self.system.move(self.partial, self.path)
        return {"slide_uid": self.uid, "path": self.path, "n_tiles": self.n, "bytes": self.at + len(end)}
