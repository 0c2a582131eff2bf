"""Image algorithms on tiles, a tile's pixels gathered as arrays; each tile is bounded by its size, not by the table's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import shapes


def gathered(px: DataFrame, by: str = "tile") -> DataFrame:
    """Pixels (by, i, r, g, b) as one row of three arrays per tile, in the order of i."""
    lists = px.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b"))).alias("v"))
    return lists.select(by, *(F.col(f"v.{c}").alias(c) for c in "rgb"))


def each(tiles: DataFrame, of: Callable[[np.ndarray], list[tuple]], schema: str, side: int) -> DataFrame:
    """Rows (tile, *of(image)) for tiles of a width of side."""
    names = ["tile", *(c.split()[0] for c in schema.split(","))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tile, *channels in frame[["tile", "r", "g", "b"]].itertuples(index=False, name=None):
                image = np.stack([np.asarray(c).reshape(-1, side) for c in channels], axis=2)
                out += [(tile, *row) for row in of(image)]
            yield pd.DataFrame(out, columns=names)

    return tiles.mapInPandas(run, f"tile {tiles.schema['tile'].dataType.simpleString()}, {schema}")


def components(px: DataFrame, threshold: int, side: int = 8) -> DataFrame:
    """Per tile the number of dark regions (joined along sides) and the largest one's pixels."""

    def of(image: np.ndarray) -> list[tuple]:
        own, n = shapes.labels(image[..., 0] < threshold, diagonal=False)
        return [(n, int(np.bincount(own.ravel(), minlength=2)[1:].max()))]

    return each(gathered(px), of, "regions int, largest int", side)


def phase_shift(px: DataFrame, side: int = 8) -> DataFrame:
    """Per tile the shift between its first two channels by phase correlation."""
    return each(gathered(px), lambda v: [tuple(map(int, shapes.phase_shift(v[..., 0].astype(float), v[..., 1].astype(float))))], "dx int, dy int", side)


def contours(px: DataFrame, threshold: int, most: int = 8, share: float = 0.001, side: int = 8) -> DataFrame:
    """The largest dark regions' outlines per tile: rank, area, box, centre, solidity, circularity."""

    def of(image: np.ndarray) -> list[tuple]:
        found = shapes.outlines(image[..., 0] < threshold, most, share)
        return [(k, o.area, *o.box, *o.centre, o.area / (o.hull_area + 1e-6), o.circularity) for k, o in enumerate(found, 1)]

    return each(gathered(px), of, "place int, area double, x int, y int, w int, h int, cx double, cy double, solidity double, circularity double", side)


def matches(px: DataFrame, threshold: int, side: int = 8) -> DataFrame:
    """Per tile the matched outlines of its first two channels, with their cost."""

    def of(image: np.ndarray) -> list[tuple]:
        a, b = (shapes.outlines(image[..., k] < threshold, 8, 0.001) for k in (0, 1))
        return shapes.matched(a, b, image.shape[:2], image.shape[:2])

    return each(gathered(px), of, "reference_place int, moving_place int, cost double", side)


def cell_counts(px: DataFrame, least: int = 50, most: int | None = None, side: int = 8) -> DataFrame:
    """Positive cells per tile and the threshold that was used; the gate is the brown one of `optics`."""
    from cohortlens.functions.optics import is_brown

    gated = px.select("tile", "i", F.greatest("r", "g", "b").alias("r"), is_brown(F.col("r"), F.col("g"), F.col("b")).cast("int").alias("g"), F.lit(0).alias("b"))
    return each(gathered(gated), lambda v: [shapes.cells(v[..., 0], v[..., 1] > 0, least, most)], "cells int, threshold double", side)


def detected(tiles: DataFrame, share: float, side: int, round_only: bool = False, roundness: float = 0.0) -> DataFrame:
    """Relative boxes of the regions of overviews (tile, r, g, b arrays)."""
    return each(tiles, lambda v: shapes.regions(v, share, round_only, roundness), "rx double, ry double, rw double, rh double", side)


def registered(pairs: DataFrame, side: int, least_ncc: float = 0.0, refine: bool = False) -> DataFrame:
    """
    Alignment of overviews (pair, ref and moving: flat RGB arrays of a width of side).

    A pair that can't be aligned is a row with an error and nulls, never a failed job; below least_ncc it is rejected. refine corrects the
    shift that the outlines leave, where that raises the correlation.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for pair, ref, moving in frame[["pair", "ref", "moving"]].itertuples(index=False, name=None):
                try:
                    got = shapes.registered(*(np.asarray(v, np.uint8).reshape(-1, side, 3) for v in (ref, moving)), refine=refine)
                    out.append((pair, "aligned" if got["ncc"] >= least_ncc else "rejected", got["matrix"].ravel().tolist(), got["pairs"], got["ncc"], None))
                except (ValueError, TypeError) as e:
                    out.append((pair, "failed", None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["pair", "status", "matrix", "n_matched", "ncc", "error"])

    return pairs.mapInPandas(run, "pair string, status string, matrix array<double>, n_matched int, ncc double, error string")
