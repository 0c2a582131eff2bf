"""Stain statistics and normalisation of pixel tables (tile, i, r, g, b); only eigenvectors and dictionaries run in Python, a row or tile at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.optics import lab, rgb
from cohortlens.operators.images import gathered

RGB = ("r", "g", "b")


def brightness(px: DataFrame) -> DataFrame:
    """Per tile the 90th percentile of all its channels' values."""
    return px.select("tile", F.explode(F.array(*RGB)).alias("v")).groupBy("tile").agg(F.percentile("v", F.lit(0.9)).alias("p90"))


def standardized(px: DataFrame) -> DataFrame:
    """Pixels scaled so that the 90th percentile becomes 255, truncated; tiles of a percentile of 0 stay."""
    scaled = lambda c: F.when(F.col("p90") > 0, F.least(F.lit(255.0), F.col(c) * 255.0 / F.col("p90"))).otherwise(F.col(c)).cast("int")
    return px.join(brightness(px), "tile").select("tile", "i", *(scaled(c).alias(c) for c in RGB))


def _lab(px: DataFrame) -> DataFrame:
    parts = lab(*(F.col(c) for c in RGB))
    return standardized(px).select("tile", "i", *(v.alias(n) for v, n in zip(parts, ("l", "a", "bb"), strict=True)))


def _stats() -> list[Column]:
    return [f(c).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in ("l", "a", "bb")]


def reinhard_fit(px: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation of L, a and b, over all pixels or by keys."""
    return _lab(px).groupBy(*by).agg(*_stats())


def reinhard(px: DataFrame, target: dict[str, float]) -> DataFrame:
    """Pixels whose tile's statistics become target's; a channel without spread takes target's mean."""
    rows = _lab(px)
    rows = rows.join(rows.groupBy("tile").agg(*_stats()), "tile")
    moved = [F.coalesce((F.col(c) - F.col(f"mean_{c}")) * target[f"std_{c}"] / F.nullif(F.col(f"std_{c}"), F.lit(0.0)), F.lit(0.0)) + target[f"mean_{c}"] for c in ("l", "a", "bb")]
    return rows.select("tile", "i", *(v.alias(c) for v, c in zip(rgb(*moved), RGB, strict=True)))


def _density(c: str) -> Column:
    return F.greatest(-F.ln(F.greatest(F.col(c), F.lit(1)) / 255.0), F.lit(1e-6))


def _dot(names: list[Column], weights: list[Column]) -> Column:
    return names[0] * weights[0] + names[1] * weights[1] + names[2] * weights[2]


def _plane(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for tile, *c in frame.itertuples(index=False, name=None):
            _, v = np.linalg.eigh(np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]], float))
            v = v[:, [2, 1]] * np.where(v[0, [2, 1]] < 0, -1, 1)
            out.append((tile, v[:, 0].tolist(), v[:, 1].tolist()))
        yield pd.DataFrame(out, columns=["tile", "p", "q"])


def macenko_fit(px: DataFrame, light: float = 0.8, percent: float = 1.0) -> DataFrame:
    """
    Per tile the stain vectors h and e and the 99th percentiles of their concentrations (Macenko and others, 2009).

    The plane comes from covariances that Spark sums, the extreme angles in it from exact percentiles of tissue
    pixels. Tiles with fewer than two tissue pixels give no row.
    """
    od = standardized(px).select("tile", (lab(*(F.col(c) for c in RGB))[0] / 100.0).alias("light"), *(_density(c).alias(c) for c in RGB))
    dark = od.where(F.col("light") < light)
    pairs = [(x, y) for k, x in enumerate(RGB) for y in RGB[k:]]
    cov = dark.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *(F.covar_samp(x, y).alias(x + y) for x, y in pairs)).where("n > 1").drop("n")
    plane = cov.mapInPandas(_plane, "tile long, p array<double>, q array<double>")
    col = [F.col(c) for c in RGB]
    along = lambda v: _dot(col, [F.col(v)[k] for k in range(3)])
    angles = dark.join(plane, "tile").groupBy("tile").agg(F.first("p").alias("p"), F.first("q").alias("q"), F.percentile(F.atan2(along("q"), along("p")), F.array(F.lit(percent / 100), F.lit(1 - percent / 100))).alias("phi"))
    vector = lambda k: F.transform(F.arrays_zip("p", "q"), lambda z: z["p"] * F.cos(F.col("phi")[k]) + z["q"] * F.sin(F.col("phi")[k]))
    both = angles.select("tile", vector(0).alias("u"), vector(1).alias("v"))
    unit = lambda a: F.transform(a, lambda x: x / F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, y: s + y * y)))
    first = F.col("u")[0] > F.col("v")[0]
    stains = both.select("tile", unit(F.when(first, F.col("u")).otherwise(F.col("v"))).alias("h"), unit(F.when(first, F.col("v")).otherwise(F.col("u"))).alias("e"))
    c = _concentrations(col, "h", "e")
    top = od.join(stains, "tile").groupBy("tile").agg(F.percentile(c[0], F.lit(0.99)).alias("max_h"), F.percentile(c[1], F.lit(0.99)).alias("max_e"))
    return stains.join(top, "tile")


def _concentrations(od: list[Column], h: str, e: str) -> tuple[Column, Column]:
    """Least squares of a pixel's densities on two stain vectors; null where they are one."""
    hv, ev = ([F.col(n)[k] for k in range(3)] for n in (h, e))
    hh, he, ee, dh, de = _dot(hv, hv), _dot(hv, ev), _dot(ev, ev), _dot(od, hv), _dot(od, ev)
    det = F.nullif(hh * ee - he * he, F.lit(0.0))
    return (dh * ee - de * he) / det, (de * hh - dh * he) / det


def macenko(px: DataFrame, target: dict, haematoxylin: bool = False) -> DataFrame:
    """Pixels with target's stains (h, e, max_h, max_e); haematoxylin gives only that channel, as a share of light."""
    rows = standardized(px).select("tile", "i", *(_density(c).alias(c) for c in RGB)).join(macenko_fit(px), "tile")
    c = _concentrations([F.col(k) for k in RGB], "h", "e")
    if haematoxylin:
        return rows.select("tile", "i", F.exp(-c[0]).alias("light"))
    scaled = [c[0] * target["max_h"] / F.nullif(F.col("max_h"), F.lit(0.0)), c[1] * target["max_e"] / F.nullif(F.col("max_e"), F.lit(0.0))]
    out = [F.least(F.lit(255.0), F.greatest(F.lit(0.0), 255 * F.exp(-(scaled[0] * target["h"][k] + scaled[1] * target["e"][k])))).cast("int").alias(n) for k, n in enumerate(RGB)]
    return rows.select("tile", "i", *out)


def vahadane_fit(px: DataFrame, sparse: float = 0.1, rounds: int = 200) -> DataFrame:
    """Per tile the two stain vectors of a sparse non-negative factorisation of its densities; multiplicative steps from a fixed start."""

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for tile, *channels in frame[["tile", *RGB]].itertuples(index=False, name=None):
                od = np.maximum(-np.log(np.maximum(np.stack(channels).astype(float), 1) / 255), 1e-6)
                w = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
                c = np.maximum(np.linalg.pinv(w) @ od, 1e-3)
                for _ in range(rounds):
                    c *= (w.T @ od) / (w.T @ w @ c + sparse + 1e-12)
                    w *= (od @ c.T) / (w @ (c @ c.T) + 1e-12)
                    w /= np.linalg.norm(w, axis=0) + 1e-12
                w = w[:, np.argsort(-w[0])]
                out.append((tile, w[:, 0].tolist(), w[:, 1].tolist()))
            yield pd.DataFrame(out, columns=["tile", "h", "e"])

    return gathered(standardized(px)).mapInPandas(of, "tile long, h array<double>, e array<double>")
