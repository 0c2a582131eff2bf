"""Magnification, geometry and colour as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard objectives.
OBJECTIVES = (1.0, 2.0, 2.5, 4.0, 5.0, 10.0, 20.0, 40.0, 60.0, 100.0)

#: Linear sRGB to XYZ, and the white it is divided by.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def snapped(mag: Column, tolerance: float = 0.05) -> Column:
    """The relatively nearest standard objective within a tolerance, else mag; the smaller one on a tie."""
    each = F.array(*(F.struct((F.abs(mag - o) / o).alias("far"), F.lit(o).alias("to")) for o in OBJECTIVES))
    best = F.array_min(each)
    return F.when(best["far"] <= tolerance, best["to"]).otherwise(mag)


def positive(v: Column) -> Column:
    """A finite number above zero from text such as "40x", else null."""
    x = F.regexp_replace(F.trim(v.cast("string")), "[xX]+$", "").try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def magnification(override: Column, properties: list[Column], mpp: list[Column], fallback: Column) -> tuple[Column, Column]:
    """(value, origin): the override, the first property that is a positive number, 10 / mpp snapped, the fallback, else null."""
    steps = [("override", positive(override)), *((f"property {k}", positive(p)) for k, p in enumerate(properties)), *((f"mpp {k}", snapped(10.0 / positive(m))) for k, m in enumerate(mpp)), ("fallback", positive(fallback))]
    origin = F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in steps), F.lit("missing"))
    return F.coalesce(*(v for _, v in steps)), origin


def level_for(base: Column, target: float, downsamples: Column) -> Column:
    """The level whose magnification is nearest target by ratio, the first on a tie; null where target would need upsampling."""
    far = F.transform(downsamples, lambda d, i: F.struct(F.round(F.abs(F.ln(base / d / target)), 9).alias("far"), i.cast("int").alias("level")))
    return F.when(base + 1e-9 >= target, F.array_min(far)["level"])


def output_length(length: Column, base: Column, target: float) -> Column:
    """Pixels of a side at the target magnification, rounded half to even, one at least."""
    return F.greatest(F.bround(length * target / base, 0), F.lit(1)).cast("int")


def to_level0(place: Column, base: Column, target: float) -> Column:
    """A place on the target's grid in pixels of the full resolution."""
    return F.bround(place * (base / target), 0).cast("int")


def read_length(length: Column, native: Column, target: float) -> Column:
    """Pixels to read at a native magnification for a length at the target's, one at least."""
    return F.greatest(F.bround(length * (native / target), 0), F.lit(1)).cast("int")


def optical_density(v: Column) -> Column:
    """Density that tissue masks sum over the channels."""
    return -F.ln((v + 1.0) / 255.0 + 1e-6)


def optical_density_max(r: Column, g: Column, b: Column) -> Column:
    """Largest density of a pixel's channels, of values clipped to 1..255."""
    return F.greatest(*(-F.ln(F.least(F.greatest(v, F.lit(1)), F.lit(255)) / 255.0) for v in (r, g, b)))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue of 0..179 (two degrees a step), saturation and value of 0..255, rounded to whole numbers."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif((top - low).cast("double"), F.lit(0.0))
    turn = F.when(top == r, 30 * (g - b) / span).when(top == g, 60 + 30 * (b - r) / span).otherwise(120 + 30 * (r - g) / span)
    hue = F.floor(F.coalesce(turn, F.lit(0.0)) + 0.5)
    return F.when(hue < 0, hue + 180).otherwise(hue), F.coalesce(F.floor(255 * span / top + 0.5), F.lit(0).cast("long")), top


def is_brown(r: Column, g: Column, b: Column) -> Column:
    """Pixels of brown chromogen: hue 5 to 20, saturation from 30, value up to 220."""
    h, s, v = hsv(r, g, b)
    return h.between(5, 20) & (s >= 30) & (v <= 220)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L, a, b of 8-bit sRGB, quantised to 8 bits as image libraries store them."""

    def linear(v: Column) -> Column:
        x = v / 255.0
        return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, 2.4)).otherwise(x / 12.92)

    rgb = [linear(v) for v in (r, g, b)]
    x, y, z = (sum((w * v for w, v in zip(ws[1:], rgb[1:], strict=True)), ws[0] * rgb[0]) / white for ws, white in zip(XYZ, WHITE, strict=True))
    f = lambda t: F.when(t > 0.008856, F.pow(t, 1 / 3)).otherwise(7.787 * t + 16 / 116)
    light = F.when(y > 0.008856, 116 * F.pow(y, 1 / 3) - 16).otherwise(903.3 * y)
    whole = lambda v: F.floor(v + 0.5)
    return whole(light * 2.55) / 2.55, whole(500 * (f(x) - f(y)) + 128) - 128.0, whole(200 * (f(y) - f(z)) + 128) - 128.0


def rgb(light: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit sRGB of CIE L, a, b, clipped."""
    fy = (light + 16) / 116.0
    cube = lambda t: F.when(t > 0.206893, F.pow(t, 3.0)).otherwise((t - 16 / 116) / 7.787)
    x, y, z = cube(fy + a / 500.0) * WHITE[0], F.when(light > 7.9996, F.pow(fy, 3.0)).otherwise(light / 903.3), cube(fy - b / 200.0) * WHITE[2]
    back = ((3.240479, -1.53715, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))

    def gamma(v: Column) -> Column:
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        return F.floor(255 * F.when(v > 0.0031308, 1.055 * F.pow(v, 1 / 2.4) - 0.055).otherwise(12.92 * v) + 0.5).cast("int")

    return tuple(gamma(p * x + q * y + s * z) for p, q, s in back)  # type: ignore[return-value]
