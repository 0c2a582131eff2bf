"""Tile grids over slides, regions and their coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiles(slides: DataFrame, size: int, ids: int = 6, stride: int | None = None) -> DataFrame:
    """A row per tile of slides (slide, width, height), cut at the edges, with ids in row order."""
    step = stride or size
    ys = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step)))
    xs = F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step)))
    out = slides.where("width > 0 AND height > 0").withColumn("y0", ys).withColumn("x0", xs)
    across = F.ceil(F.col("width") / step)
    number = F.col("y0") / step * across + F.col("x0") / step + 1
    return out.select("slide", "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).alias("w"), F.least(F.lit(size), F.col("height") - F.col("y0")).alias("h"), F.lpad(number.cast("int").cast("string"), ids, "0").alias("tile_id"))


def kept_ids(tile_rows: DataFrame, keep: Column, ids: int = 6) -> DataFrame:
    """Tiles that keep holds for, numbered within their slide in row order."""
    order = Window.partitionBy("slide").orderBy("y0", "x0")
    return tile_rows.where(keep).withColumn("patch_id", F.lpad(F.row_number().over(order).cast("string"), ids, "0"))


def valid_cells(px: DataFrame, side: int, across: int, dark: int = 230, share: float = 0.05) -> DataFrame:
    """Cells of an across x across grid over each tile (tile, i, grey) of which more than share is dark."""
    edge = F.array(*(F.lit(int(k * side / across)) for k in range(across + 1)))
    cell = lambda v: F.size(F.filter(edge, lambda e: e <= v)) - 1
    x, y = (F.col("i") % side).cast("int"), F.floor(F.col("i") / side).cast("int")
    out = px.groupBy("tile", (cell(y) * across + cell(x)).alias("cell")).agg(F.avg((F.col("grey") < dark).cast("int")).alias("fraction"))
    return out.where(F.col("fraction") > share)


#: Sides of the five named places: -1 near the left or top, 0 in the middle, 1 near the right or bottom.
PLACES = {"center": (0, 0), "top_left": (-1, -1), "top_right": (1, -1), "bottom_left": (-1, 1), "bottom_right": (1, 1)}


def _inside(low: Column, size: int, length: Column) -> tuple[Column, Column]:
    end = F.least(length, low + size)
    start = F.greatest(F.lit(0), end - size)
    return start, end


def named_boxes(slides: DataFrame, size: int, margin: float = 0.05) -> DataFrame:
    """The box of a size at each of the five named places of each slide, pushed inside it."""
    half = size // 2

    def anchor(length: Column, side: Column) -> Column:
        edge = (length * margin).cast("int") + half
        return F.when(side == 0, F.floor(length / 2)).when(side < 0, edge).otherwise(length - edge).cast("int")

    place = F.explode(F.array(*(F.struct(F.lit(n).alias("region"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for n, (x, y) in PLACES.items())))
    rows = slides.withColumn("p", place).select("slide", "width", "height", "p.*")
    (x0, x1), (y0, y1) = (_inside(anchor(F.col(c), F.col(s)) - half, size, F.col(c)) for c, s in (("width", "sx"), ("height", "sy")))
    return rows.select("slide", "region", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def relative_boxes(boxes: DataFrame) -> DataFrame:
    """boxes (slide, width, height, rx, ry, rw, rh as shares) in pixels, inside their slides."""
    scaled = lambda c, d: (F.col(c) * F.col(d)).cast("int")
    x0, y0 = F.greatest(F.lit(0), scaled("rx", "width")), F.greatest(F.lit(0), scaled("ry", "height"))
    x1 = F.least(F.col("width"), scaled("rx", "width") + scaled("rw", "width"))
    y1 = F.least(F.col("height"), scaled("ry", "height") + scaled("rh", "height"))
    return boxes.select("slide", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def moved(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """points (x, y) under a 3 x 3 transform, truncated to whole pixels."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    row = [a * x + b * y + c for a, b, c in matrix]
    return points.select("slide", *((row[k] / row[2]).cast("int").alias(n) for k, n in ((0, "x"), (1, "y"))))


def in_reading_order(boxes: DataFrame, group: str, key: str = "id") -> DataFrame:
    """boxes (x, y, w, h) by rows, then x: a row starts where a centre is half the mean height or more below the last one."""
    cx, cy = F.col("x") + F.floor(F.col("w") / 2), F.col("y") + F.floor(F.col("h") / 2)
    by_y = Window.partitionBy(group).orderBy("cy", key)
    rows = boxes.withColumns({"cx": cx, "cy": cy, "tall": F.avg("h").over(Window.partitionBy(group)) * 0.5})
    fresh = F.coalesce((F.col("cy") - F.lag("cy").over(by_y) >= F.col("tall")).cast("int"), F.lit(0))
    rows = rows.withColumn("fresh", fresh).withColumn("row", F.sum("fresh").over(by_y.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("row", "cx", "cy", key))).drop("fresh", "tall", "cx", "cy")


def composed(rows: DataFrame, path: list[str], zooms: dict[str, int], regions: list[str], extension: str) -> DataFrame:
    """An output row per input row, zoom and region with its path, from two fixed small lists."""
    z = F.explode(F.array(*(F.struct(F.lit(k).alias("zoom"), F.lit(v).alias("size")) for k, v in sorted(zooms.items()))))
    out = rows.withColumn("z", z).withColumn("region", F.explode(F.array(*map(F.lit, regions)))).select("*", "z.zoom", "z.size").drop("z")
    return out.withColumn("output", F.concat(F.concat_ws("/", *path, "zoom", "region"), F.lit(extension)))
