"""Detections as a stream: windowed counts per grid cell, appended to a manifest table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def cell_counts(events: DataFrame, cell: Column, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n and summed value per cell and window; events later than `late` are left out."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), cell.alias("cell"), "value").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window).alias("w"), "cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "cell", "n", "total")


def append_manifest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows once; restarts go on from the checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
