"""Manifests as JSON lines with a sidecar, and descriptors as TOML."""

from __future__ import annotations

import hashlib
import json
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of a recipe that are bookkeeping and don't change its hash.
BOOKKEEPING = frozenset({"generated_at", "recipe_hash", "version"})


def recipe_hash(recipe: dict) -> str:
    """First 12 hex digits of the SHA-256 of a recipe without its bookkeeping, as JSON with sorted keys."""
    body = json.dumps({k: v for k, v in recipe.items() if k not in BOOKKEEPING}, sort_keys=True, default=str)
    return hashlib.sha256(body.encode()).hexdigest()[:12]


def write_manifest(df: DataFrame, path: str, stage: str, recipe: dict | None = None) -> None:
    """df as JSON lines in path/rows and a one-row sidecar in path/info; null fields are left out."""
    df.write.mode("overwrite").json(f"{path}/rows")
    info = [(stage, recipe_hash(recipe or {}), df.count(), df.columns)]
    df.sparkSession.createDataFrame(info, "stage string, recipe_hash string, n_rows long, fields array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/info")


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a manifest; blank lines are skipped, a malformed line fails, unknown keys are dropped under a schema."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(f"{path}/rows")


def read_listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".svs", ".ndpi", ".tif", ".tiff", ".mrxs", ".scn", ".svslide", ".bif", ".vms", ".czi")) -> DataFrame:
    """Files below folder whose names end like slides, without their contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("name", name).where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(list(suffixes)))


def head_digests(spark: SparkSession, folder: str, head: int = 1 << 20) -> DataFrame:
    """path and the first 16 hex digits of the SHA-256 of each file's first MiB; no more of a file is read."""
    from pyarrow import fs

    def run(frames):
        for frame in frames:
            out = []
            for path in frame["path"]:
                system, name = fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)
                with system.open_input_file(name) as f:
                    out.append(hashlib.sha256(f.read(head)).hexdigest()[:16])
            yield frame.assign(digest=out)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return rows.mapInPandas(run, "path string, digest string")


def read_manifest_info(spark: SparkSession, path: str) -> dict:
    """The sidecar of a manifest: stage, recipe_hash, n_rows, fields, and error where its writing failed."""
    return spark.read.json(f"{path}/info").first().asDict()


class ManifestWriter:
    """Appends batches of rows to a manifest and leaves a sidecar, also when the writing fails.

    Use it in a with block; write() takes DataFrames, close() writes the sidecar from the rows that are there.
    """

    def __init__(self, spark: SparkSession, path: str, stage: str, recipe: dict | None = None, append: bool = False):
        self.spark, self.path, self.stage, self.key = spark, path, stage, recipe_hash(recipe or {})
        self.mode, self.fields, self.written = "append" if append else "overwrite", [], append

    def write(self, df: DataFrame) -> None:
        df.write.mode(self.mode).json(f"{self.path}/rows")
        self.fields += [c for c in df.columns if c not in self.fields]
        self.mode, self.written = "append", True

    def close(self, error: str | None = None) -> None:
        # Lines are counted as text: a manifest that is empty or whose last batch failed has no schema to read.
        n = self.spark.read.text(f"{self.path}/rows").where("value <> ''").count() if self.written else 0
        info = [(self.stage, self.key, n, self.fields, error)]
        self.spark.createDataFrame(info, "stage string, recipe_hash string, n_rows long, fields array<string>, error string").coalesce(1).write.mode("overwrite").json(f"{self.path}/info")

    def __enter__(self) -> ManifestWriter:
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.close(None if error is None else f"{kind.__name__}: {error}")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A result table as one CSV file with a header, null as nothing; results are aggregates, so one file holds them."""
    df.select(*(columns or df.columns)).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def as_text(df: DataFrame, limit: int = 20) -> str:
    """The first rows as aligned text, floats to 4 significant digits, and how many more there are."""
    rows, more = df.take(limit), max(0, df.count() - limit)
    if not rows:
        return "(no rows)"
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    grid = [df.columns, *([cell(v) for v in r] for r in rows)]
    widths = [max(map(len, column)) for column in zip(*grid, strict=True)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)) for line in grid]
    lines.insert(1, "  ".join("-" * w for w in widths))
    return "\n".join(lines + ([f"... {more} more row(s)"] if more else []))


def load_descriptor(text: str) -> dict:
    """A cohort's descriptor: stain names in lower case, sources as a list."""
    data = tomllib.loads(text)
    data["stains"] = {k.lower(): v for k, v in data.get("stains", {}).items()}
    sources = data.get("sources", [])
    data["sources"] = [sources] if isinstance(sources, dict) else list(sources)
    return data
