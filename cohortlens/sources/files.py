"""Files made from rows and rows from files: images, staged links and workbooks of result tables."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortlens.sources import png, tiff


def write_images(rows: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write square pictures (output, r, g, b as flat arrays) as folder/output in PNG; gives output, status (written, exists or failed), error.

    A file appears under its name when it is whole, so a task may be run again; the first row of an output decides.
    """

    def put(output: str, colours: list) -> tuple[str, str | None]:
        try:
            system, path = tiff.located(f"{folder.rstrip('/')}/{output}")
            if not overwrite and system.get_file_info(path).is_file:
                return "exists", None
            side = round(len(colours[0]) ** 0.5)
            image = np.stack([np.asarray(c, np.uint8).reshape(side, side) for c in colours], 2)
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            partial = f"{path}.{uuid.uuid4().hex}.partial"
            with system.open_output_stream(partial) as f:
                f.write(png.encoded(image))
            system.move(partial, path)
            return "written", None
        except Exception as e:  # any failure is the row's, not the job's
            return "failed", f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [put(o, v) for o, *v in frame[["output", "r", "g", "b"]].itertuples(index=False, name=None)]
            yield pd.DataFrame({"output": frame["output"], "status": [s for s, _ in done], "error": [e for _, e in done]})

    return rows.select("output", "r", "g", "b").dropDuplicates(["output"]).mapInPandas(run, "output string, status string, error string")


def read_images(paths: DataFrame) -> DataFrame:
    """path, width, height, r, g, b as flat arrays, error, of PNG and TIFF images (path); one that can't be read is a row with its error."""

    def get(path: str) -> tuple:
        try:
            with tiff.opened(path) as f:
                if path.lower().endswith(".png"):
                    image = png.decoded(f.read())
                else:
                    level = tiff.levels_of(tiff.directories(f))[0]
                    image = level.window(f, 0, 0, level.width, level.height)
            flat = image.reshape(-1, 3).astype(np.int32)
            return path, image.shape[1], image.shape[0], *(flat[:, k] for k in range(3)), None
        except Exception as e:  # any failure is the row's, not the job's
            return path, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                yield pd.DataFrame([get(path)], columns=["path", "width", "height", "r", "g", "b", "error"])

    return paths.select("path").mapInPandas(run, "path string, width int, height int, r array<int>, g array<int>, b array<int>, error string")


def stage(rows: DataFrame, folder: str, copy: bool = False, overwrite: bool = False) -> DataFrame:
    """Lay out files (name, path) below a folder that all executors share, as links or copies; gives name, status and error.

    status is linked, copied, exists or failed. A link is put in place by renaming, so a task may be run again.
    """

    def put(name: str, path: str) -> tuple[str, str | None]:
        import shutil

        try:
            source = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
            if not os.path.isfile(source):
                raise FileNotFoundError(source)
            target = os.path.join(folder, name)
            if os.path.lexists(target) and not overwrite:
                return "exists", None
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{uuid.uuid4().hex}.partial"
            shutil.copyfile(source, partial) if copy else os.symlink(os.path.abspath(source), partial)
            os.replace(partial, target)
            return "copied" if copy else "linked", None
        except OSError as e:
            return "failed", f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [put(n, p) for n, p in frame[["name", "path"]].itertuples(index=False, name=None)]
            yield pd.DataFrame({"name": frame["name"], "status": [s for s, _ in done], "error": [e for _, e in done]})

    return rows.select("name", "path").dropDuplicates(["name"]).mapInPandas(run, "name string, status string, error string")


def _column(k: int) -> str:
    text = ""
    while k:
        k, rest = divmod(k - 1, 26)
        text = chr(65 + rest) + text
    return text


def _cell(value: object, place: str) -> str:
    if value is None or value != value:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf"):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(tables: dict[str, DataFrame], path: str, most: int = 1_048_575) -> dict[str, int]:
    """A spreadsheet with a sheet per result table, rows in the tables' order; gives the rows of each.

    Rows come to the driver one partition at a time and go straight to the file; a table of more than a sheet holds is an error.
    """
    names = [_sheet(n) for n in tables]
    if len({n.lower() for n in names}) < len(names) or not names:
        raise ValueError("sheets need different names")
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    top = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    each = range(1, len(names) + 1)
    counts = {}
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in each)
        z.writestr("[Content_Types].xml", f'{top}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{sheets}</Types>')
        z.writestr("_rels/.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each)
        z.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for k, (name, df) in enumerate(tables.items(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'{top}<worksheet xmlns="{main}"><sheetData>'.encode())
                n = 1
                f.write(_line(df.columns, n))
                for row in df.toLocalIterator():
                    n += 1
                    if n > most + 1:
                        raise ValueError(f"{name} has more rows than a sheet")
                    f.write(_line(row, n))
                f.write(b"</sheetData></worksheet>")
                counts[name] = n - 1
    os.replace(partial, path)
    return counts


def _line(values, n: int) -> bytes:
    return f'<row r="{n}">{"".join(_cell(v, f"{_column(k)}{n}") for k, v in enumerate(values, 1))}</row>'.encode()


def _sheet(name: str) -> str:
    return "".join("_" if c in "[]:*?/\\" else c for c in name)[:31] or "Sheet"
