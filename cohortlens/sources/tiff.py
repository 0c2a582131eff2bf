"""Tiled RGB pyramids in TIFF and BigTIFF with numpy and zlib alone: headers, windows, encoded tiles and the frame around them."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Field types of the format as struct codes, by number.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
X_RESOLUTION, Y_RESOLUTION, PLANAR, UNIT, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SUBFILE, CHILDREN = 282, 283, 284, 296, 317, 322, 323, 324, 325, 254, 330
PLAIN, DEFLATE = (1,), (8, 32946)


def opened(path: str):
    """A random-access file of a plain path or a URI of any file system that pyarrow knows."""
    system, name = located(path)
    return system.open_input_file(name)


def located(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _at(f, place: int, n: int) -> bytes:
    f.seek(place)
    data = f.read(n)
    if len(data) < n:
        raise ValueError(f"the file ends before byte {place + n}")
    return data


def directories(f) -> list[dict[int, tuple]]:
    """Every image directory of a file, children after their parent: tag number to values."""
    head = _at(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    count, word, entry = ("Q", "Q", 20) if big else ("H", "I", 12)
    inline = struct.calcsize("=" + word)
    todo = [struct.unpack(order + "Q", _at(f, 8, 8))[0] if big else struct.unpack(order + "I", head[4:])[0]]
    out, seen = [], set()
    while todo:
        place = todo.pop(0)
        if not place or place in seen:
            continue
        seen.add(place)
        size = struct.calcsize("=" + count)
        n = struct.unpack(order + count, _at(f, place, size))[0]
        raw = _at(f, place + size, n * entry + inline)
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, code = struct.unpack_from(order + "HH", raw, k * entry)
            many = struct.unpack_from(order + word, raw, k * entry + 4)[0]
            if code not in TYPES:
                continue
            unit = struct.calcsize("=" + TYPES[code])
            start = k * entry + 4 + inline
            data = raw[start : start + inline] if unit * many <= inline else _at(f, struct.unpack_from(order + word, raw, start)[0], unit * many)
            tags[tag] = (data[: unit * many],) if TYPES[code] == "s" else struct.unpack(f"{order}{many * len(TYPES[code])}{TYPES[code][0]}", data[: unit * many])
        out.append(tags)
        todo = [*tags.get(CHILDREN, ()), struct.unpack_from(order + word, raw, n * entry)[0], *todo]
    return out


@dataclass(frozen=True)
class Level:
    """One resolution; strips are tiles as wide as the image."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    samples: int

    def window(self, f, x: int, y: int, w: int, h: int) -> np.ndarray:
        """Pixels of a window, white where it lies outside the image; only tiles that it touches are read."""
        if self.compression not in PLAIN + DEFLATE:
            raise ValueError(f"compression {self.compression} can't be decoded without an image library")
        out = np.full((h, w, 3), 255, np.uint8)
        across = -(-self.width // self.tile_width)
        left, top, right, bottom = max(x, 0), max(y, 0), min(x + w, self.width), min(y + h, self.height)
        if left >= right or top >= bottom:
            return out
        for row in range(top // self.tile_height, (bottom - 1) // self.tile_height + 1):
            for column in range(left // self.tile_width, (right - 1) // self.tile_width + 1):
                tile = self._tile(f, row * across + column, min(self.tile_height, self.height - row * self.tile_height))
                tx, ty = column * self.tile_width, row * self.tile_height
                a, b = max(left, tx), min(right, tx + self.tile_width)
                c, d = max(top, ty), min(bottom, ty + tile.shape[0])
                out[c - y : d - y, a - x : b - x] = tile[c - ty : d - ty, a - tx : b - tx]
        return out

    def shrunk(self, f, x: int, y: int, n: int, side: int) -> np.ndarray:
        """A square window of n pixels as one of a side: means of whole blocks first, a band of blocks at a time, so that no large window is held."""
        k = max(1, n // (2 * side))
        if k == 1:
            return resized(self.window(f, x, y, n, n), side, side)
        m = -(-n // k)
        bands = (self.window(f, x, y + row * k, m * k, k) for row in range(m))
        return resized(np.stack([np.rint(v.reshape(k, m, k, 3).mean((0, 2))).astype(np.uint8) for v in bands]), side, side)

    def _tile(self, f, k: int, rows: int) -> np.ndarray:
        if not self.sizes[k]:
            return np.full((self.tile_height, self.tile_width, 3), 255, np.uint8)
        data = _at(f, self.offsets[k], self.sizes[k])
        if self.compression in DEFLATE:
            data = zlib.decompress(data)
        v = np.frombuffer(data, np.uint8)
        v = v[: v.size - v.size % (self.tile_width * self.samples)].reshape(-1, self.tile_width, self.samples)
        if v.shape[0] < rows:
            raise ValueError(f"tile {k} is cut off")
        if self.predictor == 2:
            v = np.cumsum(v, 1, dtype=np.uint8)
        if self.samples == 4:
            share = v[..., 3:].astype(float) / 255
            v = np.rint(v[..., :3] * share + 255 * (1 - share)).astype(np.uint8)
        return v if self.samples >= 3 else np.repeat(v, 3, 2)


def _level(tags: dict[int, tuple]) -> Level | None:
    """The directory as a level, or None if it is no 8-bit colour or grey image."""
    samples = tags.get(SAMPLES, (1,))[0]
    if set(tags.get(BITS, (1,))) != {8} or tags.get(PLANAR, (1,))[0] != 1 or samples not in (1, 3, 4) or tags.get(PHOTOMETRIC, (2,))[0] not in (1, 2, 6):
        return None
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    if tags.get(PHOTOMETRIC, (2,))[0] == 6 and tags.get(COMPRESSION, (1,))[0] in PLAIN + DEFLATE:
        return None  # luma and chroma that no codec turns into colours
    tiled = TILES in tags
    shape = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(STRIP_ROWS, (h,))[0]))
    return Level(w, h, *shape, tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], samples)


def levels_of(tags: list[dict[int, tuple]]) -> list[Level]:
    """The pyramid, largest first: directories with the first one's proportions; labels and overviews have others."""
    found = [x for x in map(_level, tags) if x]
    if not found:
        raise ValueError("no 8-bit image in the file")
    first = found[0]
    same = [x for x in found[1:] if x.width < first.width and abs(first.width / x.width - first.height / x.height) <= max(0.02 * first.width / x.width, 1.0 / x.height * first.height / x.width)]
    return [first, *sorted(same, key=lambda x: -x.width)]


def properties_of(tags: dict[int, tuple]) -> dict[str, str]:
    """Magnification and pixel size from a description of key = value parts or OME-XML, else from the resolution fields."""
    text = tags.get(DESCRIPTION, (b"",))[0].split(b"\0")[0].decode("utf-8", "replace")
    out = {f"aperio.{k.strip()}": v.strip() for k, sep, v in (p.partition("=") for p in text.split("|")[1:]) if sep}
    for name, key in (("NominalMagnification", "openslide.objective-power"), ("PhysicalSizeX", "openslide.mpp-x"), ("PhysicalSizeY", "openslide.mpp-y")):
        if m := re.search(rf'\b{name}="([^"]*)"', text):
            out[key] = m[1]
    if "aperio.MPP" in out:
        out |= {"openslide.mpp-x": out["aperio.MPP"], "openslide.mpp-y": out["aperio.MPP"]}
    unit = {2: 25400.0, 3: 10000.0}.get(tags.get(UNIT, (2,))[0])
    for tag, key in ((X_RESOLUTION, "openslide.mpp-x"), (Y_RESOLUTION, "openslide.mpp-y")):
        top, under = tags.get(tag, (0, 1))
        # One pixel per inch is what writers put that know nothing.
        if key not in out and unit and top and under and top != under:
            out[key] = repr(unit * under / top)
    return out


def _kernel(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _weights(n: int, out: int) -> np.ndarray:
    scale = n / out
    wide = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    w = _kernel((np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """image at exactly a size: a Lanczos window of three lobes, widened where it shrinks."""
    if image.shape[:2] == (height, width):
        return image
    out = np.einsum("ij,jkc->ikc", _weights(image.shape[0], height), image.astype(float), optimize=True)
    out = np.einsum("ij,kjc->kic", _weights(image.shape[1], width), out, optimize=True)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def two_step(image: np.ndarray, side: int) -> np.ndarray:
    """image as a square: means of whole blocks down to twice the side at least, then the Lanczos window."""
    k = max(1, min(image.shape[:2]) // (2 * side))
    h, w = (n - n % k for n in image.shape[:2])
    if k > 1:
        image = np.rint(image[:h, :w].reshape(h // k, k, w // k, k, 3).mean((1, 3))).astype(np.uint8)
    return resized(image, side, side)


def encoded(tile: np.ndarray) -> bytes:
    """A tile as the writer stores it."""
    return zlib.compress(np.ascontiguousarray(tile).tobytes(), 6)


def ome_xml(width: int, height: int, name: str, mpp: tuple[float, float] | None, magnification: float | None = None) -> str:
    """The least OME-XML that names size, pixel size and objective of an RGB image."""
    from xml.sax.saxutils import quoteattr

    size = "" if mpp is None else f' PhysicalSizeX="{mpp[0]!r}" PhysicalSizeXUnit="µm" PhysicalSizeY="{mpp[1]!r}" PhysicalSizeYUnit="µm"'
    lens = "" if magnification is None else f'<Instrument ID="Instrument:0"><Objective ID="Objective:0" NominalMagnification="{magnification!r}"/></Instrument>'
    return (
        '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">' + lens + f'<Image ID="Image:0" Name={quoteattr(name)}>'
        f'<Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="uint8" SizeX="{width}" SizeY="{height}" SizeC="3" SizeZ="1" SizeT="1" Interleaved="true"{size}>'
        '<Channel ID="Channel:0:0" SamplesPerPixel="3"/><TiffData/></Pixels></Image></OME>'
    )


def head(data_bytes: int) -> bytes:
    """The first 16 bytes of a BigTIFF whose tiles follow and whose directories come after data_bytes of them."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + data_bytes)


def tail(start: int, levels: list[tuple[int, int, list[tuple[int, int]]]], side: int, text: str) -> bytes:
    """The directories, to stand at start: per level width, height and (offset, bytes) of its tiles in row order."""
    out = b""
    for k, (w, h, places) in enumerate(levels):
        here = start + len(out)
        fields = [(SUBFILE, 4, [int(k > 0)]), (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8, 8, 8]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2])]
        fields += [(DESCRIPTION, 2, text.encode() + b"\0")] if k == 0 else []
        fields += [(SAMPLES, 3, [3]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [side]), (TILE_HEIGHT, 4, [side]), (TILES, 16, [p for p, _ in places]), (TILE_BYTES, 16, [n for _, n in places])]
        rows, extra = b"", b""
        past = here + 8 + 20 * len(fields) + 8
        for tag, code, values in fields:
            data = values if code == 2 else struct.pack(f"<{len(values)}{TYPES[code]}", *values)
            if len(data) <= 8:
                rows += struct.pack("<HHQ", tag, code, len(values)) + data.ljust(8, b"\0")
            else:
                rows += struct.pack("<HHQQ", tag, code, len(values), past + len(extra))
                extra += data
        follows = past + len(extra) if k + 1 < len(levels) else 0
        out += struct.pack("<Q", len(fields)) + rows + struct.pack("<Q", follows) + extra
    return out
