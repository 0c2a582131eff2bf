"""8-bit PNG images with numpy and zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed value: the first bytes of a file.
MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(image: np.ndarray) -> bytes:
    """An RGB image (h, w, 3) as a file."""
    h, w = image.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, w * 3)], 1)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decoded(data: bytes) -> np.ndarray:
    """RGB pixels of a file: grey, colour or palette, transparency on white; other depths and interlaced files are errors."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, packed, palette, alphas, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        at += n + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alphas = body
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG files without interlacing are read")
    w, h, colours = head[0], head[1], head[3]
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colours]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * samples)
    out = np.zeros((h, w * samples), np.uint8)
    above = np.zeros(w * samples, np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(raw[y, 0]), raw[y, 1:], above, samples)
    v = out.reshape(h, w, samples)
    if colours == 3:
        share = np.frombuffer(alphas.ljust(256, b"\xff"), np.uint8)[v[..., 0]][..., None] / 255
        return _on_white(palette[v[..., 0]], share)
    rgb = v[..., :1].repeat(3, 2) if samples < 3 else v[..., :3]
    return _on_white(rgb, v[..., -1:] / 255) if samples in (2, 4) else rgb


def _on_white(rgb: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.rint(rgb * share + 255 * (1 - share)).astype(np.uint8)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), 0, dtype=np.uint8).ravel()
    if kind == 2:
        return line + above
    out, up = bytearray(len(line)), above.tobytes()
    for k, v in enumerate(line.tobytes()):
        left, over, corner = (out[k - step], up[k], up[k - step]) if k >= step else (0, up[k], 0)
        if kind == 3:
            guess = (left + over) // 2
        else:
            far = abs(over - corner), abs(left - corner), abs(left + over - 2 * corner)
            guess = left if far[0] <= far[1] and far[0] <= far[2] else over if far[1] <= far[2] else corner
        out[k] = (v + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)
