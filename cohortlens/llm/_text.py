"""Vectorised words and hashes over Arrow batches of text.

Everything here works on slices of about a MB of UTF-8, so that memory does not
follow the size of an Arrow batch.  Hashes are polynomial modulo 2**64 over odd
multipliers and then mixed; two multipliers give 128 bits.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multipliers of the two hash families (each is 5 modulo 8, so its powers do not repeat early).
P1, P2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95
SLICE_BYTES = 1 << 20


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of an odd multiplier and of its inverse, grown on demand."""

    def __init__(self, p: int):
        self.p, self.inv, self.n = p, pow(p, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n + n // 8, SLICE_BYTES + SLICE_BYTES // 8)
            self.up, self.down = _powers(self.p, self.n), _powers(self.inv, self.n)
        return self.up[:n], self.down[:n]


_POWERS = {p: Powers(p) for p in (P1, P2)}
_BYTE = {p: np.random.default_rng(p % (1 << 32)).integers(1, 1 << 63, 256, dtype=np.uint64) for p in (P1, P2)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int = P1) -> np.ndarray:
    """Hash of values[start:end] for each span; equal contents give equal hashes."""
    up, down = _POWERS[p].upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_table(separators: bytes | None = None, keep=None) -> np.ndarray:
    """True for bytes that separate words."""
    table = np.zeros(256, bool)
    if separators is not None:
        table[list(separators)] = True
    else:
        table[[b for b in range(256) if not keep(b)]] = True
    return table


#: Words are runs of anything but ASCII white space.
SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM = byte_table(keep=lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first, past) row ranges whose texts are about limit bytes together."""
    _, at = raw(texts)
    first = 0
    while first < len(texts):
        past = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(past, len(texts))
        first = past
    release()


class Words:
    """Words of a slice of texts: spans in body, and the range of words of each text."""

    def __init__(self, texts: pa.Array, separates: np.ndarray = SPACE, lower: bool = False):
        self.body, self.at = raw(texts)
        if lower:
            self.body = LOWER[self.body]
        n = len(self.body)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separates[self.body]
        cut = np.zeros(n + 1, bool)
        cut[self.at] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.at)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, p: int = P1) -> np.ndarray:
        return span_hash(_BYTE[p][self.body], self.starts, self.ends, p)

    def joined(self, k: int, keep: np.ndarray) -> bytes:
        """The kept words of text k, joined by one space."""
        a, b = self.first[k], self.first[k + 1]
        if keep[a:b].all() and b > a:
            blob = self.body[self.starts[a] : self.ends[b - 1]].tobytes()
            return b" ".join(blob.split())
        body = self.body
        return b" ".join(body[s:e].tobytes() for s, e in zip(self.starts[a:b][keep[a:b]], self.ends[a:b][keep[a:b]], strict=True))
