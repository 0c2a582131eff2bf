"""Binary images as numpy arrays: labels, morphology, outlines, their features, matching and alignment."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np

#: Weights of solidity, log aspect and centre in a match, the weight of the shape's moments, and the largest cost.
FEATURE_WEIGHTS = np.array([2.0, 1.5, 0.8, 0.8])
MOMENT_WEIGHT = 0.5
MATCH_LIMIT = 1.4

#: Steps around a pixel, clockwise from the left.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def labels(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """(labels from 1, their number) of connected regions, joined by runs of rows."""
    mask = np.asarray(mask, bool)
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    root = np.arange(len(row))
    reach = 1 if diagonal else 0

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if start[a] < end[b] + reach and start[b] < end[a] + reach:
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    _, number = np.unique([top(k) for k in range(len(root))], return_inverse=True) if len(root) else (None, np.zeros(0, int))
    out = np.zeros(mask.shape, np.int64)
    for y, s, e, n in zip(row, start, end, number, strict=True):
        out[y, s:e] = n + 1
    return out, int(number.max()) + 1 if len(root) else 0


def large_only(mask: np.ndarray, least: int, diagonal: bool = False) -> np.ndarray:
    """mask without regions of fewer than least pixels."""
    own, n = labels(mask, diagonal)
    big = np.bincount(own.ravel(), minlength=n + 1) >= least
    big[0] = False
    return big[own]


def otsu(values: np.ndarray) -> int:
    """Threshold of the largest variance between those up to it and those above, the smallest on a tie."""
    counts = np.bincount(values.ravel(), minlength=256).astype(float)
    grey = np.arange(len(counts))
    n, s = np.cumsum(counts), np.cumsum(counts * grey)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = n * (n[-1] - n) * (s / n - (s[-1] - s) / (n[-1] - n)) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, 0.0)))


def ellipse(side: int) -> list[tuple[int, int]]:
    """(row offset, half width) of the rows of a disk in a square of an odd side."""
    r = side // 2
    return [(dy, int(round(r * np.sqrt(max(0.0, (r * r - dy * dy) / (r * r)))))) if r else (0, 0) for dy in range(-r, r + 1)]


def dilated(mask: np.ndarray, side: int, erode: bool = False) -> np.ndarray:
    """mask grown (or shrunk) by a disk; pixels beyond the border change nothing."""
    m = ~mask if erode else mask
    r = side // 2
    padded = np.pad(m, ((r, r), (r + 1, r)))
    total = np.cumsum(padded, axis=1)
    out = np.zeros(m.shape, bool)
    h, w = m.shape
    for dy, half in ellipse(side):
        rows = total[r + dy : r + dy + h]
        out |= rows[:, r + 1 + half : r + 1 + half + w] > rows[:, r - half : r - half + w]
    return ~out if erode else out


def closed_then_opened(mask: np.ndarray, side: int = 15, close: int = 3, open_: int = 2) -> np.ndarray:
    for erode, times in ((False, close), (True, close), (True, open_), (False, open_)):
        for _ in range(times):
            mask = dilated(mask, side, erode)
    return mask


def tissue(image: np.ndarray) -> np.ndarray:
    """Mask of an RGB overview: largest optical density, Otsu's threshold, closing and opening."""
    density = -np.log(np.clip(image.astype(float), 1, 255) / 255).max(axis=2)
    grey = np.clip(density * 85, 0, 255).astype(np.uint8)
    return closed_then_opened(grey > otsu(grey))


@dataclass
class Outline:
    """A region's outer border with its area, length, box, centre, solidity and moment invariants."""

    points: np.ndarray
    area: float
    length: float
    box: tuple[int, int, int, int]
    centre: tuple[float, float]
    hull_area: float
    invariants: np.ndarray

    @property
    def circularity(self) -> float:
        return 4 * np.pi * self.area / self.length**2 if self.length else 0.0

    def features(self, shape: tuple[int, int]) -> np.ndarray:
        cx, cy = (self.centre[0] / shape[1], self.centre[1] / shape[0]) if self.area > 0 else (0.5, 0.5)
        return np.array([self.area / (self.hull_area + 1e-6), np.log1p(self.box[2] / (self.box[3] + 1e-6)), cx, cy])


def _border(region: np.ndarray) -> np.ndarray:
    """(x, y) of the outer border's pixels in order, by following it with the region on one side."""
    padded = np.pad(region, 1)
    y, x = map(int, np.argwhere(padded)[0])
    begin, way, out = (y, x), 0, []
    first_step = None
    while True:
        out.append((x - 1, y - 1))
        for turn in range(8):
            k = (way + 1 + turn) % 8
            if padded[y + AROUND[k][0], x + AROUND[k][1]]:
                break
        else:
            return np.array(out, float)
        if (y, x) == begin and first_step == k:
            return np.array(out[:-1], float)
        first_step = k if first_step is None else first_step
        y, x, way = y + AROUND[k][0], x + AROUND[k][1], (k + 4) % 8


def _hull(points: np.ndarray) -> np.ndarray:
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return np.array(pts)
    halves = []
    for order in (pts, pts[::-1]):
        chain: list = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        halves += chain[:-1]
    return np.array(halves)


def _signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _moments(p: np.ndarray, degree: int = 3) -> dict[tuple[int, int], float]:
    """Moments of a polygon up to a degree of 3, by a quadrature of degree 3 over the triangles it makes with the origin."""
    q = np.roll(p, -1, axis=0)
    weight = (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]) / 2
    nodes = ((-27 / 48, (p + q) / 3), *((25 / 48, a * p + b * q) for a, b in ((0.6, 0.2), (0.2, 0.6), (0.2, 0.2))))
    return {(i, j): float(sum((w * weight * z[:, 0] ** i * z[:, 1] ** j).sum() for w, z in nodes)) for i in range(degree + 1) for j in range(degree + 1 - i)}


def _invariants(points: np.ndarray, centre: tuple[float, float]) -> np.ndarray:
    """Hu's seven moment invariants of a polygon."""
    m = _moments(points - np.array(centre))
    area = abs(m[0, 0])
    if not area:
        return np.zeros(7)
    sign = np.sign(m[0, 0])
    n = {k: sign * v / area ** (1 + sum(k) / 2) for k, v in m.items()}
    a, b, c, d = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3], n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    p, q = a * a - 3 * b * b, 3 * a * a - b * b
    e = n[2, 0] - n[0, 2]
    return np.array([n[2, 0] + n[0, 2], e * e + 4 * n[1, 1] ** 2, c * c + d * d, a * a + b * b, c * a * p + d * b * q, e * (a * a - b * b) + 4 * n[1, 1] * a * b, d * a * p - c * b * q])


def outlines(mask: np.ndarray, most: int | None = None, share: float = 0.0) -> list[Outline]:
    """Outer borders of the regions of more than share of the image, the largest first and at most `most`."""
    own, n = labels(mask)
    out = []
    for k in range(1, n + 1):
        points = _border(own == k)
        area = abs(_signed_area(points))
        if area <= share * mask.size and share:
            continue
        x0, y0 = points.min(axis=0).astype(int)
        w, h = (points.max(axis=0).astype(int) - (x0, y0)) + 1
        m = _moments(points, 1)
        centre = (m[1, 0] / m[0, 0], m[0, 1] / m[0, 0]) if m[0, 0] else tuple(points.mean(axis=0))
        length = float(np.hypot(*(np.roll(points, -1, axis=0) - points).T).sum())
        out.append(Outline(points, area, length, (int(x0), int(y0), int(w), int(h)), centre, abs(_signed_area(_hull(points))), _invariants(points, centre)))
    return sorted(out, key=lambda o: -o.area)[:most]


def _invariant_distance(a: np.ndarray, b: np.ndarray) -> float:
    both = (np.abs(a) > 1e-5) & (np.abs(b) > 1e-5)
    if not both.any():
        return 0.0
    scale = lambda v: np.sign(v[both]) * np.log10(np.abs(v[both]))
    return float(np.abs(scale(a) - scale(b)).sum())


def matched(ref: list[Outline], other: list[Outline], ref_shape: tuple[int, int], other_shape: tuple[int, int], limit: float = MATCH_LIMIT) -> list[tuple[int, int, float]]:
    """(i, j, cost): each of ref in order with the cheapest one of other that is still free."""
    free, out = set(range(len(other))), []
    far = [[float(np.linalg.norm((a.features(ref_shape) - b.features(other_shape)) * FEATURE_WEIGHTS)) + MOMENT_WEIGHT * _invariant_distance(a.invariants, b.invariants) for b in other] for a in ref]
    for i, costs in enumerate(far):
        cost, j = min(((costs[j], j) for j in free), default=(np.inf, -1))
        if cost < limit and ref[i].area > 0 and other[j].area > 0:
            free.discard(j)
            out.append((i, j, cost))
    return out


def _similarity(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Rotation, scale and shift that take src to dst with least squares, points as complex numbers."""
    a, b = src @ (1, 1j), dst @ (1, 1j)
    spread = np.abs(a - a.mean()) ** 2
    turn = (np.conj(a - a.mean()) * (b - b.mean())).sum() / spread.sum() if spread.sum() else 1.0 + 0j
    shift = b.mean() - turn * a.mean()
    return np.array([[turn.real, -turn.imag, shift.real], [turn.imag, turn.real, shift.imag]])


def alignment(src: np.ndarray, dst: np.ndarray, prior: tuple[float, float], limit: float = 20.0) -> np.ndarray:
    """2 x 3 matrix from matched centres: a similarity of the largest agreeing set from three on, the mean shift of one or two, prior of none."""
    src, dst = np.asarray(src, float).reshape(-1, 2), np.asarray(dst, float).reshape(-1, 2)
    if len(src) < 3:
        dx, dy = (dst - src).mean(axis=0) if len(src) else prior
        return np.array([[1.0, 0.0, dx], [0.0, 1.0, dy]])
    best = np.zeros(len(src), bool)
    for pair in combinations(range(len(src)), 2):
        m = _similarity(src[list(pair)], dst[list(pair)])
        near = np.hypot(*(src @ m[:, :2].T + m[:, 2] - dst).T) <= limit
        best = near if near.sum() > best.sum() else best
    return _similarity(src[best], dst[best])


def phase_shift(ref: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """(dx, dy) by phase correlation of windowed grey images."""
    h, w = ref.shape
    window = np.outer(np.hanning(h), np.hanning(w))
    cross = np.fft.fft2(ref * window) * np.conj(np.fft.fft2(other * window))
    y, x = np.unravel_index(int(np.argmax(np.fft.ifft2(cross / (np.abs(cross) + 1e-8)).real)), (h, w))
    return float(x - w * (x >= w // 2)), float(y - h * (y >= h // 2))


def correlation(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    a, b = (np.asarray(v, float)[mask if mask is not None else ...].ravel() for v in (a, b))
    if not len(a):
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-8))


def registered(ref: np.ndarray, other: np.ndarray, most: int = 8, share: float = 0.001, refine: bool = False) -> dict:
    """Matrix from ref's pixels to other's, the number of matched outlines and the correlation after warping other (nearest pixel)."""
    ref, other = np.asarray(ref), np.asarray(other)
    masks = tissue(ref), tissue(other)
    sides = [outlines(m, most, share) for m in masks]
    pairs = matched(*sides, masks[0].shape, masks[1].shape)
    grey = [v.mean(axis=2) for v in (ref, other)]
    h, w = min(ref.shape[0], other.shape[0]), min(ref.shape[1], other.shape[1])
    dx, dy = phase_shift(grey[0][:h, :w], grey[1][:h, :w])
    matrix = alignment([sides[0][i].centre for i, _, _ in pairs], [sides[1][j].centre for _, j, _ in pairs], (-dx, -dy))
    if refine:
        matrix = refined(matrix, grey[0], grey[1], 1.0)
    view, seen = warped(grey[1], matrix, ref.shape[:2])
    return {"matrix": matrix, "pairs": len(pairs), "ncc": correlation(grey[0], view, seen)}


def warped(image: np.ndarray, matrix: np.ndarray, shape: tuple[int, int], fill: float = 255.0) -> tuple[np.ndarray, np.ndarray]:
    """A grey image seen through a matrix from places of `shape` to its own (nearest pixel), and where there is one."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    tx, ty = (np.rint(row[0] * x + row[1] * y + row[2]).astype(int) for row in matrix)
    seen = (tx >= 0) & (ty >= 0) & (tx < image.shape[1]) & (ty < image.shape[0])
    out = np.full(shape, fill)
    out[seen] = image[ty[seen], tx[seen]]
    return out, seen


def refined(matrix: np.ndarray, ref: np.ndarray, other: np.ndarray, up: float) -> np.ndarray:
    """
    matrix (2 x 3, between coarse overviews) with the shift that is left at views `up` times as large, found by phase correlation.

    The other view is brought onto the reference's, so that both lie on one grid; a shift that makes their correlation worse is not taken.
    """
    fine = np.array(matrix, float)
    fine[:, 2] *= up
    now, seen = warped(other, fine, ref.shape)
    dx, dy = phase_shift(ref, now)
    moved = fine.copy()
    moved[:, 2] -= fine[:, :2] @ (dx, dy)
    then, seen_then = warped(other, moved, ref.shape)
    best = moved if correlation(ref, then, seen_then) > correlation(ref, now, seen) else fine
    best[:, 2] /= up
    return best


def equalised(light: np.ndarray, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Adaptive equalisation of 8-bit values: clipped histograms of grid (columns, rows) cells, interpolated between their centres."""
    h, w = light.shape
    across, down = grid
    ch, cw = -(-h // down), -(-w // across)
    whole = np.pad(light, ((0, ch * down - h), (0, cw * across - w)), mode="symmetric")
    tables = np.empty((down, across, 256))
    limit = max(int(clip * ch * cw / 256), 1)
    for j in range(down):
        for i in range(across):
            count = np.bincount(whole[j * ch : (j + 1) * ch, i * cw : (i + 1) * cw].ravel(), minlength=256)
            over = int(np.maximum(count - limit, 0).sum())
            count = np.minimum(count, limit) + over // 256
            rest = over % 256
            if rest:
                step = max(256 // rest, 1)
                count[np.arange(0, 256, step)[:rest]] += 1
            tables[j, i] = np.clip(np.rint(np.cumsum(count) * (255 / (ch * cw))), 0, 255)
    y, x = (np.arange(h) / ch - 0.5), (np.arange(w) / cw - 0.5)
    y1, x1 = np.floor(y).astype(int), np.floor(x).astype(int)
    ay, ax = (y - y1)[:, None], (x - x1)[None, :]
    of = lambda j, i: tables[np.clip(j, 0, down - 1)[:, None], np.clip(i, 0, across - 1)[None, :], light]
    top, bottom = (of(y1 + k, x1) * (1 - ax) + of(y1 + k, x1 + 1) * ax for k in (0, 1))
    return np.clip(np.rint(top * (1 - ay) + bottom * ay), 0, 255).astype(np.uint8)


#: Hues of brown, least saturation and value, largest value, and how much more saturated it gets.
BROWN_HUES, BROWN_LEAST, BROWN_MOST, BROWN_GAIN = (5, 22), 40, 220, 1.5


def enhanced(image: np.ndarray, clip: float = 2.0, grid: tuple[int, int] = (8, 8)) -> np.ndarray:
    """An overview whose lightness is equalised and whose brown is more saturated, so that pale cores stand out.

    Lightness is luma; colours are scaled with it, which keeps hue and saturation.
    """
    rgb = np.asarray(image, float)
    luma = rgb @ (0.299, 0.587, 0.114)
    light = equalised(np.rint(luma).astype(np.uint8), clip, grid).astype(float)
    rgb = np.clip(rgb * ((light + 1) / (luma + 1))[..., None], 0, 255)
    most, least = rgb.max(2), rgb.min(2)
    spread = np.where(most > least, most - least, 1)
    r, g, b = np.moveaxis(rgb, 2, 0)
    hue = np.where(most == r, (g - b) / spread, np.where(most == g, 2 + (b - r) / spread, 4 + (r - g) / spread)) * 30 % 180
    saturation = np.where(most > 0, (most - least) / np.where(most > 0, most, 1), 0) * 255
    brown = (most > least) & (hue >= BROWN_HUES[0]) & (hue <= BROWN_HUES[1]) & (saturation >= BROWN_LEAST) & (most >= BROWN_LEAST) & (most <= BROWN_MOST)
    gain = np.where(brown, np.minimum(BROWN_GAIN, 255 / np.maximum(saturation, 1)), 1.0)[..., None]
    return np.clip(np.rint(most[..., None] - (most[..., None] - rgb) * gain), 0, 255).astype(np.uint8)


def regions(image: np.ndarray, share: float, round_only: bool = False, roundness: float = 0.0) -> list[tuple[float, float, float, float]]:
    """Boxes of dark regions of a blurred overview as shares of its sides (x, y, w, h), of share of its area or more."""
    grey = np.rint(np.asarray(image, float) @ (0.299, 0.587, 0.114))
    sigma = 0.3 * ((13 - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-(np.arange(-6, 7) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(grey, [(6, 6) if k == axis else (0, 0) for k in (0, 1)], mode="reflect" if min(grey.shape) > 6 else "edge")
        grey = sum(c * np.take(padded, np.arange(k, k + grey.shape[axis]), axis=axis) for k, c in enumerate(kernel))
    grey = np.rint(grey).astype(np.uint8)
    h, w = grey.shape
    found = [o for o in outlines(grey <= otsu(grey)) if o.area >= share * h * w and (not round_only or o.length and o.circularity >= roundness)]
    return [(o.box[0] / w, o.box[1] / h, o.box[2] / w, o.box[3] / h) for o in found]


def cells(value: np.ndarray, brown: np.ndarray, least: int = 50, most: int | None = None, threshold: float | None = None) -> tuple[int, float]:
    """(positive cells, threshold) of a tile from its brightness and gate: inverted brightness above a threshold, small things and holes removed."""
    if brown.sum() < 10:
        return 0, 0.0
    dark = 255 - value
    threshold = float(otsu(dark[brown])) if threshold is None else threshold
    solid = large_only((dark > threshold) & brown, least)
    solid = ~large_only(~solid, max(1, least // 2))
    own, n = labels(solid)
    sizes = np.bincount(own.ravel(), minlength=n + 1)[1:]
    return int(((sizes >= least) & (sizes <= (most or np.inf))).sum()), threshold
