"""Pictures put together from pictures: side by side, with a scale bar, with a grid over them."""

from __future__ import annotations

import numpy as np


def side_by_side(images: list[np.ndarray], gap: int = 8) -> np.ndarray:
    """Images in a row on white, aligned at the top."""
    height = max(v.shape[0] for v in images)
    parts = []
    for v in images:
        whole = np.full((height, v.shape[1] + gap, 3), 255, np.uint8)
        whole[: v.shape[0], : v.shape[1]] = v
        parts.append(whole)
    return np.concatenate(parts, 1)[:, : -gap or None]


def with_scale_bar(image: np.ndarray, microns: float, mpp: float, place: str = "bottom_left") -> np.ndarray:
    """A white bar with end ticks: as long as microns are, two fifths of the image at most, 20 pixels at least, inside the image."""
    out = np.array(image, np.uint8)
    h, w = out.shape[:2]
    length = min(max(min(int(microns / mpp), int(w * 0.40)), 20), w)
    thick, margin = max(2, int(w * 0.006)), max(15, int(w * 0.03))
    tick = 3 * thick
    vertical, _, horizontal = place.partition("_")
    x = {"left": margin, "right": w - margin - length}.get(horizontal, margin)
    y = margin if vertical == "top" else h - margin - tick
    x, y = max(0, min(x, w - length)), max(0, min(y, h - tick))
    middle = y + tick // 2
    out[max(0, middle - thick // 2) : middle - thick // 2 + thick, x : x + length] = 255
    for end in (x, x + length - thick):
        out[y : y + tick, max(0, end) : end + thick] = 255
    return out


def with_grid(image: np.ndarray, density: int, kept: set[int], colour: tuple[int, int, int] = (0, 158, 115)) -> np.ndarray:
    """The borders of the kept cells of a density x density grid, numbered by rows."""
    out = np.array(image, np.uint8)
    h, w = out.shape[:2]
    for cell in kept:
        row, column = divmod(cell, density)
        top, bottom, left, right = row * h // density, (row + 1) * h // density - 1, column * w // density, (column + 1) * w // density - 1
        if bottom < top or right < left:
            continue
        out[[top, bottom], left : right + 1] = colour
        out[top : bottom + 1, [left, right]] = colour
    return out
