"""Gradient-histogram descriptors, image shrinking, feature pyramids and filter responses, as Arrow kernels over pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Unit vectors of the nine undirected orientations, the energy floor, the clip and the texture weight.
COS = (1.0000, 0.9397, 0.7660, 0.5000, 0.1736, -0.1736, -0.5000, -0.7660, -0.9397)
SIN = (0.0000, 0.3420, 0.6428, 0.8660, 0.9848, 0.9848, 0.8660, 0.6428, 0.3420)
EPS, CLIP, TEXTURE = 0.0001, 0.2, 0.2357


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def gradients(im: np.ndarray, sbin: int) -> tuple[np.ndarray, ...]:
    """(y, x, magnitude, orientation 0..17) of the visible inner pixels. Pixels beyond the image repeat its last inner one.

    im: (h, w) or (h, w, channels); of several channels the one with the strongest gradient counts, the first of equal ones.
    """
    im = np.asarray(im, np.float64)
    im = im[:, :, None] if im.ndim == 2 else im
    h, w = im.shape[:2]
    y, x = np.arange(1, half_up(h / sbin) * sbin - 1), np.arange(1, half_up(w / sbin) * sbin - 1)
    if h < 3 or w < 3 or not len(y) or not len(x):
        none = np.empty(0, int)
        return none, none, np.empty(0), none
    at = np.ix_(np.minimum(y, h - 2), np.minimum(x, w - 2))
    dy = (np.roll(im, -1, 0) - np.roll(im, 1, 0))[at]
    dx = (np.roll(im, -1, 1) - np.roll(im, 1, 1))[at]
    strength = dx * dx + dy * dy
    pick = strength.argmax(2)[:, :, None]
    dx, dy, v = (np.take_along_axis(a, pick, 2)[:, :, 0] for a in (dx, dy, strength))
    along = dx[:, :, None] * np.array(COS) + dy[:, :, None] * np.array(SIN)
    # candidates in the order in which they are compared: each direction before its opposite; none counts unless positive
    both = np.stack([along, -along], axis=3).reshape(*along.shape[:2], 18)
    best = both.argmax(2)
    orientation = np.where(both.max(2) > 0, best // 2 + 9 * (best % 2), 0)
    yy, xx = np.meshgrid(y, x, indexing="ij")
    return yy.ravel(), xx.ravel(), np.sqrt(v).ravel(), orientation.ravel()


def histogram(im: np.ndarray, sbin: int, interpolate: bool = True) -> np.ndarray:
    """(rows, columns, 18): magnitudes by cell and orientation. Interpolated, a pixel votes for its four nearest cell centres;
    else for the cell whose centre is next above and left of it. Votes outside the grid are lost."""
    rows, cols = half_up(im.shape[0] / sbin), half_up(im.shape[1] / sbin)
    y, x, v, o = gradients(im, sbin)
    out = np.zeros((rows, cols, 18))
    fy, fx = (y + 0.5) / sbin - 0.5, (x + 0.5) / sbin - 0.5
    cy, cx = np.floor(fy).astype(int), np.floor(fx).astype(int)
    votes = [(0, 0, v)]
    if interpolate:
        ay, ax = fy - cy, fx - cx
        votes = [(0, 0, (1 - ay) * (1 - ax) * v), (0, 1, (1 - ay) * ax * v), (1, 0, ay * (1 - ax) * v), (1, 1, ay * ax * v)]
    for dy, dx, vote in votes:
        r, c = cy + dy, cx + dx
        inside = (r >= 0) & (c >= 0) & (r < rows) & (c < cols)
        np.add.at(out, (r[inside], c[inside], o[inside]), vote[inside])
    return out


def hog(im: np.ndarray, sbin: int = 12, kind: str = "hog31") -> np.ndarray:
    """(rows - 2, columns - 2, dimensions) cell descriptors.

    hog31: 18 signed and 9 unsigned orientations and 4 textures; hog13: the unsigned ones and the textures; raw18: plain sums.
    """
    hist = histogram(im, sbin, kind != "raw18")
    rows, cols = max(0, hist.shape[0] - 2), max(0, hist.shape[1] - 2)
    inner = hist[1 : 1 + rows, 1 : 1 + cols]
    if kind == "raw18" or not rows or not cols:
        return inner if kind == "raw18" else np.zeros((rows, cols, 31 if kind == "hog31" else 13))
    unsigned = hist[:, :, :9] + hist[:, :, 9:]
    energy = (unsigned**2).sum(2)
    block = energy[:-1, :-1] + energy[1:, :-1] + energy[:-1, 1:] + energy[1:, 1:]
    scale = 1 / np.sqrt(block + EPS)
    # blocks in which the cell is first, first column only, first row only, last
    four = np.stack([scale[1 : rows + 1, 1 : cols + 1], scale[:rows, 1 : cols + 1], scale[1 : rows + 1, :cols], scale[:rows, :cols]], axis=2)
    clipped = lambda h: np.minimum(h[:, :, :, None] * four[:, :, None, :], CLIP)
    signed, plain = clipped(inner), clipped(inner[:, :, :9] + inner[:, :, 9:])
    texture = TEXTURE * signed.sum(2)
    parts = [0.5 * signed.sum(3)] if kind == "hog31" else []
    return np.concatenate([*parts, 0.5 * plain.sum(3), texture], axis=2)


KINDS = {"hog31": hog, "hog13": hog, "raw18": hog}


def describe(pages: DataFrame, sbin: int = 12, kind: str = "hog31") -> DataFrame:
    """(doc_id, r, c, feat) of pages (doc_id, h, w, pixels). KINDS maps a name to its function; others can be added to it."""
    f = KINDS[kind]

    def run(batches):
        for batch in batches:
            for p in batch.itertuples():
                d = f(np.frombuffer(p.pixels, np.uint8).reshape(p.h, p.w), sbin, kind)
                r, c = np.divmod(np.arange(d.shape[0] * d.shape[1]), max(1, d.shape[1]))
                yield pd.DataFrame({"doc_id": p.doc_id, "r": r, "c": c, "feat": pd.Series(list(d.reshape(len(r), d.shape[2])), dtype=object)})

    return pages.select("doc_id", "h", "w", "pixels").mapInPandas(run, "doc_id long, r int, c int, feat array<double>")


def overlap_weights(n: int, m: int) -> np.ndarray:
    """(m, n): the share of each of n unit cells in each of m equal stretches; slivers under a thousandth are left out."""
    step = n / m if m else 0.0
    lo, hi = np.arange(m)[:, None] * step, (np.arange(m)[:, None] + 1) * step
    shared = np.minimum(hi, np.arange(n) + 1) - np.maximum(lo, np.arange(n))
    return np.where(shared > 1e-3, shared, 0.0) * (m / n)


def shrink(im: np.ndarray, scale: float) -> np.ndarray:
    """Area average of an image at a scale of at most 1."""
    if scale > 1:
        raise ValueError("images are only made smaller")
    h, w = im.shape[:2]
    rows, cols = overlap_weights(h, half_up(h * scale)), overlap_weights(w, half_up(w * scale))
    return np.einsum("ih,hw...,jw->ij...", rows, np.asarray(im, np.float64), cols, optimize=True)


def bicubic(im: np.ndarray, height: int, width: int) -> np.ndarray:
    """Keys' cubic (a = -1/2), widened when the image shrinks; borders repeat."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = m / n
        wide = max(1.0, 1 / scale)
        centre = (np.arange(m) + 0.5) / scale - 0.5
        reach = int(np.ceil(2 * wide)) + 1
        taps = np.floor(centre)[:, None].astype(int) + np.arange(-reach, reach + 1)
        t = np.abs((centre[:, None] - taps) / wide)
        k = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
        k /= k.sum(1, keepdims=True)
        out = np.zeros((m, n))
        np.add.at(out, (np.repeat(np.arange(m), taps.shape[1]), np.clip(taps, 0, n - 1).ravel()), k.ravel())
        return out

    return weights(im.shape[0], height) @ np.asarray(im, np.float64) @ weights(im.shape[1], width).T


def pyramid_scales(h: int, w: int, interval: int = 10, largest: float = 1.0, smallest: float = 0.01, levels: int = 200, least_px: int = 5) -> list[float]:
    """Scales largest / 2^(i / interval), down to the smallest, to an image side of least_px, or to the number of levels."""
    out = []
    for i in range(levels):
        s = largest / 2 ** (i / interval)
        if s < smallest or min(half_up(h * s), half_up(w * s)) <= least_px:
            break
        out.append(s)
    return out


def pyramid(im: np.ndarray, sbin: int = 12, kind: str = "hog31", **options) -> list[tuple[float, np.ndarray]]:
    """(scale, descriptors) per level, with a border of one empty cell around each."""
    scales = pyramid_scales(*im.shape[:2], **options)
    return [(s, np.pad(hog(shrink(im, s), sbin, kind), ((1, 1), (1, 1), (0, 0)))) for s in scales]


def glyph_weights(feat: np.ndarray, fold: int = 4) -> np.ndarray:
    """Weights of a descriptor's glyphs: its groups of channels summed and negative sums cut."""
    return np.maximum(0, feat.reshape(*feat.shape[:-1], fold, -1).sum(-2))


def glyphs(weights: np.ndarray, size: int = 15) -> np.ndarray:
    """A picture of (rows, columns, orientations): each cell the sum of its orientations' bars, by weight."""
    rows, cols, n = weights.shape
    y, x = np.mgrid[:size, :size] - (size - 1) / 2
    bars = np.array([np.abs(np.cos(o * np.pi / n) * x + np.sin(o * np.pi / n) * y) <= 0.05 * size + 0.5 for o in range(n)], float)
    return np.einsum("rco,oij->ricj", weights, bars).reshape(rows * size, cols * size)
