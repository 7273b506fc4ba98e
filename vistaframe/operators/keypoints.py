"""Scale-invariant keypoints and their descriptors, as Arrow-batched NumPy.

Written from the published method: extrema of differences of Gaussians over
octaves, refined once, without those of low contrast or on edges; orientations
from a weighted histogram of gradients; descriptors of 4 x 4 cells by 8
directions, interpolated, normalised, clipped at 0.2 and scaled to bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import map_batches
from .extractors import grey

INTERVALS, SIGMA, BLUR_BEFORE = 3, 1.6, 0.5
CONTRAST, EDGE, BORDER = 0.04, 10.0, 5
ORIENTATION_BINS, PEAK = 36, 0.8
CELLS, DIRECTIONS, CLIP, SCALE = 4, 8, 0.2, 512.0


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, separable, with edges mirrored."""
    radius = max(1, int(np.ceil(4 * sigma)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        p = np.pad(image, pad, mode="reflect" if image.shape[axis] > radius else "edge")
        n = image.shape[axis]
        image = sum(w * p.take(range(i, i + n), axis) for i, w in enumerate(k))
    return image


def doubled(image: np.ndarray) -> np.ndarray:
    """Twice the size, bilinear."""
    h, w = image.shape
    r, c = (np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, n - 1) for n in (h, w))
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None]
    return (1 - fr) * ((1 - fc) * image[r0][:, c0] + fc * image[r0][:, c1]) + fr * ((1 - fc) * image[r1][:, c0] + fc * image[r1][:, c1])


def pyramid(image: np.ndarray) -> list[np.ndarray]:
    """Octaves, each a stack of INTERVALS + 3 blurred images of the doubled image."""
    base = blurred(doubled(image), np.sqrt(max(SIGMA**2 - (2 * BLUR_BEFORE) ** 2, 0.01)))
    sigmas = SIGMA * 2 ** (np.arange(INTERVALS + 3) / INTERVALS)
    steps = np.sqrt(np.diff(sigmas**2))
    out = []
    for _ in range(max(1, int(round(np.log2(min(base.shape)))) - 2)):
        levels = [base]
        for s in steps:
            levels.append(blurred(levels[-1], s))
        out.append(np.stack(levels))
        base = levels[INTERVALS][::2, ::2]
        if min(base.shape) < 2 * BORDER + 2:
            break
    return out


def extrema(gaussians: np.ndarray) -> Iterator[tuple[float, float, float]]:
    """(interval, row, column), refined, of one octave."""
    d = np.diff(gaussians, axis=0)
    inner = d[1:-1, 1:-1, 1:-1]
    neighbours = [d[1 + i : d.shape[0] - 1 + i, 1 + r : d.shape[1] - 1 + r, 1 + c : d.shape[2] - 1 + c] for i in (-1, 0, 1) for r in (-1, 0, 1) for c in (-1, 0, 1) if (i, r, c) != (0, 0, 0)]
    least, most = np.minimum.reduce(neighbours), np.maximum.reduce(neighbours)
    found = (np.abs(inner) > 0.5 * CONTRAST / INTERVALS) & ((inner > most) | (inner < least))
    for i, r, c in np.argwhere(found) + 1:
        if not (BORDER <= r < d.shape[1] - BORDER and BORDER <= c < d.shape[2] - BORDER):
            continue
        x = d[i, r, c]
        g = np.array([d[i + 1, r, c] - d[i - 1, r, c], d[i, r + 1, c] - d[i, r - 1, c], d[i, r, c + 1] - d[i, r, c - 1]]) / 2
        ii, rr, cc = d[i + 1, r, c] + d[i - 1, r, c] - 2 * x, d[i, r + 1, c] + d[i, r - 1, c] - 2 * x, d[i, r, c + 1] + d[i, r, c - 1] - 2 * x
        ir = (d[i + 1, r + 1, c] - d[i + 1, r - 1, c] - d[i - 1, r + 1, c] + d[i - 1, r - 1, c]) / 4
        ic = (d[i + 1, r, c + 1] - d[i + 1, r, c - 1] - d[i - 1, r, c + 1] + d[i - 1, r, c - 1]) / 4
        rc = (d[i, r + 1, c + 1] - d[i, r + 1, c - 1] - d[i, r - 1, c + 1] + d[i, r - 1, c - 1]) / 4
        h = np.array([[ii, ir, ic], [ir, rr, rc], [ic, rc, cc]])
        if abs(np.linalg.det(h)) < 1e-18:
            continue
        shift = -np.linalg.solve(h, g)
        trace, det = rr + cc, rr * cc - rc * rc
        if np.abs(shift).max() > 0.6 or abs(x + g @ shift / 2) * INTERVALS < CONTRAST or det <= 0 or trace**2 * EDGE >= (EDGE + 1) ** 2 * det:
            continue
        yield i + shift[0], r + shift[1], c + shift[2]


def _gradients(level: np.ndarray, row: float, col: float, radius: int):
    """Offsets, sizes and directions of gradients around a point."""
    r0, c0 = int(round(row)), int(round(col))
    rows = np.arange(max(1, r0 - radius), min(level.shape[0] - 1, r0 + radius + 1))
    cols = np.arange(max(1, c0 - radius), min(level.shape[1] - 1, c0 + radius + 1))
    r, c = (x.ravel() for x in np.meshgrid(rows, cols, indexing="ij"))
    down, right = level[r + 1, c] - level[r - 1, c], level[r, c + 1] - level[r, c - 1]
    return r - row, c - col, np.hypot(down, right), np.arctan2(down, right) % (2 * np.pi)


def orientations(level: np.ndarray, sigma: float, row: float, col: float) -> list[float]:
    """Directions of the peaks of the gradient histogram."""
    dr, dc, size, angle = _gradients(level, row, col, int(round(4.5 * sigma)))
    if not len(size):
        return []
    weight = size * np.exp(-(dr**2 + dc**2) / (2 * (1.5 * sigma) ** 2))
    h = np.bincount((angle * ORIENTATION_BINS / (2 * np.pi)).round().astype(int) % ORIENTATION_BINS, weight, ORIENTATION_BINS)
    h = (np.roll(h, 2) + np.roll(h, -2)) / 16 + 4 * (np.roll(h, 1) + np.roll(h, -1)) / 16 + 6 * h / 16
    left, right = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= PEAK * h.max()) & (h > 0))
    return [float(((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * h[k] + right[k])) % ORIENTATION_BINS) * 2 * np.pi / ORIENTATION_BINS) for k in peaks]


def descriptor(level: np.ndarray, sigma: float, row: float, col: float, turn: float) -> np.ndarray:
    """128 numbers from 0 to 255."""
    width = 3 * sigma
    radius = int(round(min(width * np.sqrt(2) * (CELLS + 1) / 2, np.hypot(*level.shape))))
    dr, dc, size, angle = _gradients(level, row, col, radius)
    r = (-np.sin(turn) * dc + np.cos(turn) * dr) / width
    c = (np.cos(turn) * dc + np.sin(turn) * dr) / width
    rb, cb = r + CELLS / 2 - 0.5, c + CELLS / 2 - 0.5
    ok = (rb > -1) & (rb < CELLS) & (cb > -1) & (cb < CELLS)
    rb, cb = rb[ok], cb[ok]
    ob = ((angle[ok] - turn) % (2 * np.pi)) * DIRECTIONS / (2 * np.pi)
    w = size[ok] * np.exp(-(r[ok] ** 2 + c[ok] ** 2) / (0.5 * CELLS**2))
    out = np.zeros((CELLS + 2, CELLS + 2, DIRECTIONS))
    r0, c0, o0 = (np.floor(x).astype(int) for x in (rb, cb, ob))
    fr, fc, fo = rb - r0, cb - c0, ob - o0
    for i, wi in ((0, 1 - fr), (1, fr)):
        for j, wj in ((0, 1 - fc), (1, fc)):
            for o, wo in ((0, 1 - fo), (1, fo)):
                np.add.at(out, (r0 + i + 1, c0 + j + 1, (o0 + o) % DIRECTIONS), w * wi * wj * wo)
    v = out[1:-1, 1:-1].ravel()
    v = np.minimum(v, CLIP * max(np.linalg.norm(v), 1e-12))
    return np.minimum(np.floor(SCALE * v / max(np.linalg.norm(v), 1e-12)), 255.0)


def describe(image: np.ndarray) -> list[list[float]]:
    """Descriptors of all keypoints, by octave, interval, row and column."""
    out = []
    for gaussians in pyramid(image.astype(float) / 255):
        for i, row, col in extrema(gaussians):
            sigma = SIGMA * 2 ** (i / INTERVALS)
            level = gaussians[int(np.clip(round(i), 0, INTERVALS + 2))]
            out += [descriptor(level, sigma, row, col, turn).tolist() for turn in orientations(level, sigma, row, col)]
    return out


def keypoints(images: DataFrame) -> DataFrame:
    """(imageid, pos, vec): one row a descriptor; an image without keypoints has none."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image_id, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = describe(grey(data, height, width, channels))
                yield pa.RecordBatch.from_arrays([pa.array([image_id] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["imageid", "pos", "vec"])

    return map_batches(images.select("image_id", "height", "width", "channels", "data"), kernel, "imageid string, pos int, vec array<double>")
