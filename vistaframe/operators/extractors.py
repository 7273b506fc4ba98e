"""Texture and gradient features of grey images, as Arrow-batched NumPy.

``textures`` gives uniform local binary patterns (24 points on a circle of
radius 3) as normalised 26-bin histograms of tiles; ``gradients`` gives
histograms of oriented gradients of the image shrunk by ten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import map_batches
from .histograms import EPSILON

POINTS, RADIUS, TILE, STRIDE = 24, 3, 99, 100
BLOCK, ORIENTATIONS, CELL, CELLS = 10, 9, 8, 2


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """8-bit grey values of blue, green, red bytes."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels < 3:
        return x[:, :, 0]
    y = 0.299 * x[:, :, 2] + 0.587 * x[:, :, 1] + 0.114 * x[:, :, 0]
    return np.clip(np.floor(y + 0.5), 0, 255).astype(np.uint8)


def _sampled(image: np.ndarray, down: float, right: float) -> np.ndarray:
    """The image shifted by fractions of pixels, bilinear, 0 outside."""
    h, w = image.shape
    pad = RADIUS + 2
    p = np.pad(image, pad)
    r, c = int(np.floor(down)), int(np.floor(right))
    fr, fc = down - r, right - c
    part = lambda a, b: p[pad + r + a : pad + r + a + h, pad + c + b : pad + c + b + w]
    top = (1 - fc) * part(0, 0) + fc * part(0, 1)
    bottom = (1 - fc) * part(1, 0) + fc * part(1, 1)
    return (1 - fr) * top + fr * bottom


def uniform_patterns(tile: np.ndarray, points: int = POINTS, radius: float = RADIUS) -> np.ndarray:
    """A code for each pixel: the number of set points if they change at most twice
    along the circle, else points + 1."""
    image = tile.astype(float)
    angle = 2 * np.pi * np.arange(points) / points
    downs, rights = np.round(-radius * np.sin(angle), 5), np.round(radius * np.cos(angle), 5)
    bits = np.stack([_sampled(image, d, r) >= image for d, r in zip(downs, rights, strict=True)])
    changes = (bits[1:] != bits[:-1]).sum(0)
    return np.where(changes <= 2, bits.sum(0), points + 1)


def texture_vector(image: np.ndarray) -> list[float]:
    """Histograms of tiles of 99 by 99 that start at every hundredth pixel, in row-major order."""
    out: list[float] = []
    for top in range(0, image.shape[0], STRIDE):
        for left in range(0, image.shape[1], STRIDE):
            codes = uniform_patterns(image[top : top + TILE, left : left + TILE])
            counts = np.bincount(codes.ravel(), minlength=POINTS + 2).astype(float)
            out += (counts / (counts.sum() + EPSILON)).tolist()
    return out


def shrunk(image: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Means of whole blocks; edges are filled up with 0."""
    h, w = image.shape
    p = np.pad(image.astype(float), ((0, -h % block), (0, -w % block)))
    return p.reshape(p.shape[0] // block, block, p.shape[1] // block, block).mean((1, 3))


def gradient_vector(image: np.ndarray) -> list[float]:
    """Oriented gradients: cells of 8 by 8, sliding blocks of 2 by 2 cells, clipped at 0.2."""
    x = shrunk(image)
    down, right = np.zeros_like(x), np.zeros_like(x)
    down[1:-1] = x[2:] - x[:-2]
    right[:, 1:-1] = x[:, 2:] - x[:, :-2]
    size, angle = np.hypot(down, right), np.rad2deg(np.arctan2(down, right)) % 180
    rows, cols = x.shape[0] // CELL, x.shape[1] // CELL
    place = np.minimum((angle / (180 / ORIENTATIONS)).astype(int), ORIENTATIONS - 1)
    cells = np.zeros((rows, cols, ORIENTATIONS))
    for o in range(ORIENTATIONS):
        part = np.where(place == o, size, 0)[: rows * CELL, : cols * CELL]
        cells[:, :, o] = part.reshape(rows, CELL, cols, CELL).sum((1, 3)) / CELL**2
    out: list[float] = []
    for r in range(rows - CELLS + 1):
        for c in range(cols - CELLS + 1):
            v = cells[r : r + CELLS, c : c + CELLS].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            out += (v / np.sqrt((v**2).sum() + 1e-10)).tolist()
    return out


def _extracted(images: DataFrame, function) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heights, widths, channels, data = (c.to_pylist() for c in batch.columns)
            vectors = [function(grey(*x)) for x in zip(data, heights, widths, channels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float64()))], ["imageid", "vec"])

    return map_batches(images.select("image_id", "height", "width", "channels", "data"), kernel, "imageid string, vec array<double>")


def textures(images: DataFrame) -> DataFrame:
    """(imageid, vec) of the texture model."""
    return _extracted(images, texture_vector)


def gradients(images: DataFrame) -> DataFrame:
    """(imageid, vec) of the oriented-gradient model."""
    return _extracted(images, gradient_vector)
