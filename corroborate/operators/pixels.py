"""Statistics of pictures: rows (key, height, width, data binary of RGB bytes by rows), worked on by numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signal import bands, dct_matrix

# Thresholds of flags, skin tones in Cr and Cb, catchlights, patches.
SATURATION, CLIPPED, BYTES, BLUR, SMALL, DARK = 40.0, 0.15, 0.08, 10.0, 200_000, 50.0
SKIN_CR, SKIN_CB = (133, 173), (77, 127)
CATCHLIGHT_SIGMA, SIGMA_FLOOR, CATCHLIGHT_LEAST, CATCHLIGHT_AREA = 3.5, 5.0, 150.0, 2
HAIR_VARIANCE, HAIR_HUE = 250.0, (50, 170)
MEAN, STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luminance in whole numbers, as picture libraries round it."""
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14


def saturation(rgb: np.ndarray) -> np.ndarray:
    high, low = rgb.max(axis=-1).astype(float), rgb.min(axis=-1).astype(float)
    return np.floor(np.where(high > 0, 255 * (high - low) / np.maximum(high, 1), 0.0) + 0.5)


def hue(rgb: np.ndarray) -> np.ndarray:
    """0 to 179, two degrees a step."""
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    high, span = np.maximum(np.maximum(r, g), b), rgb.max(axis=-1).astype(float) - rgb.min(axis=-1)
    of = np.where(high == r, g - b, np.where(high == g, 2 * span + b - r, 4 * span + r - g))
    return np.where(span > 0, np.floor((60 * of / np.maximum(span, 1) % 360) / 2 + 0.5) % 180, 0.0)


def laplacian_variance(x: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian; edges mirror the picture without repeating the last line."""
    p = np.pad(x.astype(float), 1, mode="reflect" if min(x.shape) > 1 else "edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def coerced(x: np.ndarray) -> np.ndarray:
    """Samples as bytes; fractions up to 1 are taken for shares of 255."""
    if x.dtype == np.uint8:
        return x
    y = x.astype(float)
    if np.issubdtype(x.dtype, np.floating) and y.size and y.max() <= 1:
        y = y * 255
    return np.rint(y).clip(0, 255).astype(np.uint8)


def normalised(rgb: np.ndarray) -> np.ndarray:
    """Channels as networks take them: shares of 255, less the mean, over the deviation."""
    return (rgb / 255 - MEAN) / STD


def gradient(luma: np.ndarray) -> tuple[float, float]:
    """(direction in degrees, magnitude) of the mean gradient, weighted by magnitude, by 5 x 5 Sobel masks."""
    smooth, slope = np.array([1, 4, 6, 4, 1.0]), np.array([-1, -2, 0, 2, 1.0])
    p = np.pad(luma.astype(float), 2, mode="reflect" if min(luma.shape) > 2 else "edge")
    windows = np.lib.stride_tricks.sliding_window_view(p, (5, 5))
    gx, gy = np.einsum("hwij,i,j->hw", windows, smooth, slope), np.einsum("hwij,i,j->hw", windows, slope, smooth)
    size = np.hypot(gx, gy)
    w = size / (size.sum() + 1e-10)
    x, y = float((gx * w).sum()), float((gy * w).sum())
    return float(np.degrees(np.arctan2(y, x)) % 360), float(np.hypot(x, y))


def chroma(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = 0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]
    bytes_ = lambda v: np.clip(np.floor(v + 0.5), 0, 255)
    return bytes_((rgb[..., 0] - y) * 0.713 + 128), bytes_((rgb[..., 2] - y) * 0.564 + 128)


def skin(rgb: np.ndarray) -> np.ndarray:
    cr, cb = chroma(rgb)
    return (cr >= SKIN_CR[0]) & (cr <= SKIN_CR[1]) & (cb >= SKIN_CB[0]) & (cb <= SKIN_CB[1])


def in_rgb(picture: np.ndarray) -> np.ndarray:
    """Channels turned around where the first is much darker than the last and both vary: such pictures come as BGR."""
    first, last = picture[..., 0].astype(float), picture[..., 2].astype(float)
    return picture[..., ::-1] if first.mean() < last.mean() * 0.9 and first.var() > 50 and last.var() > 50 else picture


def catchlight(iris: np.ndarray) -> tuple[float, float] | None:
    """Offset of the largest bright spot's centre from the middle of a square, in halves of its side; None without a spot of
    two pixels or more. Pixels that touch, also at a corner, are one spot."""
    g = grey(iris).astype(float)
    bright = g >= max(np.median(g) + CATCHLIGHT_SIGMA * max(g.std(), SIGMA_FLOOR), CATCHLIGHT_LEAST)
    label, number = np.zeros(g.shape, int), 0
    for start in zip(*np.nonzero(bright)):
        if not label[start]:
            number += 1
            todo = [start]
            label[start] = number
            while todo:
                y, x = todo.pop()
                for v in range(max(0, y - 1), min(g.shape[0], y + 2)):
                    for u in range(max(0, x - 1), min(g.shape[1], x + 2)):
                        if bright[v, u] and not label[v, u]:
                            label[v, u] = number
                            todo.append((v, u))
    areas = np.bincount(label.ravel(), minlength=1)[1:]
    if not len(areas) or areas.max() < CATCHLIGHT_AREA:
        return None
    y, x = np.nonzero(label == int(areas.argmax()) + 1)
    half = len(g) / 2
    return float((x.mean() - half) / half), float((y.mean() - half) / half)


def hair(roi: np.ndarray) -> bool:
    """A region too rough for skin, or one of other hues that is nearly so."""
    if not roi.size:
        return True
    rough, h = laplacian_variance(grey(roi)), hue(roi)
    other = float(((h > HAIR_HUE[0]) & (h < HAIR_HUE[1])).mean())
    return rough > HAIR_VARIANCE or (other > 0.6 and rough > HAIR_VARIANCE * 0.7)


def patch_places(height: int, width: int, size: int = 224, overlap: float = 0.5) -> list[tuple[int, int]]:
    """Corners (row, column) of square patches that overlap; one for a picture that fits in a patch."""
    if height <= size and width <= size:
        return [(0, 0)]
    step = int(size * (1 - overlap))
    return [(y, x) for y in range(0, max(height - size + 1, 1), step) for x in range(0, max(width - size + 1, 1), step)]


def grid_places(height: int, width: int, grid: int = 3, cover: float = 0.65, least: int = 32) -> list[tuple[int, int, int, int]]:
    """Boxes (y1, x1, y2, x2) of grid x grid patches, each covering a share of the sides."""
    h, w = int(height * cover), int(width * cover)
    down, across = (height - h) // max(grid - 1, 1), (width - w) // max(grid - 1, 1)
    every = [(i * down, j * across, min(i * down + h, height), min(j * across + w, width)) for i in range(grid) for j in range(grid)]
    return [b for b in every if b[2] - b[0] >= least and b[3] - b[1] >= least] or [(0, 0, height, width)]


def filter_bank(rgb: np.ndarray) -> np.ndarray:
    """Blocks x 64: the coefficients of all whole 8 x 8 blocks of the picture's luma (shares of 1), row-major by frequency."""
    luma = rgb @ np.array([0.2126, 0.7152, 0.0722]) / 255
    h, w = luma.shape[0] // 8, luma.shape[1] // 8
    blocks = luma[: h * 8, : w * 8].reshape(h, 8, w, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    return (dct_matrix() @ blocks @ dct_matrix().T).reshape(-1, 64)


def polygon_mean(cells: np.ndarray, points: list[tuple[float, float]]) -> float:
    """Mean over the cells in or on the convex hull's outline of points (x, y) given in order; of fewer than three points, the
    mean at the points."""
    p = np.array([(int(x), int(y)) for x, y in points]).reshape(-1, 2)
    if len(p) < 3:
        return float(cells[p[:, 1], p[:, 0]].mean()) if len(p) else 0.0
    y, x = np.indices(cells.shape)
    after = np.roll(p, -1, axis=0)
    turn = np.stack([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(p, after)])
    inside = (turn >= 0).all(axis=0) | (turn <= 0).all(axis=0)
    return float(cells[inside].mean()) if inside.any() else 0.0


def statistics(pictures: DataFrame, key: str) -> DataFrame:
    """(key, pixels, saturation, black, white, blur, brightness, r, g, b, angle, gradient, skin, hair, base, mid, high) of each
    picture: means, shares of black and white pixels, variance of the Laplacian, mean colour, direction of light, share of
    skin, whether it looks like hair, and energies of its frequency bands."""
    names = ["pixels", "saturation", "black", "white", "blur", "brightness", "r", "g", "b", "angle", "gradient", "skin", "hair", "base", "mid", "high"]

    def one(h: int, w: int, data: bytes) -> tuple:
        rgb = np.frombuffer(data, np.uint8).reshape(h, w, 3)
        g, n = grey(rgb), h * w
        energy = np.square(filter_bank(rgb)).sum(axis=0)
        three = [float(np.sqrt(energy[band].sum())) for band in bands()]
        return (n, float(saturation(rgb).mean()), float((g == 0).sum()) / n, float((g == 255).sum()) / n, laplacian_variance(g), float(g.mean()), *rgb.reshape(-1, 3).mean(axis=0).tolist(), *gradient(g), float(skin(rgb).mean()), hair(rgb), *three)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *one(h, w, d)) for k, h, w, d in zip(b[key], b["height"], b["width"], b["data"])]
            yield pd.DataFrame(rows, columns=[key, *names])

    kinds = ["long", *["double"] * 11, "boolean", *["double"] * 3]
    return pictures.select(key, "height", "width", "data").mapInPandas(run, f"{key} {dict(pictures.dtypes)[key]}, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def evasion_flags(stats: DataFrame, length: Column) -> Column:
    """array<string> of what hides traces, from ``statistics`` columns and the file's bytes (null if unknown)."""
    rules = [
        ("GRAYSCALE", F.col("saturation") < SATURATION), ("CLIPPED_BLACK", F.col("black") > CLIPPED), ("CLIPPED_WHITE", F.col("white") > CLIPPED), ("COMPRESSION", length / F.col("pixels") < BYTES), ("HEAVY_BLUR", F.col("blur") < BLUR),
        ("LOW_RES", F.col("pixels") < SMALL), ("LOW_LIGHT", F.col("brightness") < DARK),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in rules]))


def images(spark, path: str) -> DataFrame:
    """(path, height, width, data) of the pictures that Spark's source can decode, as RGB without alpha; others are left out."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for o, h, w, n, d in zip(b["origin"], b["height"], b["width"], b["nChannels"], b["data"]):
                x = np.frombuffer(d, np.uint8).reshape(h, w, n)  # BGR, BGRA or grey
                rgb = np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]
                out.append((o, h, w, np.ascontiguousarray(rgb).tobytes()))
            yield pd.DataFrame(out, columns=["path", "height", "width", "data"])

    return rows.mapInPandas(run, "path string, height int, width int, data binary")
