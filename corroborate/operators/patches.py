"""Pictures of any size cut into patches, and what the patches say together.

A picture (key, height, width, data binary of RGB bytes by rows) is cut inside the task that holds it; only numbers leave the
task, one row for each patch, and a few pictures are held at a time. How patches agree is left to aggregates: the median and
the deviation of a picture's patches, and the score damped where they are too much alike. Pictures without bytes, or
whose bytes don't fit their size, have no patches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import band_anomaly, consistency_damping
from .pixels import filter_bank, grey, grid_places, laplacian_variance, patch_places
from .signal import EPS, bands

#: Pictures whose patches make up one batch of rows.
AT_ONCE = 64


def boxes(height: int, width: int, kind: str = "overlapping", size: int = 224, overlap: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(y1, x1, y2, x2) of the patches: squares that overlap by a share of their side, or a grid of three by three."""
    if kind == "grid":
        return grid_places(height, width)
    return [(y, x, min(y + size, height), min(x + size, width)) for y, x in patch_places(height, width, size, overlap)]


def feature_map(rgb: np.ndarray) -> np.ndarray:
    """Rows x columns x 64: log1p of the size of each block's coefficients, row-major by frequency; whole 8 x 8 blocks only."""
    h, w = rgb.shape[0] // 8, rgb.shape[1] // 8
    return np.log1p(np.abs(filter_bank(rgb))).reshape(h, w, 64)


def band_shares(rgb: np.ndarray, strict_reference: bool = False) -> tuple[float, float, float]:
    """Shares of the low, middle and high band in the coefficients of all blocks; none without a whole block."""
    energy = np.square(filter_bank(rgb)).sum(axis=0)
    three = [float(np.sqrt(energy[b].sum())) for b in bands(strict_reference)]
    return tuple(e / (sum(three) + EPS) for e in three)


def raw(height: int, width: int, data: bytes | None) -> np.ndarray | None:
    """Pixels from bytes of RGB by rows; None where they don't fit the size."""
    return None if data is None or height < 1 or width < 1 or len(data) != height * width * 3 else np.frombuffer(data, np.uint8).reshape(height, width, 3)


def patch_rows(pictures: DataFrame, key: str, kind: str = "overlapping", size: int = 224, overlap: float = 0.5, strict_reference: bool = False, columns: tuple[str, ...] = ("height", "width", "data"), decode: Callable[..., np.ndarray | None] = raw) -> DataFrame:
    """(key, patch, y, x, height, width, base, mid, high, luma, rough, log_energy): each patch's band shares, mean luminance,
    variance of the Laplacian, and mean of its feature map. ``decode`` makes the pixels of one picture from ``columns``, one at
    a time, so a table can hold pictures in any compact form; a picture it returns None for has no patches."""
    names = [key, "patch", "y", "x", "height", "width", "base", "mid", "high", "luma", "rough", "log_energy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in batches:
            for k, *stored in zip(b[key], *(b[c] for c in columns)):
                rgb = decode(*stored)
                if rgb is None:
                    continue
                for n, (y1, x1, y2, x2) in enumerate(boxes(*rgb.shape[:2], kind, size, overlap)):
                    part = rgb[y1:y2, x1:x2]
                    g, cells = grey(part), feature_map(part)
                    rows.append((k, n, y1, x1, y2 - y1, x2 - x1, *band_shares(part, strict_reference), float(g.mean()), laplacian_variance(g), float(cells.mean()) if cells.size else 0.0))
                held += 1
                if held == AT_ONCE:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names)

    kinds = dict(pictures.dtypes)[key]
    return pictures.select(key, *columns).mapInPandas(run, f"{key} {kinds}, patch int, y int, x int, height int, width int, base double, mid double, high double, luma double, rough double, log_energy double")


def scored(rows: DataFrame) -> DataFrame:
    """``patch_rows`` with a score: how far the bands lie beyond those of natural pictures."""
    return rows.withColumn("score", band_anomaly(F.col("base"), F.col("mid"), F.col("high")))


def agreement(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """(key, n, median, mean, std, damped): the true median of a picture's patch scores, their mean and population deviation,
    and the mean damped where patches are too much alike to hold a local fault."""
    g = rows.groupBy(key).agg(F.count(score).alias("n"), F.median(score).alias("median"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return g.withColumn("damped", consistency_damping(F.col("mean"), F.col("std")))


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull of whole points, by rising angle; points on its edges are left out."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return half(p) + half(p[::-1])


def region_mean(cells: np.ndarray, points: list[tuple[float, float]], margin: int = 5) -> float:
    """Mean of a map's cells in or on the convex hull of points (x, y) in any order, brought inside the map by ``margin``; of
    fewer than three points, the mean at the points, and 0 of none."""
    h, w = cells.shape
    inside = [(int(np.clip(x, margin, w - margin - 1)), int(np.clip(y, margin, h - margin - 1))) for x, y in points]
    if len(inside) < 3:
        return float(np.mean([cells[y, x] for x, y in inside])) if inside else 0.0
    ring = hull(inside)
    if len(ring) < 3:  # all on one line: the cells of the line between its ends
        (x1, y1), (x2, y2) = ring[0], ring[-1]
        n = max(abs(x2 - x1), abs(y2 - y1)) + 1
        return float(cells[np.rint(np.linspace(y1, y2, n)).astype(int), np.rint(np.linspace(x1, x2, n)).astype(int)].mean())
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    y, x = np.mgrid[min(ys) : max(ys) + 1, min(xs) : max(xs) + 1]
    within = np.ones(y.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        within &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0
    return float(cells[y[within], x[within]].mean())


def region_scores(maps: DataFrame, key: str, regions: dict[str, list[int]]) -> DataFrame:
    """(key, region, score) from rows (key, height, width, cells array<double> by rows, landmarks array<array<double>>): a region is
    the hull of its landmarks; those that a face lacks are left out. ``forensic.boundary`` takes these rows. Rows without a map or
    landmarks, or with a map of another size than told, are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h, w, cells, marks in zip(b[key], b["height"], b["width"], b["cells"], b["landmarks"]):
                if cells is None or marks is None or h < 1 or w < 1 or len(cells) != h * w:
                    continue
                own = np.asarray(cells, float).reshape(h, w)
                margin = min(5, (min(h, w) - 1) // 2)
                out += [(k, name, region_mean(own, [tuple(marks[i]) for i in at if i < len(marks)], margin)) for name, at in regions.items()]
            yield pd.DataFrame(out, columns=[key, "region", "score"])

    return maps.select(key, "height", "width", "cells", "landmarks").mapInPandas(run, f"{key} {dict(maps.dtypes)[key]}, region string, score double")
