"""Patches of pictures and regions of maps against plain versions."""

import random

import numpy as np
import pytest

from corroborate import media_queries
from corroborate.operators import forensic, patches
from corroborate.oracle import SCAN
from corroborate.sources import bridge

from .conftest import SF

REGIONS = {"jaw": [0, 1, 2, 3], "cheek_l": [4, 5, 6], "nose_bridge": [7, 8], "hairline": [900], "cheek_r": [9, 10, 11, 12]}


def plain_coefficients(rgb):
    """Blocks x 64 by the sums that define the transform."""
    luma = (0.2126 * rgb[..., 0] + 0.7152 * rgb[..., 1] + 0.0722 * rgb[..., 2]) / 255
    n = np.arange(8)
    scale = lambda k: np.sqrt((1 if k == 0 else 2) / 8)
    wave = [scale(k) * np.cos(np.pi * (2 * n + 1) * k / 16) for k in range(8)]
    blocks = [luma[y : y + 8, x : x + 8] for y in range(0, luma.shape[0] - 7, 8) for x in range(0, luma.shape[1] - 7, 8)]
    return np.array([[float((np.outer(wave[u], wave[v]) * b).sum()) for u in range(8) for v in range(8)] for b in blocks])


def plain_patch(rgb):
    c = plain_coefficients(rgb)
    e = [np.sqrt(np.square(c[:, band]).sum()) for band in SCAN]
    base, mid, high = (x / (sum(e) + 1e-10) for x in e)
    return base, mid, high, float(np.log1p(np.abs(c)).mean()), min(1.0, 3 * max(0.0, mid - 0.35) + 5 * max(0.0, high - 0.20))


@pytest.fixture(scope="module")
def expected(spark):
    rows = bridge.table(spark, SF, "embeddings").orderBy("vec_id").limit(6).collect()
    out = {}
    for r in rows:
        rgb = bridge.large_picture(r.embedding)
        assert rgb.shape == (340, 236, 3)
        out[r.vec_id] = {(y, 0): plain_patch(rgb[y : y + 224, :224]) for y in (0, 112)}
    return out


def test_patches_of_the_query(spark, expected):
    got = media_queries.picture_patches(spark, SF)
    rows = got.where("vec_id < 6").collect()
    assert got.groupBy("vec_id").count().where("count = 2").count() == bridge.table(spark, SF, "embeddings").count()
    for r in rows:
        base, mid, high, log_energy, score = expected[r.vec_id][r.y, r.x]
        assert (r.base, r.mid, r.high, r.log_energy, r.score) == pytest.approx((base, mid, high, log_energy, score), abs=2e-6)


def test_agreement_and_calibration_of_the_queries(spark, expected):
    got = {r.vec_id: r for r in media_queries.picture_agreement(spark, SF).where("vec_id < 6").collect()}
    for k, places in expected.items():
        s = [p[4] for p in places.values()]
        mean, std = np.mean(s), np.std(s)
        damped = mean if mean < 0.35 or std >= 0.06 else mean * max(0.2, std / 0.06) if mean >= 0.43 else mean * (1 - 0.7 * (1 - np.sqrt(std / 0.06)))
        assert (got[k].n, got[k].median, got[k].mean, got[k].std, got[k].damped) == pytest.approx((2, np.median(s), mean, std, damped), abs=3e-6)
    rows = media_queries.picture_patches(spark, SF).collect()
    c = media_queries.picture_calibration(spark, SF).first()
    assert c.num_samples == len(rows) and c.mean_mid == pytest.approx(np.mean([r.mid for r in rows]), abs=2e-6) and c.std_high == pytest.approx(np.std([r.high for r in rows]), abs=2e-6)


def test_small_odd_and_missing_pictures(spark):
    rng = np.random.default_rng(1)
    rows = [(1, 8, 8, rng.integers(0, 256, 192, np.uint8).tobytes()), (2, 3, 5, bytes(45)), (3, 9, 9, b"short"), (4, 10, 10, None), (5, 0, 0, b""), (6, 230, 500, rng.integers(0, 256, 230 * 500 * 3, np.uint8).tobytes())]
    df = spark.createDataFrame([(k, h, w, bytearray(d) if d is not None else None) for k, h, w, d in rows], "k long, height int, width int, data binary")
    got = patches.scored(patches.patch_rows(df, "k")).collect()
    assert sorted((r.k, r.y, r.x, r.height, r.width) for r in got) == [(1, 0, 0, 8, 8), (2, 0, 0, 3, 5), (6, 0, 0, 224, 224), (6, 0, 112, 224, 224), (6, 0, 224, 224, 224)]
    grid = patches.patch_rows(df.where("k = 6"), "k", kind="grid").collect()
    assert sorted((r.y, r.x, r.height, r.width) for r in grid) == [(y, x, 149, 325) for y in (0, 40, 80) for x in (0, 87, 174)]
    assert patches.agreement(patches.scored(patches.patch_rows(df.where("k > 6"), "k")), "k").count() == 0


def test_regions_equal_points_in_polygons(spark):
    rng, random_ = np.random.default_rng(2), random.Random(2)
    cells = rng.random((60, 50))

    def crosses(ring, x, y):
        """On the same side of all edges of a ring, in either direction, or on one of them."""
        turns = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1])]
        return all(t >= 0 for t in turns) or all(t <= 0 for t in turns)

    for n in range(3, 12):
        points = [(random_.randint(5, 44), random_.randint(5, 54)) for _ in range(n)]
        got = patches.region_mean(cells, points)
        assert got == pytest.approx(patches.region_mean(cells, random_.sample(points, n)))  # any order
        ring = patches.hull(points)
        assert all(crosses(ring, *p) for p in points) and set(ring) <= set(points)
        want = [cells[y, x] for y in range(60) for x in range(50) if crosses(ring, x, y) and min(p[0] for p in ring) <= x <= max(p[0] for p in ring) and min(p[1] for p in ring) <= y <= max(p[1] for p in ring)]
        if len(ring) > 2:
            assert got == pytest.approx(np.mean(want))
    assert patches.region_mean(cells, []) == 0 and patches.region_mean(cells, [(7, 8)]) == cells[8, 7]
    assert patches.region_mean(cells, [(10, 10), (12, 10), (14, 10)]) == pytest.approx(cells[10, 10:15].mean())
    assert patches.region_mean(cells, [(-9, 8), (-3, 8)]) == cells[8, 5]  # brought inside

    marks = [[float(x), float(y)] for x, y in rng.integers(5, 44, (20, 2))]
    hot = np.zeros((60, 50))
    hot[:] = 0.9
    rows = [(1, 60, 50, hot.ravel().tolist(), marks), (2, 60, 50, None, marks), (3, 60, 50, [1.0], marks), (4, 60, 50, (hot * 0).ravel().tolist(), marks), (5, 60, 50, hot.ravel().tolist(), None)]
    df = spark.createDataFrame(rows, "case_id long, height int, width int, cells array<double>, landmarks array<array<double>>")
    found = forensic.boundary(patches.region_scores(df, "case_id", REGIONS)).collect()
    assert {(r.case_id, r.detected) for r in found} == {(1, True), (4, False)}
