"""Spectral and array features. Native where sums express them; numpy inside tasks for transforms."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


#: The rank of each cell of an 8 x 8 block in the zig-zag scan, by rows.
RANKS = [
    0, 1, 5, 6, 14, 15, 27, 28,
    2, 4, 7, 13, 16, 26, 29, 42,
    3, 8, 12, 17, 25, 30, 41, 43,
    9, 11, 18, 24, 31, 40, 44, 53,
    10, 19, 23, 32, 39, 45, 52, 54,
    20, 22, 33, 38, 46, 51, 55, 60,
    21, 34, 37, 47, 50, 56, 59, 61,
    35, 36, 48, 49, 57, 58, 62, 63,
]


@cache
def zigzag() -> list[int]:
    """Row-major positions of an 8 x 8 block in the order of the scan."""
    return sorted(range(64), key=RANKS.__getitem__)


def bands(strict_reference: bool = False) -> list[list[int]]:
    """Positions of the low, middle and high band: 21, 21 and 22. By the scan; or, if ``strict_reference``, the table of ranks
    read as if it were a table of positions, which mixes the frequencies but is what calibrations of old were made with."""
    order = RANKS if strict_reference else zigzag()
    return [order[:21], order[21:42], order[42:]]


def band_energies(block: Column, strict_reference: bool = False) -> list[Column]:
    """L2 energies of the low, middle and high band of a block of 64 coefficients."""
    return [F.sqrt(sum((F.pow(F.get(block, F.lit(k)).cast("double"), 2) for k in sorted(band)), F.lit(0.0))) for band in bands(strict_reference)]


def band_rows(blocks: DataFrame, key: str = "vec_id", block: str = "embedding", strict_reference: bool = False) -> DataFrame:
    """(key, base, mid, high): shares of the bands."""
    rows = blocks.select(key, *[e.alias(n) for n, e in zip(("e0", "e1", "e2"), band_energies(F.col(block), strict_reference))])
    total = F.col("e0") + F.col("e1") + F.col("e2") + EPS
    return rows.select(key, *[F.round(F.col(e) / total, 6).alias(n) for n, e in (("base", "e0"), ("mid", "e1"), ("high", "e2"))])


def calibration(bands: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each band's share, and the number of rows."""
    names = ("base", "mid", "high")
    return bands.agg(*[F.round(F.avg(n), 6).alias(f"mean_{n}") for n in names], *[F.round(F.stddev_pop(n), 6).alias(f"std_{n}") for n in names], F.count("*").alias("num_samples"))


#: Deviations that count as an anomaly, and the share of the high band that does where no calibration is known.
Z_ANOMALY, HIGH_SHARE = 1.5, 0.15


def z_scores(bands: DataFrame, means: dict[str, float] | None = None, stds: dict[str, float] | None = None) -> DataFrame:
    """Bands with z_base, z_mid, z_high, anomaly, anomaly_type: the high band first, then the low one, in either direction.
    Without calibration the z columns are null, and only a large share of the high band is an anomaly."""
    if means is None or stds is None:
        none = F.lit(None).cast("double")
        high = F.col("high") > HIGH_SHARE
        return bands.select("*", *[none.alias(f"z_{n}") for n in ("base", "mid", "high")], high.alias("anomaly"), F.when(high, "high_freq").alias("anomaly_type"))
    z = {n: F.when(F.lit(stds[n]) >= 1e-8, (F.col(n) - means[n]) / (stds[n] or 1.0)).otherwise(0.0) for n in means}
    kind = F.when(F.abs(z["high"]) > Z_ANOMALY, "high_freq").when(F.abs(z["base"]) > Z_ANOMALY, "low_freq")
    return bands.select("*", *[F.round(v, 6).alias(f"z_{n}") for n, v in z.items()], kind.isNotNull().alias("anomaly"), kind.alias("anomaly_type"))


def probe(vectors: DataFrame, weights: list[float], bias: float, temperature: float = 1.0, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, probability, confidence) of a linear probe on the L2-normalised vector."""
    from ..functions.scores import parabolic_confidence, temperature_sigmoid

    x = [F.get(F.col(column), F.lit(k)).cast("double") for k in range(len(weights))]
    norm = F.sqrt(sum((v * v for v in x), F.lit(0.0)))
    dot = sum((v * F.lit(w) for v, w in zip(x, weights)), F.lit(0.0))
    logit = F.when(norm > 0, dot / norm).otherwise(0.0) + bias
    rows = vectors.select(key, temperature_sigmoid(logit, temperature).alias("p"))
    return rows.select(key, F.round("p", 6).alias("probability"), F.round(parabolic_confidence(F.col("p"), 0.3), 6).alias("confidence"))


@cache
def dct_matrix(n: int = 8) -> np.ndarray:
    k, i = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


@cache
def _low_frequencies() -> np.ndarray:
    """64 x 20: what takes the pixels of a block to its coefficients of order 1 to 5."""
    m = dct_matrix()
    i, j = np.indices((8, 8))
    return np.einsum("ax,by->xyab", m, m)[:, :, (i + j > 0) & (i + j <= 5)].reshape(64, -1)


def peak_ratios(grey: np.ndarray) -> np.ndarray:
    """8 x 8: for each offset of the block grid (rows down, columns across), the periodicity of its rounded low-frequency
    coefficients: the largest autocorrelation of their histogram beyond the centre and its neighbours, over the centre. The
    blocks of all offsets in one row of blocks are transformed in one product."""
    h, w = grey.shape
    out = np.zeros((8, 8))
    if h < 8 or w < 8:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(grey, (8, 8))
    for dy in range(min(8, h - 7)):
        c = np.rint(windows[dy::8].reshape(-1, 64) @ _low_frequencies()).reshape(len(windows[dy::8]), w - 7, -1)
        hist = np.zeros((8, 513))
        for dx in range(min(8, w - 7)):
            x = c[:, dx::8].ravel()
            hist[dx] = np.bincount((x[np.abs(x) <= 256] + 256).astype(np.int64), minlength=513)
        power = np.abs(np.fft.rfft(hist, 1024, axis=1)) ** 2
        auto = np.rint(np.fft.irfft(power, 1024, axis=1)[:, :257])  # whole numbers: counts of equal distances
        out[dy] = np.where(auto[:, 0] > 0, auto[:, 2:].max(axis=1) / np.maximum(auto[:, 0], 1), 0.0)
    return out


def dct_peaks(crops: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, dy, dx, ratio, z, n_crops) from grey crops (key, crop, h, w, data binary): the grid of the greatest ratio in the
    first crop, then the mean over all crops of the ratio at that grid and of its z-score against all 64 offsets."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("crop")
        every = [peak_ratios(np.frombuffer(d, np.uint8).reshape(h, w).astype(np.float32).astype(float)) for h, w, d in zip(b["h"], b["w"], b["data"])]
        dy, dx = divmod(int(np.argmax(every[0])), 8)
        at = [float(r[dy, dx]) for r in every]
        z = [(x - r.mean()) / r.std() if r.std() > 1e-10 else 0.0 for x, r in zip(at, every)]
        return pd.DataFrame([(b[key].iloc[0], dy, dx, round(float(np.mean(at)), 6), round(float(np.mean(z)), 6), len(at))], columns=[key, "dy", "dx", "ratio", "z", "n_crops"])

    return crops.select(key, "crop", "h", "w", "data").groupBy(key).applyInPandas(run, f"{key} {dict(crops.dtypes)[key]}, dy int, dx int, ratio double, z double, n_crops int")


#: Frames that a pulse needs at least, length of its transform, band of heart rates in Hz, share of motion.
MIN_FRAMES, TRANSFORM, BAND, MOTION, MOTION_HZ, FLAT = 90, 2048, (0.7, 2.5), 0.75, 0.5, 1e-5
#: Frames that are looked at for light, and the mean grey below which there is too little.
CHECKED, DARK = 15, 50.0


def pos_signal(rgb: np.ndarray) -> np.ndarray:
    """Pulse signal of mean colours (frames x 3): colours over their means, projected on the plane orthogonal to skin tone,
    both projections brought to one scale and added, standardised."""
    c = rgb / np.maximum(rgb.mean(axis=0), 1.0)
    x, y = c[:, 1] - c[:, 2], c[:, 1] + c[:, 2] - 2 * c[:, 0]
    h = x + x.std() / (y.std() + 1e-7) * y
    return np.nan_to_num((h - h.mean()) / (h.std() + 1e-7))


def _power(x: np.ndarray, n: int, fps: float) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.rfftfreq(n, 1 / fps), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)), n)) ** 2


def motion_share(green: np.ndarray, fps: float = 30.0) -> float:
    """Energy below half a hertz, over that and the energy of heart rates; 1 for a trace too short to tell."""
    if len(green) < MIN_FRAMES:
        return 1.0
    f, power = _power(np.asarray(green, float), max(256, len(green)), fps)
    slow, heart = power[f < MOTION_HZ].sum(), power[(f >= BAND[0]) & (f <= BAND[1])].sum()
    return float(slow / (slow + heart + 1e-10))


def pulse(signal: np.ndarray, fps: float = 30.0) -> tuple[float, float, float]:
    """(peak in Hz, SNR in dB of the five bins around it inside the band, concentration: peak over the band's median)."""
    x = np.asarray(signal, float)
    if x.std() < FLAT:
        return 0.0, -100.0, 0.0
    f, power = _power(x, TRANSFORM, fps)
    band = (f >= BAND[0]) & (f <= BAND[1])
    f, power = f[band], power[band]
    if not power.sum():
        return 0.0, -100.0, 0.0
    k = int(np.argmax(power))
    near = power[max(0, k - 2) : k + 3].sum()
    rest = power[: max(0, k - 2)].sum() + power[k + 3 :].sum()
    return float(f[k]), float(10 * np.log10(max(near, 1e-10) / max(rest, 1e-10))), float(power[k] / (np.median(power) + 1e-10))


def carried(traces: DataFrame, key: list[str], order: str = "frame", colours: tuple[str, ...] = ("r", "g", "b"), seed: float = 128.0) -> DataFrame:
    """Mean colours where a frame's region was empty (null): those of the last frame that had any, at first ``seed``."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return traces.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(seed)) for c in colours})


def pulse_metrics(traces: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, region, n, peak_hz, snr_db, concentration, std, flat, motion_share, moving) from mean colours (key, region, frame,
    r, g, b) of the skin regions of a face; nulls are carried. A trace holds the frames of one analysed clip (at most
    300), so a group is bounded. With fewer than 90 frames, or where the region is darker than ``DARK`` in any 15th frame that
    has it, there is no pulse: the metrics are null."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rgb = b.sort_values("frame")[["r", "g", "b"]].to_numpy(float)
        if len(rgb) < MIN_FRAMES or b["dark"].any():
            got: list = [None] * 4 + [True, 1.0, True]
        else:
            h, share = pos_signal(rgb), motion_share(rgb[:, 1])
            hz, snr, concentration = pulse(h)
            got = [hz, snr, concentration, float(rgb[:, 1].std()), bool(h.std() < FLAT), share, share > MOTION]
        return pd.DataFrame([(b[key].iloc[0], b["region"].iloc[0], len(rgb), *got)], columns=[key, "region", "n", "peak_hz", "snr_db", "concentration", "std", "flat", "motion_share", "moving"])

    kinds = dict(traces.dtypes)
    dark = (F.col("frame") % CHECKED == 0) & ((F.col("r") + F.col("g") + F.col("b")) / 3 < DARK)
    rows = traces.select(key, "region", "frame", "r", "g", "b", F.coalesce(dark, F.lit(False)).alias("dark"))
    rows = carried(rows, [key, "region"])
    return rows.groupBy(key, "region").applyInPandas(run, f"{key} {kinds[key]}, region {kinds['region']}, n long, peak_hz double, snr_db double, concentration double, std double, flat boolean, motion_share double, moving boolean")
