"""Scalar expressions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    """Into [0, 1]; NaN becomes 1, as it compares as the greatest."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nearest(x: Column, digits: int) -> Column:
    """Rounded half up by the product with a power of ten, as SQL engines do it; ``F.round`` goes by the shortest decimal, so
    what lies a bit below a tie goes another way."""
    return F.round(x * 10.0**digits) / 10.0**digits


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded half up, with a shift far below the last digit: sums that are ties on paper fall on one side whatever the
    order their terms were added in."""
    return nearest(x + 10.0 ** -(digits + 3), digits)


def to_logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def from_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def band(score: Column, confidence: Column) -> Column:
    """What a reader sees: abstained, clear, inconclusive or suspicious."""
    return F.when(confidence <= 0, "ABSTAINED").when(score >= 0.70, "CLEAR").when(score >= 0.45, "INCONCLUSIVE").otherwise("SUSPICIOUS")


def ui_status(score: Column, confidence: Column, error: Column) -> Column:
    return F.when(error, "ERROR").when(confidence == 0, "ABSTAINED").when(score < 0.5, "SUSPICIOUS").otherwise("CLEAR")


def temperature_sigmoid(logit: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def parabolic_confidence(p: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), floor + 4 * (p - 0.5) * (p - 0.5)))


def dct_confidence(score: Column, z: Column) -> Column:
    return F.least(F.lit(0.95), 0.4 + 0.5 * F.pow((score - 0.5) / 0.45, 2) + F.when((z > 4.15) | (z < 1), 0.15).otherwise(0.0))


def dct_score(ratio: Column, z: Column, phone: Column) -> Column:
    return F.when(z < 4.15, F.least(F.lit(0.15), 0.15 * ratio)).when(phone, clamp((ratio - 0.96) / 0.04)).otherwise(clamp((ratio - 0.88) / 0.10))


def band_anomaly(base: Column, mid: Column, high: Column) -> Column:
    """Score of energy ratios beyond those of natural pictures."""
    return F.least(F.lit(1.0), 3 * F.greatest(F.lit(0.0), mid - 0.35) + 5 * F.greatest(F.lit(0.0), high - 0.20))


def consistency_damping(score: Column, std: Column) -> Column:
    """Scores that patches disagree on count less."""
    share = std / 0.06
    return F.when(score < 0.35, score).when(std >= 0.06, score).when(score >= 0.43, score * F.greatest(F.lit(0.2), share)).otherwise(score * (1 - 0.7 * (1 - F.sqrt(share))))


def recency_penalty(days: Column) -> Column:
    return F.least(F.exp(0.005 * F.greatest(days, F.lit(0))), F.lit(10.0))


def range_severity(value: Column, low: float, high: float) -> Column:
    """0 inside [low, high]; else how far outside, by the range's width, at most 1."""
    return F.when(value < low, F.least(F.lit(1.0), (low - value) / (high - low))).when(value > high, F.least(F.lit(1.0), (value - high) / (high - low))).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with fields x1, y1, x2, y2; 0 where both are empty."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, (w * h).cast("double") / union).otherwise(0.0)
