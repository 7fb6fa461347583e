"""Scores of several views of one crop (as it is, mirrored, at another scale) and of several crops, brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import temperature_sigmoid

#: Fixed value: above this score of a wholly synthetic picture, the search for blended faces is left out.
SKIP_ABOVE = 0.90


def averaged(views: DataFrame, key: str = "case_id", crop: str = "face", temperature: float = 1.0) -> DataFrame:
    """(key, crop, n_views, logit, score): the mean of a crop's logits over its views, then the calibrated score. Null logits
    are views that gave nothing; a crop without any has null scores."""
    g = views.groupBy(key, crop).agg(F.count("logit").alias("n_views"), F.avg("logit").alias("logit"))
    return g.withColumn("score", temperature_sigmoid(F.col("logit"), temperature))


def worst(crops: DataFrame, key: str = "case_id", score: str = "score") -> DataFrame:
    """(key, worst, real_prob, n_crops): the crop that looks most like a fake decides."""
    return crops.groupBy(key).agg(F.max(score).alias("worst"), F.count(score).alias("n_crops")).withColumn("real_prob", 1 - F.col("worst"))


def highest(views: DataFrame, key: str = "case_id", part: str = "patch", score: str = "score") -> DataFrame:
    """(key, n, mean, std): of each part the view that looks most like a fake, then mean and population deviation over parts."""
    g = views.groupBy(key, part).agg(F.max(score).alias("m"))
    return g.groupBy(key).agg(F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def skipped(synthetic: Column, real_prob: Column, confidence: Column) -> Column:
    """struct(skipped, real_prob, confidence): a picture that is almost surely synthetic as a whole is a fake, and the tool for
    blended faces doesn't run; a null score skips nothing."""
    skip = F.coalesce(synthetic > SKIP_ABOVE, F.lit(False))
    return F.struct(skip.alias("skipped"), F.when(skip, 0.0).otherwise(real_prob).alias("real_prob"), F.when(skip, 1.0).otherwise(confidence).alias("confidence"))
