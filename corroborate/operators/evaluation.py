"""Classifier evaluation: confusion, rates, tie-aware area under the curve, balanced samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores whose counts are summed on their own.
RANGES = 4096


def confusion(rows: DataFrame) -> DataFrame:
    """One row from (y, predicted), 0 or 1: tp, tn, fp, fn, total, accuracy, precision, recall, f1; 0 where undefined."""
    is_ = lambda y, p: F.count_if((F.col("y") == y) & (F.col("predicted") == p))
    g = rows.agg(is_(1, 1).alias("tp"), is_(0, 0).alias("tn"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"))
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    rates = [(over(tp + tn, tp + tn + fp + fn), "accuracy"), (over(tp, tp + fp), "precision"), (over(tp, tp + fn), "recall"), (over(2 * tp, 2 * tp + fp + fn), "f1")]
    return g.select("*", (tp + tn + fp + fn).alias("total"), *[F.round(r, 6).alias(n) for r, n in rates])


def roc_auc(rows: DataFrame) -> DataFrame:
    """(n_pos, n_neg, auc) from (y, score); ties count half; null with one class only.

    Scores are counted first, so what is ranked are distinct scores; the ranks come from counts of ranges of scores
    and running sums inside each, so no task gets all of them."""
    counts = rows.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    dealt = counts.withColumn("range", F.floor(F.col("score") * RANGES))
    totals = dealt.groupBy("range").agg(F.sum("n").alias("t"))
    before = totals.select("range", F.coalesce(F.sum("t").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("inside", inside).join(F.broadcast(before), "range")
    g = ranked.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2)).alias("u"))
    return g.select("n_pos", "n_neg", F.round(F.try_divide(F.col("u"), F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def balanced_sample(rows: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each class, by a hash of key and seed: the same rows each time."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("place") <= n)


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def matched(rows: DataFrame, verdict: str = "verdict", truth: str = "y") -> DataFrame:
    """Adds ``matched``: a verdict of FAKE stands for 1, any other for 0."""
    return rows.withColumn("matched", (F.col(verdict) == "FAKE").cast("int") == F.col(truth))
