"""Bounds-based early stopping: can tools that are still pending change the verdict?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims as d

CONFLICT, LEAST_EVIDENCE = 0.35, 0.10


def evaluate(scores: DataFrame, real_threshold: float = 0.5, fake_threshold: float = 0.5) -> DataFrame:
    """(case_id, stop, reason, confidence, score, lowest, highest) from (case_id, tool, fake, verified): one row for each
    tool that ran; ``fake`` null marks a tool that failed, which is neither scored nor pending."""
    dim = F.broadcast(d.tools(scores.sparkSession).select("tool", "registry_weight", "tier"))
    rows = scores.join(dim, "tool", "left")
    w, s = F.col("registry_weight"), F.col("fake")
    valid = w.isNotNull() & s.isNotNull()
    sum_ = lambda c: F.coalesce(F.sum(F.when(valid, c)), F.lit(0.0))
    everything = sum(t[2] for t in d.TOOLS)
    g = rows.groupBy("case_id").agg(
        F.max(F.coalesce("verified", F.lit(False))).alias("verified"), F.count_if(valid).alias("n"), sum_(w).alias("run"), (F.lit(everything) - F.coalesce(F.sum(w), F.lit(0.0))).alias("pending"), sum_(s * w).alias("sw"),
        sum_(2 * w * F.greatest(F.lit(0.0), s - 0.5)).alias("fake"), sum_(2 * w * F.greatest(F.lit(0.0), 0.5 - s)).alias("real"), F.max(F.coalesce(valid & (F.col("tier") == 3), F.lit(False))).alias("trusted"),
    )
    score = F.round(F.col("sw") / F.col("run"), 9)
    low, high = F.round(F.col("sw") / (F.col("run") + F.col("pending")), 9), F.round((F.col("sw") + F.col("pending")) / (F.col("run") + F.col("pending")), 9)
    g = g.withColumn("score", F.when(F.col("run") > 0, score)).withColumn("lowest", F.when(F.col("run") > 0, low)).withColumn("highest", F.when(F.col("run") > 0, high))
    most = F.greatest("fake", "real")
    conflict = (F.col("n") > 1) & (F.round(F.col("fake") + F.col("real"), 9) >= LEAST_EVIDENCE) & (most > 0) & (F.round(F.least("fake", "real") / F.when(most > 0, most), 9) > CONFLICT)
    is_real = (F.col("highest") < fake_threshold) & (F.col("score") < real_threshold)
    is_fake = (F.col("lowest") > real_threshold) & (F.col("score") > fake_threshold)
    reason = (
        F.when(F.col("verified"), "HALT_HARDWARE_VERIFIED").when((F.col("n") == 0) | (F.col("run") <= 0), "CONTINUE_AMBIGUOUS").when(conflict, "CONTINUE_ADVERSARIAL_CONFLICT")
        .when((is_real | is_fake) & ~F.col("trusted"), "CONTINUE_SECURITY_REQUIRED").when(is_real, "HALT_LOCKED_REAL").when(is_fake, "HALT_LOCKED_FAKE").otherwise("CONTINUE_AMBIGUOUS")
    )
    g = g.withColumn("reason", reason)
    confidence = F.when(F.col("reason") == "HALT_HARDWARE_VERIFIED", 1.0).when(F.col("reason") == "HALT_LOCKED_REAL", 1 - F.col("score")).otherwise(F.coalesce("score", F.lit(0.0)))
    rounded = [F.round(c, 6).alias(n) for n, c in (("confidence", confidence), ("score", F.col("score")), ("lowest", F.col("lowest")), ("highest", F.col("highest")))]
    return g.select("case_id", F.col("reason").startswith("HALT").alias("stop"), "reason", *rounded)


def pending_tools(evidence: DataFrame) -> DataFrame:
    """(case_id, tool) of the tools a case has no row of."""
    names = F.array(*map(F.lit, d.NAMES))
    done = evidence.groupBy("case_id").agg(F.collect_set("tool").alias("done"))  # ten values at most
    return done.select("case_id", F.explode(F.array_except(names, "done")).alias("tool"))


def unknown_tools(evidence: DataFrame) -> DataFrame:
    """(tool, n_rows) of names outside the registry."""
    return evidence.join(F.broadcast(d.tools(evidence.sparkSession).select("tool")), "tool", "left_anti").groupBy("tool").agg(F.count("*").alias("n_rows"))
