"""Fusion: deduplicate evidence, route and weight it, and combine it to a score and a verdict.

Rows of a case are reduced to one for each tool by an aggregate with map-side combine, so a hot case costs at most ten
rows for each task before the shuffle; all later steps are windows and one aggregate over the case, on one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims as d
from ..functions.scores import clamp, from_logit, rounded, to_logit

_FIELDS = ["seq", "success", "real_prob", "confidence", "error", "error_msg", "peak_ratio", "c2pa_verified", "is_ai_generated", "liveness_label", "execution_time", "flags", "decision"]


def dedup(evidence: DataFrame, mode: str = "prefer_success") -> DataFrame:
    """One row for each case and tool. ``prefer_success``: the last success, else the last row; ``overwrite``: the last
    row. ``slot`` is the place of the tool's first row."""
    fields = [c for c in _FIELDS if c in evidence.columns]
    order = F.struct("success", "seq") if mode == "prefer_success" else F.struct("seq")
    rows = evidence.withColumn("success", F.coalesce("success", F.lit(False)))
    g = rows.groupBy("case_id", "tool").agg(F.max_by(F.struct(*fields), order).alias("w"), F.min("seq").alias("slot"))
    return g.select("case_id", "tool", "slot", *[F.col(f"w.{c}").alias(c) for c in fields])


def with_context(rows: DataFrame) -> DataFrame:
    """Facts of a case that routing needs: compression, grey images, blur, and the universal detector's score."""
    case = Window.partitionBy("case_id")
    own = lambda tool: (F.col("tool") == tool) & F.col("success")
    flag = lambda name: F.max(F.array_contains("flags", name)).over(case)
    return (
        rows.withColumn("dct_peak", F.coalesce(F.max(F.when(own("run_dct"), F.col("peak_ratio"))).over(case), F.lit(0.0)))
        .withColumn("compression", flag("COMPRESSION") | (F.col("dct_peak") > 0.80))
        .withColumn("grayscale", flag("GRAYSCALE"))
        .withColumn("blur", flag("HEAVY_BLUR"))
        .withColumn("univfd_fake", F.coalesce(F.max(F.when(own("run_univfd"), 1 - clamp(F.col("real_prob")))).over(case), F.lit(0.5)))
    )


def _times(weight: Column | float, *factors: tuple[Column, float]) -> Column:
    out = weight if isinstance(weight, Column) else F.lit(weight)
    for when, factor in factors:
        out = out * F.when(when, factor).otherwise(1.0)
    return out


def route(confidence_weighting: bool = False) -> Column:
    """struct(contribution, weight, abstain) of a row with context; the first rule that holds decides."""
    tool, s, conf = F.col("tool"), 1 - F.col("real_prob"), F.col("confidence")
    grey, blur, compression = F.col("grayscale"), F.col("blur"), F.col("compression")
    base = F.col("fusion_weight")
    by = conf if confidence_weighting else F.lit(1.0)
    vote = lambda w, share=s: F.struct((w * by * share).alias("contribution"), (w * by).alias("weight"), F.lit(False).alias("abstain"))
    silent = lambda abstain: F.struct(F.lit(0.0).alias("contribution"), F.lit(0.0).alias("weight"), F.lit(abstain).alias("abstain"))
    sbi = F.when(s >= 0.80, _times(0.15, (compression, 0.40), (grey, 0.1))).otherwise(_times(0.03 + 0.12 * F.col("univfd_fake"), (compression, 0.40), (grey | blur, 0.1)))
    return (
        F.when(~F.col("success") | (F.coalesce("error_msg", F.lit("")) != ""), silent(True))
        .when(F.coalesce(conf, F.lit(0.0)) <= 0, silent(True))
        .when((base == 0) & (tool != "check_c2pa"), silent(True))
        .when(tool == "check_c2pa", silent(False))
        .when((tool == "run_rppg") & (s < 0.30), vote(F.lit(0.06), 0.0))
        .when((tool == "run_rppg") & (s > 0.70), vote(F.lit(0.06), 0.85))
        .when(tool == "run_rppg", silent(True))
        .when(tool == "run_univfd", vote(base))
        .when(tool == "run_xception", vote(_times(base, (grey | compression, 1.25))))
        .when(tool == "run_sbi", vote(sbi))
        .when(tool == "run_freqnet", vote(_times(base, (compression, 0.50), (grey | blur, 0.1))))
        .when((tool == "run_corneal") & (s < 0.30), silent(True))
        .when((tool == "run_illumination") & (s < 0.08), silent(True))
        .when(tool == "run_geometry", vote(_times(base, (grey | compression | blur, 1.5))))
        .otherwise(vote(base))
    )


def routed(evidence: DataFrame, confidence_weighting: bool = False, mode: str = "prefer_success") -> DataFrame:
    """Deduplicated rows with contribution, weight and abstain after damping of low confidence."""
    spark = evidence.sparkSession
    rows = with_context(dedup(evidence, mode).withColumn("real_prob", clamp(F.col("real_prob"))))
    dim = F.broadcast(d.tools(spark).select("tool", "fusion_weight", "category", "gpu"))
    rows = rows.join(dim, "tool", "left").fillna({"fusion_weight": 0.0, "gpu": False}).withColumn("r", route(confidence_weighting))
    damp = F.when(F.col("confidence") < d.DAMPED_BELOW, F.pow(F.col("confidence") / d.DAMPED_BELOW, 2)).otherwise(1.0)
    damp = F.when(F.col("r.abstain"), 1.0).otherwise(damp)
    return rows.withColumn("contribution", F.col("r.contribution") * damp).withColumn("weight", F.col("r.weight") * damp).withColumn("abstain", F.col("r.abstain")).drop("r")


def deviation(votes: Column) -> Column:
    """Standard deviation of an array of structs (category, slot, x), sorted: x by x inside a category, then over the means of
    the categories. Thresholds compare it unrounded, so two votes exactly at one fall as they do in this order."""
    new = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, v: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (v["x"] - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (v["x"] - mean) * (v["x"] - a["mean"])).alias("m2"))

    def join(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + b["n"] / n * gap).alias("mean"), (b["m2"] + a["m2"] + gap * gap * b["n"] * a["n"] / n).alias("m2"))

    categories = F.array_distinct(F.transform(votes, lambda v: v["category"]))
    parts = F.transform(categories, lambda c: F.aggregate(F.filter(votes, lambda v: v["category"].eqNullSafe(c)), new, add))
    return F.aggregate(parts, new, join, lambda a: F.sqrt(a["m2"] / a["n"]))


def fused(evidence: DataFrame, confidence_weighting: bool = False, mode: str = "prefer_success", provenance_override: bool = True, strict_reference: bool = False, also: dict[str, Column] | None = None) -> DataFrame:
    """One row for each case: score of authenticity, verdict, conflict, weights, policy boost and override.

    An override by verified provenance that visuals agree with scores 1; with ``strict_reference`` 0, as a spoofing
    warning does. ``also``: further aggregates of a case's rows, by the names they get."""
    rows = routed(evidence, confidence_weighting, mode)
    fake, conf, weight, gpu = 1 - F.col("real_prob"), F.col("confidence"), F.col("weight"), F.col("gpu")
    votes = gpu & (weight > 1e-9)
    mass = F.when(fake > 0.5, fake).when(fake >= d.NEAR_MISS, 0.5 + (fake - d.NEAR_MISS) * d.NEAR_MISS_SLOPE).otherwise(0.0)
    rows = rows.withColumn("suspect", votes & (mass > d.MASS_ABOVE)).withColumn("mass", mass)
    earlier = Window.partitionBy("case_id", "category").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    again = F.coalesce(F.max(F.col("suspect")).over(earlier), F.lit(False)) & F.col("category").isNotNull()
    logit = to_logit(F.col("mass")) * F.when(again, 0.5).otherwise(1.0) * conf * conf * F.when(conf >= d.DOMINANCE_CONFIDENCE, d.DOMINANCE).otherwise(1.0)
    rows = rows.withColumn("logit", F.when(F.col("suspect"), logit))
    implied = F.when(~F.col("abstain"), F.when(weight > 1e-9, F.col("contribution") / weight).when(gpu, 0.0))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0.0))
    visual = (gpu | F.col("tool").isin("run_geometry", "run_illumination")) & F.col("success") & (conf > 0.1)
    plain = route(False)
    rows = rows.withColumn("plain", plain)
    dual = votes & (fake > d.FAKE_ABOVE) & (conf >= d.MULTI_CONFIDENCE)
    g = rows.groupBy("case_id").agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("c"), *[c.alias(n) for n, c in (also or {}).items()],
        total(F.col("weight"), gpu & (weight > 0)).alias("gw"), total(F.col("contribution"), gpu & (weight > 0)).alias("gc"),
        total(F.col("weight"), ~gpu & (weight > 0)).alias("cw"), total(F.col("contribution"), ~gpu & (weight > 0)).alias("cc"),
        F.sort_array(F.collect_list(F.when(implied.isNotNull(), F.struct("category", "slot", implied.alias("x"))))).alias("votes"),
        F.max(F.when(votes, fake)).alias("strongest"), F.count_if(votes & (fake > d.FAKE_ABOVE) & (conf >= d.SINGLE_CONFIDENCE)).alias("singles"),
        F.slice(F.sort_array(F.collect_list(F.when(dual, fake)), False), 1, 2).alias("top"), F.count_if(dual).alias("duals"),
        F.sum("logit").alias("logit"), F.count("logit").alias("suspects"),
        F.count_if(votes & fake.between(d.MIDDLE_LOW, d.MIDDLE_HIGH) & (conf < d.MIDDLE_CONFIDENCE)).alias("middle"),
        F.count_if(gpu & F.col("success") & F.col("abstain") & (conf > 0)).alias("lost"),
        F.count_if(~F.col("abstain")).alias("n_ran"), F.count_if(F.col("abstain")).alias("n_abstained"),
        F.coalesce(F.max((F.col("tool") == "check_c2pa") & F.col("success") & F.coalesce("c2pa_verified", F.lit(False))), F.lit(False)).alias("verified"),
        total(F.col("fusion_weight"), visual).alias("vis_total"), total(F.col("plain.weight"), visual & (F.col("plain.weight") > 1e-9)).alias("vis_w"), total(F.col("plain.contribution"), visual & (F.col("plain.weight") > 1e-9)).alias("vis_c"),
    )
    std = F.when(F.size("votes") < 2, 0.0).otherwise(deviation(F.col("votes")))
    gpu_mean = F.col("gc") / F.col("gw")
    base = F.when(F.col("w") < 1e-9, F.lit(0.5)).when(F.col("gw") > 1e-9, (1 - d.CPU_SHARE) * gpu_mean + d.CPU_SHARE * F.when(F.col("cw") > 1e-9, F.col("cc") / F.col("cw")).otherwise(gpu_mean)).otherwise(F.col("c") / F.col("w"))
    boost = F.when(F.col("singles") > 0, d.SINGLE_BOOST * F.col("strongest")).when(F.col("duals") >= 2, d.MULTI_BOOST * (F.get("top", F.lit(0)) + F.get("top", F.lit(1))) / 2).otherwise(0.0)
    reason = F.when(F.col("singles") > 0, "single_high_confidence_gpu").when(F.col("duals") >= 2, "two_gpu_fake_votes")
    g = g.withColumn("std", std).withColumn("base", base).withColumn("boost", boost)
    lone = (F.col("suspects") == 1) & (F.col("std") > d.MIDDLE_LOW / 2)
    score = F.when((F.col("suspects") == 0) | lone, F.col("base")).otherwise(F.greatest(from_logit(F.col("logit") * d.LOGIT_DAMPING), F.col("base")))
    score = F.when(F.col("middle") >= 2, F.greatest(score, F.lit(d.MIDDLE_SCORE))).otherwise(score)
    g = g.withColumn("candidate", F.least(F.lit(1.0), F.greatest("base", score) + F.col("boost"))).withColumn("worse", F.col("candidate") * (1 + d.COVERAGE * F.col("lost")))
    final = F.when((F.col("candidate") < 0.40) & (F.col("worse") >= 0.50), 0.4999).otherwise(F.least(F.lit(1.0), F.col("worse")))
    empty = F.col("w") < 1e-9
    seen = F.col("verified") & (F.col("vis_total") > d.OVERRIDE_WEIGHT) & F.lit(provenance_override)
    visual_mean = F.when(F.col("vis_w") > 0, F.col("vis_c") / F.col("vis_w")).otherwise(0.0)
    g = g.withColumn("override", seen & (visual_mean < d.OVERRIDE_AGREE)).withColumn("spoofing", seen & (visual_mean > d.OVERRIDE_CONTRADICT))
    real = F.when(F.col("override"), 0.0 if strict_reference else 1.0).when(F.col("spoofing"), 0.0).when(empty, 0.5).otherwise(F.round(1 - rounded(clamp(final)), 4))
    return g.withColumn("ensemble_score", real).select(
        "case_id", "ensemble_score", verdict(F.col("ensemble_score")).alias("verdict"), "override", "spoofing",
        (empty | (F.col("w") < d.INCONCLUSIVE_WEIGHT) | (F.round("std", 9) > d.INCONCLUSIVE_STD)).alias("is_inconclusive"), (F.round("std", 9) > d.CONFLICT_STD).alias("has_conflict"),
        rounded(F.col("std")).alias("conflict_std"), rounded(F.col("w")).alias("total_weight"), rounded(F.col("base"), 6).alias("base_fake"), rounded(F.col("boost")).alias("policy_boost"), reason.alias("policy_reason"), "suspects", "n_ran", "n_abstained", *(also or {}),
    )


def verdict(score: Column) -> Column:
    return F.when(score <= d.VERDICT_CUT, "FAKE").otherwise("REAL")


def abstentions(evidence: DataFrame) -> DataFrame:
    """Tools that gave no vote, with the reason."""
    return routed(evidence).where("abstain").select("case_id", "tool", "real_prob", F.when(F.col("success"), "abstain_or_failure").otherwise("tool_failed").alias("reason"))


def weight_breakdown(evidence: DataFrame, confidence_weighting: bool = False) -> DataFrame:
    rows = routed(evidence, confidence_weighting).where("success")
    return rows.select("case_id", "tool", "slot", "real_prob", F.round(1 - F.col("real_prob"), 6).alias("fake_prob"), "confidence", rounded(F.col("contribution"), 9).alias("contribution"), rounded(F.col("weight"), 9).alias("effective_weight"))
