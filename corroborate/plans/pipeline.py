"""The staged plan for all cases at once: cheap tools, provenance short-circuit, gate, expensive tools, fusion, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims as d
from ..operators import fusion, routing


def staged(evidence: DataFrame, media: DataFrame) -> DataFrame:
    """Deduplicated rows of the tools that each case's plan runs, with the gate's decision.

    A case has ten rows at most by then, so the gate is a window over them: stages follow on one partitioning by case,
    without joining the evidence with itself."""
    dim = F.broadcast(d.tools(evidence.sparkSession).select("tool", "gate_weight", "domain", "gpu"))
    plans = media.withColumn("gate", routing.face_gate()).select("case_id", "gate", routing.cheap_tools().alias("cheap"))
    rows = fusion.dedup(evidence).join(plans, "case_id").join(dim, "tool", "left")
    rows = rows.withColumn("is_cheap", F.array_contains("cheap", F.col("tool")))
    case = Window.partitionBy("case_id")
    rows = routing.decided(rows.withColumns({n: c.over(case) for n, c in routing.gate_terms(F.col("is_cheap")).items()}))
    some = F.max("is_cheap").over(case)  # without a cheap row there is nothing to decide on: the full plan
    rows = rows.withColumn("decision", F.when(some, F.col("decision")))
    later = F.array_contains(routing.expensive_tools(F.coalesce("decision", F.lit("FULL_GPU")), F.col("gate")), F.col("tool"))
    return rows.where(F.col("is_cheap") | later)


def verdicts(evidence: DataFrame, media: DataFrame) -> DataFrame:
    """(case_id, path, decision, ensemble_score, verdict, degraded) of each case with evidence its plan runs.

    Verified provenance decides alone; all other cases are fused."""
    certain = (F.col("tool") == "check_c2pa") & F.col("success") & F.coalesce("c2pa_verified", F.lit(False))
    also = {"certain": F.max(certain), "ai": F.max(certain & F.coalesce("is_ai_generated", F.lit(False))), "decision": F.max("decision"), "degraded": F.avg(F.col("error").cast("int")) > 0.5}
    scored = fusion.fused(staged(evidence, media).drop("slot", "gpu", "gate_weight", "domain"), also=also)
    either = lambda a, b: F.when(F.col("certain"), a).otherwise(b)
    score = either(F.when(F.col("ai"), 0.0).otherwise(1.0), F.col("ensemble_score"))
    verdict = either(F.when(F.col("ai"), "FAKE").otherwise("REAL"), F.col("verdict"))
    return scored.select("case_id", either(F.lit("provenance"), F.lit("fusion")).alias("path"), either(F.lit(None), F.col("decision")).alias("decision"), score.alias("ensemble_score"), verdict.alias("verdict"), either(F.lit(False), F.col("degraded")).alias("degraded"))


def report(verdict_rows: DataFrame) -> DataFrame:
    """(case_id, text): a sentence for each verdict."""
    text = F.format_string("Case %s: %s with an authenticity of %.4f by %s.", "case_id", "verdict", "ensemble_score", "path")
    return verdict_rows.select("case_id", text.alias("text"))
