"""Staged plans: which tools run, from cheap facts to expensive evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims as d

# Fixed values of the gates.
MIN_CONFIDENCE, MIN_AREA, MIN_FRAMES = 0.60, 0.01, 0.30
DECISIVE, HALT_ABOVE, MINIMAL_FROM, LEAST_DECISIVE = 0.15, 0.93, 0.80, 3
ADMITTED = ["mp4", "avi", "mov", "mkv", "jpg", "jpeg", "png", "webp"]
MAX_BYTES = 500 * 1024 * 1024


def face_gate() -> Column:
    return F.col("has_face") & (F.col("max_confidence") >= MIN_CONFIDENCE) & (F.col("max_face_area_ratio") >= MIN_AREA) & (F.col("frames_with_faces_pct") >= MIN_FRAMES)


def cheap_tools() -> Column:
    """array<string> of the cheap tools of a media summary with ``gate``; the flags are looked at in this order only."""
    has = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    gate = F.col("gate")
    hidden, small, dark = has("MOTION_BLUR", "OCCLUSION"), has("FACE_TOO_SMALL"), has("LOW_LIGHT")
    pulse = gate & ~F.col("insufficient_temporal_data") & (F.col("media_type") != "image")
    runs = [("check_c2pa", F.lit(True)), ("run_dct", F.lit(True)), ("run_rppg", pulse), ("run_geometry", gate & ~hidden), ("run_illumination", gate & ~hidden & (small | ~dark)), ("run_corneal", gate & ~hidden & ~small & ~dark)]
    return F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in runs]))


def cheap_plan(media: DataFrame) -> DataFrame:
    """(case_id, seq, tool) of the cheap phase."""
    return media.withColumn("gate", face_gate()).select("case_id", F.posexplode(cheap_tools()).alias("seq", "tool"))


def usable() -> Column:
    return F.col("success") & ~F.col("error") & ~F.coalesce("liveness_label", F.lit("")).isin("ABSTAIN", "ERROR")


def gate_terms(counts: Column | None = None) -> dict[str, Column]:
    """Aggregates of a case's cheap rows, one for each tool, with gate_weight and domain; ``counts``: which rows count.
    They serve as aggregates and, with ``over``, as windows."""
    off = F.col("real_prob") - 0.5
    decisive = usable() & (F.abs(off) > DECISIVE) & (F.lit(True) if counts is None else counts)
    on = lambda c: F.when(decisive, c)
    return {
        "n_decisive": F.count_if(decisive), "w": F.sum(on(F.col("gate_weight"))), "s": F.sum(on(-2 * off * F.col("confidence") * F.col("gate_weight"))),
        "low": F.min(on(off < 0)), "high": F.max(on(off < 0)), "n_domains": F.count(on(F.col("domain"))),  # a domain has one tool
    }


def decided(rows: DataFrame) -> DataFrame:
    """Columns confidence (9 digits), unison and decision from the terms of the gate."""
    enough, w = F.col("n_decisive") >= LEAST_DECISIVE, F.coalesce("w", F.lit(0.0))
    rows = rows.withColumn("gate_confidence", F.round(F.when(enough & (w > 0), F.abs(F.col("s") / F.when(w > 0, w))).otherwise(0.0), 9))
    rows = rows.withColumn("unison", F.coalesce(enough & (F.col("low") == F.col("high")) & (F.col("n_domains") >= 2), F.lit(False)))
    c = F.col("gate_confidence")
    return rows.withColumn("decision", F.when(~enough, "FULL_GPU").when((c > HALT_ABOVE) & F.col("unison"), "HALT").when(c >= MINIMAL_FROM, "MINIMAL_GPU").otherwise("FULL_GPU"))


def gate_decision(evidence: DataFrame) -> DataFrame:
    """(case_id, decision, confidence, unison, n_decisive, n_domains) from rows of cheap tools, one for each tool."""
    dim = F.broadcast(d.tools(evidence.sparkSession).select("tool", "gate_weight", "domain", "gpu"))
    g = evidence.join(dim, "tool").where("NOT gpu").groupBy("case_id").agg(*[c.alias(n) for n, c in gate_terms().items()])
    return decided(g).select("case_id", "decision", F.round("gate_confidence", 6).alias("confidence"), "unison", "n_decisive", "n_domains")


def expensive_tools(decision: Column, gate: Column) -> Column:
    lit = lambda *names: F.array(*map(F.lit, names))
    full = F.when(gate, lit("run_freqnet", "run_univfd", "run_xception", "run_sbi")).otherwise(lit("run_freqnet", "run_univfd", "run_xception"))
    return F.when(decision == "HALT", F.array().cast("array<string>")).when(decision == "MINIMAL_GPU", lit("run_univfd")).otherwise(full)


def expensive_plan(media: DataFrame, decisions: DataFrame) -> DataFrame:
    """(case_id, seq, tool) of the expensive phase; a case without a decision gets the full plan."""
    rows = media.withColumn("gate", face_gate()).join(decisions.select("case_id", "decision"), "case_id", "left")
    return rows.select("case_id", F.posexplode(expensive_tools(F.coalesce("decision", F.lit("FULL_GPU")), F.col("gate"))).alias("seq", "tool"))


def degraded(evidence: DataFrame) -> DataFrame:
    """(case_id, n_rows, error_share, degraded): more than half of the rows are errors."""
    share = F.avg(F.col("error").cast("int"))
    return evidence.groupBy("case_id").agg(F.count("*").alias("n_rows"), F.round(share, 6).alias("error_share"), (share > 0.5).alias("degraded"))


def provenance_verdict() -> Column:
    """struct(verdict, score) of a verified provenance row: AI-made is fake, anything else real."""
    fake = F.col("is_ai_generated")
    return F.struct(F.when(fake, "FAKE").otherwise("REAL").alias("verdict"), F.when(fake, 0.0).otherwise(1.0).alias("score"))


def admitted(path: Column, length: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(ADMITTED) & (length <= MAX_BYTES)


#: Words in names of errors, the kind they stand for, and a failed tool's confidence.
FAILURES = [("OutOfMemory", "RESOURCE", 0.1), ("Timeout", "TIMEOUT", 0.2), ("InvalidInput", "INPUT", 0.0), ("ValueError", "INPUT", 0.0)]


def failure(message: Column) -> Column:
    """struct(kind, confidence) of an error text."""
    kind, conf = F.lit("UNKNOWN"), F.lit(0.0)
    for part, name, c in reversed(FAILURES):
        kind, conf = F.when(message.contains(part), name).otherwise(kind), F.when(message.contains(part), c).otherwise(conf)
    return F.struct(kind.alias("kind"), conf.alias("confidence"))
