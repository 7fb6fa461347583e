"""The registered queries of the engine's own operators; ``oracle`` has the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dims as d
from .functions import scores as fn
from .operators import casestore, early_stop, evaluation, forensic, fusion, provenance, routing, signal, store, tracks
from .plans import pipeline
from .sources import bridge
from .sources.shared import shared_folder
from .sources.bridge import table
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEYS = sorted(d.NAMES[:4])
#: The case that nearest cases are sought for, and the time of asking.
QUERY, AS_OF = {k: 0.5 for k in KEYS}, "2025-01-01 00:00:00"
PROBE = [round(((k * 37) % 19 - 9) / 10, 1) for k in range(64)]


def query(f):
    QUERIES[f.__name__] = f
    return f


def dense(spark, sf_dir):
    return bridge.tool_results(spark, sf_dir, dense=True)


@query
def dedup_latest(spark, sf_dir):
    return fusion.dedup(bridge.tool_results(spark, sf_dir)).select("case_id", "tool", "slot", "seq", "success", "real_prob", "confidence")


@query
def dedup_overwrite(spark, sf_dir):
    return fusion.dedup(bridge.tool_results(spark, sf_dir), mode="overwrite").select("case_id", "tool", "slot", "seq", "success")


@query
def weight_breakdown(spark, sf_dir):
    return fusion.weight_breakdown(bridge.tool_results(spark, sf_dir))


@query
def fusion_full(spark, sf_dir):
    return fusion.fused(bridge.tool_results(spark, sf_dir))


@query
def fusion_dense(spark, sf_dir):
    return fusion.fused(dense(spark, sf_dir))


@query
def fusion_confidence_weighted(spark, sf_dir):
    return fusion.fused(bridge.tool_results(spark, sf_dir), confidence_weighting=True)


@query
def fusion_strict(spark, sf_dir):
    return fusion.fused(dense(spark, sf_dir), strict_reference=True).select("case_id", "ensemble_score", "verdict", "override", "spoofing")


@query
def fusion_base(spark, sf_dir):
    return fusion.fused(bridge.tool_results(spark, sf_dir), provenance_override=False).select("case_id", "base_fake", "total_weight", "verdict")


@query
def abstentions(spark, sf_dir):
    return fusion.abstentions(bridge.tool_results(spark, sf_dir))


@query
def conflict_stats(spark, sf_dir):
    return fusion.fused(bridge.tool_results(spark, sf_dir)).groupBy("has_conflict", "is_inconclusive", "verdict").agg(F.count("*").alias("n"), F.round(F.avg("conflict_std"), 4).alias("mean_std"))


@query
def policy_boost(spark, sf_dir):
    return fusion.fused(dense(spark, sf_dir)).select("case_id", "policy_boost", "policy_reason", "suspects")


@query
def face_gate(spark, sf_dir):
    return bridge.media_summary(spark, sf_dir).select("case_id", routing.face_gate().alias("gate"), "max_confidence", "max_face_area_ratio", "frames_with_faces_pct")


@query
def cheap_plan(spark, sf_dir):
    return routing.cheap_plan(bridge.media_summary(spark, sf_dir))


@query
def gate_decision(spark, sf_dir):
    return routing.gate_decision(fusion.dedup(dense(spark, sf_dir)))


@query
def expensive_plan(spark, sf_dir):
    return routing.expensive_plan(bridge.media_summary(spark, sf_dir), routing.gate_decision(fusion.dedup(dense(spark, sf_dir))))


@query
def degraded_cases(spark, sf_dir):
    return routing.degraded(bridge.tool_results(spark, sf_dir))


@query
def pipeline_verdict(spark, sf_dir):
    return pipeline.verdicts(dense(spark, sf_dir), bridge.media_summary(spark, sf_dir))


@query
def verdict_report(spark, sf_dir):
    return pipeline.report(pipeline.verdicts(dense(spark, sf_dir), bridge.media_summary(spark, sf_dir)))


@query
def early_stop_decisions(spark, sf_dir):
    rows = fusion.dedup(bridge.tool_results(spark, sf_dir))
    verified = (F.col("tool") == "check_c2pa") & F.col("success") & F.col("c2pa_verified")
    return early_stop.evaluate(rows.select("case_id", "tool", F.when(F.col("success"), 1 - F.col("real_prob")).alias("fake"), verified.alias("verified")))


@query
def pending_tools(spark, sf_dir):
    return early_stop.pending_tools(bridge.tool_results(spark, sf_dir))


@query
def unknown_tools(spark, sf_dir):
    named = bridge.tool_results(spark, sf_dir).withColumn("tool", F.when(F.col("seq") % 10 == 0, F.concat("tool", F.lit("_v2"))).otherwise(F.col("tool")))
    return early_stop.unknown_tools(named)


@query
def tool_health(spark, sf_dir):
    t = bridge.tool_results(spark, sf_dir)
    return t.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.round(F.sum("execution_time"), 4).alias("total_time"), F.round(F.avg("execution_time"), 6).alias("avg_time"), F.max(F.when(F.col("error"), F.col("seq"))).alias("last_error_seq"))


@query
def breaker_state(spark, sf_dir):
    return tracks.breaker_state(bridge.tool_results(spark, sf_dir).select(F.col("case_id").alias("tool"), "seq", (F.col("confidence") > 0.5).alias("success")))


@query
def score_bands(spark, sf_dir):
    t = bridge.tool_results(spark, sf_dir)
    return t.groupBy(fn.band(F.col("real_prob"), F.col("confidence")).alias("band"), fn.ui_status(F.col("real_prob"), F.col("confidence"), F.col("error")).alias("status")).agg(F.count("*").alias("n"))


@query
def longest_run(spark, sf_dir):
    return tracks.longest_runs(bridge.track_boxes(spark, sf_dir))


@query
def asof_box(spark, sf_dir):
    boxes = bridge.track_boxes(spark, sf_dir)
    frames = boxes.select("case_id", "track", F.explode(F.array(F.col("frame") + 1, F.col("frame") + 5)).alias("frame")).distinct()
    return tracks.as_of(frames, boxes)


@query
def box_iou(spark, sf_dir):
    return tracks.overlaps(bridge.track_boxes(spark, sf_dir), least=0.1)


@query
def coverage_metrics(spark, sf_dir):
    return tracks.coverage(bridge.track_boxes(spark, sf_dir), total_frames=720)


@query
def best_track(spark, sf_dir):
    return tracks.best_track(bridge.track_boxes(spark, sf_dir), least_frames=3)


@query
def upper_median(spark, sf_dir):
    return tracks.upper_median(table(spark, sf_dir, "events"), "user_id", "value")


@query
def stride_sample(spark, sf_dir):
    return tracks.stride_sample(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id").select("user_id", "event_id", "rn")


def _scores(spark, sf_dir):
    t = dense(spark, sf_dir)
    return t.select(F.col("case_id").alias("subject"), "seq", F.col("real_prob").alias("score"), (F.col("seq") % 9 == 0).alias("inconclusive"))


@query
def ema_smoothing(spark, sf_dir):
    return tracks.smoothed(_scores(spark, sf_dir))


@query
def ema_smoothing_in_tasks(spark, sf_dir):
    return tracks.smoothed_in_tasks(_scores(spark, sf_dir))


def _predicted(spark, sf_dir):
    return bridge.truth(spark, sf_dir).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def confusion(spark, sf_dir):
    return evaluation.confusion(_predicted(spark, sf_dir))


@query
def roc_auc(spark, sf_dir):
    return evaluation.roc_auc(bridge.truth(spark, sf_dir))


@query
def balanced_sample(spark, sf_dir):
    return evaluation.balanced_sample(bridge.truth(spark, sf_dir), "y", "doc_id", 20, seed=7).select("doc_id", "y", "place")


@query
def class_counts(spark, sf_dir):
    return evaluation.class_counts(table(spark, sf_dir, "embeddings"), "label")


def _store(spark, sf_dir):
    c = bridge.cases(spark, sf_dir)
    return casestore.latest(c.where("doc_id % 3 <> 0")), c.where("doc_id % 3 = 0")


@query
def case_upsert(spark, sf_dir):
    return casestore.upsert(*_store(spark, sf_dir)).select("file_hash", "doc_id", "verdict", "confidence", "feedback_label")


@query
def batch_insert_ignore(spark, sf_dir):
    return casestore.insert_or_ignore(*_store(spark, sf_dir)).select("file_hash", "doc_id", "verdict")


@query
def case_feedback(spark, sf_dir):
    store, _ = _store(spark, sf_dir)
    labels = store.where("doc_id % 5 = 0").select("file_hash", F.lit("CONFIRMED").alias("label"))
    return casestore.feedback(store, labels).groupBy("feedback_label").agg(F.count("*").alias("n"))


@query
def global_stats(spark, sf_dir):
    return casestore.global_stats(bridge.cases(spark, sf_dir), KEYS)


@query
def covariance(spark, sf_dir):
    return casestore.covariance(bridge.cases(spark, sf_dir), KEYS)


@query
def nearest_cases(spark, sf_dir):
    import numpy as np

    return casestore.nearest(bridge.cases(spark, sf_dir), QUERY, AS_OF, k=5, inverse=np.eye(len(KEYS)))


@query
def nearest_cases_newest(spark, sf_dir):
    """Among the newest 50 labelled cases for each one asked for."""
    import numpy as np

    return casestore.nearest(bridge.cases(spark, sf_dir), QUERY, AS_OF, k=5, inverse=np.eye(len(KEYS)), per=50)


@query
def nearest_cases_mahalanobis(spark, sf_dir):
    return casestore.nearest(bridge.cases(spark, sf_dir), QUERY, AS_OF, k=5)


@query
def fts_match(spark, sf_dir):
    return casestore.containing(bridge.cases(spark, sf_dir), ["The", "of", "and"])


def _kept_store(spark, sf_dir):
    """Two merges: two thirds of the cases; then the rest, and the hashes of some documents taken out."""
    c = bridge.cases(spark, sf_dir)
    s = store.CaseStore(spark, shared_folder(spark, "cases"), c.schema)
    s.merge(c.where("doc_id % 3 <> 0"))
    s.merge(c.where("doc_id % 3 = 0"), c.where("doc_id % 11 = 5").select("file_hash"))
    return s


@query
def store_merged(spark, sf_dir):
    return _kept_store(spark, sf_dir).read().select("file_hash", "doc_id", "verdict", "confidence", "feedback_label")


@query
def store_moments(spark, sf_dir):
    m = _kept_store(spark, sf_dir).moments
    rows = [(a, b, m.n, round(float(m.mean[i]), 9), round(float(m.m2[i, j]), 6)) for i, a in enumerate(m.keys) for j, b in enumerate(m.keys)]
    return spark.createDataFrame(rows, "a string, b string, n long, mean_a double, m2 double")


@query
def store_search(spark, sf_dir):
    s = _kept_store(spark, sf_dir)
    s.compact()
    return s.search(["The", "of", "and"])


@query
def metadata_filter(spark, sf_dir):
    return casestore.metadata_filter(bridge.cases(spark, sf_dir), "lang", "de").select("doc_id", "file_hash")


@query
def keyword_flags(spark, sf_dir):
    c = table(spark, sf_dir, "documents")
    text = F.concat("text", F.lit(" made with "), F.get(F.array(*map(F.lit, ["Gemini", "dall e", "DALL-E", "StableDiffusion", "megaminx", "Midjourneyman", "Kling-2", "copilot", "PIKA", "dalle3"])), (F.col("doc_id") % 10).cast("int")))
    return c.select("doc_id", provenance.mentions_ai(text).alias("ai"), provenance.mentions_ai(F.col("text"), ["the", "license", "der"]).alias("control"))


def _actions(key):
    names = ["c2pa.edited", "C2PA.opened", "c2pa.cropped", "c2pa.resized", "c2pa.filtered", "c2pa.colorgraded", "c2pa.Retouched", "c2pa.composited", "c2pa.adjusted", "c2pa.created", "c2pa.placed"]
    pick = lambda by: F.get(F.array(*map(F.lit, names)), (key * by % len(names)).cast("int"))
    return F.array(pick(3), pick(5), pick(7))


@query
def severity_score(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", provenance.severity(_actions(F.col("page_id"))).alias("severity"), (F.col("page_id") % 4 != 0).alias("valid"), (F.col("page_id") % 5 == 0).alias("ai"))
    return rows.withColumn("s", provenance.provenance_score(F.col("valid"), F.col("ai"), F.col("severity"))).select("page_id", "severity", "s.real_prob", "s.confidence")


@query
def band_energy(spark, sf_dir):
    return signal.band_rows(table(spark, sf_dir, "embeddings"))


@query
def band_energy_strict(spark, sf_dir):
    return signal.band_rows(table(spark, sf_dir, "embeddings"), strict_reference=True)


@query
def calibration_stats(spark, sf_dir):
    return signal.calibration(signal.band_rows(table(spark, sf_dir, "embeddings")))


@query
def band_z_scores(spark, sf_dir):
    return signal.z_scores(signal.band_rows(table(spark, sf_dir, "embeddings")), {"base": 0.35, "mid": 0.33, "high": 0.32}, {"base": 0.03, "mid": 0.03, "high": 0.03})


@query
def probe_score(spark, sf_dir):
    return signal.probe(table(spark, sf_dir, "embeddings"), PROBE, 0.1, temperature=2.0)


@query
def patch_consistency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(F.avg((F.col("event_id") % 100).cast("double") / 100).alias("mean"), (F.stddev_pop((F.col("event_id") % 100).cast("double") / 100) / 6).alias("std"))
    return g.select("user_id", fn.nearest(F.col("mean"), 6).alias("mean"), fn.nearest(fn.consistency_damping(F.col("mean"), F.col("std")), 6).alias("damped"))


@query
def dct_scores(spark, sf_dir):
    t = bridge.tool_results(spark, sf_dir).where("tool = 'run_dct'")
    z = F.col("confidence") * 8
    s = fn.dct_score(F.col("peak_ratio"), z, F.col("seq") % 2 == 0)
    return t.select("seq", F.round(s, 6).alias("score"), F.round(fn.dct_confidence(s, z), 6).alias("confidence"))


@query
def failure_kinds(spark, sf_dir):
    t = bridge.tool_results(spark, sf_dir)
    message = F.get(F.array(*map(F.lit, ["OutOfMemoryError: x", "TimeoutError", "InvalidInput: y", "ValueError", "KeyError"])), (F.col("seq") % 5).cast("int"))
    return t.withColumn("f", routing.failure(message)).groupBy("f.kind", "f.confidence").agg(F.count("*").alias("n"))


@query
def psd_projection(spark, sf_dir):
    m = casestore.covariance_matrix(bridge.cases(spark, sf_dir), KEYS)
    return spark.createDataFrame([(a, b, round(float(m[i, j]), 9)) for i, a in enumerate(KEYS) for j, b in enumerate(KEYS)], "a string, b string, cov double")


@query
def event_windows_tumbling(spark, sf_dir):
    return windows.windowed(table(spark, sf_dir, "events"), "6 hours")


@query
def event_windows_sliding(spark, sf_dir):
    return windows.windowed(table(spark, sf_dir, "events"), "12 hours", "6 hours")


@query
def event_windows_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), "8 hours")


@query
def key_order(spark, sf_dir):
    return casestore.common_keys(bridge.cases(spark, sf_dir), ["run_sbi", *reversed(KEYS)]).select(F.array_join("keys", ",").alias("keys"))


@query
def recency(spark, sf_dir):
    days = F.col("doc_id") * 3
    return table(spark, sf_dir, "documents").select("doc_id", F.round(fn.recency_penalty(days), 6).alias("penalty"))


@query
def top_votes(spark, sf_dir):
    w = Window.partitionBy("case_id").orderBy(F.desc("confidence"), "tool")
    return fusion.dedup(dense(spark, sf_dir)).withColumn("place", F.row_number().over(w)).where("place <= 2").select("case_id", "place", "tool", "confidence")


REGIONS = ["cheek_l", "cheek_r", "hairline", "jaw", "nose_bridge"]


def _vectors(spark, sf_dir):
    """Embeddings by id, with a whole number read off two of their numbers."""
    part = lambda k: F.floor(F.abs(F.get("embedding", F.lit(k)).cast("double")) * 1e6)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), (part(0) + part(7)).alias("v"))


def _share(x, of=100):
    return F.pmod(x, F.lit(of + 1)).cast("double") / float(of)


@query
def region_boundary(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.col("id").alias("case_id"), "v", F.posexplode(F.array(*map(F.lit, REGIONS))).alias("k", "region"))
    return forensic.boundary(rows.withColumn("score", _share(F.col("v") * (7 * F.col("k") + 3))))


@query
def illumination_scores(spark, sf_dir):
    v = F.col("v")
    rows = _vectors(spark, sf_dir).select("id", "v", _share(v * 3).alias("g"), (_share(v * 7) / 5).alias("f"), (_share(v * 11) / 5).alias("c"), forensic.angle_between((v * 37 % 360).cast("double"), (v * 53 % 360).cast("double")).alias("t"))
    score = forensic.illumination(F.col("g"), F.col("f"), F.col("c"), F.col("t"), v % 3 == 0)
    return rows.select(F.col("id").alias("vec_id"), F.col("t").alias("turn"), fn.rounded(score, 6).alias("score"), forensic.illumination_confidence(F.col("g") / 10 + 0.00013, (v % 150).cast("double"), v % 200).alias("confidence"))


@query
def corneal_confidences(spark, sf_dir):
    v = F.col("v")
    return _vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), fn.rounded(forensic.corneal_confidence((v % 25).cast("double"), v % 7, (v % 17).cast("double"), (v % 40).cast("double"), (v % 31).cast("double")), 6).alias("confidence"))


@query
def neural_fusion_scores(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("id", _share(F.col("v") * 7).alias("n"), _share(F.col("v") * 13).alias("b"))
    n, b = F.col("n"), F.col("b")
    return rows.select(F.col("id").alias("vec_id"), fn.rounded(forensic.neural_fusion(n, b), 6).alias("fused"), fn.rounded(forensic.agreement_confidence(n, b), 6).alias("agreement"), fn.rounded(forensic.margin_confidence(n), 6).alias("margin"), fn.rounded(fn.band_anomaly(F.lit(0.0), b, n), 6).alias("band_score"))


@query
def liveness_labels(spark, sf_dir):
    v, k = F.col("v"), F.col("region")
    rows = _vectors(spark, sf_dir).select(F.col("id").alias("case_id"), "v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("region"))
    rows = rows.select("case_id", "v", "region", (F.lit(60) + v * (k + 3) * 7 % 250).cast("double").alias("p"), (v * (k + 2) * 13 % 120 - 40).cast("double").alias("s"), (v * (k + 5) * 3 % 20).cast("double").alias("d"))
    rows = rows.select("case_id", "region", (F.col("p") / 100).alias("peak_hz"), (F.col("s") / 10).alias("snr_db"), (F.col("d") / 100).alias("std"), (v % 11 == 0).alias("flat"), (v % 17 == 0).alias("occluded"), (v % 19 == 0).alias("moving"))
    return forensic.liveness_labels(rows)


@query
def tracker(spark, sf_dir):
    return forensic.track(bridge.track_boxes(spark, sf_dir))


@query
def tracker_retiring(spark, sf_dir):
    """A track ends after 24 frames without its box."""
    return forensic.track(bridge.track_boxes(spark, sf_dir), retire_after=24)


@query
def evidence_lines(spark, sf_dir):
    return forensic.evidence_lines(fusion.dedup(dense(spark, sf_dir)))
