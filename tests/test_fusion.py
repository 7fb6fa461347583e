import itertools

import pytest
from pyspark.sql import functions as F

from corroborate import dims
from corroborate.operators import early_stop, fusion, routing, tracks

SCHEMA = "case_id string, seq long, tool string, success boolean, real_prob double, confidence double, error boolean, error_msg string, peak_ratio double, c2pa_verified boolean, is_ai_generated boolean, liveness_label string, flags array<string>"


def rows(spark, listed, case="c", flags=()):
    full = [(case, k, t, ok, p, c, not ok, None if ok else "x", 0.0, False, False, None, list(flags)) for k, (t, p, c, ok) in enumerate(((*r, True)[:4] for r in listed), 1)]
    return spark.createDataFrame(full, SCHEMA)


def one(spark, listed, **k):
    return fusion.fused(rows(spark, listed), **k).first()


def test_three_borderline_votes(spark):
    r = one(spark, [("run_dct", 0.92, 0.95), ("run_geometry", 0.84, 0.80), ("run_freqnet", 1.0, 0.95), ("run_univfd", 0.57, 0.52), ("run_xception", 0.51, 0.41), ("run_sbi", 0.59, 0.45)])
    assert (r.ensemble_score, r.verdict, r.total_weight, r.policy_reason, r.is_inconclusive, r.has_conflict) == (0.15, "FAKE", 0.5886, None, False, False)
    assert r.base_fake == pytest.approx(0.246924, abs=1e-6)


@pytest.mark.parametrize("weighted,score,weight,base", [(False, 0.4621, 0.1067, 0.471875), (True, 0.4049, 0.0798, 0.529123)])
def test_single_confident_vote(spark, weighted, score, weight, base):
    r = one(spark, [("run_xception", 0.95, 0.20), ("run_sbi", 0.45, 0.85)], confidence_weighting=weighted)
    assert (r.ensemble_score, r.total_weight, r.policy_boost, r.is_inconclusive, r.has_conflict) == (score, weight, 0.066, True, True)
    assert r.base_fake == pytest.approx(base, abs=1e-6)


def test_all_abstain(spark):
    r = one(spark, [("run_dct", 0.9, 0.0), ("run_sbi", 0.9, 0.0)])
    assert (r.ensemble_score, r.verdict, r.is_inconclusive) == (0.5, "FAKE", True)


@pytest.mark.parametrize("pair,kept", [((True, False), 1), ((False, True), 2), ((True, True), 2), ((False, False), 2)])
def test_dedup(spark, pair, kept):
    d = fusion.dedup(rows(spark, [("run_dct", 0.1, 0.5, pair[0]), ("run_dct", 0.2, 0.5, pair[1])])).first()
    assert (d.seq, d.slot) == (kept, 1)


@pytest.mark.parametrize("fake,weight", [(0.29, 0.06), (0.31, 0.0), (0.69, 0.0), (0.71, 0.06)])
def test_pulse_bands(spark, fake, weight):
    assert fusion.routed(rows(spark, [("run_rppg", 1 - fake, 0.9)])).first().weight == pytest.approx(weight)


@pytest.mark.parametrize("tool,flag,factor", [("run_xception", "GRAYSCALE", 1.25), ("run_freqnet", "COMPRESSION", 0.5), ("run_freqnet", "HEAVY_BLUR", 0.1), ("run_geometry", "HEAVY_BLUR", 1.5), ("run_dct", "GRAYSCALE", 1.0)])
def test_flags_scale_weights(spark, tool, flag, factor):
    base = dict((t[0], t[1]) for t in dims.TOOLS)[tool]
    assert fusion.routed(rows(spark, [(tool, 0.4, 0.9)], flags=[flag])).first().weight == pytest.approx(base * factor)


@pytest.mark.parametrize("conf,factor", [(0.59, (0.59 / 0.6) ** 2), (0.60, 1.0)])
def test_damping(spark, conf, factor):
    assert fusion.routed(rows(spark, [("run_dct", 0.4, conf)])).first().weight == pytest.approx(0.09 * factor)


def test_order_of_rows_does_not_matter_without_categories(spark):
    listed = [("run_dct", 0.3, 0.9), ("run_geometry", 0.4, 0.7), ("run_univfd", 0.2, 0.6)]
    assert len({one(spark, list(p)).ensemble_score for p in itertools.permutations(listed)}) == 1


def test_abstainers_change_nothing(spark):
    a = [("run_dct", 0.3, 0.9), ("run_univfd", 0.2, 0.6)]
    assert one(spark, a).ensemble_score == one(spark, [*a, ("run_geometry", 0.9, 0.0)]).ensemble_score


@pytest.mark.parametrize("conf,n,decision", [(0.95, 3, "FULL_GPU"), (0.95, 2, "FULL_GPU"), (1.0, 3, "HALT")])
def test_gate(spark, conf, n, decision):
    listed = [(t, 0.0, conf) for t in ("run_dct", "run_geometry", "run_rppg")][:n]
    got = routing.gate_decision(fusion.dedup(rows(spark, listed))).first()
    assert got.decision == ("HALT" if n == 3 and conf > 0.93 else decision)


def test_flag_ladder(spark):
    schema = "case_id string, has_face boolean, max_confidence double, max_face_area_ratio double, frames_with_faces_pct double, insufficient_temporal_data boolean, media_type string, flags array<string>"
    cases = {(): 6, ("MOTION_BLUR",): 3, ("FACE_TOO_SMALL",): 5, ("LOW_LIGHT",): 4, ("FACE_TOO_SMALL", "LOW_LIGHT"): 5}
    df = spark.createDataFrame([(",".join(f), True, 0.9, 0.5, 0.9, False, "video", list(f)) for f in cases], schema)
    got = {r.case_id: r["count"] for r in routing.cheap_plan(df).groupBy("case_id").count().collect()}
    assert got == {",".join(f): n for f, n in cases.items()}


def test_early_stop(spark):
    df = spark.createDataFrame([("locked", t[0], 0.01, False) for t in dims.TOOLS] + [("ver", "run_dct", 0.5, True), ("split", "run_sbi", 1.0, False), ("split", "run_xception", 0.0, False), ("unknown", "nobody", 0.5, False)], "case_id string, tool string, fake double, verified boolean")
    got = {r.case_id: r.reason for r in early_stop.evaluate(df).collect()}
    assert got == {"locked": "HALT_LOCKED_REAL", "ver": "HALT_HARDWARE_VERIFIED", "split": "CONTINUE_ADVERSARIAL_CONFLICT", "unknown": "CONTINUE_AMBIGUOUS"}


def test_longest_run_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1, f) for f in (1, 2, 3, 7, 8, 9)], "case_id string, track long, frame long")
    r = tracks.longest_runs(df).first()
    assert (r.start, r.end) == (1, 4)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", 5.0), ("b", 6.0)], "k string, v double")
    assert {r.k: r.median for r in tracks.upper_median(df, "k", "v").collect()} == {"a": 3.0, "b": 6.0}


def test_smoothing_clears_state(spark):
    df = spark.createDataFrame([("s", k, v, skip) for k, (v, skip) in enumerate([(0.8, False), (0.4, False), (0.9, True), (0.6, False)])], "subject string, seq long, score double, inconclusive boolean")
    for f in (tracks.smoothed, tracks.smoothed_in_tasks):
        assert [r.smooth for r in f(df).orderBy("seq").collect()] == [0.8, 0.68, 0.9, 0.6]


def test_empty_tables(spark):
    empty = rows(spark, [("run_dct", 0.1, 0.5)]).where("false")
    assert fusion.fused(empty).count() == 0 and routing.gate_decision(fusion.dedup(empty)).count() == 0


def test_hot_case_is_reduced_before_the_shuffle(spark):
    hot = spark.range(20000).select(F.lit("hot").alias("case_id"), F.col("id").alias("seq"), F.lit("run_dct").alias("tool"), F.lit(True).alias("success"), F.lit(0.2).alias("real_prob"), F.lit(0.9).alias("confidence"), F.lit(False).alias("error"), F.lit(None).cast("string").alias("error_msg"), F.lit(0.0).alias("peak_ratio"), F.lit(False).alias("c2pa_verified"), F.array().cast("array<string>").alias("flags"))
    assert fusion.fused(hot).count() == 1
    plan = fusion.dedup(hot)._jdf.queryExecution().toString()
    assert "partial_max_by" in plan
