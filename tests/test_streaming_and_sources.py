import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.operators import casestore, signal, tracks
from corroborate.queries import _scores
from corroborate.sources import media, sinks
from corroborate.streaming import windows

from .conftest import SF, drained


def run_stream(df, name, mode="append", timers=False):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    if timers:
        drained(q)
    else:
        q.processAllAvailable()
        q.stop()
    return df.sparkSession.table(name)


def test_windows_as_a_stream_equal_batch(spark, tmp_path):
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    got = run_stream(windows.windowed(stream, "6 hours", watermark="1 hour"), "w1", "complete")
    want = windows.windowed(spark.read.parquet(str(tmp_path)), "6 hours")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_smoothing_as_a_stream_equals_batch(spark, tmp_path):
    rows = _scores(spark, SF)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = run_stream(windows.smoothed_stream(stream), "w2", timers=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tracks.smoothed(rows).collect()))


def test_event_frames(spark, tmp_path):
    df = spark.createDataFrame([("verdict", "{}")], "event_type string, data string")
    assert df.select(sinks.event_frame("event_type", "data")).first()[0] == 'data: {"event_type":"verdict","data":"{}"}\n\n'
    df.write.parquet(str(tmp_path / "in"))
    q = sinks.event_sink(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.text(str(tmp_path / "out")).count() >= 1


def test_scan_labels_and_admits(spark, tmp_path):
    for name in ("Real/a.jpg", "Fake/b.PNG", "Fake/deep/c.mp4", "Real/d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"JFIF Apple" if name.endswith("jpg") else b"x")
    got = media.scan(spark, str(tmp_path), with_content=True).select("label", "kind", media.phone_origin(F.col("content")).alias("phone")).collect()
    assert sorted(map(tuple, got)) == [(0, "image", True), (1, "image", False), (1, "video", False)]


def test_frame_indices_round_half_to_even(spark):
    got = spark.range(1).select(media.frame_indices(F.lit(45.0), F.lit(10)).alias("i")).first().i
    assert got == [0, 2, 3, 4, 6, 8, 9]


def test_sinusoid_gives_its_pulse(spark):
    t = np.arange(512) / 30
    hz, snr, _ = signal.pulse(np.sin(2 * np.pi * 1.2 * t))
    assert abs(hz * 60 - 72) < 60 * 30 / 2048 * 2 and snr > 3


def test_positive_matrix():
    m = casestore.positive(np.array([[1.0, 2.0], [2.0, 1.0]]))
    assert np.linalg.eigvalsh(m).min() > 0


def test_metadata_key_is_checked(spark):
    with pytest.raises(ValueError):
        casestore.metadata_filter(spark.createDataFrame([({"a": "b"},)], "metadata map<string,string>"), "a; drop", "b")


def test_quantisation_tables(spark):
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([4] * 64) + b"\xff\xda"
    df = spark.createDataFrame([("a", bytearray(head)), ("b", bytearray(b"none")), ("c", None)], "path string, content binary")
    assert [tuple(r) for r in media.quantisation_tables(df).collect()] == [("a", 0, 4.0)]


def test_calibration_round_trip(spark, tmp_path):
    bands = spark.createDataFrame([(0.7, 0.2, 0.1), (0.5, 0.3, 0.2)], "base double, mid double, high double")
    sinks.calibration(bands, str(tmp_path / "c"))
    assert sinks.load_calibration(spark, str(tmp_path / "c"))["mean_base"] == 0.6
    assert sinks.load_calibration(spark, str(tmp_path / "none")) == sinks.DEFAULTS


def test_tracker_follows_two_boxes(spark):
    from corroborate.operators import forensic

    rows = [("c", f, 10 + 2 * f, 10, 60 + 2 * f, 60) for f in range(6)] + [("c", f, 300 - 3 * f, 200, 380 - 3 * f, 280) for f in range(6)]
    got = forensic.track(spark.createDataFrame(rows, "case_id string, frame long, x1 int, y1 int, x2 int, y2 int")).collect()
    assert len(got) == 12 and len({r.track for r in got}) == 2 and {r.track for r in got if r.y1 > 100} != {r.track for r in got if r.y1 < 100}


@pytest.mark.parametrize("n,m", [(5, 5), (5, 7), (7, 5), (6, 6), (4, 7)])
def test_matching_equals_permutations(n, m):
    from itertools import permutations

    from corroborate.operators import forensic

    rng = np.random.default_rng(n * 10 + m)
    for k in range(25):
        overlap = rng.random((n, m)) if k % 2 else rng.integers(0, 3, (n, m)) / 2.0
        wide = overlap if n <= m else overlap.T
        best = max(sum(wide[i, x] for i, x in enumerate(p)) for p in permutations(range(max(n, m)), min(n, m)))
        pairs = forensic.matching(-overlap)
        assert len(pairs) == len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(n, m)
        assert sum(overlap[i, j] for i, j in pairs) == pytest.approx(best)
        kept = forensic.assign(overlap, 0.0)
        assert sum(overlap[i, j] for i, j in kept) == pytest.approx(best)


def test_assignment_of_many_boxes_is_not_greedy():
    from corroborate.operators import forensic

    # The best single pair (0, 0) leaves box 1 without a partner; taken together, (0, 1) and (1, 0) are better.
    overlap = np.zeros((14, 14))
    overlap[:2, :2] = [[0.9, 0.8], [0.8, 0.1]]
    overlap[range(2, 14), range(2, 14)] = 0.5
    assert sorted(forensic.assign(overlap, 0.3)) == [(0, 1), (1, 0), *[(k, k) for k in range(2, 14)]]
    # Where each box has one partner above the bound, smaller overlaps don't outvote it.
    assert forensic.assign(np.array([[0.31, 0.29], [0.29, 0.0]]), 0.3) == [(0, 0)]


@pytest.mark.parametrize("euclid", [False, True])
def test_nearest_cases_by_the_keys_they_have(spark, euclid):
    import datetime as dt

    query = {"a": 0.9, "b": 0.8, "c": 0.7}
    rng = random.Random(3)
    scores = [{k: rng.random() for k in "abc" if rng.random() < 0.6} for _ in range(40)]
    scores += [{"a": 0.9}, {"b": 0.8, "c": None}, {}, {"z": 0.9}, None]
    rows = [(f"h{i}", i, dt.datetime(2024, 12, 31), "REAL", s) for i, s in enumerate(scores)]
    store = spark.createDataFrame(rows, "file_hash string, doc_id long, ts timestamp, feedback_label string, tool_scores map<string,double>")
    cov = np.eye(3) if euclid else casestore.covariance_matrix(store, list("abc"))
    want = {}
    for i, s in enumerate(scores):
        at = [j for j, k in enumerate("abc") if (s or {}).get(k) is not None]
        if at:
            off = np.array([scores[i]["abc"[j]] - query["abc"[j]] for j in at])
            want[i] = float(np.sqrt(off @ np.linalg.inv(cov[np.ix_(at, at)]) @ off))
    got = casestore.nearest(store, query, "2024-12-31 00:00:00", k=45, inverse=np.eye(3) if euclid else None).collect()
    assert {r.doc_id: r.distance for r in got} == pytest.approx(want, abs=2e-6)
    assert {got[0].doc_id, got[1].doc_id} == {40, 41}


def test_nearest_cases_with_ten_keys_and_all_masks(spark):
    """Every set of ten keys occurs; the plan has code of a size that compiles."""
    keys = [f"k{i}" for i in range(10)]
    rng = np.random.default_rng(4)
    rows = []
    for bits in range(1024):
        rows.append((bits, {k: float(rng.random()) for i, k in enumerate(keys) if bits >> i & 1}))
    store = spark.createDataFrame([(str(i), i, s, "REAL") for i, s in rows], "file_hash string, doc_id long, tool_scores map<string,double>, feedback_label string").withColumn("ts", F.lit("2024-12-01 00:00:00").cast("timestamp"))
    query = {k: 0.5 for k in keys}
    half = np.linalg.inv(np.diag(np.linspace(1, 2, 10)) + 0.1)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = casestore.nearest(store, query, "2024-12-31 00:00:00", k=2000, inverse=half).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    whole, want = np.linalg.inv(half), {}
    for i, scores in rows[1:]:
        at = [j for j in range(10) if i >> j & 1]
        off = np.array([scores[keys[j]] - 0.5 for j in at])
        want[i] = float(np.sqrt(off @ np.linalg.inv(whole[np.ix_(at, at)]) @ off))
    assert {r.doc_id: r.distance for r in got} == pytest.approx(want, abs=2e-6)


def test_dark_regions_give_no_pulse(spark):
    rows = [(c, 0, t, 100.0 + t % 3, None if (c, t) == (3, 15) else 20.0 if (c, t) in ((1, 30), (2, 31)) else 90.0 + t % 5, 80.0) for c in range(4) for t in range(120)]
    rows = [(c, r, t, 20.0 if g == 20.0 else x, g, b) for c, r, t, x, g, b in rows]
    df = spark.createDataFrame(rows, "case_id long, region int, frame int, r double, g double, b double")
    got = {r.case_id: r for r in signal.pulse_metrics(df).collect()}
    assert got[1].peak_hz is None and all(got[c].peak_hz is not None for c in (0, 2, 3))  # frame 31 isn't looked at
