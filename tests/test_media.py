"""Faces, pictures, manifests and what surrounds the tools, against plain versions and values worked out by hand."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.functions import scores as fn
from corroborate.operators import casestore, faces, forensic, pixels, provenance, routing, service, signal, tracks
from corroborate.sources import media, sinks


# Provenance


def manifest(actions, issuer="S", status="", chain=True, source="", agent="", active="m1"):
    sign = {"issuer": issuer, "validation_status": status, "certificates": ["root"] if chain else []}
    acts = [{"action": a, "digitalSourceType": source, "softwareAgent": agent} for a in actions]
    return json.dumps({"active_manifest": active, "manifests": {"m0": {"signature_info": {"issuer": "Maker"}, "assertions": [{"label": "c2pa.actions", "data": {"actions": [{"action": "c2pa.created"}]}}]}, "m1": {"signature_info": {k: v for k, v in sign.items() if v is not None}, "assertions": [{"label": "c2pa.actions.v2", "data": {"actions": acts}}]}}})


CASES = [
    (manifest([], source="x/trainedAlgorithmicMedia", agent="Tool"), ("valid", True, "Tool", 0, 0.0, 0.95)),
    (manifest([]), ("valid", False, "", 0, 1.0, 0.95)),
    (manifest(["c2pa.edited"]), ("valid", False, "", 1, 0.7, 0.8)),
    (manifest(["C2PA.Composited", "c2pa.cropped"], chain=False), ("valid_no_chain", False, "", 3, 0.4, 0.7)),
    (manifest([], status="Signature INVALID"), ("invalid", False, "", 0, 0.5, 0.3)),
    (manifest([], status="cert expired"), ("expired", False, "", 0, 0.5, 0.3)),
    (manifest([], status="Untrusted root", agent="made by Midjourney"), ("untrusted", True, "made by Midjourney", 0, 0.2, 0.6)),
    (manifest([], issuer=None), ("unsigned", False, "", 0, 0.5, 0.3)),
    (manifest([], active="other"), ("unsigned", False, "", 0, 0.5, 0.3)),
    (None, ("none", False, "", 0, 0.5, 0.0)),
    ("not json", ("none", False, "", 0, 0.5, 0.0)),
]


def test_manifests_by_hand(spark):
    rows = []
    for k, (text, _) in enumerate(CASES):
        if text and k in (0, 6):  # these need an action to carry agent or source type
            text = text.replace('"actions": []', '"actions": [{"action": "c2pa.opened", "digitalSourceType": "%s", "softwareAgent": "%s"}]' % (("x/trainedAlgorithmicMedia", "Tool") if k == 0 else ("", "made by Midjourney")))
        rows.append((k, text))
    got = {r.case_id: r for r in provenance.assess(spark.createDataFrame(rows, "case_id long, manifest string")).collect()}
    for k, (_, want) in enumerate(CASES):
        r = got[k]
        assert (r.state, r.is_ai, r.ai_tool, r.severity, r.real_prob, r.confidence) == want, k
    assert (got[1].creation_tool, got[1].final_tool) == ("Maker", "S") and got[9].creation_tool == "Unknown"
    assert got[3].actions == "c2pa.created (), c2pa.composited (), c2pa.cropped ()"


def test_words_stand_alone(spark):
    texts = ["with Gemini", "megaminx", "midjourneyman", "DALL-E", "dall e", "dalle", "Stable Diffusion", "stablediffusion", "kling!", "pika", "recraft", "jimeng", "partylamb", "copilot", "gpt-4", None]
    got = [r.ai for r in spark.createDataFrame([(t,) for t in texts], "t string").select(provenance.mentions_ai(F.col("t")).alias("ai")).collect()]
    assert got == [True, False, False, *[True] * 10, False, False, None]


def test_readers_errors_that_mean_no_manifest(spark):
    got = spark.createDataFrame([("No JUMBF data",), ("file NOT FOUND",), ("bad bytes",), (None,)], "e string").select(provenance.absent(F.col("e")).alias("a")).collect()
    assert [r.a for r in got] == [True, True, False, False]


# Pictures


def plain_laplacian(x):
    h, w = x.shape
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    return np.array([[sum(float(x[mirror(y + a, h), mirror(z + b, w)]) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))) - 4.0 * x[y, z] for z in range(w)] for y in range(h)])


def test_picture_measures_equal_plain_versions():
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (12, 15, 3), dtype=np.uint8)
    g = pixels.grey(rgb)
    assert np.abs(g - (0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2])).max() <= 1
    assert math.isclose(pixels.laplacian_variance(g), plain_laplacian(g).var())
    import colorsys

    for y in range(12):
        for x in range(15):
            h, s, _ = colorsys.rgb_to_hsv(*(rgb[y, x] / 255))
            assert abs(pixels.saturation(rgb)[y, x] - s * 255) <= 0.51 and abs((pixels.hue(rgb)[y, x] - h * 180 + 90) % 180 - 90) <= 0.51
    ramp = np.tile(np.arange(40.0), (40, 1))
    assert pixels.gradient(ramp)[0] == pytest.approx(0, abs=1e-6) and pixels.gradient(ramp.T)[0] == pytest.approx(90)
    assert pixels.gradient(ramp[:, ::-1])[0] == pytest.approx(180)


def test_filter_bank_is_orthonormal():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (16, 24, 3), dtype=np.uint8)
    luma = rgb @ np.array([0.2126, 0.7152, 0.0722]) / 255
    c = pixels.filter_bank(rgb)
    assert c.shape == (6, 64) and np.allclose((c**2).sum(), (luma**2).sum()) and np.isclose(c[0, 0], luma[:8, :8].sum() / 8)


def test_catchlights_and_hair():
    eye = np.full((15, 15, 3), 40, np.uint8)
    assert pixels.catchlight(eye) is None
    eye[3, 4] = 255
    assert pixels.catchlight(eye) is None  # one pixel is noise
    eye[4, 5] = 255  # touches at a corner
    eye[10, 10:13] = 255
    assert pixels.catchlight(eye) == pytest.approx(((11 - 7.5) / 7.5, (10 - 7.5) / 7.5))
    assert not pixels.hair(np.full((20, 20, 3), 120, np.uint8)) and pixels.hair(np.random.default_rng(0).integers(0, 256, (20, 20, 3), dtype=np.uint8)) and pixels.hair(np.empty((0, 5, 3), np.uint8))


def test_patches_and_polygons():
    assert pixels.patch_places(200, 224) == [(0, 0)] and pixels.patch_places(448, 224) == [(0, 0), (112, 0), (224, 0)]
    assert pixels.grid_places(100, 100)[:2] == [(0, 0, 65, 65), (0, 17, 65, 82)] and pixels.grid_places(40, 40) == [(0, 0, 40, 40)]
    cells = np.arange(100.0).reshape(10, 10)
    assert pixels.polygon_mean(cells, [(2, 2), (4, 2), (4, 4), (2, 4)]) == cells[2:5, 2:5].mean() and pixels.polygon_mean(cells, [(3, 5)]) == 53 and pixels.polygon_mean(cells, []) == 0


def test_channels_and_samples():
    rng = np.random.default_rng(2)
    bgr = rng.integers(0, 256, (9, 9, 3), dtype=np.uint8)
    bgr[..., 0] //= 4
    assert (pixels.in_rgb(bgr) == bgr[..., ::-1]).all() and (pixels.in_rgb(bgr[..., ::-1]) == bgr[..., ::-1]).all()
    assert pixels.coerced(np.array([0.0, 0.5, 1.0])).tolist() == [0, 128, 255] and pixels.coerced(np.array([300, -2])).tolist() == [255, 0]
    assert np.allclose(pixels.normalised(np.full((1, 1, 3), 255))[0, 0], (1 - pixels.MEAN) / pixels.STD)
    skin = np.array([[[200, 150, 120], [20, 200, 20]]], np.uint8)
    assert pixels.skin(skin).tolist() == [[True, False]]


def test_pictures_from_files(spark, tmp_path):
    import struct
    import zlib

    def png(rows):
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows))) + part(b"IEND", b"")

    (tmp_path / "a.png").write_bytes(png([[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)]]))
    (tmp_path / "b.png").write_bytes(b"no picture")
    [r] = pixels.images(spark, str(tmp_path)).collect()
    assert (r.height, r.width, bytes(r.data)) == (2, 2, bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 8, 7]))


# Signals


def plain_peaks(grey):
    """The ratio of each grid offset, with one transform for each block."""
    m = signal.dct_matrix()
    out = np.zeros((8, 8))
    for dy in range(8):
        for dx in range(8):
            counts = np.zeros(513)
            for y in range(dy, grey.shape[0] - 7, 8):
                for x in range(dx, grey.shape[1] - 7, 8):
                    c = np.round(m @ grey[y : y + 8, x : x + 8] @ m.T)
                    for i in range(8):
                        for j in range(8):
                            if 0 < i + j <= 5 and abs(c[i, j]) <= 256:
                                counts[int(c[i, j]) + 256] += 1
            lags = {k: sum(counts[a] * counts[a + k] for a in range(513 - k)) for k in range(257)}
            out[dy, dx] = max(lags[k] for k in range(2, 257)) / lags[0] if lags[0] else 0.0
    return out


def test_peak_ratios_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    grey = rng.random((27, 33)) * 255  # no whole numbers, so that no coefficient is a tie
    want = plain_peaks(grey)
    assert np.allclose(signal.peak_ratios(grey), want) and not signal.peak_ratios(np.zeros((5, 40))).any()
    grey = grey.astype(np.uint8).astype(float)
    want, other = signal.peak_ratios(grey), signal.peak_ratios(255 - grey)
    rows = [(1, k, 27, 33, bytearray((grey if k == 0 else 255 - grey).astype(np.uint8).tobytes())) for k in (1, 0)]
    r = signal.dct_peaks(spark.createDataFrame(rows, "case_id long, crop int, h int, w int, data binary")).first()
    dy, dx = np.unravel_index(want.argmax(), (8, 8))
    assert (r.dy, r.dx, r.n_crops) == (dy, dx, 2) and r.ratio == pytest.approx((want[dy, dx] + other[dy, dx]) / 2, abs=1e-6)


def test_pulse_equals_a_plain_transform():
    rng = np.random.default_rng(5)
    x = np.sin(np.arange(150) / 30 * 2 * np.pi * 1.3) + rng.normal(size=150) / 3
    w = (x - x.mean()) * np.hanning(150)
    f = np.arange(1025) * 30 / 2048
    power = np.array([abs(sum(w * np.exp(-2j * np.pi * k * np.arange(150) / 2048))) ** 2 for k in range(1025)])
    band = [k for k in range(1025) if 0.7 <= f[k] <= 2.5]
    top = max(band, key=lambda k: power[k])
    near = [k for k in range(top - 2, top + 3) if k in band]
    hz, snr, concentration = signal.pulse(x)
    assert hz == pytest.approx(f[top]) and concentration == pytest.approx(power[top] / np.median(power[band]))
    assert snr == pytest.approx(10 * np.log10(power[near].sum() / (power[band].sum() - power[near].sum())))
    assert signal.pulse(np.zeros(100)) == (0.0, -100.0, 0.0) and signal.motion_share(np.ones(50)) == 1.0
    assert signal.motion_share(np.sin(np.arange(200) / 30 * 2 * np.pi * 0.2)) > 0.9 > 0.1 > signal.motion_share(np.sin(np.arange(200) / 30 * 2 * np.pi * 1.5))


def test_pulse_of_regions(spark):
    rows = [(1, r, t, 120 + 0.2 * math.sin(t / 30 * 2 * math.pi * 1.2), 100 + 0.9 * math.sin(t / 30 * 2 * math.pi * 1.2), None if t == 7 else 90.0) for r in range(3) for t in range(1800)] + [(2, r, t, 1.0, 1.0, 1.0) for r in range(3) for t in range(20)]
    m = signal.pulse_metrics(spark.createDataFrame(rows, "case_id long, region int, frame int, r double, g double, b double"))
    got = {(r.case_id, r.region): r for r in m.collect()}
    assert got[2, 0].peak_hz is None and got[2, 0].moving and all(abs(got[1, r].peak_hz - 1.2) < 0.05 for r in range(3))
    labels = {r.case_id: r.label for r in forensic.liveness_labels(m.withColumn("occluded", F.lit(False))).collect()}
    assert labels == {1: "PULSE_PRESENT", 2: "AMBIGUOUS"}


# Tracks


def test_matching_is_the_best_of_all_permutations():
    import itertools

    rng = np.random.default_rng(6)
    for n, m in ((4, 4), (3, 6), (6, 4), (5, 5), (7, 7)):
        for _ in range(20):
            o = np.round(rng.random((n, m)) * (rng.random((n, m)) < 0.6), 3)
            got = sum(o[i, j] for i, j in forensic.matching(-o))
            small = o if n <= m else o.T
            best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
            assert got == pytest.approx(best)


def test_breaker_equals_a_plain_one(spark):
    rng = random.Random(7)
    rows = [(tool, k, float(k * 7), rng.random() < 0.5) for tool in ("a", "b") for k in range(300)]
    want = {}
    for tool in ("a", "b"):
        state, count, at = "CLOSED", 0, 0.0
        for t, k, now, ok in rows:
            if t != tool:
                continue
            if state == "OPEN" and now - at > 60:
                state = "HALF_OPEN"
            allowed = state != "OPEN"
            if allowed:
                state, count = ("CLOSED", 0) if ok else (state, count + 1)
                if count >= 3:
                    state, at = "OPEN", now
            want[tool, k] = (allowed, state)
    got = {(r.tool, r.seq): (r.allowed, r.state) for r in tracks.breaker(spark.createDataFrame(rows, "tool string, seq long, at double, success boolean")).collect()}
    assert got == want and {s for _, s in got.values()} >= {"OPEN", "CLOSED"}


def test_run_length_keeps_the_first_of_equals(spark):
    boxes = spark.createDataFrame([("c", 1, f) for f in (1, 2, 3, 7, 8, 9)] + [("c", 2, 5)], "case_id string, track long, frame long")
    assert sorted((r.track, r.start, r.end) for r in tracks.longest_runs(boxes).collect()) == [(1, 1, 4), (2, 5, 6)]


def test_upper_median_and_typical_face(spark):
    rows = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.4), (2, 0, 0.5), (2, 1, 0.1), (2, 2, 0.9), (2, 3, 0.5)], "case_id long, face int, score double")
    assert {(r.case_id, r.face) for r in faces.typical(rows, "case_id").collect()} == {(1, 1), (2, 0)}
    assert {(r.case_id, r.face) for r in faces.worst(rows, "case_id").collect()} == {(1, 1), (2, 2)}


def test_admission(spark):
    got = spark.createDataFrame([(2, 60), (3, 60), (4, 150), (5, 150), (4, 120)], "n long, frames long").select(tracks.admission(F.col("n"), F.col("frames")).alias("a")).collect()
    assert [r.a for r in got] == [False, True, False, True, True]


# Around the tools


def test_kinds_of_errors(spark):
    errors = [service.OutOfMemoryToolError("no room"), service.ToolTimeoutError("too slow"), service.InvalidInputError("bad"), KeyError("k")]
    rows = spark.createDataFrame([(n, f"{type(e).__name__}: {e}") for n, e in enumerate(errors)], "n int, m string")
    got = [r.e for r in rows.orderBy("n").select(service.error_row(F.lit("t"), F.col("m")).alias("e")).collect()]
    assert [(e.confidence, e.evidence_summary.split("[")[1].split("]")[0]) for e in got] == [(0.1, "RESOURCE"), (0.2, "TIMEOUT"), (0.0, "INPUT"), (0.0, "UNKNOWN")]


def test_normalised_weights(spark):
    weights = lambda *w: {r.tool: r.weight for r in service.normalised_weights(spark.createDataFrame([(str(k), x) for k, x in enumerate(w)], "tool string, weight double")).collect()}
    assert weights(1.0, 3.0) == {"0": 0.25, "1": 0.75} and weights(0.4, 0.6) == {"0": 0.4, "1": 0.6}


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(forensic.boundary_confidence(lit(0.9), lit(True))) == pytest.approx(0.94) and one(forensic.boundary_confidence(lit(0.5), lit(False))) == 0.4
    assert tuple(one(forensic.without_boundary(lit(0.8), lit(0.6), lit(False)))) == (pytest.approx(0.28), 0.3) and tuple(one(forensic.without_boundary(lit(0.4), lit(0.6), lit(False)))) == (0.4, 0.6)
    assert tuple(one(routing.provenance_verdict().alias("v")) if False else spark.range(1).select(lit(True).alias("is_ai_generated")).select(routing.provenance_verdict().alias("v")).first().v) == ("FAKE", 0.0)
    assert [one(routing.admitted(lit(p), lit(n))) for p, n in (("a.JPG", 5), ("a.gif", 5), ("a.mp4", 600 * 2**20), ("a.webp", 500 * 2**20))] == [True, False, False, True]
    assert [one(media.duration(*map(lit, x))) for x in ((7.5, 30, 10.0), (None, 30, 10.0), (None, 30, 0.0))] == [7.5, 3.0, 0.0]
    assert one(fn.recency_penalty(lit(1000))) == 10.0 and one(fn.recency_penalty(lit(200))) == pytest.approx(math.e)
    assert one(service.iso_time(lit("2024-01-01T00:00:00Z"))) is not None and one(service.iso_time(lit("soon"))) is None
    assert one(service.scores_map(lit('{"a": 0.5}'))) == {"a": 0.5} and one(faces.sane(lit(None).cast("array<array<double>>"))) is False


def test_feedback_for_unknown_hashes(spark):
    store = spark.createDataFrame([("h1",)], "file_hash string")
    casestore.assert_known(store, spark.createDataFrame([("h1", "REAL")], "file_hash string, label string"))
    with pytest.raises(KeyError):
        casestore.assert_known(store, spark.createDataFrame([("h2", "REAL")], "file_hash string, label string"))


def test_files_of_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "FAKE")], "doc_id long, verdict string")
    sinks.results_csv(rows, str(tmp_path / "c"))
    sinks.metrics_json(rows, str(tmp_path / "j"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).first().verdict == "FAKE" and spark.read.json(str(tmp_path / "j")).first().doc_id == 1


def test_first_per_class(spark):
    rows = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, y int")
    assert sorted(r.doc_id for r in media.first_per_class(rows, "y", "doc_id", 2).collect()) == [0, 1, 2, 3]


def test_phone_origin_and_trust(spark):
    files = [(b"Exif\0\0 Apple 4032", 6, 5), (b"Exif Apple 4032", 6, 5), (b"JFIF HUAWEI", None, None), (b"Exif\0\0 SONY " + b"x" * 100, 6, 5)]
    got = spark.createDataFrame([(k, bytearray(c), w, h) for k, (c, w, h) in enumerate(files)], "k int, c binary, w int, h int").select("k", media.phone_origin(F.col("c")).alias("o"), media.phone_trust(F.col("c"), F.col("w"), F.col("h")).alias("t")).orderBy("k").collect()
    assert [(r.o, r.t.trust, r.t.is_phone) for r in got] == [(True, 1.0, True), (False, 0.3, False), (False, 0.0, False), (True, 0.4, False)]


def test_tracks_are_told_from_their_second_hit(spark):
    rows = [("c", f, 10, 10, 60, 60) for f in (0, 1, 2, 5, 6)] + [("c", f, 300, 200, 380, 280) for f in (2, 5, 6)]
    got = forensic.track(spark.createDataFrame(rows, "case_id string, frame long, x1 int, y1 int, x2 int, y2 int")).collect()
    assert sorted((r.track, r.frame) for r in got) == [(1, 0), (1, 1), (1, 2), (1, 5), (1, 6), (2, 5), (2, 6)]
    ended = forensic.track(spark.createDataFrame([("c", f, 10, 10, 60, 60) for f in (0, 1, 40, 41)], "case_id string, frame long, x1 int, y1 int, x2 int, y2 int"), retire_after=24).collect()
    assert sorted((r.track, r.frame) for r in ended) == [(1, 0), (1, 1), (2, 41)]


def test_word_index_finds_what_a_scan_finds(spark):
    store = spark.createDataFrame([(1, "The end of it"), (2, "of the, and"), (3, None), (4, "THE AND OF x")], "doc_id long, reasoning string")
    for words in (["of", "The"], ["and"], ["absent"]):
        found = {r.doc_id for r in casestore.containing(store, words).collect()}
        assert found == {r.doc_id for r in casestore.match(casestore.postings(store), words).collect()}
