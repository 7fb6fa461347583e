"""The registered queries of faces, pictures, manifests and what surrounds the tools; ``media_oracle`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scores import rounded
from .operators import casestore, evaluation, faces, forensic, fusion, patches, pixels, provenance, routing, service, signal, tracks, views
from .plans import pipeline
from .sources import bridge, media
from .sources.bridge import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def geometry_checks(spark, sf_dir):
    return faces.geometry(bridge.faces(spark, sf_dir))


@query
def geometry_of_case(spark, sf_dir):
    return faces.typical(faces.geometry(bridge.faces(spark, sf_dir)), "case_id")


@query
def worst_face(spark, sf_dir):
    return faces.worst(faces.geometry(bridge.faces(spark, sf_dir)), "case_id")


@query
def surest_face(spark, sf_dir):
    return faces.worst(faces.geometry(bridge.faces(spark, sf_dir)), "case_id", score="confidence")


@query
def head_pose(spark, sf_dir):
    rows = bridge.faces(spark, sf_dir).select("case_id", "face", faces.head_pose(F.col("landmarks")).alias("p"))
    return rows.select("case_id", "face", *[rounded(F.col(f"p.{n}"), 5).alias(n) for n in ("yaw", "pitch", "roll")])


@query
def corneal_scores(spark, sf_dir):
    lm = bridge.faces(spark, sf_dir)
    spot = lambda a, b: F.struct(faces.point(F.col("landmarks"), a)[0].alias("x"), faces.point(F.col("landmarks"), b)[1].alias("y"))
    rows = lm.select("case_id", "face", F.when(F.col("face") != 1, spot(468, 33)).alias("l"), spot(473, 94).alias("r"), faces.head_pose(F.col("landmarks")).alias("p"))
    c = faces.corneal(F.col("l"), F.col("r"), F.col("p.yaw") + F.col("p.pitch") + F.col("p.roll"))
    return rows.select("case_id", "face", c.alias("c")).select("case_id", "face", rounded(F.col("c.score"), 6).alias("score"), rounded(F.col("c.divergence"), 6).alias("divergence"), "c.consistent")


@query
def face_crops(spark, sf_dir):
    return faces.crops(bridge.faces(spark, sf_dir))


@query
def skin_regions(spark, sf_dir):
    f = bridge.faces(spark, sf_dir)
    box = f.withColumns({"box_x1": F.lit(100) + F.col("face") * 40, "box_y1": F.lit(60), "box_x2": F.lit(330) + F.col("face") * 160, "box_y2": F.lit(380)})
    return faces.skin_boxes(box.withColumn("landmarks", F.when(F.col("case_id") % 7 == 0, F.slice("landmarks", 1, 100)).otherwise(F.col("landmarks"))))


@query
def scaled_landmarks(spark, sf_dir):
    x, y = faces.point(F.col("landmarks"), 152)
    box = F.struct(F.lit(100.0).alias("x1"), F.lit(50.0).alias("y1"), F.lit(500.0).alias("x2"), F.lit(430.0).alias("y2"))
    rows = bridge.faces(spark, sf_dir).select("case_id", "face", faces.scaled(x, y, box, F.col("frame_w"), F.col("frame_h"), 1.15).alias("p"))
    return rows.select("case_id", "face", rounded(F.col("p.x"), 6).alias("x"), rounded(F.col("p.y"), 6).alias("y"))


@query
def sane_landmarks(spark, sf_dir):
    f = bridge.faces(spark, sf_dir)
    few = F.slice("landmarks", 1, F.when(F.col("face") == 0, 90).otherwise(478))
    return f.select("case_id", "face", faces.sane(few).alias("sane"))


@query
def detections_kept(spark, sf_dir):
    b = bridge.track_boxes(spark, sf_dir)
    return faces.detections(b.withColumns({"x2": F.col("x1") + (F.col("x2") - F.col("x1")) % 80, "y2": F.col("y1") + (F.col("y2") - F.col("y1")) % 90}), ["case_id", "frame"])


@query
def nearest_landmark_set(spark, sf_dir):
    b = bridge.track_boxes(spark, sf_dir)
    sets = b.select("case_id", "frame", F.col("track").alias("ord"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 10).alias("y1"), (F.col("x2") + 5).alias("x2"), (F.col("y2") + 15).alias("y2"))
    return faces.nearest_set(b, sets, ["case_id", "frame"])


@query
def even_sample(spark, sf_dir):
    return faces.sampled(bridge.track_boxes(spark, sf_dir), ["case_id", "track"]).select("case_id", "track", "frame")


@query
def sharpest_frame(spark, sf_dir):
    return faces.sharpest(bridge.sharp_boxes(spark, sf_dir), ["case_id", "track"])


@query
def best_frame_box(spark, sf_dir):
    b = bridge.sharp_boxes(spark, sf_dir)
    best = faces.sharpest(b, ["case_id", "track"]).select("case_id", "track", (F.col("frame") + F.col("track") % 2).alias("best"))
    return faces.box_at(best, b.drop("sharpness"), ["case_id", "track"])


def _tracks(spark, sf_dir):
    return faces.track_flags(bridge.sharp_boxes(spark, sf_dir), bridge.FRAME_W, bridge.FRAME_H, n_frames=120)


@query
def track_flags(spark, sf_dir):
    return _tracks(spark, sf_dir).withColumn("flags", F.array_join("flags", ","))


@query
def case_flags(spark, sf_dir):
    known = bridge.track_boxes(spark, sf_dir).select("case_id").distinct()
    of_media = known.select("case_id", F.array_compact(F.array(F.when(F.col("case_id") % 2 == 0, "MOTION_BLUR"), F.when(F.col("case_id") % 3 == 0, "GRAYSCALE"))).alias("flags"))
    return faces.summary(_tracks(spark, sf_dir), of_media, least=3)


@query
def rebased_boxes(spark, sf_dir):
    b = bridge.track_boxes(spark, sf_dir)
    return faces.rebased(b, tracks.longest_runs(b), ["case_id", "track"])


@query
def unmatched_boxes(spark, sf_dir):
    b = bridge.track_boxes(spark, sf_dir)
    return faces.unmatched(b, ["case_id", "frame"]).select("case_id", "frame", "track")


@query
def abstain_gates(spark, sf_dir):
    m = bridge.media_summary(spark, sf_dir)
    n = F.col("case_id").cast("long")
    gate = faces.pulse_gate(F.col("media_type"), n % 9 != 0, n % 200, n % 4, F.col("frames_with_faces_pct") * 30 - 3)
    return m.select("case_id", faces.illumination_abstains(F.col("flags")).alias("no_light"), gate.alias("g")).select("case_id", "no_light", "g.label", "g.error", "g.reason")


@query
def hair_share(spark, sf_dir):
    b = bridge.track_boxes(spark, sf_dir).withColumn("hair", F.col("x1") % 2 == 0)
    return faces.occluded(b, ["case_id", "track"])


@query
def carried_means(spark, sf_dir):
    return signal.carried(bridge.traces(spark, sf_dir), ["case_id", "region"])


@query
def evasion_flags(spark, sf_dir):
    stats = pixels.statistics(bridge.pictures(spark, sf_dir), "vec_id")
    length = F.when(F.col("vec_id") % 3 != 0, F.col("vec_id") % 20)
    return stats.select("vec_id", F.array_join(pixels.evasion_flags(stats, length), ",").alias("flags"), *[rounded(F.col(c), 4).alias(c) for c in ("saturation", "black", "white", "blur", "brightness", "r", "g", "b")])


@query
def picture_statistics(spark, sf_dir):
    stats = pixels.statistics(bridge.pictures(spark, sf_dir), "vec_id")
    return stats.select("vec_id", *[F.round(c, 4).alias(c) for c in ("angle", "gradient", "skin", "base", "mid", "high")], "hair")


def _patches(spark, sf_dir):
    return patches.scored(patches.patch_rows(table(spark, sf_dir, "embeddings"), "vec_id", columns=("embedding",), decode=bridge.large_picture))


@query
def picture_patches(spark, sf_dir):
    """Overlapping patches of pictures larger than a patch."""
    return _patches(spark, sf_dir).select("vec_id", "patch", "y", "x", *[F.round(c, 6).alias(c) for c in ("base", "mid", "high", "luma", "rough", "log_energy", "score")])


@query
def picture_agreement(spark, sf_dir):
    g = patches.agreement(_patches(spark, sf_dir), "vec_id")
    return g.select("vec_id", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "std", "damped")])


@query
def picture_calibration(spark, sf_dir):
    return signal.calibration(_patches(spark, sf_dir))


def _views(spark, sf_dir):
    """Logits of two views of two crops of each embedding: sums of its numbers, by place."""
    e = table(spark, sf_dir, "embeddings")
    number = lambda k: F.get("embedding", F.lit(k)).cast("double")
    logit = lambda c, v: F.struct(F.lit(c).alias("face"), F.lit(v).alias("view"), (4 * (number(c * 20 + v * 7) + number(c * 20 + v * 7 + 1))).alias("logit"))
    rows = F.explode(F.array(*[logit(c, v) for c in (0, 1) for v in (0, 1)])).alias("s")
    return e.select(F.col("vec_id").alias("case_id"), rows).select("case_id", "s.*")


@query
def view_scores(spark, sf_dir):
    """The worst crop of each case, its logits averaged over both views."""
    found = views.worst(views.averaged(_views(spark, sf_dir), temperature=2.0))
    return found.select("case_id", "n_crops", rounded(F.col("worst"), 6).alias("worst"), rounded(F.col("real_prob"), 6).alias("real_prob"))


@query
def view_spread(spark, sf_dir):
    """Mean and deviation over crops of the view that looks most like a fake."""
    rows = _views(spark, sf_dir).withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))
    return views.highest(rows, part="face").select("case_id", "n", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("std"), 6).alias("std"))


@query
def skipped_tools(spark, sf_dir):
    """The tool for blended faces beside the score of a wholly synthetic picture, where a case has both."""
    rows = fusion.dedup(bridge.tool_results(spark, sf_dir, dense=True))
    one = lambda tool, value: F.max(F.when(F.col("tool") == tool, value))
    g = rows.groupBy("case_id").agg(one("run_univfd", 1 - F.col("real_prob")).alias("u"), one("run_sbi", F.col("real_prob")).alias("p"), one("run_sbi", F.col("confidence")).alias("c")).where("p IS NOT NULL")
    return g.select("case_id", views.skipped(F.col("u"), F.col("p"), F.col("c")).alias("s")).select("case_id", "s.*")


@query
def dct_peak(spark, sf_dir):
    """Two crops of 40 x 40 for each embedding."""

    def crops(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            small = [np.clip(np.asarray(v, float) * 400 + 128, 0, 255).astype(np.uint8).reshape(8, 8) for v in b["embedding"]]
            rows = [(k, c, 40, 40, np.tile(x if c == 0 else x.T, (5, 5)).tobytes()) for k, x in zip(b["vec_id"], small) for c in (0, 1)]
            yield pd.DataFrame(rows, columns=["vec_id", "crop", "h", "w", "data"])

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return signal.dct_peaks(e.mapInPandas(crops, f"vec_id {dict(e.dtypes)['vec_id']}, crop int, h int, w int, data binary"), key="vec_id")


@query
def pulse_metrics(spark, sf_dir):
    m = signal.pulse_metrics(bridge.traces(spark, sf_dir))
    return m.withColumns({c: F.round(c, n) for c, n in (("peak_hz", 6), ("snr_db", 3), ("concentration", 1), ("std", 5), ("motion_share", 5))})


@query
def pulse_labels(spark, sf_dir):
    rows = signal.pulse_metrics(bridge.traces(spark, sf_dir)).withColumn("occluded", F.col("case_id") % 20 == 0)
    return forensic.liveness_labels(rows)


@query
def band_anomalies(spark, sf_dir):
    return signal.z_scores(signal.band_rows(table(spark, sf_dir, "embeddings")))


def _assessed(spark, sf_dir):
    return provenance.assess(bridge.manifests(spark, sf_dir), "doc_id")


@query
def manifest_scores(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", "verified", "is_ai", "ai_tool", "severity", "actions", "n_actions", "real_prob", "confidence")


@query
def signature_states(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", "state")


@query
def chain_tools(spark, sf_dir):
    return _assessed(spark, sf_dir).select("doc_id", "creation_tool", "final_tool")


@query
def phone_files(spark, sf_dir):
    """Bytes of a file put together for each document: markers, makers and sides in turn."""
    i = F.col("doc_id")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), F.pmod(k, F.lit(len(xs))).cast("int"))
    text = F.concat(pick(["Exif\0\0", "JFIF", "Exif", "exif\0\0", ""], i), F.lit(" "), pick(["Apple", "HUAWEI", "LG", "iPhone", "Huawei", "Sony", "HTC"], i), F.lit(" "), pick(["4032", "1080", ""], i), F.repeat(F.lit("x"), (i % 50).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.cast("binary").alias("content"))
    return rows.select("doc_id", media.phone_origin(F.col("content")).alias("phone"), media.phone_trust(F.col("content"), F.lit(8), F.lit(6)).alias("t")).select("doc_id", "phone", "t.trust", "t.is_phone")


@query
def normalised_weights(spark, sf_dir):
    """Weights of tools by the mean confidence of their successful rows."""
    t = bridge.tool_results(spark, sf_dir)
    return service.normalised_weights(t.groupBy("tool").agg(F.round(F.avg(F.when(F.col("success"), F.col("confidence"))), 9).alias("weight")))


@query
def error_rows(spark, sf_dir):
    t = bridge.tool_results(spark, sf_dir).where("error")
    message = F.get(F.array(*map(F.lit, ["OutOfMemoryError: x", "ToolTimeoutError", "InvalidInput: y", "odd"])), (F.col("seq") % 4).cast("int"))
    return t.select("seq", service.error_row(F.col("tool"), message).alias("e")).select("seq", "e.tool", "e.success", "e.real_prob", "e.confidence", "e.error_msg", "e.evidence_summary")


@query
def breaker_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").cast("string").alias("tool"), F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 900).alias("at"), (F.pmod(F.col("event_id") * 31, F.lit(10)) > 5).alias("success"))
    return tracks.breaker(calls)


@query
def progress_rows(spark, sf_dir):
    dense, summary = bridge.tool_results(spark, sf_dir, dense=True), bridge.media_summary(spark, sf_dir)
    return service.progress(summary, routing.gate_decision(fusion.dedup(dense)), pipeline.verdicts(dense, summary))


@query
def token_budgets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", service.token_budget(F.col("text"), F.col("doc_id") % 3 + 1).alias("t"))
    return rows.select("doc_id", "t.*", service.retry_tokens(F.col("doc_id") % 3000, F.col("t.num_predict")).alias("next_tokens"))


@query
def fallback_documents(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", service.fallback_document(F.concat(F.lit("Error "), F.col("page_id").cast("string")), F.col("page_id") % 4).alias("document"))


@query
def client_metrics(spark, sf_dir):
    i = F.col("event_id")
    return service.client_metrics(table(spark, sf_dir, "events").select((i % 3 != 0).alias("json"), (i % 7 != 0).alias("success"), (i % 4 + 1).alias("attempt"), (i % 11 == 0).alias("truncated"), (F.pmod(i, F.lit(100)) / 10.0).alias("seconds")))


@query
def stream_frames(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    stream = F.concat(F.lit("data: "), "role", F.lit("\n\n\ndata:"), F.col("turn").cast("string"), F.lit("\r\n\r\n \n\nlast"))
    return c.select("conv_id", "turn", F.array_join(service.frames(stream), "|").alias("frames"))


@query
def iso_times(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.get(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("x")), (F.col("event_id") % 3).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(service.iso_time(text)).alias("seconds"), service.stamped("report", t, "json").alias("name"))


@query
def score_maps(spark, sf_dir):
    c = bridge.cases(spark, sf_dir)
    back = service.scores_map(service.scores_json(F.col("tool_scores")))
    odd = F.when(F.col("doc_id") % 6 == 0, F.map_concat("tool_scores", F.create_map(F.lit("x"), F.lit(float("nan"))))).otherwise(F.col("tool_scores"))
    total = F.aggregate(F.map_values(back), F.lit(0.0), lambda s, x: s + x)
    language = F.get_json_object(F.to_json("metadata"), "$.lang")
    return c.select("doc_id", rounded(total, 6).alias("total"), F.size(back).alias("n"), service.valid_scores(odd).alias("valid"), language.alias("lang"))


@query
def store_counts(spark, sf_dir):
    c = bridge.cases(spark, sf_dir)
    store, new = casestore.latest(c.where("doc_id % 3 <> 0")), c.where("doc_id % 3 = 0")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    got = casestore.insert_or_ignore(store, new)
    return n(new, "offered").crossJoin(n(got, "inserted")).crossJoin(n(store.where("feedback_label IS NOT NULL"), "labelled")).withColumn("ignored", F.col("offered") - F.col("inserted"))


@query
def first_of_class(spark, sf_dir):
    return media.first_per_class(bridge.truth(spark, sf_dir), "y", "doc_id", 20).select("doc_id", "y")


@query
def first_pictures(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id").orderBy("vec_id").limit(500)


@query
def tool_agreement(spark, sf_dir):
    """Verdicts by score, each with whether it matches the truth; counts of both."""
    t = bridge.truth(spark, sf_dir)
    label = F.when(F.col("score") >= 0.5, "FAKE").otherwise("REAL")
    return evaluation.matched(t.withColumn("verdict", label), "verdict", "y").groupBy("verdict", "matched").agg(F.count("*").alias("n"))
