"""Deterministic evidence from the plain tables: stand-ins for what media decoders and models would deliver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import NAMES

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _part(x: Column, by: int, of: int) -> Column:
    """A double in [0, 1] with few digits, from integer arithmetic alone."""
    return F.pmod(x * by, F.lit(of)).cast("double") / F.lit(float(of - 1))


def tool_results(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Evidence rows from events; a case is a user's day, or a user if ``dense``. ``flags`` are those of the user."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    day = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    code = (F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1) * 2 + i % 2
    failed = i % 17 == 0
    return e.select(
        (F.col("user_id").cast("string") if dense else day).alias("case_id"),
        i.alias("seq"),
        F.get(F.array(*map(F.lit, NAMES)), code.cast("int")).alias("tool"),
        (~failed).alias("success"),
        _part(i, 7919, 1001).alias("real_prob"),
        _part(i, 6007, 1001).alias("confidence"),
        failed.alias("error"),
        F.when(failed, F.lit("tool failed")).alias("error_msg"),
        _part(i, 31, 101).alias("peak_ratio"),
        (i % 3 == 0).alias("c2pa_verified"),
        (i % 6 == 0).alias("is_ai_generated"),
        F.when(i % 13 == 0, F.lit("ABSTAIN")).alias("liveness_label"),
        (F.pmod(i, F.lit(50)).cast("double") / 10).alias("execution_time"),
        flags_of(F.col("user_id")).alias("flags"),
    )


def flags_of(user: Column) -> Column:
    named = [("COMPRESSION", 5), ("GRAYSCALE", 7), ("HEAVY_BLUR", 11), ("MOTION_BLUR", 13), ("FACE_TOO_SMALL", 4), ("LOW_LIGHT", 6)]
    return F.array_compact(F.array(*[F.when(user % k == 0, F.lit(n)) for n, k in named]))


def media_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user: gate metrics from counts, flags from modular tests."""
    e = table(spark, sf_dir, "events")
    views = F.count_if(F.col("event_type") == "view")
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), views.alias("v"), F.count_distinct(F.to_date("ts")).alias("days"))
    n = F.col("n").cast("double")
    return g.select(
        F.col("user_id").cast("string").alias("case_id"),
        (F.col("v") > 0).alias("has_face"),
        F.round(1 - F.lit(1.0) / (1 + F.col("v")), 6).alias("max_confidence"),
        F.round(F.col("v") / n / 10, 6).alias("max_face_area_ratio"),
        F.round(F.col("days") / F.lit(30.0), 6).alias("frames_with_faces_pct"),
        (F.col("n") % 3 == 0).alias("insufficient_temporal_data"),
        F.when(F.col("user_id") % 2 == 0, "video").otherwise("image").alias("media_type"),
        flags_of(F.col("user_id")).alias("flags"),
    )


def track_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes: a track for each user, a frame for each whole hour since 2024-01-01; the least event of an hour counts."""
    e = table(spark, sf_dir, "events")
    frame = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    g = e.groupBy((F.col("user_id") % 10).cast("string").alias("case_id"), F.col("user_id").alias("track"), frame.alias("frame")).agg(F.min("event_id").alias("i"))
    x, y = F.pmod(F.col("i") * 37, F.lit(500)).cast("int"), F.pmod(F.col("i") * 53, F.lit(400)).cast("int")
    return g.select("case_id", "track", "frame", x.alias("x1"), y.alias("y1"), (x + 60 + F.col("i") % 80).cast("int").alias("x2"), (y + 50 + F.col("i") % 90).cast("int").alias("y2"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled items with a score: 1 = positive."""
    d, y = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return y.join(d, "doc_id").select("doc_id", F.col("toxic").alias("y"), (F.pmod(F.col("n_chars") * 7 + F.col("toxic") * 300, F.lit(1000)).cast("double") / 1000).alias("score"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case rows from documents; the hash of the text is the key."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    scores = F.map_from_arrays(F.array(*map(F.lit, NAMES[:4])), F.array(*[F.pmod(i * k, F.lit(997)).cast("double") / 997 for k in (7, 11, 13, 17)]))
    return d.select(
        F.sha2("text", 256).alias("file_hash"), i.alias("doc_id"), F.timestamp_seconds(F.lit(1704067200) + i * 86400 % 31536000).alias("ts"), F.when(i % 2 == 0, "image").otherwise("video").alias("file_type"),
        F.when(i % 3 == 0, "FAKE").otherwise("REAL").alias("verdict"), (F.pmod(i * 31, F.lit(1000)).cast("double") / 1000).alias("confidence"), scores.alias("tool_scores"),
        F.col("text").alias("reasoning"), F.when(i % 4 == 0, F.when(i % 8 == 0, "FAKE").otherwise("REAL")).alias("feedback_label"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


#: Where some landmarks of a plain face lie, as shares of the picture.
FACE = {
    0: (0.50, 0.66), 1: (0.50, 0.55), 10: (0.50, 0.20), 33: (0.35, 0.40), 61: (0.43, 0.70), 66: (0.42, 0.33), 94: (0.50, 0.60), 98: (0.455, 0.58), 133: (0.45, 0.40), 152: (0.50, 0.82), 168: (0.50, 0.42), 234: (0.28, 0.50), 263: (0.65, 0.40),
    291: (0.57, 0.70), 296: (0.58, 0.33), 327: (0.545, 0.58), 362: (0.55, 0.40), 454: (0.72, 0.50), 468: (0.43, 0.40), 473: (0.57, 0.40),
}
FRAME_W, FRAME_H = 640, 480


def face_point(k: int) -> tuple[float, float]:
    return FACE.get(k, (round(0.3 + k % 20 / 50, 6), round(0.25 + k % 30 / 60, 6)))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces from embeddings, three to a case: a plain face, each point moved by two of the 64 numbers."""
    e = table(spark, sf_dir, "embeddings")
    base = [F.array(*[F.lit(face_point(k)[side]) for k in range(478)]) for side in (0, 1)]
    number = lambda k: F.get("embedding", k.cast("int")).cast("double")
    move = lambda xs, k, n: F.round(F.get(xs, k) + number(n) * 0.1, 6)
    points = F.transform(F.sequence(F.lit(0), F.lit(477)), lambda k: F.array(move(base[0], k, k % 64), move(base[1], k, (k * 7 + 3) % 64)))
    v = F.col("vec_id").cast("long")
    return e.select(F.floor(v / 3).alias("case_id"), (v % 3).alias("face"), points.alias("landmarks"), F.lit(float(FRAME_W)).alias("frame_w"), F.lit(float(FRAME_H)).alias("frame_h"), F.when(v % 4 == 0, 0.45).otherwise(380.0).alias("crop_w"))


def sharp_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track boxes with a sharpness from their corners, null for one in nine."""
    s = F.pmod(F.col("x1") * 7 + F.col("y1") * 13, F.lit(40))
    return track_boxes(spark, sf_dir).withColumn("sharpness", F.when(F.col("x1") % 9 != 0, s.cast("double")))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 RGB pictures from embeddings: a pixel's channels are three of the 64 numbers."""
    e = table(spark, sf_dir, "embeddings")

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            x = np.clip(np.floor(np.stack(b["embedding"]).astype(float) * 200 + 128), 0, 255).astype(np.uint8)
            rgb = np.stack([x, np.roll(x, -21, axis=1), np.roll(x, -42, axis=1)], axis=2)
            yield pd.DataFrame({"vec_id": b["vec_id"], "height": 8, "width": 8, "data": [p.tobytes() for p in rgb]})

    return e.select("vec_id", "embedding").mapInPandas(run, f"vec_id {dict(e.dtypes)['vec_id']}, height int, width int, data binary")


def large_picture(embedding):
    """340 x 236 RGB pixels of an embedding: its 64 numbers as a block of 8 x 8, repeated, on steps that rise from block to
    block; None for a null one or one of another length."""
    import numpy as np

    if embedding is None or len(embedding) != 64:
        return None
    block = np.floor(np.nan_to_num(np.asarray(embedding, float)).clip(-9, 9) * 200 + 128).reshape(8, 8)
    y, x = np.mgrid[:340, :236]
    steps = (y // 8 * 3 + x // 8 * 5) % 32
    return np.stack([np.clip(np.roll(block, k, axis=1)[y % 8, x % 8] + steps * (k + 1), 0, 255) for k in range(3)], axis=2).astype(np.uint8)


#: Parts that manifests are put together from.
AGENTS = ["", "Adobe Photoshop 25", "DALL-E 3", "dalle 2", "Stable-Diffusion XL", "Fluxus", "Midjourneyman", "Adobe Firefly", "GIMP"]
MANIFEST_ACTIONS = ["c2pa.created", "c2pa.edited", "C2PA.Cropped", "c2pa.opened", "c2pa.retouched", "c2pa.composited", "c2pa.placed", "x.Created", "c2pa.adjusted", "c2pa.colorgraded", "c2pa.resized", "c2pa.filtered", "custom.created"]
SOURCE_TYPES = ["", "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia", "digitalCapture", "http://cv.iptc.org/newscodes/digitalsourcetype/compositeSynthetic", "minorHumanEdits", "negativeFilm"]
STATUSES = ["", "Valid", "Signature INVALID", "untrusted root", "cert expired"]


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, manifest): JSON of one to three manifests for each document, null for one in ten; ids and lengths choose parts."""
    i, n = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), F.pmod(k, F.lit(len(xs))).cast("int"))
    last = n % 3

    def entry(k: Column) -> Column:
        agent = pick(AGENTS, n + k)
        action = lambda a: F.struct(a.alias("action"), pick(SOURCE_TYPES, i + n + k).alias("digitalSourceType"), agent.alias("softwareAgent"))
        none = "struct<label:string,data:struct<generator:string,actions:array<struct<action:string,digitalSourceType:string,softwareAgent:string>>>>"
        acts = F.struct(F.when(k % 2 == 0, "c2pa.actions").otherwise("c2pa.actions.v2").alias("label"), F.struct(F.lit(None).cast("string").alias("generator"), F.array(action(pick(MANIFEST_ACTIONS, i * 7 + n + k * 5)), action(pick(MANIFEST_ACTIONS, i + 3 * k))).alias("actions")).alias("data")).cast(none)
        work = F.when((i + k) % 4 == 0, F.struct(F.lit("stds.schema-org.CreativeWork").alias("label"), F.struct(pick(AGENTS, n * 3 + k).alias("generator"), F.lit(None).cast("array<struct<action:string,digitalSourceType:string,softwareAgent:string>>").alias("actions")).alias("data")).cast(none))
        sign = F.struct(F.when((i + k) % 11 != 0, F.concat(F.lit("signer "), ((i + k) % 5).cast("string"))).alias("issuer"), pick(STATUSES, i * 3 + k).alias("validation_status"), F.when((i + k) % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("root"))).alias("certificates"))
        return F.struct(F.concat(F.lit("m"), k.cast("string")).alias("key"), F.struct(sign.alias("signature_info"), F.array_compact(F.array(acts, work)).alias("assertions")).alias("value"))

    body = F.struct(F.concat(F.lit("m"), last.cast("string")).alias("active_manifest"), F.map_from_entries(F.transform(F.sequence(F.lit(0).cast("long"), last), entry)).alias("manifests"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(i % 10 != 0, F.to_json(body)).alias("manifest"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean colours of three skin regions for 120 frames, from embeddings: a beat of a rate of its own, and some noise."""
    e = table(spark, sf_dir, "embeddings")
    t, r = F.col("frame"), F.col("region")
    rows = e.select(F.col("vec_id").cast("long").alias("case_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("region")).select("*", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("frame"))
    noise = lambda k: F.get("embedding", F.pmod(t * 11 + r * 5 + k, F.lit(64)).cast("int")).cast("double")
    beat = F.sin(t / 30.0 * 6.283185307179586 * (0.9 + (F.col("case_id") % 50) / 50.0))
    gone = (t % 37 == 5) & (r == 1)
    colour = lambda level, gain, k: F.when(~gone, F.round(level + gain * beat + noise(k) * (F.col("case_id") % 3), 6))
    return rows.select("case_id", "region", "frame", colour(120.0, 0.3, 0).alias("r"), colour(100.0, 0.9, 1).alias("g"), colour(90.0, 0.2, 2).alias("b"))
