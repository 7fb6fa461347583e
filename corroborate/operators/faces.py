"""Faces: rules on landmarks, boxes and tracks. DataFrame expressions throughout.

Landmarks are an array of 478 points [x, y], as shares of the picture's sides; boxes have columns x1, y1, x2, y2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import iou, nearest, range_severity, rounded
from . import pairs
from .tracks import admission

# Ranges and weights of the six checks, gates, landmarks of regions and patches.
CHECKS = ["IPD ratio", "Philtrum ratio", "Eye width asymmetry", "Nose width ratio", "Mouth width ratio", "Vertical thirds"]
WEIGHTS = {"IPD ratio": 2.0, "Philtrum ratio": 1.5, "Eye width asymmetry": 1.0, "Nose width ratio": 1.5, "Mouth width ratio": 1.0, "Vertical thirds": 2.0}
BOTH_SIDES = ["Eye width asymmetry", "Nose width ratio", "Mouth width ratio"]
IPD, PHILTRUM, NOSE, MOUTH, EYES, THIRDS, YAW, ROLL = (0.35, 0.60), (0.06, 0.20), (0.45, 0.80), (0.75, 1.15), 0.08, 0.26, 0.25, 15.0
POINTS, SANE = 478, 100
SKIN = {"forehead": [109, 10, 338, 297, 332, 284, 103, 67], "left_cheek": [50, 205, 207, 215, 138, 135, 210], "right_cheek": [280, 425, 427, 435, 367, 364, 430]}
SKIN_DEFAULT = {"forehead": (0.2, 0.05, 0.8, 0.25), "left_cheek": (0.1, 0.5, 0.4, 0.85), "right_cheek": (0.6, 0.5, 0.9, 0.85)}
PATCHES = {
    "left_periorbital": [33, 160, 158, 133, 153, 144], "right_periorbital": [362, 385, 387, 263, 373, 380], "nasolabial_left": [92, 205, 216, 206], "nasolabial_right": [322, 425, 436, 426],
    "hairline_band": [10, 338, 297, 332, 284], "chin_jaw": [172, 136, 150, 149, 176, 148, 152, 377, 400, 379, 365],
}
MARGIN, LEAST_SIDE, SAMPLES = 0.2, 64, 5
DIVERGENCE, CONSISTENT, FARTHEST, POSE = 0.5, 0.5, 8**0.5, 0.03
HIDING = ["GRAYSCALE", "HEAVY_BLUR", "CLIPPED_BLACK", "CLIPPED_WHITE"]


def point(landmarks: Column, k: int, width: Column | float = 1.0, height: Column | float = 1.0) -> tuple[Column, Column]:
    p = F.get(landmarks, F.lit(k))
    return F.get(p, F.lit(0)).cast("double") * width, F.get(p, F.lit(1)).cast("double") * height


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))


def over(a: Column, b: Column) -> Column:
    return a / (b + 1e-10)


def sane(landmarks: Column) -> Column:
    """At least a hundred of the points lie in the picture."""
    inside = lambda p: F.get(p, F.lit(0)).between(0, 1) & F.get(p, F.lit(1)).between(0, 1)
    return F.coalesce(F.size(F.filter(landmarks, inside)) >= SANE, F.lit(False))


def excess(value: Column, most: float) -> Column:
    """0 up to ``most``, then by how much of it ``value`` is beyond, at most 1."""
    return F.when(value <= most, 0.0).otherwise(F.least((value - most) / (most + 1e-10), F.lit(1.0)))


def geometry(faces: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, face, yaw, roll, violations, checks, score, confidence) of faces (key, face, landmarks, frame_w, frame_h, crop_w).

    Faces turned aside skip the checks that compare both sides, tilted ones the vertical thirds. The score sums weighted
    severities over the weights that could be reached; small faces and scores below .35 count less."""
    rows = faces.where(F.size("landmarks") >= POINTS)
    at = lambda k: point(F.col("landmarks"), k, F.col("frame_w"), F.col("frame_h"))
    used = {k: at(k) for k in (0, 1, 33, 61, 66, 94, 98, 133, 152, 168, 263, 291, 296, 327, 362, 468, 473)}
    between = lambda a, b: distance(used[a], used[b])
    y = lambda k: used[k][1]
    rows = rows.withColumns({"wide": between(33, 263), "ipd": between(468, 473)})
    dx, dy = used[263][0] - used[33][0], used[263][1] - used[33][1]
    thirds = F.array(F.abs((y(66) + y(296)) / 2 - y(168)), F.abs(y(168) - y(94)), F.abs(y(94) - y(152)))
    rows = rows.withColumns(
        {
            "yaw": over(F.abs((used[33][0] + used[263][0]) / 2 - used[1][0]), F.col("wide")), "roll": F.when(F.abs(dx) < 1e-10, 90.0).otherwise(F.abs(F.degrees(F.atan2(dy, dx)))), "ipd_ratio": over(F.col("ipd"), F.col("wide")),
            "philtrum": over(between(94, 0), between(168, 152)), "eyes": over(F.abs(between(33, 133) - between(263, 362)), F.col("wide")), "nose": over(between(98, 327), F.col("ipd")), "mouth": over(between(61, 291), F.col("ipd")), "thirds": thirds,
        }
    )
    mean = F.aggregate("thirds", F.lit(0.0), lambda s, t: s + t) / 3
    rows = rows.withColumn("uneven", F.when(mean < 1e-10, 0.0).otherwise(F.array_max(F.transform("thirds", lambda t: over(F.abs(t - mean), mean)))))
    aside, tilted = F.col("yaw") > YAW, F.col("roll") > ROLL
    found = [range_severity(F.col("ipd_ratio"), *IPD), range_severity(F.col("philtrum"), *PHILTRUM), excess(F.col("eyes"), EYES), range_severity(F.col("nose"), *NOSE), range_severity(F.col("mouth"), *MOUTH), excess(F.col("uneven"), THIRDS)]
    skip = {**dict.fromkeys(BOTH_SIDES, aside), "Vertical thirds": tilted}
    severity = {n: F.when(skip.get(n, F.lit(False)), 0.0).otherwise(s) for n, s in zip(CHECKS, found)}
    rows = rows.withColumn("severities", F.array(*severity.values()))
    total = sum((F.get("severities", F.lit(k)) * WEIGHTS[n] for k, n in enumerate(CHECKS)), F.lit(0.0))
    reach = F.when(aside, sum(w for n, w in WEIGHTS.items() if n not in BOTH_SIDES)).otherwise(sum(WEIGHTS.values()))
    pixels = F.col("wide") * F.col("crop_w")
    score = F.least(over(total, reach), F.lit(1.0)) * F.when(pixels < 120, F.greatest(F.lit(0.7), 0.7 + 0.3 * (pixels - 60) / 60)).otherwise(1.0)
    confidence = F.lit(0.8) * F.when(F.col("yaw") > 0.12, 0.85).otherwise(1.0) * F.when(pixels < 80, 0.6).when(pixels < 120, 0.85).otherwise(1.0)
    named = F.filter(F.zip_with(F.array(*map(F.lit, CHECKS)), "severities", lambda n, s: F.when(s > 0, n)), lambda x: x.isNotNull())
    return rows.withColumn("raw", score).select(
        key, "face", rounded(F.col("yaw"), 6).alias("yaw"), rounded(F.col("roll"), 6).alias("roll"), F.array_join(named, ",").alias("violations"), F.lit(len(CHECKS)).alias("checks"),
        rounded(F.when(F.col("raw") < 0.35, F.col("raw") * 0.5).otherwise(F.col("raw")), 6).alias("score"), F.round(confidence + 1e-9, 2).alias("confidence"),
    )


def head_pose(landmarks: Column) -> Column:
    """struct(yaw, pitch, roll) in degrees, from irises, cheeks, nose, forehead and chin; zeros with too few points."""
    p = {k: point(landmarks, k) for k in (1, 10, 152, 234, 454, 468, 473)}
    left, right = distance(p[1], p[234]), distance(p[1], p[454])
    roll = F.abs(F.degrees(F.atan2(p[473][1] - p[468][1], p[473][0] - p[468][0])))
    pitch = F.abs((p[1][1] - (p[10][1] + p[152][1]) / 2) / (distance(p[10], p[152]) + 1e-10)) * 45
    enough = F.size(landmarks) >= POINTS
    value = lambda x, n: F.when(enough, x).otherwise(0.0).alias(n)
    return F.struct(value(F.abs(left - right) / (left + right + 1e-10) * 60, "yaw"), value(pitch, "pitch"), value(roll, "roll"))


def corneal(left: Column, right: Column, pose: Column) -> Column:
    """struct(score, divergence, consistent) of the catchlights' offsets (structs x, y) in both eyes, null without both; the
    tolerance widens as the head turns (degrees of all three angles)."""
    apart = F.sqrt(F.pow(left["x"] - right["x"], 2) + F.pow(left["y"] - right["y"], 2))
    score = F.least(F.lit(1.0), apart / FARTHEST / (DIVERGENCE * (1 + POSE * pose)))
    return F.when(left.isNotNull() & right.isNotNull(), F.struct(score.alias("score"), apart.alias("divergence"), (score < CONSISTENT).alias("consistent")))


def box_of(landmarks: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) around all points, in pixels."""
    side = lambda k, most: (F.array_max if most else F.array_min)(F.transform(landmarks, lambda p: F.get(p, F.lit(k)).cast("double")))
    return F.struct((side(0, False) * width).alias("x1"), (side(1, False) * height).alias("y1"), (side(0, True) * width).alias("x2"), (side(1, True) * height).alias("y2"))


def with_margin(box: Column, width: Column, height: Column, margin: float = MARGIN) -> Column:
    """The box a margin of its sides wider all round, cut to whole pixels and to the picture."""
    mx, my = (box["x2"] - box["x1"]) * margin, (box["y2"] - box["y1"]) * margin
    low, high = (lambda v: F.greatest(F.lit(0), v.cast("int"))), (lambda v, most: F.least(most.cast("int"), v.cast("int")))
    return F.struct(low(box["x1"] - mx).alias("x1"), low(box["y1"] - my).alias("y1"), high(box["x2"] + mx, width).alias("x2"), high(box["y2"] + my, height).alias("y2"))


def crops(faces: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, face, patch, x1, y1, x2, y2): the face and its six named patches, each with a margin."""
    box = lambda nodes: box_of(F.array(*[F.get("landmarks", F.lit(k)) for k in nodes]) if nodes else F.col("landmarks"), F.col("frame_w"), F.col("frame_h"))
    every = F.array(*[F.struct(F.lit(n).alias("patch"), with_margin(box(nodes), F.col("frame_w"), F.col("frame_h")).alias("b")) for n, nodes in {"face": [], **PATCHES}.items()])
    return faces.select(key, "face", F.explode(every).alias("p")).select(key, "face", "p.patch", "p.b.*")


def skin_boxes(faces: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, face, region, x1, y1, x2, y2) of the three skin regions a pulse is read from: their landmarks' extent as shares of
    the face's, laid on the face's current box (box_x1 ..) and cut to the frame; fixed shares without landmarks. Empty
    regions are left out."""
    lm, whole = F.col("landmarks"), box_of(F.col("landmarks"), F.lit(1.0), F.lit(1.0))
    w, h = whole["x2"] - whole["x1"], whole["y2"] - whole["y1"]
    usable = (F.size(lm) == POINTS) & (w > 0) & (h > 0)

    def region(name: str, nodes: list[int]) -> Column:
        own = box_of(F.array(*[F.get(lm, F.lit(k)) for k in nodes]), F.lit(1.0), F.lit(1.0))
        share = [(own["x1"] - whole["x1"]) / w, (own["y1"] - whole["y1"]) / h, (own["x2"] - whole["x1"]) / w, (own["y2"] - whole["y1"]) / h]
        share = [F.when(usable, s).otherwise(F.lit(d)) for s, d in zip(share, SKIN_DEFAULT[name])]
        bw, bh = F.col("box_x2") - F.col("box_x1"), F.col("box_y2") - F.col("box_y1")
        raw = [(F.col("box_x1") + bw * share[0]).cast("int"), (F.col("box_y1") + bh * share[1]).cast("int"), (F.col("box_x1") + bw * share[2]).cast("int"), (F.col("box_y1") + bh * share[3]).cast("int")]
        most = [F.col("frame_w").cast("int") - 1, F.col("frame_h").cast("int") - 1, F.col("frame_w").cast("int"), F.col("frame_h").cast("int")]
        return F.struct(F.lit(name).alias("region"), *[F.greatest(F.lit(0), F.least(v, m)).alias(n) for v, m, n in zip(raw, most, ("x1", "y1", "x2", "y2"))])

    return faces.select(key, "face", F.explode(F.array(*[region(n, k) for n, k in SKIN.items()])).alias("r")).select(key, "face", "r.*").where("x1 < x2 AND y1 < y2")


def scaled(x: Column, y: Column, box: Column, width: Column, height: Column, scale: float, side: float = 380.0) -> Column:
    """struct(x, y): a landmark (shares of the picture) in the square crop of ``box``, padded by ``scale`` and resized back."""
    pad, whole = int((side * scale - side) // 2), side + int((side * scale - side) // 2) + int(side * scale - side - int((side * scale - side) // 2))
    move = lambda v, low, extent: ((v - low) * (side / extent) + pad) * (side / whole)
    return F.struct(move(x * width, box["x1"], box["x2"] - box["x1"]).alias("x"), move(y * height, box["y1"], box["y2"] - box["y1"]).alias("y"))


def detections(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Of a frame's boxes those of at least 64 pixels a side, by area; where none is, the largest all the same. Adds ``place``."""
    wide = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= LEAST_SIDE
    w = Window.partitionBy(*key)
    by = w.orderBy(F.desc((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), "x1", "y1", "x2", "y2")
    rows = boxes.withColumns({"__wide": wide, "__any": F.max(wide).over(w), "place": F.row_number().over(by)})
    return rows.where("__wide OR (NOT __any AND place = 1)").drop("__wide", "__any")


def nearest_set(tracks: DataFrame, sets: DataFrame, key: list[str]) -> DataFrame:
    """For each track's box (key, track, x1 ..) the landmark set (key, ord, x1 ..) of its frame that overlaps most, the first of
    equals: (key, track, ord, iou)."""
    each = pairs.by_frame(tracks, sets, key, "track", "ord", pairs.best)
    best = each.groupBy(*key, "track").agg(F.max_by(F.struct("ord", "iou"), F.struct("iou", -F.col("ord"))).alias("m"))
    return best.select(*key, "track", "m.ord", "m.iou")


def sampled(rows: DataFrame, key: list[str], order: str = "frame", most: int = SAMPLES) -> DataFrame:
    """At most ``most`` rows of a key, evenly spread by ``order`` and with both ends."""
    w = Window.partitionBy(*key)
    n = rows.withColumns({"__rn": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    k = F.least(F.col("__n"), F.lit(most))
    picked = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.when(k > 1, F.floor(i * (F.col("__n") - 1) / F.greatest(k - 1, F.lit(1)))).otherwise(0))
    return n.where(F.array_contains(picked, F.col("__rn").cast("long"))).drop("__rn", "__n")


def sharpest(boxes: DataFrame, key: list[str]) -> DataFrame:
    """(key, frame, sharpness): the sharpest of a few frames spread over a track (columns frame, sharpness; null for an empty
    crop), the first of equals; the track's first frame where none is sharp at all."""
    few = sampled(boxes, key)
    first = boxes.groupBy(*key).agg(F.min("frame").alias("first"))
    best = few.where("sharpness > 0").groupBy(*key).agg(F.max_by(F.struct("frame", "sharpness"), F.struct("sharpness", -F.col("frame"))).alias("b"))
    return first.join(best, key, "left").select(*key, F.coalesce("b.frame", "first").alias("frame"), F.coalesce("b.sharpness", F.lit(0.0)).alias("sharpness"))


def box_at(tracks: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """For each track (key, best) its box at the best frame, or that of its first frame: (key, frame, x1, y1, x2, y2, exact)."""
    box = F.struct("frame", "x1", "y1", "x2", "y2")
    rows = boxes.join(tracks, key).groupBy(*key).agg(F.min_by(box, F.when(F.col("frame") == F.col("best"), F.lit(0)).otherwise(1)).alias("hit"), F.min_by(box, "frame").alias("any"), F.max(F.col("frame") == F.col("best")).alias("exact"))
    return rows.select(*key, F.when(F.col("exact"), F.col("hit")).otherwise(F.col("any")).alias("b"), "exact").select(*key, "b.*", "exact")


def track_flags(boxes: DataFrame, width: int, height: int, n_frames: int, parts: int = 10) -> DataFrame:
    """(case_id, track, start, end, present, area, sharpness, flags) of admitted tracks, from boxes with sharpness (null for an
    empty crop): the longest run of frames, means over every k-th of its frames (about ``parts``), and what hides the face."""
    w = Window.partitionBy("case_id", "track").orderBy("frame")
    rows = boxes.withColumn("run", F.col("frame") - F.row_number().over(w))
    own = Window.partitionBy("case_id", "track", "run")
    rows = rows.withColumns({"at": F.row_number().over(own.orderBy("frame")) - 1, "len": F.count("*").over(own)})
    area = (F.col("x2") - F.greatest(F.lit(0), "x1")) * (F.col("y2") - F.greatest(F.lit(0), "y1")) / float(width * height)
    hit = F.col("at") % F.greatest(F.lit(1), F.floor(F.col("len") / parts)) == 0
    runs = rows.groupBy("case_id", "track", "run").agg(F.min("frame").alias("start"), F.max("len").alias("len"), F.count_if(hit).alias("n"), F.sum(F.when(hit, area)).alias("area"), F.sum(F.when(hit, F.coalesce("sharpness", F.lit(0.0)))).alias("sharp"))
    g = runs.groupBy("case_id", "track").agg(F.sum("len").alias("present"), F.max_by(F.struct("start", "len", "n", "area", "sharp"), F.struct("len", -F.col("start"))).alias("r"))
    g = g.where(admission(F.col("present"), F.lit(n_frames)))
    flags = [F.when(F.col("r.len") < F.col("present") * 0.8, "OCCLUSION"), F.when(F.col("area") < 0.01, "FACE_TOO_SMALL"), F.when(F.col("sharpness") < 15, "MOTION_BLUR")]
    g = g.withColumns({"area": rounded(F.col("r.area") / F.col("r.n"), 6), "sharpness": rounded(F.col("r.sharp") / F.col("r.n"), 6)})
    return g.select("case_id", "track", "r.start", (F.col("r.start") + F.col("r.len")).alias("end"), "present", "area", "sharpness", F.array_compact(F.array(*flags)).alias("flags"))


def summary(tracks: DataFrame, media_flags: DataFrame, least: int = 90) -> DataFrame:
    """(case_id, track, flags, insufficient): the track of the longest run, the least id of equals; its flags and those of the
    media (case_id, flags), each once, sorted."""
    size = F.col("end") - F.col("start")
    best = tracks.groupBy("case_id").agg(F.max_by(F.struct("track", "flags", size.alias("len")), F.struct(size.alias("s"), -F.col("track"))).alias("b"))
    rows = media_flags.select("case_id", F.col("flags").alias("of_media")).join(best, "case_id", "left")
    every = F.array_sort(F.array_distinct(F.concat("of_media", F.coalesce("b.flags", F.array().cast("array<string>")))))
    return rows.select("case_id", "b.track", F.array_join(every, ",").alias("flags"), F.coalesce(F.col("b.len") < least, F.lit(True)).alias("insufficient"))


def rebased(boxes: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """Boxes inside a track's window (key, start, end), frames counted from its start."""
    rows = boxes.join(windows.select(*key, "start", "end"), key).where("frame >= start AND frame < end")
    return rows.withColumn("frame", F.col("frame") - F.col("start")).drop("start", "end")


def unmatched(boxes: DataFrame, key: list[str], least: float = 0.3) -> DataFrame:
    """Boxes that overlap with no other track's box of the same key by ``least``. The join leaves a box at its first match."""
    a, b, box = boxes.alias("a"), boxes.select(*key, "track", *pairs.BOX).alias("b"), lambda t: F.struct(*[F.col(f"{t}.{c}") for c in pairs.BOX])
    share = iou(box("a"), box("b"))
    match = (F.col("a.track") != F.col("b.track")) & (share > least - 1e-6) & (nearest(share, 6) >= least)
    for c in key:
        match = (F.col(f"a.{c}") == F.col(f"b.{c}")) & match
    return a.join(b, match, "left_anti")


def worst(rows: DataFrame, key: str, score: str = "score", order: str = "face") -> DataFrame:
    """(key, face, score): the face of the greatest score, the first of equals."""
    return rows.groupBy(key).agg(F.max_by(F.struct(order, score), F.struct(score, -F.col(order))).alias("w")).select(key, "w.*")


def typical(rows: DataFrame, key: str, score: str = "score", order: str = "face") -> DataFrame:
    """(key, face, score): the face nearest to the upper median of a key's scores, the first of equals. A key's faces are few."""
    g = rows.groupBy(key).agg(F.sort_array(F.collect_list(score)).alias("s"), F.collect_list(F.struct(order, score)).alias("r"))
    median = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    g = g.withColumn("m", median)
    best = F.array_min(F.transform("r", lambda x: F.struct(F.abs(x[score] - F.col("m")).alias("gap"), x[order].alias(order), x[score].alias(score))))
    return g.select(key, best[order].alias(order), best[score].alias(score))


def illumination_abstains(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, HIDING)))


def pulse_gate(media_type: Column, has_frames: Column, n_frames: Column, n_faces: Column, window: Column) -> Column:
    """struct(label, error, reason): why no pulse is read, null if it is; the first that holds."""
    rules = [
        (media_type == "image", "SKIPPED", False, "Static image"), (~has_frames, "ERROR", True, "Missing input"), (n_frames < 90, "ABSTAIN", False, "INSUFFICIENT_TEMPORAL_DATA"), (n_faces == 0, "ABSTAIN", False, "NO_FACES"),
        (window <= 0, "ABSTAIN", False, "EMPTY_WINDOW"),
    ]
    out = F.lit(None).cast("struct<label:string,error:boolean,reason:string>")
    for when, label, error, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(label).alias("label"), F.lit(error).alias("error"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def occluded(rows: DataFrame, key: list[str], every: int = 15, most: float = 0.4) -> DataFrame:
    """(key, checked, share, occluded): of every 15th frame (columns frame, hair), whether more than ``most`` show hair."""
    g = rows.where(F.col("frame") % every == 0).groupBy(*key).agg(F.count("*").alias("checked"), F.round(F.avg(F.col("hair").cast("int")), 6).alias("share"))
    return g.withColumn("occluded", F.col("share") > most)
