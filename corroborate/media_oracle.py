"""DuckDB SQL with the same rows as the queries of ``media_queries``; its fixed values are written out here on their own."""

from __future__ import annotations

from .oracle import BOXES, CASES, DD, MEDIA, RUNS, SQL as CORE, ev
from .sources.bridge import face_point

SQL: dict[str, str] = {}

# The inputs: the face template, moved by the numbers of an embedding.
_TX, _TY = (", ".join(str(face_point(k)[side]) for k in range(478)) for side in (0, 1))
_D = "::DOUBLE"
FACES = f"""fa AS (SELECT vec_id::BIGINT // 3 AS case_id, vec_id::BIGINT % 3 AS face, 640e0 AS fw, 480e0 AS fh, CASE WHEN vec_id % 4 = 0 THEN 0.45e0 ELSE 380e0 END AS cw,
 list_transform(range(478), lambda k: round(([{_TX}])[k + 1]::DOUBLE + embedding[(k % 64)::INT + 1]::DOUBLE * 0.1::DOUBLE, 6)) AS xs, list_transform(range(478), lambda k: round(([{_TY}])[k + 1]::DOUBLE + embedding[((k * 7 + 3) % 64)::INT + 1]::DOUBLE * 0.1::DOUBLE, 6)) AS ys FROM embeddings)"""


def px(k: int) -> str:
    return f"(xs[{k + 1}] * fw)"


def py(k: int) -> str:
    return f"(ys[{k + 1}] * fh)"


def dist(a: int, b: int, unit: bool = False) -> str:
    x, y = (f"xs[{a + 1}] - xs[{b + 1}]", f"ys[{a + 1}] - ys[{b + 1}]") if unit else (f"{px(a)} - {px(b)}", f"{py(a)} - {py(b)}")
    return f"sqrt(power({x}, 2) + power({y}, 2))"


def outside(v: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {v} < {lo}{_D} THEN least(1, ({lo}{_D} - {v}) / ({hi}{_D} - {lo}{_D})) WHEN {v} > {hi}{_D} THEN least(1, ({v} - {hi}{_D}) / ({hi}{_D} - {lo}{_D})) ELSE 0 END"


def beyond(v: str, most: float) -> str:
    return f"CASE WHEN {v} <= {most}{_D} THEN 0 ELSE least(1, ({v} - {most}{_D}) / ({most}{_D} + 1e-10)) END"


GEOMETRY = f"""{FACES}, g1 AS (SELECT case_id, face, cw, {dist(33, 263)} AS wide, {dist(468, 473)} AS ipd, ({px(33)} + {px(263)}) / 2 - {px(1)} AS off, CASE WHEN abs({px(263)} - {px(33)}) < 1e-10 THEN 90 ELSE abs(degrees(atan2({py(263)} - {py(33)}, {px(263)} - {px(33)}))) END AS roll,
  {dist(94, 0)} AS ph, {dist(168, 152)} AS low, abs({dist(33, 133)} - {dist(263, 362)}) AS eyes, {dist(98, 327)} AS nose, {dist(61, 291)} AS mouth, abs(({py(66)} + {py(296)}) / 2 - {py(168)}) AS t1, abs({py(168)} - {py(94)}) AS t2, abs({py(94)} - {py(152)}) AS t3 FROM fa),
 g2 AS (SELECT *, abs(off) / (wide + 1e-10) AS yaw, (t1 + t2 + t3) / 3 AS m FROM g1),
 g3 AS (SELECT *, CASE WHEN m < 1e-10 THEN 0 ELSE greatest(abs(t1 - m), abs(t2 - m), abs(t3 - m)) / (m + 1e-10) END AS uneven FROM g2),
 g4 AS (SELECT *, {outside('(ipd / (wide + 1e-10))', 0.35, 0.60)} AS s1, {outside('(ph / (low + 1e-10))', 0.06, 0.20)} AS s2, CASE WHEN yaw > 0.25 THEN 0 ELSE {beyond('(eyes / (wide + 1e-10))', 0.08)} END AS s3, CASE WHEN yaw > 0.25 THEN 0 ELSE {outside('(nose / (ipd + 1e-10))', 0.45, 0.80)} END AS s4,
  CASE WHEN yaw > 0.25 THEN 0 ELSE {outside('(mouth / (ipd + 1e-10))', 0.75, 1.15)} END AS s5, CASE WHEN roll > 15 THEN 0 ELSE {beyond('uneven', 0.26)} END AS s6, wide * cw AS pxw FROM g3),
 g5 AS (SELECT *, least(1, (2 * s1 + 1.5 * s2 + s3 + 1.5 * s4 + s5 + 2 * s6)::DOUBLE / (CASE WHEN yaw > 0.25 THEN 5.5e0 ELSE 9e0 END + 1e-10)) * CASE WHEN pxw < 120 THEN greatest(0.7e0, 0.7e0 + 0.3e0 * (pxw - 60) / 60) ELSE 1 END AS raw FROM g4),
 geo AS (SELECT case_id, face, round(yaw + 1e-9, 6) AS yaw, round(roll + 1e-9, 6) AS roll, array_to_string(list_filter([CASE WHEN s1 > 0 THEN 'IPD ratio' END, CASE WHEN s2 > 0 THEN 'Philtrum ratio' END, CASE WHEN s3 > 0 THEN 'Eye width asymmetry' END, CASE WHEN s4 > 0 THEN 'Nose width ratio' END,
  CASE WHEN s5 > 0 THEN 'Mouth width ratio' END, CASE WHEN s6 > 0 THEN 'Vertical thirds' END], lambda x: x IS NOT NULL), ',') AS violations, 6 AS checks, round(CASE WHEN raw < 0.35 THEN raw * 0.5e0 ELSE raw END + 1e-9, 6) AS score,
  round(0.8e0 * CASE WHEN yaw > 0.12 THEN 0.85e0 ELSE 1 END * CASE WHEN pxw < 80 THEN 0.6e0 WHEN pxw < 120 THEN 0.85e0 ELSE 1 END + 1e-9, 2) AS confidence FROM g5)"""
SQL["geometry_checks"] = f"WITH {GEOMETRY} SELECT * FROM geo"
SQL["geometry_of_case"] = f"""WITH {GEOMETRY}, md AS (SELECT case_id, list_sort(list(score))[count(*) // 2 + 1] AS m FROM geo GROUP BY case_id) SELECT case_id, face, score FROM (SELECT geo.case_id, face, score, row_number() OVER (PARTITION BY geo.case_id ORDER BY abs(score - m), face) AS k FROM geo JOIN md USING (case_id)) WHERE k = 1"""
for name, column in (("worst_face", "score"), ("surest_face", "confidence")):
    SQL[name] = f"WITH {GEOMETRY} SELECT case_id, face, {column} FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {column} DESC, face) AS k FROM geo) WHERE k = 1"
POSE = f"""{FACES}, po AS (SELECT *, abs({dist(1, 234, True)} - {dist(1, 454, True)}) / ({dist(1, 234, True)} + {dist(1, 454, True)} + 1e-10) * 60 AS yaw, abs((ys[2] - (ys[11] + ys[153]) / 2) / ({dist(10, 152, True)} + 1e-10)) * 45 AS pitch, abs(degrees(atan2(ys[474] - ys[469], xs[474] - xs[469]))) AS roll FROM fa)"""
SQL["head_pose"] = f"WITH {POSE} SELECT case_id, face, round(yaw + 1e-8, 5) AS yaw, round(pitch + 1e-8, 5) AS pitch, round(roll + 1e-8, 5) AS roll FROM po"
SQL["corneal_scores"] = f"""WITH {POSE}, c AS (SELECT case_id, face, sqrt(power(xs[469] - xs[474], 2) + power(ys[34] - ys[95], 2)) AS a, yaw + pitch + roll AS p FROM po), s AS (SELECT *, least(1, a / sqrt(8) / (0.5 * (1 + 0.03e0 * p))) AS s FROM c)
 SELECT case_id, face, CASE WHEN face <> 1 THEN round(s + 1e-9, 6) END AS score, CASE WHEN face <> 1 THEN round(a + 1e-9, 6) END AS divergence, CASE WHEN face <> 1 THEN s < 0.5 END AS consistent FROM s"""
_PATCH = {
    "left_periorbital": [33, 160, 158, 133, 153, 144], "right_periorbital": [362, 385, 387, 263, 373, 380], "nasolabial_left": [92, 205, 216, 206], "nasolabial_right": [322, 425, 436, 426], "hairline_band": [10, 338, 297, 332, 284],
    "chin_jaw": [172, 136, 150, 149, 176, 148, 152, 377, 400, 379, 365],
}
_SIDES = lambda nodes: [f"list_{f}({p if nodes is None else '[' + ', '.join(f'{p}[{k + 1}]' for k in nodes) + ']'})" for f in ("min", "max") for p in ("xs", "ys")]
_ONE = [f"SELECT case_id, face, '{n}' AS patch, {x1} * fw AS a, {y1} * fh AS b, {x2} * fw AS c, {y2} * fh AS d FROM fa" for n, nodes in {"face": None, **_PATCH}.items() for x1, y1, x2, y2 in [_SIDES(nodes)]]
SQL["face_crops"] = f"""WITH {FACES}, p AS ({' UNION ALL '.join(_ONE)}) SELECT case_id, face, patch, greatest(0, trunc(a - (c - a) * 0.2e0)::INT) AS x1, greatest(0, trunc(b - (d - b) * 0.2e0)::INT) AS y1, least(640, trunc(c + (c - a) * 0.2e0)::INT) AS x2, least(480, trunc(d + (d - b) * 0.2e0)::INT) AS y2 FROM p"""
_SKIN = {"forehead": ([109, 10, 338, 297, 332, 284, 103, 67], (0.2, 0.05, 0.8, 0.25)), "left_cheek": ([50, 205, 207, 215, 138, 135, 210], (0.1, 0.5, 0.4, 0.85)), "right_cheek": ([280, 425, 427, 435, 367, 364, 430], (0.6, 0.5, 0.9, 0.85))}
_REGION = [
    f"SELECT case_id, face, '{n}' AS region, " + ", ".join(f"CASE WHEN case_id % 7 = 0 THEN {d}e0 ELSE ({s} - {low}) / ({high} - {low}) END AS {c}" for s, d, low, high, c in zip(_SIDES(nodes), default, ("lx", "ly", "lx", "ly"), ("hx", "hy", "hx", "hy"), "abcd")) + " FROM w"
    for n, (nodes, default) in _SKIN.items()
]
SQL["skin_regions"] = f"""WITH {FACES}, w AS (SELECT *, list_min(xs) AS lx, list_max(xs) AS hx, list_min(ys) AS ly, list_max(ys) AS hy FROM fa), r AS ({' UNION ALL '.join(_REGION)}), q AS (SELECT *, 100 + face * 40 AS bx, 330 + face * 160 - (100 + face * 40) AS bw FROM r),
 o AS (SELECT case_id, face, region, greatest(0, least(trunc(bx + bw * a)::INT, 639)) AS x1, greatest(0, least(trunc(60 + 320 * b)::INT, 479)) AS y1, greatest(0, least(trunc(bx + bw * c)::INT, 640)) AS x2, greatest(0, least(trunc(60 + 320 * d)::INT, 480)) AS y2 FROM q) SELECT * FROM o WHERE x1 < x2 AND y1 < y2"""
SQL["scaled_landmarks"] = f"""WITH {FACES} SELECT case_id, face, round((({px(152)} - 100) * (380e0 / 400) + 28) * (380e0 / 436) + 1e-9, 6) AS x, round((({py(152)} - 50) * (380e0 / 380) + 28) * (380e0 / 436) + 1e-9, 6) AS y FROM fa"""
SQL["sane_landmarks"] = f"WITH {FACES} SELECT case_id, face, len(list_filter(range(CASE WHEN face = 0 THEN 90 ELSE 478 END), lambda k: xs[k + 1] >= 0 AND xs[k + 1] <= 1 AND ys[k + 1] >= 0 AND ys[k + 1] <= 1)) >= 100 AS sane FROM fa"

# Boxes and tracks.
SQL["detections_kept"] = f"""WITH {BOXES}, d AS (SELECT case_id, track, frame, x1, y1, x1 + (x2 - x1) % 80 AS x2, y1 + (y2 - y1) % 90 AS y2 FROM bx), k AS (SELECT *, x2 - x1 >= 64 AND y2 - y1 >= 64 AS ok, bool_or(x2 - x1 >= 64 AND y2 - y1 >= 64) OVER (PARTITION BY case_id, frame) AS others,
 row_number() OVER (PARTITION BY case_id, frame ORDER BY (x2 - x1) * (y2 - y1) DESC, x1, y1, x2, y2) AS place FROM d) SELECT * EXCLUDE (ok, others) FROM k WHERE ok OR NOT others AND place = 1"""
SQL["nearest_landmark_set"] = f"""WITH {BOXES}, s AS (SELECT case_id, frame, track AS ord, x1 + 20 AS x1, y1 + 10 AS y1, x2 + 5 AS x2, y2 + 15 AS y2 FROM bx),
 p AS (SELECT bx.case_id, bx.frame, bx.track, s.ord, greatest(0, least(bx.x2, s.x2) - greatest(bx.x1, s.x1)) * greatest(0, least(bx.y2, s.y2) - greatest(bx.y1, s.y1)) AS i, (bx.x2 - bx.x1) * (bx.y2 - bx.y1) + (s.x2 - s.x1) * (s.y2 - s.y1) AS u FROM bx JOIN s ON bx.case_id = s.case_id AND bx.frame = s.frame),
 v AS (SELECT *, round(CASE WHEN u - i > 0 THEN i::DOUBLE / (u - i) ELSE 0 END, 6) AS iou FROM p) SELECT case_id, frame, track, ord, iou FROM (SELECT *, row_number() OVER (PARTITION BY case_id, frame, track ORDER BY iou DESC, ord) AS k FROM v) WHERE k = 1"""
_EVEN = "n AS (SELECT *, row_number() OVER (PARTITION BY case_id, track ORDER BY frame) - 1 AS rn, count(*) OVER (PARTITION BY case_id, track) AS n FROM sb), few AS (SELECT * FROM n WHERE n <= 5 OR rn IN (0, (n - 1) // 4, (n - 1) * 2 // 4, (n - 1) * 3 // 4, n - 1))"
SHARP = f"{BOXES}, sb AS (SELECT *, CASE WHEN x1 % 9 <> 0 THEN ((x1 * 7 + y1 * 13) % 40)::DOUBLE END AS sharpness FROM bx)"
SQL["even_sample"] = f"WITH {SHARP}, {_EVEN} SELECT case_id, track, frame FROM few"
BEST = f"{SHARP}, {_EVEN}, be AS (SELECT case_id, track, coalesce(any_value(f) FILTER (k = 1 AND s > 0), min(first)) AS frame, coalesce(any_value(s) FILTER (k = 1 AND s > 0), 0) AS sharpness FROM (SELECT case_id, track, frame AS f, sharpness AS s, row_number() OVER (PARTITION BY case_id, track ORDER BY coalesce(sharpness, -1) DESC, frame) AS k, min(frame) OVER (PARTITION BY case_id, track) AS first FROM few) GROUP BY case_id, track)"
SQL["sharpest_frame"] = f"WITH {BEST} SELECT * FROM be"
SQL["best_frame_box"] = f"""WITH {BEST}, t AS (SELECT case_id, track, frame + track % 2 AS best FROM be), j AS (SELECT bx.*, frame = best AS exact, row_number() OVER (PARTITION BY case_id, track ORDER BY CASE WHEN frame = best THEN 0 ELSE 1 END, frame) AS k FROM bx JOIN t USING (case_id, track)) SELECT case_id, track, frame, x1, y1, x2, y2, exact FROM j WHERE k = 1"""
TRACKS = f"""{SHARP}, r AS (SELECT *, frame - row_number() OVER (PARTITION BY case_id, track ORDER BY frame) AS run FROM sb), r2 AS (SELECT *, row_number() OVER (PARTITION BY case_id, track, run ORDER BY frame) - 1 AS pos, count(*) OVER (PARTITION BY case_id, track, run) AS len FROM r),
 r3 AS (SELECT case_id, track, run, min(frame) AS start, max(len) AS len, avg((x2 - greatest(0, x1)) * (y2 - greatest(0, y1)) / 307200e0) FILTER (pos % greatest(1, len // 10) = 0) AS area, avg(coalesce(sharpness, 0)) FILTER (pos % greatest(1, len // 10) = 0) AS sharp FROM r2 GROUP BY ALL),
 r4 AS (SELECT *, sum(len) OVER (PARTITION BY case_id, track) AS present, row_number() OVER (PARTITION BY case_id, track ORDER BY len DESC, start) AS k FROM r3),
 tf AS (SELECT case_id, track, start, start + len AS "end", present::BIGINT AS present, round(area + 1e-9, 6) AS area, round(sharp + 1e-9, 6) AS sharpness, list_filter([CASE WHEN len < present * 0.8 THEN 'OCCLUSION' END, CASE WHEN round(area + 1e-9, 6) < 0.01 THEN 'FACE_TOO_SMALL' END, CASE WHEN round(sharp + 1e-9, 6) < 15 THEN 'MOTION_BLUR' END], lambda x: x IS NOT NULL) AS flags FROM r4 WHERE k = 1 AND present >= 4)"""
SQL["track_flags"] = f"WITH {TRACKS} SELECT * REPLACE (array_to_string(flags, ',') AS flags) FROM tf"
SQL["case_flags"] = f"""WITH {TRACKS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "end" - start DESC, track) AS k FROM tf) WHERE k = 1), m AS (SELECT DISTINCT case_id, list_filter([CASE WHEN case_id::INT % 2 = 0 THEN 'MOTION_BLUR' END, CASE WHEN case_id::INT % 3 = 0 THEN 'GRAYSCALE' END], lambda x: x IS NOT NULL) AS f FROM bx)
 SELECT m.case_id, track, array_to_string(list_sort(list_distinct(list_concat(f, coalesce(flags, [])))), ',') AS flags, coalesce("end" - start < 3, true) AS insufficient FROM m LEFT JOIN b ON m.case_id = b.case_id"""
SQL["rebased_boxes"] = f"""WITH {BOXES}, {RUNS} SELECT bx.case_id, bx.track, frame - start AS frame, x1, y1, x2, y2 FROM bx JOIN lr ON bx.case_id = lr.case_id AND bx.track = lr.track WHERE frame >= start AND frame < "end" """
SQL["unmatched_boxes"] = f"""WITH {BOXES}, h AS ({CORE['box_iou'].replace('0.1', '0.3')}) SELECT case_id, frame, track FROM bx WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.case_id = bx.case_id AND h.frame = bx.frame AND (h.a = bx.track OR h.b = bx.track))"""
SQL["abstain_gates"] = f"""WITH {MEDIA}, x AS (SELECT *, case_id::BIGINT AS n FROM med), y AS (SELECT case_id, list_has_any(flags, ['GRAYSCALE', 'HEAVY_BLUR', 'CLIPPED_BLACK', 'CLIPPED_WHITE']) AS no_light, CASE WHEN media_type = 'image' THEN 1 WHEN n % 9 = 0 THEN 2 WHEN n % 200 < 90 THEN 3 WHEN n % 4 = 0 THEN 4 WHEN frames_with_faces_pct * 30 - 3 <= 0 THEN 5 END AS g FROM x)
 SELECT case_id, no_light, ['SKIPPED', 'ERROR', 'ABSTAIN', 'ABSTAIN', 'ABSTAIN'][g] AS label, CASE WHEN g IS NOT NULL THEN g = 2 END AS error, ['Static image', 'Missing input', 'INSUFFICIENT_TEMPORAL_DATA', 'NO_FACES', 'EMPTY_WINDOW'][g] AS reason FROM y"""
SQL["hair_share"] = f"WITH {BOXES} SELECT case_id, track, count(*) AS checked, round(avg((x1 % 2 = 0)::INT), 6) AS share, round(avg((x1 % 2 = 0)::INT), 6) > 0.4 AS occluded FROM bx WHERE frame % 15 = 0 GROUP BY ALL"
_COLOUR = lambda level, gain, k: f"CASE WHEN NOT (t % 37 = 5 AND r = 1) THEN round({level}e0 + {gain}e0 * beat + embedding[(t * 11 + r * 5 + {k}) % 64 + 1]::DOUBLE * (v % 3), 6) END"
TRACES = f"""tr0 AS (SELECT vec_id::BIGINT AS v, embedding, r, t, sin(t / 30e0 * 6.283185307179586 * (0.9e0 + (vec_id % 50) / 50e0)) AS beat FROM embeddings, range(3) a(r), range(120) b(t)), tr AS (SELECT v AS case_id, r::INT AS region, t::INT AS frame, {_COLOUR(120, 0.3, 0)} AS r, {_COLOUR(100, 0.9, 1)} AS g, {_COLOUR(90, 0.2, 2)} AS b FROM tr0)"""
_CARRY = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY case_id, region ORDER BY frame ROWS UNBOUNDED PRECEDING), 128) AS {c}" for c in "rgb")
SQL["carried_means"] = f"WITH {TRACES} SELECT case_id, region, frame, {_CARRY} FROM tr"

# Pictures: a pixel for each row.
PIXELS = """px0 AS (SELECT vec_id, k, greatest(0, least(255, floor(embedding[k + 1]::DOUBLE * 200 + 128)))::INT AS r, greatest(0, least(255, floor(embedding[(k + 21) % 64 + 1]::DOUBLE * 200 + 128)))::INT AS g, greatest(0, least(255, floor(embedding[(k + 42) % 64 + 1]::DOUBLE * 200 + 128)))::INT AS b FROM embeddings, range(64) x(k)),
 px1 AS (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 AS y, CASE WHEN greatest(r, g, b) > 0 THEN floor(255e0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) + 0.5) ELSE 0 END AS s FROM px0),
 px2 AS (SELECT vec_id, list(y ORDER BY k) AS ys, avg(s) AS saturation, avg((y = 0)::INT) AS black, avg((y = 255)::INT) AS white, avg(y) AS brightness, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM px1 GROUP BY vec_id),
 px3 AS (SELECT *, list_transform(range(64), lambda k: ys[(abs(k // 8 - 1) * 8 + k % 8)::INT + 1] + ys[((7 - abs(7 - (k // 8 + 1))) * 8 + k % 8)::INT + 1] + ys[(k // 8 * 8 + abs(k % 8 - 1))::INT + 1] + ys[(k // 8 * 8 + 7 - abs(7 - (k % 8 + 1)))::INT + 1] - 4 * ys[k::INT + 1]) AS lap FROM px2),
 px4 AS (SELECT *, list_aggregate(lap, 'var_pop') AS blur, CASE WHEN vec_id % 3 <> 0 THEN vec_id % 20 END AS bytes FROM px3)"""
_FLAGS = [("GRAYSCALE", "saturation < 40"), ("CLIPPED_BLACK", "black > 0.15"), ("CLIPPED_WHITE", "white > 0.15"), ("COMPRESSION", "bytes / 64e0 < 0.08"), ("HEAVY_BLUR", "blur < 10"), ("LOW_RES", "true"), ("LOW_LIGHT", "brightness < 50")]
SQL["evasion_flags"] = f"""WITH {PIXELS} SELECT vec_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS)}], lambda x: x IS NOT NULL), ',') AS flags, {', '.join(f'round({c} + 1e-7, 4) AS {c}' for c in ('saturation', 'black', 'white', 'blur', 'brightness', 'r', 'g', 'b'))} FROM px4"""
SQL["band_anomalies"] = CORE["band_energy"].replace("SELECT * FROM bands", "SELECT *, NULL::DOUBLE AS z_base, NULL::DOUBLE AS z_mid, NULL::DOUBLE AS z_high, high > 0.15 AS anomaly, CASE WHEN high > 0.15 THEN 'high_freq' END AS anomaly_type FROM bands")

# Manifests: a row for each, without JSON.
_AGENT = "['', 'Adobe Photoshop 25', 'DALL-E 3', 'dalle 2', 'Stable-Diffusion XL', 'Fluxus', 'Midjourneyman', 'Adobe Firefly', 'GIMP']"
_IS_AI = "[false, false, true, true, true, false, false, true, false]"
_NAMES = "['c2pa.created', 'c2pa.edited', 'C2PA.Cropped', 'c2pa.opened', 'c2pa.retouched', 'c2pa.composited', 'c2pa.placed', 'x.Created', 'c2pa.adjusted', 'c2pa.colorgraded', 'c2pa.resized', 'c2pa.filtered', 'custom.created']"
_WEIGHT = "[0, 1, 1, 0, 2, 2, 0, 0, 1, 0, 0, 1, 0]"
_KNOWN = "[1, 1, 1, 1, 1, 1, 0, 2, 1, 1, 1, 1, 2]"
_CREATED = "[true, false, false, false, false, false, false, false, false, false, false, false, true]"
_STATE = "['', '', 'invalid', 'untrusted', 'expired']"
_TOLD = lambda a: f"CASE {_KNOWN}[{a}] WHEN 1 THEN lower({_NAMES}[{a}]) || ' (' || agent || ')' WHEN 2 THEN 'created by ' || agent END"
CHAINS = f"""ma AS (SELECT doc_id AS i, n_chars AS n, unnest(range(0, 1 + n_chars % 3)) AS k FROM documents WHERE doc_id % 10 <> 0),
 mb AS (SELECT i, k, k = n % 3 AS own, CASE WHEN (i + k) % 11 <> 0 THEN 'signer ' || ((i + k) % 5) END AS issuer, (i * 3 + k) % 5 + 1 AS st, (i + k) % 3 <> 0 AS ch, {_AGENT}[(n + k) % 9 + 1] AS agent, {_IS_AI}[(n + k) % 9 + 1] AS named, (i + n + k) % 6 IN (1, 3) AS typed,
  CASE WHEN (i + k) % 4 = 0 THEN (n * 3 + k) % 9 + 1 END AS gen, (i * 7 + n + k * 5) % 13 + 1 AS a, (i + 3 * k) % 13 + 1 AS b FROM ma),
 mc AS (SELECT *, CASE WHEN typed THEN CASE WHEN agent = '' THEN 'AI Generator' ELSE agent END WHEN named THEN agent WHEN {_IS_AI}[gen] THEN {_AGENT}[gen] END AS ai, {_TOLD('a')} AS t1, {_TOLD('b')} AS t2, {_CREATED}[a] OR {_CREATED}[b] AS made FROM mb),
 md AS (SELECT i, any_value(CASE WHEN {_STATE}[st] <> '' THEN {_STATE}[st] WHEN issuer IS NULL THEN 'unsigned' WHEN NOT ch THEN 'valid_no_chain' ELSE 'valid' END) FILTER (own) AS state, arg_min(ai, k) FILTER (ai IS NOT NULL) AS ai, sum({_WEIGHT}[a] + {_WEIGHT}[b])::INT AS severity,
  list_filter(flatten(list([t1, t2] ORDER BY k)), lambda x: x IS NOT NULL) AS told, coalesce(arg_min(coalesce(issuer, 'Unknown'), k) FILTER (made), arg_min(coalesce(issuer, 'Unknown'), k)) AS creation_tool, any_value(coalesce(issuer, 'Unknown')) FILTER (own) AS final_tool FROM mc GROUP BY i),
 me AS (SELECT doc_id, md.*, i IS NOT NULL AS has, coalesce(state IN ('valid', 'valid_no_chain'), false) AS ok, ai IS NOT NULL AS is_ai, coalesce(severity, 0) AS sev FROM documents LEFT JOIN md ON doc_id = i)"""
SQL["manifest_scores"] = f"""WITH {CHAINS} SELECT doc_id, ok AS verified, is_ai, coalesce(ai, '') AS ai_tool, sev AS severity, coalesce(array_to_string(told[1:3], ', '), '') AS actions, coalesce(len(told), 0)::INT AS n_actions,
 (CASE WHEN NOT has THEN 0.5 WHEN ok AND is_ai THEN 0 WHEN ok AND sev >= 3 THEN 0.4 WHEN ok AND sev >= 1 THEN 0.7 WHEN ok THEN 1 WHEN is_ai THEN 0.2 ELSE 0.5 END)::DOUBLE AS real_prob, (CASE WHEN NOT has THEN 0 WHEN ok AND is_ai THEN 0.95 WHEN ok AND sev >= 3 THEN 0.7 WHEN ok AND sev >= 1 THEN 0.8 WHEN ok THEN 0.95 WHEN is_ai THEN 0.6 ELSE 0.3 END)::DOUBLE AS confidence FROM me"""
SQL["signature_states"] = f"WITH {CHAINS} SELECT doc_id, coalesce(state, 'none') AS state FROM me"
SQL["chain_tools"] = f"WITH {CHAINS} SELECT doc_id, coalesce(creation_tool, 'Unknown') AS creation_tool, coalesce(final_tool, 'Unknown') AS final_tool FROM me"
SQL["phone_files"] = """WITH x AS (SELECT doc_id, doc_id % 5 AS m, doc_id % 7 AS b, doc_id % 3 AS s, [5 + 1, 4, 4, 5 + 1, 0][doc_id % 5 + 1] + 1 + length(['Apple', 'HUAWEI', 'LG', 'iPhone', 'Huawei', 'Sony', 'HTC'][doc_id % 7 + 1]) + 1 + [4, 4, 0][doc_id % 3 + 1] + doc_id % 50 AS n FROM documents),
 t AS (SELECT doc_id, m IN (0, 1) AND b IN (0, 2, 4, 6) AS phone, CASE WHEN m = 0 AND b IN (0, 4) THEN 0.4e0 ELSE 0 END + CASE WHEN m = 0 AND s = 0 THEN 0.3e0 ELSE 0 END + CASE WHEN n / 48e0 > 0.3 AND n / 48e0 < 1.8 THEN 0.3e0 ELSE 0 END AS t FROM x) SELECT doc_id, phone, round(t, 6) AS trust, t > 0.5 AS is_phone FROM t"""

# What surrounds the tools.
SQL["error_rows"] = f"""WITH {ev()}, x AS (SELECT seq, tool, seq % 4 AS k FROM ev WHERE error), y AS (SELECT *, ['OutOfMemoryError: x', 'ToolTimeoutError', 'InvalidInput: y', 'odd'][k + 1] AS error_msg FROM x)
 SELECT seq, tool, false AS success, 0.5e0 AS real_prob, [0.1e0, 0.2e0, 0e0, 0e0][k + 1] AS confidence, error_msg, 'Tool ' || tool || ' failed: [' || ['RESOURCE', 'TIMEOUT', 'INPUT', 'UNKNOWN'][k + 1] || '] ' || error_msg AS evidence_summary FROM y"""
SQL["progress_rows"] = f"""WITH {MEDIA}, cp AS ({CORE['cheap_plan']}), gd_ AS ({CORE['gate_decision']}), ep AS ({CORE['expensive_plan']}), vd AS ({CORE['pipeline_verdict']})
 SELECT case_id, 1 AS stage, 0 AS seq, 'PIPELINE_SELECTED' AS event, CASE WHEN has_face AND max_confidence >= 0.60 AND max_face_area_ratio >= 0.01 AND frames_with_faces_pct >= 0.30 THEN 'face' ELSE 'no_face' END AS detail FROM med
 UNION ALL SELECT case_id, 2, seq, 'TOOL_STARTED', tool FROM cp UNION ALL SELECT case_id, 3, 0, 'GATE', decision FROM gd_ UNION ALL SELECT case_id, 4, seq, 'TOOL_STARTED', tool FROM ep UNION ALL SELECT case_id, 5, 0, 'VERDICT', verdict FROM vd"""
SQL["token_budgets"] = """WITH t AS (SELECT doc_id, floor(coalesce(length(text), NULL) / 2.5e0)::BIGINT AS p, doc_id % 3 + 1 AS a FROM documents), u AS (SELECT *, least(2048, greatest(8192 - p - CASE WHEN a > 1 THEN 30 ELSE 0 END, 256)) AS n FROM t)
 SELECT doc_id, p AS prompt_tokens, n AS num_predict, greatest(8192, p + n) AS num_ctx, 42 + (a - 1) * 1000 AS seed, CASE WHEN doc_id % 3000 >= n THEN floor(n * 1.5e0)::BIGINT ELSE n END AS next_tokens FROM u"""
SQL["fallback_documents"] = """SELECT page_id, '{"verdict":"INCONCLUSIVE","confidence":0.0,"reasoning":"LLM synthesis failed after ' || (page_id % 4) || ' attempts. Error ' || page_id || '. Relying on raw ensemble score.","_error":"llm_synthesis_failed","_fallback":true,"_exclude_from_ensemble":true}' AS document FROM pages"""
SQL["client_metrics"] = """WITH c AS (SELECT event_id % 3 <> 0 AS j, event_id % 7 <> 0 AS ok, event_id % 4 + 1 AS a, event_id % 11 = 0 AS t, (event_id % 100) / 10e0 AS s FROM events)
 SELECT count(*) FILTER (j AND ok) AS json_success_count, count(*) FILTER (j AND NOT ok) AS json_failure_count, count(*) FILTER (NOT j AND ok) AS text_success_count, count(*) FILTER (a > 1) AS retry_count, count(*) FILTER (t) AS truncation_count, count(*) FILTER (ok) AS total_generation_calls,
 round(coalesce(count(*) FILTER (j AND ok) / nullif(count(*) FILTER (j), 0)::DOUBLE, 0) * 100, 2) AS json_success_rate, round(coalesce(avg(s) FILTER (ok), 0), 2) AS avg_generation_time_sec FROM c"""
SQL["stream_frames"] = "SELECT conv_id, turn, role || '|' || chr(10) || 'data:' || turn || '|last' AS frames FROM conversations"
SQL["iso_times"] = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch(date_trunc('second', ts))::BIGINT WHEN 1 THEN epoch(date_trunc('second', ts))::BIGINT - 7200 END AS seconds, 'report_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' AS name FROM events"""
SQL["score_maps"] = """SELECT doc_id, round((doc_id * 7 % 997) / 997e0 + (doc_id * 11 % 997) / 997e0 + (doc_id * 13 % 997) / 997e0 + (doc_id * 17 % 997) / 997e0 + 1e-9, 6) AS total, 4 AS n, doc_id % 6 <> 0 AS valid, lang FROM documents"""
SQL["store_counts"] = f"""WITH {CASES}, c AS (SELECT (SELECT count(*) FROM inc) AS offered, (SELECT count(DISTINCT file_hash) FROM inc WHERE file_hash NOT IN (SELECT file_hash FROM st)) AS inserted, (SELECT count(*) FROM st WHERE feedback_label IS NOT NULL) AS labelled) SELECT *, offered - inserted AS ignored FROM c"""
_TRUTH = "t AS (SELECT l.doc_id, toxic AS y, ((n_chars * 7 + toxic * 300) % 1000)::DOUBLE / 1000 AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
SQL["first_of_class"] = f"WITH {_TRUTH} SELECT doc_id, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY doc_id) AS k FROM t) WHERE k <= 20"
SQL["first_pictures"] = "SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 500"
SQL["tool_agreement"] = f"WITH {_TRUTH} SELECT CASE WHEN score >= 0.5 THEN 'FAKE' ELSE 'REAL' END AS verdict, (score >= 0.5)::INT = y AS matched, count(*) AS n FROM t GROUP BY ALL"
SQL["normalised_weights"] = f"""WITH {ev()}, w AS (SELECT tool, round(avg(confidence) FILTER (success), 9) AS w FROM ev GROUP BY tool)
 SELECT tool, round(w / sum(w) OVER (), 9) AS weight FROM w"""
SQL["breaker_calls"] = """WITH RECURSIVE c AS (SELECT user_id::VARCHAR AS tool, event_id AS seq, (event_id * 7 % 900)::DOUBLE AS at_, (event_id * 31) % 10 > 5 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7 % 900, event_id) AS rn FROM events),
 s AS (SELECT tool, 0::BIGINT AS rn, 0::BIGINT AS seq, true AS allowed, 'CLOSED' AS state, 0 AS n, 0e0 AS trip FROM (SELECT DISTINCT tool FROM c)
  UNION ALL SELECT tool, rn, seq, st <> 'OPEN', CASE WHEN st = 'OPEN' THEN st WHEN ok THEN 'CLOSED' WHEN n + 1 >= 3 THEN 'OPEN' ELSE st END, CASE WHEN st = 'OPEN' THEN n WHEN ok THEN 0 ELSE n + 1 END, CASE WHEN st <> 'OPEN' AND NOT ok AND n + 1 >= 3 THEN at_ ELSE trip END
  FROM (SELECT c.*, s.n, s.trip, CASE WHEN s.state = 'OPEN' AND c.at_ - s.trip > 60 THEN 'HALF_OPEN' ELSE s.state END AS st FROM s JOIN c ON c.tool = s.tool AND c.rn = s.rn + 1))
 SELECT tool, seq, allowed, state FROM s WHERE rn > 0"""
_POWER = lambda n: f"power(sum(w * cos(2 * pi() * k * frame / {n})), 2) + power(sum(w * sin(2 * pi() * k * frame / {n})), 2)"
_HANN = "(0.5 - 0.5 * cos(2 * pi() * frame / 119))"
SQL["pulse_metrics"] = f"""WITH {TRACES}, ca AS (SELECT case_id, region, frame, {_CARRY} FROM tr), mn AS (SELECT *, r / greatest(avg(r) OVER p, 1) AS cr, g / greatest(avg(g) OVER p, 1) AS cg, b / greatest(avg(b) OVER p, 1) AS cb FROM ca WINDOW p AS (PARTITION BY case_id, region)),
 xy AS (SELECT *, cg - cb AS x, cg + cb - 2 * cr AS y FROM mn), hh AS (SELECT *, x + stddev_pop(x) OVER p / (stddev_pop(y) OVER p + 1e-7) * y AS h FROM xy WINDOW p AS (PARTITION BY case_id, region)), hs AS (SELECT *, (h - avg(h) OVER p) / (stddev_pop(h) OVER p + 1e-7) AS s FROM hh WINDOW p AS (PARTITION BY case_id, region)),
 sw AS (SELECT case_id, region, frame, (s - avg(s) OVER p) * {_HANN} AS w, (g - avg(g) OVER p) * {_HANN} AS v FROM hs WINDOW p AS (PARTITION BY case_id, region)),
 pw AS (SELECT case_id, region, k, {_POWER(2048)} AS p FROM sw, range(48, 171) b(k) GROUP BY ALL), pk AS (SELECT case_id, region, arg_max(k, p) AS top, max(p) AS most, median(p) AS mid, sum(p) AS total FROM pw GROUP BY ALL),
 nr AS (SELECT pk.case_id, pk.region, any_value(top) AS top, any_value(most) AS most, any_value(mid) AS mid, any_value(total) AS total, sum(p) FILTER (abs(k - top) <= 2) AS near FROM pk JOIN pw ON pk.case_id = pw.case_id AND pk.region = pw.region GROUP BY ALL),
 mw AS (SELECT case_id, region, k, {_POWER(256).replace('w *', 'v *')} AS p FROM sw, range(0, 22) b(k) WHERE k <= 4 OR k >= 6 GROUP BY ALL), mo AS (SELECT case_id, region, sum(p) FILTER (k <= 4) / (sum(p) + 1e-10) AS share FROM mw GROUP BY ALL),
 st AS (SELECT case_id, region, count(*) AS n, stddev_pop(g) AS std FROM ca GROUP BY ALL), fl AS (SELECT case_id, region, stddev_pop(s) < 1e-5 AS flat FROM hs GROUP BY ALL)
 SELECT st.case_id, st.region, n, round(top * 30e0 / 2048, 6) AS peak_hz, round(10 * log10(greatest(near, 1e-10) / greatest(total - near, 1e-10)), 3) AS snr_db, round(most / (mid + 1e-10), 1) AS concentration, round(std, 5) AS std, flat, round(share, 5) AS motion_share, share > 0.75 AS moving
 FROM st JOIN nr ON st.case_id = nr.case_id AND st.region = nr.region JOIN mo ON st.case_id = mo.case_id AND st.region = mo.region JOIN fl ON st.case_id = fl.case_id AND st.region = fl.region"""
_RULES = CORE["liveness_labels"][CORE["liveness_labels"].index("g AS (SELECT id") :].replace("v % 17 = 0 OR v % 19 = 0 AS unclear, v % 11 = 0 AS flat FROM b", "id % 20 = 0 OR (SELECT bool_or(moving) FROM r WHERE r.id = b.id) AS unclear, (SELECT bool_and(flat) FROM r WHERE r.id = b.id) AS flat FROM b")
SQL["pulse_labels"] = f"""WITH pm AS ({SQL['pulse_metrics']}), r AS (SELECT case_id AS id, case_id AS v, region AS k, peak_hz AS hz, snr_db AS snr, std AS sd, flat, moving FROM pm), {_RULES}"""
_VIEWS = "vw AS (SELECT vec_id AS case_id, c AS face, v AS view, 4 * (embedding[c * 20 + v * 7 + 1]::DOUBLE + embedding[c * 20 + v * 7 + 2]::DOUBLE) AS logit FROM embeddings, range(2) a(c), range(2) b(v))"
SQL["view_scores"] = f"""WITH {_VIEWS}, f AS (SELECT case_id, face, 1 / (1 + exp(-avg(logit) / 2)) AS s FROM vw GROUP BY ALL) SELECT case_id, count(*) AS n_crops, round(max(s) + 1e-9, 6) AS worst, round(1 - max(s) + 1e-9, 6) AS real_prob FROM f GROUP BY case_id"""
SQL["view_spread"] = f"""WITH {_VIEWS}, f AS (SELECT case_id, face, max(1 / (1 + exp(-logit))) AS m FROM vw GROUP BY ALL) SELECT case_id, count(*) AS n, round(avg(m) + 1e-9, 6) AS mean, round(stddev_pop(m) + 1e-9, 6) AS std FROM f GROUP BY case_id"""
SQL["skipped_tools"] = f"""WITH {ev(True)}, {DD}, g AS (SELECT case_id, max(1 - real_prob) FILTER (tool = 'run_univfd') AS u, max(real_prob) FILTER (tool = 'run_sbi') AS p, max(confidence) FILTER (tool = 'run_sbi') AS c FROM dd GROUP BY case_id)
 SELECT case_id, coalesce(u > 0.90::DOUBLE, false) AS skipped, CASE WHEN u > 0.90::DOUBLE THEN 0 ELSE p END AS real_prob, CASE WHEN u > 0.90::DOUBLE THEN 1 ELSE c END AS confidence FROM g WHERE p IS NOT NULL"""
