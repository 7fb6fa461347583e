"""DuckDB SQL with the same rows as each registered query."""

from __future__ import annotations

from . import dims as d
from .queries import AS_OF, KEYS, PROBE, QUERY
from .sources.bridge import EVENT_TYPES

SQL: dict[str, str] = {}


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


DIM = "dim(tool, fw, rw, tier, gw, category, domain, gpu) AS (VALUES " + ", ".join(f"('{t[0]}', {t[1]}::DOUBLE, {t[2]}::DOUBLE, {t[3]}, {t[4]}::DOUBLE, {repr(t[5]) if t[5] else 'NULL'}, {repr(t[6]) if t[6] else 'NULL'}, {t[7]})" for t in d.TOOLS) + ")"


def ev(dense: bool = False) -> str:
    case = "CAST(user_id AS VARCHAR)" + ("" if dense else " || '-' || strftime(ts, '%Y-%m-%d')")
    flags = ", ".join(f"user_id % {k} = 0 AS {n}" for n, k in (("f_comp", 5), ("f_grey", 7), ("f_blur", 11)))
    return f"""ev AS (SELECT {case} AS case_id, event_id AS seq, {_list(d.NAMES)}[list_position({_list(EVENT_TYPES)}, event_type) * 2 - 1 + event_id % 2] AS tool,
 event_id % 17 <> 0 AS success, ((event_id * 7919) % 1001)::DOUBLE / 1000e0 AS real_prob, ((event_id * 6007) % 1001)::DOUBLE / 1000e0 AS confidence, event_id % 17 = 0 AS error,
 CASE WHEN event_id % 17 = 0 THEN 'tool failed' END AS error_msg, ((event_id * 31) % 101)::DOUBLE / 100e0 AS peak_ratio, event_id % 3 = 0 AS c2pa_verified, event_id % 6 = 0 AS is_ai_generated,
 CASE WHEN event_id % 13 = 0 THEN 'ABSTAIN' END AS liveness_label, (event_id % 50)::DOUBLE / 10e0 AS execution_time, {flags} FROM events)"""


DD = """dd AS (SELECT * EXCLUDE rn FROM (SELECT *, min(seq) OVER (PARTITION BY case_id, tool) AS slot, row_number() OVER (PARTITION BY case_id, tool ORDER BY success DESC, seq DESC) AS rn FROM ev) WHERE rn = 1)"""

S = "(1 - real_prob)"


def _route(by: str) -> str:
    """contribution and weight as two CASE expressions, null for an abstention."""
    cut = lambda *f: " * ".join(f"CASE WHEN {w} THEN {x}::DOUBLE ELSE 1e0 END" for w, x in f)
    sbi = f"CASE WHEN {S} >= 0.80 THEN 0.15::DOUBLE * {cut(('comp', 0.40), ('grey', 0.1))} ELSE (0.03::DOUBLE + 0.12::DOUBLE * univfd_fake) * {cut(('comp', 0.40), ('grey OR blur', 0.1))} END"
    weight = f"""CASE WHEN NOT success OR coalesce(error_msg, '') <> '' OR confidence <= 0 OR (fw = 0 AND tool <> 'check_c2pa') THEN NULL
 WHEN tool = 'check_c2pa' THEN 0e0 WHEN tool = 'run_rppg' THEN CASE WHEN {S} < 0.30 OR {S} > 0.70 THEN 0.06::DOUBLE * {by} END
 WHEN tool = 'run_univfd' THEN fw * {by} WHEN tool = 'run_xception' THEN fw * {cut(('grey OR comp', 1.25))} * {by} WHEN tool = 'run_sbi' THEN {sbi} * {by}
 WHEN tool = 'run_freqnet' THEN fw * {cut(('comp', 0.50), ('grey OR blur', 0.1))} * {by} WHEN tool = 'run_corneal' AND {S} < 0.30 THEN NULL WHEN tool = 'run_illumination' AND {S} < 0.08 THEN NULL
 WHEN tool = 'run_geometry' THEN fw * {cut(('grey OR comp OR blur', 1.5))} * {by} ELSE fw * {by} END"""
    return weight


def routed(dense: bool = False, weighted: bool = False) -> str:
    share = f"CASE WHEN tool = 'run_rppg' THEN CASE WHEN {S} < 0.30 THEN 0e0 ELSE 0.85::DOUBLE END ELSE {S} END"
    return f"""{DIM}, {ev(dense)}, {DD},
 cx AS (SELECT dd.*, coalesce(dim.fw, 0) AS fw, dim.category, coalesce(dim.gpu, false) AS gpu,
  bool_or(f_comp) OVER c OR coalesce(max(CASE WHEN dd.tool = 'run_dct' AND success THEN peak_ratio END) OVER c, 0) > 0.80 AS comp, bool_or(f_grey) OVER c AS grey, bool_or(f_blur) OVER c AS blur,
  coalesce(max(CASE WHEN dd.tool = 'run_univfd' AND success THEN 1 - real_prob END) OVER c, 0.5) AS univfd_fake FROM dd LEFT JOIN dim USING (tool) WINDOW c AS (PARTITION BY case_id)),
 rr AS (SELECT *, {_route('confidence' if weighted else '1e0')} AS rw0, {_route('1e0')} AS pw, {share} AS share FROM cx),
 ro AS (SELECT *, rw0 IS NULL AS abstain, coalesce(rw0 * share, 0) * damp AS contribution, coalesce(rw0, 0) * damp AS weight FROM (SELECT *, CASE WHEN rw0 IS NOT NULL AND confidence < 0.60 THEN power(confidence / 0.60::DOUBLE, 2) ELSE 1e0 END AS damp FROM rr))"""


def fused(dense: bool = False, weighted: bool = False, override: bool = True, strict: bool = False) -> str:
    v = "(gpu AND weight > 1e-9)"
    lo = "ln(greatest(1e-6, least(1 - 1e-6, mass)) / (1 - greatest(1e-6, least(1 - 1e-6, mass))))"
    return f"""WITH {routed(dense, weighted)},
 ma AS (SELECT *, CASE WHEN {S} > 0.5 THEN {S} WHEN {S} >= 0.42 THEN 0.5 + ({S} - 0.42) * 0.50 ELSE 0 END AS mass FROM ro),
 su AS (SELECT *, {v} AND mass > 0.51 AS suspect, CASE WHEN NOT abstain THEN CASE WHEN weight > 1e-9 THEN contribution / weight WHEN gpu THEN 0e0 END END AS implied FROM ma),
 lg AS (SELECT *, CASE WHEN suspect THEN {lo} * CASE WHEN category IS NOT NULL AND coalesce(max(suspect::INT) OVER (PARTITION BY case_id, category ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 0.5 ELSE 1 END * confidence * confidence * CASE WHEN confidence >= 0.40 THEN 2.5 ELSE 1 END END AS logit,
  {v} AND {S} > 0.5 AND confidence >= 0.55 AS dual, (gpu OR tool IN ('run_geometry', 'run_illumination')) AND success AND confidence > 0.1 AS visual FROM su),
 g AS (SELECT case_id, sum(weight) AS w, sum(contribution) AS c, coalesce(sum(weight) FILTER (gpu AND weight > 0), 0) AS gw, coalesce(sum(contribution) FILTER (gpu AND weight > 0), 0) AS gc,
  coalesce(sum(weight) FILTER (NOT gpu AND weight > 0), 0) AS cw, coalesce(sum(contribution) FILTER (NOT gpu AND weight > 0), 0) AS cc, CASE WHEN count(implied) < 2 THEN 0 ELSE stddev_pop(implied) END AS std,
  max({S}) FILTER ({v}) AS strongest, count(*) FILTER ({v} AND {S} > 0.5 AND confidence >= 0.80) AS singles, list_sort(list({S}) FILTER (dual), 'DESC') AS top, count(*) FILTER (dual) AS duals,
  sum(logit) AS logit, count(logit) AS suspects, count(*) FILTER ({v} AND {S} BETWEEN 0.35 AND 0.55 AND confidence < 0.85) AS middle, count(*) FILTER (gpu AND success AND abstain AND confidence > 0) AS lost,
  count(*) FILTER (NOT abstain) AS n_ran, count(*) FILTER (abstain) AS n_abstained, bool_or(tool = 'check_c2pa' AND success AND c2pa_verified) AS verified,
  coalesce(sum(fw) FILTER (visual), 0) AS vt, coalesce(sum(pw) FILTER (visual AND pw > 1e-9), 0) AS vw, coalesce(sum(pw * share) FILTER (visual AND pw > 1e-9), 0) AS vc FROM lg GROUP BY case_id),
 b AS (SELECT *, CASE WHEN w < 1e-9 THEN 0.5 WHEN gw > 1e-9 THEN 0.85 * (gc / gw) + 0.15 * CASE WHEN cw > 1e-9 THEN cc / cw ELSE gc / gw END ELSE c / w END AS base,
  CASE WHEN singles > 0 THEN 0.12 * strongest WHEN duals >= 2 THEN 0.10 * (top[1] + top[2]) / 2 ELSE 0 END AS boost, CASE WHEN singles > 0 THEN 'single_high_confidence_gpu' WHEN duals >= 2 THEN 'two_gpu_fake_votes' END AS policy_reason FROM g),
 sc AS (SELECT *, CASE WHEN suspects = 0 OR (suspects = 1 AND std > 0.175) THEN base ELSE greatest(1 / (1 + exp(-logit * 0.45)), base) END AS s0 FROM b),
 ca AS (SELECT *, least(1, greatest(base, CASE WHEN middle >= 2 THEN greatest(s0, 0.85) ELSE s0 END) + boost) AS cand, verified AND vt > 0.40 AND {override} AS seen, CASE WHEN vw > 0 THEN vc / vw ELSE 0 END AS vm FROM sc),
 fi AS (SELECT *, CASE WHEN cand < 0.40 AND cand * (1 + 0.02 * lost) >= 0.50 THEN 0.4999 ELSE least(1, cand * (1 + 0.02 * lost)) END AS final, seen AND vm < 0.35 AS override, seen AND vm > 0.55 AS spoofing FROM ca),
 fused AS (SELECT case_id, CASE WHEN override THEN {0 if strict else 1} WHEN spoofing THEN 0 WHEN w < 1e-9 THEN 0.5 ELSE round(1 - round(least(1, greatest(0, final)) + 1e-7, 4), 4) END::DOUBLE AS ensemble_score, override, spoofing,
  w < 1e-9 OR w < 0.50 OR round(std, 9) > 0.25 AS is_inconclusive, round(std, 9) > 0.20 AS has_conflict, round(std + 1e-7, 4) AS conflict_std, round(w + 1e-7, 4) AS total_weight, round(base + 1e-9, 6) AS base_fake, round(boost + 1e-7, 4) AS policy_boost, policy_reason, suspects, n_ran, n_abstained FROM fi),
 out AS (SELECT case_id, ensemble_score, CASE WHEN ensemble_score <= 0.54 THEN 'FAKE' ELSE 'REAL' END AS verdict, * EXCLUDE (case_id, ensemble_score) FROM fused)"""


E_ = f"WITH {ev()}, {DD}"
SQL["dedup_latest"] = f"{E_} SELECT case_id, tool, slot, seq, success, real_prob, confidence FROM dd"
SQL["dedup_overwrite"] = f"WITH {ev()} SELECT case_id, tool, min(seq) AS slot, max(seq) AS seq, arg_max(success, seq) AS success FROM ev GROUP BY ALL"
SQL["weight_breakdown"] = f"WITH {routed()} SELECT case_id, tool, slot, real_prob, round({S}, 6) AS fake_prob, confidence, round(contribution + 1e-12, 9) AS contribution, round(weight + 1e-12, 9) AS effective_weight FROM ro WHERE success"
SQL["fusion_full"] = fused() + " SELECT * FROM out"
SQL["fusion_dense"] = fused(True) + " SELECT * FROM out"
SQL["fusion_confidence_weighted"] = fused(weighted=True) + " SELECT * FROM out"
SQL["fusion_strict"] = fused(True, strict=True) + " SELECT case_id, ensemble_score, verdict, override, spoofing FROM out"
SQL["fusion_base"] = fused(override=False) + " SELECT case_id, base_fake, total_weight, verdict FROM out"
SQL["abstentions"] = f"WITH {routed()} SELECT case_id, tool, real_prob, CASE WHEN success THEN 'abstain_or_failure' ELSE 'tool_failed' END AS reason FROM ro WHERE abstain"
SQL["conflict_stats"] = fused() + " SELECT has_conflict, is_inconclusive, verdict, count(*) AS n, round(avg(conflict_std), 4) AS mean_std FROM out GROUP BY ALL"
SQL["policy_boost"] = fused(True) + " SELECT case_id, policy_boost, policy_reason, suspects FROM out"

_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN user_id % {k} = 0 THEN '{n}' END" for n, k in (("COMPRESSION", 5), ("GRAYSCALE", 7), ("HEAVY_BLUR", 11), ("MOTION_BLUR", 13), ("FACE_TOO_SMALL", 4), ("LOW_LIGHT", 6))) + "], lambda x: x IS NOT NULL)"
MEDIA = f"""med AS (SELECT CAST(user_id AS VARCHAR) AS case_id, v > 0 AS has_face, round(1 - 1e0 / (1 + v), 6) AS max_confidence, round(v::DOUBLE / n / 10, 6) AS max_face_area_ratio, round(days / 30e0, 6) AS frames_with_faces_pct,
 n % 3 = 0 AS insufficient, CASE WHEN user_id % 2 = 0 THEN 'video' ELSE 'image' END AS media_type, {_FLAGS} AS flags FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS v, count(DISTINCT ts::DATE) AS days FROM events GROUP BY user_id)),
 mg AS (SELECT *, has_face AND max_confidence >= 0.60 AND max_face_area_ratio >= 0.01 AND frames_with_faces_pct >= 0.30 AS gate, list_has_any(flags, ['MOTION_BLUR', 'OCCLUSION']) AS hid, list_contains(flags, 'FACE_TOO_SMALL') AS small, list_contains(flags, 'LOW_LIGHT') AS dark FROM med)"""
CHEAP = """cp AS (SELECT case_id, list_filter(['check_c2pa', 'run_dct', CASE WHEN gate AND NOT insufficient AND media_type <> 'image' THEN 'run_rppg' END, CASE WHEN gate AND NOT hid THEN 'run_geometry' END,
 CASE WHEN gate AND NOT hid AND (small OR NOT dark) THEN 'run_illumination' END, CASE WHEN gate AND NOT hid AND NOT small AND NOT dark THEN 'run_corneal' END], lambda x: x IS NOT NULL) AS tools FROM mg),
 cheap AS (SELECT case_id, unnest(range(0, len(tools))) AS seq, unnest(tools) AS tool FROM cp)"""


def gate(source: str) -> str:
    return f"""gd AS (SELECT *, CASE WHEN n_decisive < 3 THEN 'FULL_GPU' WHEN confidence > 0.93 AND unison THEN 'HALT' WHEN confidence >= 0.80 THEN 'MINIMAL_GPU' ELSE 'FULL_GPU' END AS decision FROM (
 SELECT case_id, n_decisive, n_domains, round(CASE WHEN n_decisive >= 3 AND w > 0 THEN abs(s / w) ELSE 0 END, 9) AS confidence, coalesce(n_decisive >= 3 AND same AND n_domains >= 2, false) AS unison FROM (
 SELECT case_id, count(*) FILTER (x) AS n_decisive, coalesce(sum(gw) FILTER (x), 0) AS w, coalesce(sum(-2 * (real_prob - 0.5) * confidence * gw) FILTER (x), 0) AS s, min((real_prob < 0.5)::INT) FILTER (x) = max((real_prob < 0.5)::INT) FILTER (x) AS same, count(DISTINCT domain) FILTER (x) AS n_domains
 FROM (SELECT q.*, dim.gw, dim.domain, success AND NOT error AND coalesce(liveness_label, '') NOT IN ('ABSTAIN', 'ERROR') AND abs(real_prob - 0.5) > 0.15 AS x FROM {source} q JOIN dim USING (tool) WHERE NOT dim.gpu) GROUP BY case_id)))"""


EXPENSIVE = """ep AS (SELECT case_id, CASE WHEN coalesce(decision, 'FULL_GPU') = 'HALT' THEN [] WHEN decision = 'MINIMAL_GPU' THEN ['run_univfd'] WHEN gate THEN ['run_freqnet', 'run_univfd', 'run_xception', 'run_sbi'] ELSE ['run_freqnet', 'run_univfd', 'run_xception'] END AS tools FROM mg LEFT JOIN gd USING (case_id)),
 expensive AS (SELECT case_id, unnest(range(0, len(tools))) AS seq, unnest(tools) AS tool FROM ep)"""
SQL["face_gate"] = f"WITH {MEDIA} SELECT case_id, gate, max_confidence, max_face_area_ratio, frames_with_faces_pct FROM mg"
SQL["cheap_plan"] = f"WITH {MEDIA}, {CHEAP} SELECT * FROM cheap"
_G = f"WITH {DIM}, {ev(True)}, {DD}, {gate('dd')}"
SQL["gate_decision"] = f"{_G} SELECT case_id, decision, round(confidence, 6) AS confidence, unison, n_decisive, n_domains FROM gd"
SQL["expensive_plan"] = f"{_G}, {MEDIA}, {EXPENSIVE} SELECT * FROM expensive"
SQL["degraded_cases"] = f"WITH {ev()} SELECT case_id, count(*) AS n_rows, round(avg(error::INT), 6) AS error_share, avg(error::INT) > 0.5 AS degraded FROM ev GROUP BY case_id"
_STAGED = fused(True).replace(f"{DD},", f"d0 AS (SELECT * EXCLUDE rn FROM (SELECT *, min(seq) OVER (PARTITION BY case_id, tool) AS slot, row_number() OVER (PARTITION BY case_id, tool ORDER BY success DESC, seq DESC) AS rn FROM ev) WHERE rn = 1), {MEDIA}, {CHEAP}, ch AS (SELECT d0.* FROM d0 JOIN (SELECT case_id, tool FROM cheap) USING (case_id, tool)), {gate('ch')}, {EXPENSIVE}, pl AS (SELECT * FROM ch UNION ALL SELECT d0.* FROM d0 JOIN (SELECT case_id, tool FROM expensive) USING (case_id, tool)), cer AS (SELECT * FROM pl WHERE tool = 'check_c2pa' AND success AND c2pa_verified), dd AS (SELECT * REPLACE (seq AS slot) FROM pl WHERE case_id NOT IN (SELECT case_id FROM cer)),", 1)
_VERDICTS = f"""{_STAGED}, ver AS (SELECT case_id, 'provenance' AS path, NULL AS decision, CASE WHEN is_ai_generated THEN 0e0 ELSE 1e0 END AS ensemble_score, CASE WHEN is_ai_generated THEN 'FAKE' ELSE 'REAL' END AS verdict, false AS degraded FROM cer
 UNION ALL SELECT o.case_id, 'fusion', gd.decision, o.ensemble_score, o.verdict, g2.deg FROM out o JOIN (SELECT case_id, avg(error::INT) > 0.5 AS deg FROM dd GROUP BY case_id) g2 USING (case_id) LEFT JOIN gd USING (case_id))"""
SQL["pipeline_verdict"] = f"{_VERDICTS} SELECT * FROM ver"
SQL["verdict_report"] = f"{_VERDICTS} SELECT case_id, format('Case {{}}: {{}} with an authenticity of {{:.4f}} by {{}}.', case_id, verdict, ensemble_score, path) AS text FROM ver"
_ALL = sum(t[2] for t in d.TOOLS)
SQL["early_stop_decisions"] = f"""{E_}, {DIM}, q AS (SELECT case_id, tool, CASE WHEN success THEN 1 - real_prob END AS fake, tool = 'check_c2pa' AND success AND c2pa_verified AS verified FROM dd),
 g AS (SELECT case_id, bool_or(verified) AS verified, count(*) FILTER (ok) AS n, coalesce(sum(rw) FILTER (ok), 0) AS run, {_ALL!r}::DOUBLE - coalesce(sum(rw), 0) AS pending, coalesce(sum(fake * rw) FILTER (ok), 0) AS sw, coalesce(sum(2 * rw * greatest(0, fake - 0.5)) FILTER (ok), 0) AS f, coalesce(sum(2 * rw * greatest(0, 0.5 - fake)) FILTER (ok), 0) AS r, coalesce(bool_or(ok AND tier = 3), false) AS trusted
  FROM (SELECT q.*, dim.rw, dim.tier, dim.rw IS NOT NULL AND fake IS NOT NULL AS ok FROM q LEFT JOIN dim USING (tool)) GROUP BY case_id),
 h AS (SELECT *, CASE WHEN run > 0 THEN round(sw / run, 9) END AS score, CASE WHEN run > 0 THEN round(sw / (run + pending), 9) END AS lowest, CASE WHEN run > 0 THEN round((sw + pending) / (run + pending), 9) END AS highest FROM g),
 i AS (SELECT *, CASE WHEN verified THEN 'HALT_HARDWARE_VERIFIED' WHEN n = 0 OR run <= 0 THEN 'CONTINUE_AMBIGUOUS' WHEN n > 1 AND round(f + r, 9) >= 0.10 AND greatest(f, r) > 0 AND round(least(f, r) / greatest(f, r), 9) > 0.35 THEN 'CONTINUE_ADVERSARIAL_CONFLICT'
  WHEN ((highest < 0.5 AND score < 0.5) OR (lowest > 0.5 AND score > 0.5)) AND NOT trusted THEN 'CONTINUE_SECURITY_REQUIRED' WHEN highest < 0.5 AND score < 0.5 THEN 'HALT_LOCKED_REAL' WHEN lowest > 0.5 AND score > 0.5 THEN 'HALT_LOCKED_FAKE' ELSE 'CONTINUE_AMBIGUOUS' END AS reason FROM h)
 SELECT case_id, starts_with(reason, 'HALT') AS stop, reason, round(CASE WHEN reason = 'HALT_HARDWARE_VERIFIED' THEN 1 WHEN reason = 'HALT_LOCKED_REAL' THEN 1 - score ELSE coalesce(score, 0) END, 6) AS confidence, round(score, 6) AS score, round(lowest, 6) AS lowest, round(highest, 6) AS highest FROM i"""
SQL["pending_tools"] = f"WITH {ev()}, {DIM}, c AS (SELECT DISTINCT case_id FROM ev) SELECT case_id, dim.tool FROM c CROSS JOIN dim ANTI JOIN ev ON ev.case_id = c.case_id AND ev.tool = dim.tool"
SQL["unknown_tools"] = f"WITH {ev()} SELECT tool || '_v2' AS tool, count(*) AS n_rows FROM ev WHERE seq % 10 = 0 GROUP BY ALL"
SQL["tool_health"] = f"WITH {ev()} SELECT tool, count(*) AS calls, count(*) FILTER (error) AS errors, round(sum(execution_time), 4) AS total_time, round(avg(execution_time), 6) AS avg_time, max(seq) FILTER (error) AS last_error_seq FROM ev GROUP BY tool"
SQL["breaker_state"] = f"""WITH {ev()}, r AS (SELECT case_id AS tool, seq, confidence > 0.5 AS ok, sum((confidence > 0.5)::INT) OVER (PARTITION BY case_id ORDER BY seq) AS run FROM ev)
 SELECT tool, seq, in_row::BIGINT AS in_row, CASE WHEN in_row >= 3 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY tool, run ORDER BY seq) AS in_row FROM r)"""
SQL["score_bands"] = f"""WITH {ev()} SELECT CASE WHEN confidence <= 0 THEN 'ABSTAINED' WHEN real_prob >= 0.70 THEN 'CLEAR' WHEN real_prob >= 0.45 THEN 'INCONCLUSIVE' ELSE 'SUSPICIOUS' END AS band,
 CASE WHEN error THEN 'ERROR' WHEN confidence = 0 THEN 'ABSTAINED' WHEN real_prob < 0.5 THEN 'SUSPICIOUS' ELSE 'CLEAR' END AS status, count(*) AS n FROM ev GROUP BY ALL"""
BOXES = """bx AS (SELECT CAST(user_id % 10 AS VARCHAR) AS case_id, user_id AS track, frame, x AS x1, y AS y1, (x + 60 + i % 80)::INT AS x2, (y + 50 + i % 90)::INT AS y2 FROM (
 SELECT user_id, frame, i, ((i * 37) % 500)::INT AS x, ((i * 53) % 400)::INT AS y FROM (SELECT user_id, floor((epoch(ts) - 1704067200) / 3600)::BIGINT AS frame, min(event_id) AS i FROM events GROUP BY ALL)))"""
RUNS = """rn AS (SELECT case_id, track, min(frame) AS start, count(*) AS length FROM (SELECT case_id, track, frame, frame - row_number() OVER (PARTITION BY case_id, track ORDER BY frame) AS run FROM (SELECT DISTINCT case_id, track, frame FROM bx)) GROUP BY case_id, track, run),
 lr AS (SELECT case_id, track, start, start + length AS "end", length FROM (SELECT *, row_number() OVER (PARTITION BY case_id, track ORDER BY length DESC, start) AS k FROM rn) WHERE k = 1)"""
SQL["longest_run"] = f"WITH {BOXES}, {RUNS} SELECT * FROM lr"
SQL["asof_box"] = f"""WITH {BOXES}, fr AS (SELECT DISTINCT case_id, track, unnest([frame + 1, frame + 5]) AS frame FROM bx)
 SELECT fr.case_id, fr.track, fr.frame, x1, y1, x2, y2 FROM fr ASOF JOIN bx ON fr.case_id = bx.case_id AND fr.track = bx.track AND fr.frame >= bx.frame"""
SQL["box_iou"] = f"""WITH {BOXES}, p AS (SELECT a.case_id, a.frame, a.track AS a, b.track AS b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS t
 FROM bx a JOIN bx b ON a.case_id = b.case_id AND a.frame = b.frame AND a.track < b.track) SELECT * FROM (SELECT case_id, frame, a, b, round(i::DOUBLE / (t - i), 6) AS iou FROM p) WHERE iou >= 0.1"""
SQL["coverage_metrics"] = f"""WITH {BOXES}, t AS (SELECT case_id, track, count(DISTINCT frame) AS n, max((x2 - x1) * (y2 - y1)) AS area FROM bx GROUP BY ALL), s AS (SELECT case_id, count(DISTINCT frame) AS frames FROM bx GROUP BY ALL)
 SELECT case_id, round(any_value(frames) / 720e0, 6) AS frames_with_faces_pct, round(max(n) / 720e0, 6) AS max_track_coverage, max(area) AS max_area FROM t JOIN s USING (case_id) GROUP BY case_id"""
SQL["best_track"] = f"""WITH {BOXES}, {RUNS} SELECT case_id, track, start, "end", length < 3 AS insufficient FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY length DESC, track) AS k FROM lr) WHERE k = 1"""
SQL["upper_median"] = "SELECT user_id, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS median FROM events GROUP BY user_id"
SQL["stride_sample"] = "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn % greatest(1, n // 10) = 0"
_EMA = f"""WITH RECURSIVE {ev(True)}, o AS (SELECT case_id AS subject, seq, real_prob AS score, seq % 9 = 0 AS skip, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS k FROM ev),
 f AS (SELECT subject, seq, score, k, CASE WHEN skip THEN NULL ELSE score END AS st FROM o WHERE k = 1 UNION ALL
  SELECT o.subject, o.seq, o.score, o.k, CASE WHEN o.skip THEN NULL WHEN f.st IS NULL THEN o.score ELSE 0.7::DOUBLE * f.st + 0.3::DOUBLE * o.score END FROM f JOIN o ON o.subject = f.subject AND o.k = f.k + 1)
 SELECT subject, seq, score, coalesce(round(st + 1e-7, 4), score) AS smooth FROM f"""
SQL["ema_smoothing"] = SQL["ema_smoothing_in_tasks"] = _EMA
TRUTH = "tr AS (SELECT doc_id, toxic AS y, ((n_chars * 7 + toxic * 300) % 1000)::DOUBLE / 1000e0 AS score FROM labels JOIN documents USING (doc_id))"
SQL["confusion"] = f"""WITH {TRUTH}, g AS (SELECT count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn FROM tr)
 SELECT *, tp + tn + fp + fn AS total, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM g"""
SQL["roc_auc"] = f"""WITH {TRUTH}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM tr), s AS (SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(rk) FILTER (y = 1) AS sr FROM r)
 SELECT n_pos, n_neg, round(((sr - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg))::DOUBLE, 6) AS auc FROM s"""
SQL["balanced_sample"] = f"WITH {TRUTH} SELECT doc_id, y, place FROM (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY sha256('7:' || doc_id), doc_id) AS place FROM tr) WHERE place <= 20"
SQL["class_counts"] = "SELECT label, count(*) AS n FROM embeddings GROUP BY label"
_SC = ", ".join(f"((doc_id * {k}) % 997)::DOUBLE / 997 AS {n}" for n, k in zip(d.NAMES[:4], (7, 11, 13, 17)))
CASES = f"""cs AS (SELECT sha256(text) AS file_hash, doc_id, to_timestamp(1704067200 + doc_id * 86400 % 31536000)::TIMESTAMP AS ts, CASE WHEN doc_id % 3 = 0 THEN 'FAKE' ELSE 'REAL' END AS verdict, ((doc_id * 31) % 1000)::DOUBLE / 1000 AS confidence,
 CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'FAKE' ELSE 'REAL' END END AS feedback_label, lang, text, {_SC} FROM documents),
 st AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY ts DESC, doc_id) AS k FROM cs WHERE doc_id % 3 <> 0) WHERE k = 1), inc AS (SELECT * FROM cs WHERE doc_id % 3 = 0)"""
SQL["case_upsert"] = f"""SET_TZ WITH {CASES}, nw AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY ts DESC, doc_id DESC) AS k FROM inc) WHERE k = 1)
 SELECT coalesce(st.file_hash, nw.file_hash) AS file_hash, coalesce(st.doc_id, nw.doc_id) AS doc_id, coalesce(nw.verdict, st.verdict) AS verdict, coalesce(nw.confidence, st.confidence) AS confidence, coalesce(st.feedback_label, nw.feedback_label) AS feedback_label FROM st FULL JOIN nw ON st.file_hash = nw.file_hash""".replace("SET_TZ ", "")
SQL["batch_insert_ignore"] = f"WITH {CASES} SELECT file_hash, min(doc_id) AS doc_id, arg_min(verdict, doc_id) AS verdict FROM inc WHERE file_hash NOT IN (SELECT file_hash FROM st) GROUP BY file_hash"
SQL["case_feedback"] = f"WITH {CASES} SELECT CASE WHEN doc_id % 5 = 0 THEN 'CONFIRMED' ELSE feedback_label END AS feedback_label, count(*) AS n FROM st GROUP BY ALL"
SQL["global_stats"] = f"WITH {CASES} " + " UNION ALL ".join(f"SELECT '{k}' AS key, count({k}) AS n, round(avg({k}), 9) AS mean, round(var_pop({k}) * count({k}), 6) AS m2 FROM cs" for k in KEYS)
_COV = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN count(*) < 2 THEN {1 if a == b else 0} ELSE covar_samp({a}, {b}) + {1e-6 if a == b else 0} END, 9) AS cov FROM cs" for a in KEYS for b in KEYS)
SQL["covariance"] = f"WITH {CASES} {_COV}"
_DIST = "sqrt(" + " + ".join(f"power({k} - {QUERY[k]}::DOUBLE, 2)" for k in KEYS) + ")"
SQL["nearest_cases"] = f"""WITH {CASES}, l AS (SELECT *, greatest(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400)::BIGINT, 0) AS days, {_DIST} AS dist FROM (SELECT * FROM cs WHERE feedback_label IS NOT NULL NEWEST))
 SELECT file_hash, doc_id, round(dist, 6) AS distance, days, round(dist * least(exp(0.005 * days), 10), 6) AS penalised FROM l ORDER BY dist * least(exp(0.005 * days), 10), doc_id LIMIT 5"""
SQL["nearest_cases_newest"] = SQL["nearest_cases"].replace("NEWEST", "ORDER BY ts DESC, doc_id LIMIT 250")
SQL["nearest_cases"] = SQL["nearest_cases"].replace(" NEWEST", "")
SQL["fts_match"] = f"""WITH {CASES}, w AS (SELECT doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') AS ws FROM cs) SELECT doc_id FROM w WHERE list_has_all(ws, ['the', 'of', 'and'])"""
_ONE = lambda where: f"SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY ts DESC, doc_id DESC) AS k FROM cs WHERE {where}) WHERE k = 1"
_MERGED = f"""{CASES}, s1 AS ({_ONE('doc_id % 3 <> 0')}), s2 AS ({_ONE('doc_id % 3 = 0')}), out AS (SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE doc_id % 11 = 5), s3 AS (SELECT * FROM s1 WHERE file_hash NOT IN (SELECT file_hash FROM out)),
 mg AS (SELECT coalesce(s3.file_hash, s2.file_hash) AS file_hash, coalesce(s3.doc_id, s2.doc_id) AS doc_id, coalesce(s2.verdict, s3.verdict) AS verdict, coalesce(s2.confidence, s3.confidence) AS confidence, coalesce(s3.feedback_label, s2.feedback_label) AS feedback_label, coalesce(s2.text, s3.text) AS text,
  {", ".join(f"coalesce(s2.{k}, s3.{k}) AS {k}" for k in KEYS)} FROM s3 FULL JOIN s2 ON s3.file_hash = s2.file_hash)"""
SQL["store_merged"] = f"WITH {_MERGED} SELECT file_hash, doc_id, verdict, confidence, feedback_label FROM mg"
SQL["store_moments"] = f"WITH {_MERGED} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(avg({a}), 9) AS mean_a, round(covar_pop({a}, {b}) * count(*), 6) AS m2 FROM mg" for a in KEYS for b in KEYS)
SQL["store_search"] = f"WITH {_MERGED}, w AS (SELECT doc_id, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+') AS ws FROM mg) SELECT doc_id FROM w WHERE list_has_all(ws, ['the', 'of', 'and'])"
SQL["metadata_filter"] = f"WITH {CASES} SELECT doc_id, file_hash FROM cs WHERE lang = 'de'"
#: Fixed values, on their own: the cells of the three bands along the scan, and as the table of ranks has them.
SCAN = [
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40],
    [48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22],
    [15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63],
]
STRICT = [
    [0, 1, 5, 6, 14, 15, 27, 28, 2, 4, 7, 13, 16, 26, 29, 42, 3, 8, 12, 17, 25],
    [30, 41, 43, 9, 11, 18, 24, 31, 40, 44, 53, 10, 19, 23, 32, 39, 45, 52, 54, 20, 22],
    [33, 38, 46, 51, 55, 60, 21, 34, 37, 47, 50, 56, 59, 61, 35, 36, 48, 49, 57, 58, 62, 63],
]


def _bands(cells: list[list[int]]) -> str:
    e = ", ".join("sqrt(" + " + ".join(f"power(embedding[{k + 1}]::DOUBLE, 2)" for k in sorted(band)) + f") AS e{n}" for n, band in enumerate(cells))
    return BANDS.replace("ENERGIES", e)


BANDS = "bands AS (SELECT vec_id, round(e0 / (e0 + e1 + e2 + 1e-10), 6) AS base, round(e1 / (e0 + e1 + e2 + 1e-10), 6) AS mid, round(e2 / (e0 + e1 + e2 + 1e-10), 6) AS high FROM (SELECT vec_id, ENERGIES FROM embeddings))"
SQL["band_energy_strict"] = f"WITH {_bands(STRICT)} SELECT * FROM bands"
BANDS = _bands(SCAN)
SQL["band_energy"] = f"WITH {BANDS} SELECT * FROM bands"
SQL["calibration_stats"] = f"WITH {BANDS} SELECT " + ", ".join(f"round(avg({n}), 6) AS mean_{n}, round(stddev_pop({n}), 6) AS std_{n}" for n in ("base", "mid", "high")) + ", count(*) AS num_samples FROM bands"
SQL["band_z_scores"] = f"""WITH {BANDS}, z AS (SELECT *, (base - 0.35::DOUBLE) / 0.03::DOUBLE AS zb, (mid - 0.33::DOUBLE) / 0.03::DOUBLE AS zm, (high - 0.32::DOUBLE) / 0.03::DOUBLE AS zh FROM bands), k AS (SELECT *, CASE WHEN abs(zh) > 1.5 THEN 'high_freq' WHEN abs(zb) > 1.5 THEN 'low_freq' END AS anomaly_type FROM z)
 SELECT vec_id, base, mid, high, round(zb, 6) AS z_base, round(zm, 6) AS z_mid, round(zh, 6) AS z_high, anomaly_type IS NOT NULL AS anomaly, anomaly_type FROM k"""
_DOT = " + ".join(f"embedding[{k + 1}]::DOUBLE * {w}::DOUBLE" for k, w in enumerate(PROBE))
_NORM = "sqrt(" + " + ".join(f"power(embedding[{k + 1}]::DOUBLE, 2)" for k in range(64)) + ")"
SQL["probe_score"] = f"""WITH p AS (SELECT vec_id, 1 / (1 + exp(-(CASE WHEN n > 0 THEN dt / n ELSE 0 END + 0.1::DOUBLE) / 2)) AS p FROM (SELECT vec_id, {_NORM} AS n, {_DOT} AS dt FROM embeddings))
 SELECT vec_id, round(p, 6) AS probability, round(greatest(0.3::DOUBLE, least(1, 0.3::DOUBLE + 4 * (p - 0.5) * (p - 0.5))), 6) AS confidence FROM p"""
SQL["patch_consistency"] = """WITH g AS (SELECT user_id, avg((event_id % 100)::DOUBLE / 100) AS m, stddev_pop((event_id % 100)::DOUBLE / 100) / 6 AS s FROM events GROUP BY user_id)
 SELECT user_id, round(m, 6) AS mean, round(CASE WHEN m < 0.35 OR s >= 0.06 THEN m WHEN m >= 0.43 THEN m * greatest(0.2, s / 0.06::DOUBLE) ELSE m * (1 - 0.7 * (1 - sqrt(s / 0.06::DOUBLE))) END, 6) AS damped FROM g"""
SQL["dct_scores"] = f"""WITH {ev()}, s AS (SELECT seq, confidence * 8 AS z, CASE WHEN confidence * 8 < 4.15 THEN least(0.15::DOUBLE, 0.15::DOUBLE * peak_ratio) WHEN seq % 2 = 0 THEN greatest(0, least(1, (peak_ratio - 0.96::DOUBLE) / 0.04::DOUBLE)) ELSE greatest(0, least(1, (peak_ratio - 0.88::DOUBLE) / 0.10::DOUBLE)) END AS s FROM ev WHERE tool = 'run_dct')
 SELECT seq, round(s, 6) AS score, round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.5 * power((s - 0.5) / 0.45::DOUBLE, 2) + CASE WHEN z > 4.15 OR z < 1 THEN 0.15::DOUBLE ELSE 0 END), 6) AS confidence FROM s"""
SQL["failure_kinds"] = f"""WITH {ev()} SELECT CASE seq % 5 WHEN 0 THEN 'RESOURCE' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'INPUT' WHEN 3 THEN 'INPUT' ELSE 'UNKNOWN' END AS kind, (CASE seq % 5 WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0 END)::DOUBLE AS confidence, count(*) AS n FROM ev GROUP BY ALL"""
SQL["event_windows_tumbling"] = "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
SQL["event_windows_sliding"] = "SELECT s AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours']) AS s, event_type, value FROM events) GROUP BY ALL"
SQL["event_windows_session"] = """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '8 hours' THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT min(ts) AS start, max(ts) + INTERVAL '8 hours' AS finish, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
SQL["key_order"] = "SELECT '" + ",".join(KEYS) + "' AS keys"
SQL["recency"] = "SELECT doc_id, round(least(exp(0.005::DOUBLE * greatest(doc_id * 3, 0)), 10), 6) AS penalty FROM documents"
SQL["top_votes"] = f"WITH {ev(True)}, {DD} SELECT case_id, place, tool, confidence FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, tool) AS place FROM dd) WHERE place <= 2"
_RG = "[" + ", ".join(f"'{r}'" for r in ("cheek_l", "cheek_r", "hairline", "jaw", "nose_bridge")) + "]"
SQL["region_boundary"] = f"""WITH r AS (SELECT vec_id::BIGINT AS case_id, k, {_RG}[k + 1] AS region, ((v0 * (7 * k + 3)) % 101)::DOUBLE / 100 AS score FROM (SELECT vec_id, (floor(abs(embedding[1]::DOUBLE) * 1e6) + floor(abs(embedding[8]::DOUBLE) * 1e6))::BIGINT AS v0 FROM embeddings) e, range(5) t(k)),
 g AS (SELECT case_id, arg_max(region, (score, region)) FILTER (score >= 0.40) AS best, max(score) FILTER (score >= 0.40) AS top, count(*) FILTER (score >= 0.40) AS n, bool_or(score >= 0.40 AND region = 'jaw') AS j, bool_or(score >= 0.40 AND region = 'hairline') AS h, bool_or(score >= 0.40 AND region = 'nose_bridge') AS o, bool_or(score >= 0.40 AND region IN ('cheek_l', 'cheek_r')) AS c FROM r GROUP BY case_id),
 x AS (SELECT *, c AND (j OR h OR o) AS touching, coalesce(best IN ('jaw', 'hairline') AND top > 0.55, false) AS wide FROM g)
 SELECT case_id, CASE WHEN n = 0 OR best = 'nose_bridge' THEN false WHEN n = 1 THEN wide ELSE touching END AS detected, CASE WHEN n = 0 THEN 'diffuse' WHEN best = 'nose_bridge' THEN 'nose_bridge_glasses_reflection' WHEN n = 1 AND NOT wide THEN 'isolated_' || best || '_false_positive' WHEN n = 1 OR touching THEN best ELSE 'diffuse' END AS region, coalesce(top, 0) AS score FROM x"""
SQL["illumination_scores"] = """WITH r AS (SELECT vec_id::BIGINT AS id, v0 AS v, ((v * 3) % 101)::DOUBLE / 100 AS g, ((v * 7) % 101)::DOUBLE / 100 / 5 AS f, ((v * 11) % 101)::DOUBLE / 100 / 5 AS c, abs(((v * 37) % 360)::DOUBLE - ((v * 53) % 360)::DOUBLE) % 360 AS t0 FROM (SELECT vec_id, (floor(abs(embedding[1]::DOUBLE) * 1e6) + floor(abs(embedding[8]::DOUBLE) * 1e6))::BIGINT AS v0 FROM embeddings)), t AS (SELECT *, CASE WHEN t0 > 180 THEN 360 - t0 ELSE t0 END AS t FROM r)
 SELECT id AS vec_id, t AS turn, CASE WHEN f > 0.02 AND c > 0.02 THEN round(least(1, CASE WHEN t > 90 THEN 0.20::DOUBLE + 0.50 * t / 180 ELSE 0.15::DOUBLE * g END + CASE WHEN v % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END) + 1e-9, 6) END AS score,
 round(least(0.95::DOUBLE, least(0.9::DOUBLE, (g / 10 + 0.00013::DOUBLE) * 10) * CASE WHEN v % 150 < 50 THEN 0.6::DOUBLE WHEN v % 150 < 100 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN v % 200 < 80 THEN 0.7::DOUBLE WHEN v % 200 < 120 THEN 0.85::DOUBLE ELSE 1 END), 3) AS confidence FROM t"""
SQL["corneal_confidences"] = """SELECT vec_id::BIGINT AS vec_id, round(greatest(0.1::DOUBLE, least(0.9::DOUBLE, 0.25 * greatest(0, 1 - (v0 % 25)::DOUBLE / 20) + 0.25 * greatest(0, 1 - (v0 % 7 - 2) * 0.15::DOUBLE) + 0.25 * least(1, (v0 % 17)::DOUBLE / 12) + 0.25 * greatest(0, 1 - (v0 % 40 + v0 % 31)::DOUBLE / 60))) + 1e-9, 6) AS confidence FROM (SELECT vec_id, (floor(abs(embedding[1]::DOUBLE) * 1e6) + floor(abs(embedding[8]::DOUBLE) * 1e6))::BIGINT AS v0 FROM embeddings)"""
SQL["neural_fusion_scores"] = """WITH r AS (SELECT vec_id::BIGINT AS vec_id, ((v0 * 7) % 101)::DOUBLE / 100 AS n, ((v0 * 13) % 101)::DOUBLE / 100 AS b FROM (SELECT vec_id, (floor(abs(embedding[1]::DOUBLE) * 1e6) + floor(abs(embedding[8]::DOUBLE) * 1e6))::BIGINT AS v0 FROM embeddings))
 SELECT vec_id, round(least(1, CASE WHEN (n > 0.35 AND b > 0.15) OR b > 0.40 THEN n + least(0.25::DOUBLE, 0.24::DOUBLE * b) ELSE n END) + 1e-9, 6) AS fused, round(least(0.95::DOUBLE, greatest(0.4::DOUBLE, abs(n - 0.5) + 0.3::DOUBLE * (1 - abs(n - b)) + 0.2::DOUBLE)) + 1e-9, 6) AS agreement,
 round(least(0.95::DOUBLE, greatest(0.4::DOUBLE, 0.4::DOUBLE + 1.2::DOUBLE * abs(n - 0.5))) + 1e-9, 6) AS margin, round(least(1, 3 * greatest(0, b - 0.35::DOUBLE) + 5 * greatest(0, n - 0.20::DOUBLE)) + 1e-9, 6) AS band_score FROM r"""
SQL["liveness_labels"] = """WITH r AS (SELECT vec_id::BIGINT AS id, v0 AS v, k, (60 + v * (k + 3) * 7 % 250)::DOUBLE / 100 AS hz, (v * (k + 2) * 13 % 120 - 40)::DOUBLE / 10 AS snr, (v * (k + 5) * 3 % 20)::DOUBLE / 100 AS sd FROM (SELECT vec_id, (floor(abs(embedding[1]::DOUBLE) * 1e6) + floor(abs(embedding[8]::DOUBLE) * 1e6))::BIGINT AS v0 FROM embeddings) e, range(3) t(k)),
 g AS (SELECT id, v, max(sd) AS sd, count(*) FILTER (sd >= 0.05) AS an, count(*) FILTER (snr >= 3) AS n_good, count(*) FILTER (snr >= 3 AND hz >= 40::DOUBLE / 60 AND hz <= 3) AS pl, coalesce(list(hz ORDER BY k) FILTER (snr >= 3), []) AS p FROM r GROUP BY id, v),
 b AS (SELECT *, list_sort(list_filter([CASE WHEN n_good > 1 THEN {'gap': abs(p[1] - p[2]), 'k': 0, 'mid': (p[1] + p[2]) / 2} END, CASE WHEN n_good > 2 THEN {'gap': abs(p[1] - p[3]), 'k': 1, 'mid': (p[1] + p[3]) / 2} END, CASE WHEN n_good > 2 THEN {'gap': abs(p[2] - p[3]), 'k': 2, 'mid': (p[2] + p[3]) / 2} END], lambda x: x IS NOT NULL))[1] AS best FROM g),
 t AS (SELECT *, len(list_filter(p, lambda x: abs(x - best.mid) <= 0.5)) AS tog, v % 17 = 0 OR v % 19 = 0 AS unclear, v % 11 = 0 AS flat FROM b)
 SELECT id AS case_id, CASE WHEN unclear THEN 'AMBIGUOUS' WHEN flat AND sd >= 0.05 THEN 'SYNTHETIC_FLATLINE' WHEN flat THEN 'NO_PULSE' WHEN an < 2 OR n_good < 2 OR pl = 0 THEN 'AMBIGUOUS' WHEN best.gap <= 0.5 THEN 'PULSE_PRESENT' ELSE 'AMBIGUOUS' END AS label,
 (CASE WHEN unclear THEN 0.5 WHEN flat AND sd >= 0.05 THEN 0.35 WHEN flat OR an < 2 OR n_good < 2 OR pl = 0 THEN 0.5 WHEN best.gap <= 0.5 THEN 0.95 ELSE 0.5 END)::DOUBLE AS real_prob,
 round((CASE WHEN unclear THEN 0 WHEN flat AND sd >= 0.05 THEN least(0.8::DOUBLE, sd * 12) WHEN flat OR an < 2 OR n_good < 2 OR pl = 0 THEN 0 WHEN best.gap <= 0.5 THEN CASE WHEN tog >= 3 THEN 0.95 WHEN tog = 2 THEN 0.70 ELSE 0.50 END WHEN n_good = 3 THEN 0.60 ELSE 0.40 END)::DOUBLE, 6) AS confidence, n_good FROM t"""
SQL["evidence_lines"] = f"""WITH {ev(True)}, {DD} SELECT case_id, string_agg(tool || ': ' || CASE WHEN confidence = 0 THEN '[ABSTAINED] Insufficient data.' ELSE 'Authenticity ' || format('{{:.1f}}', real_prob * 100) || '%: ' || CASE WHEN real_prob >= 0.70 THEN 'CLEAR' WHEN real_prob >= 0.45 THEN 'INCONCLUSIVE' ELSE 'SUSPICIOUS' END END, chr(10) ORDER BY slot) AS text FROM dd GROUP BY case_id"""
#: The words as the rule has them, written out on their own.
SQL["keyword_flags"] = r"""SELECT doc_id, regexp_matches(lower(text || ' made with ' || ['Gemini', 'dall e', 'DALL-E', 'StableDiffusion', 'megaminx', 'Midjourneyman', 'Kling-2', 'copilot', 'PIKA', 'dalle3'][doc_id % 10 + 1]),
 '\bgemini\b|\bmidjourney\b|\bdall[-\s]?e?\b|\bstable[\s-]?diffusion\b|\bopenai\b|\badobe[\s-]?firefly\b|\bflux\b|\bideogram\b|\bleonardo\b|\bkling\b|\brunway\b|\bpika\b|\bsora\b|\brecraft\b|\bjimeng\b|\bimagen\b|\bpartylamb\b') AS ai,
 regexp_matches(lower(text), '\b(the|license|der)\b') AS control FROM documents"""
_SEV = "[1, 0, 1, 0, 1, 0, 2, 2, 1, 0, 0]"
SQL["severity_score"] = f"""WITH s AS (SELECT page_id, {' + '.join(f'{_SEV}[(page_id * {k}) % 11 + 1]' for k in (3, 5, 7))} AS severity, page_id % 4 <> 0 AS valid, page_id % 5 = 0 AS ai FROM pages)
 SELECT page_id, severity, (CASE WHEN valid AND ai THEN 0 WHEN valid AND severity >= 3 THEN 0.4 WHEN valid AND severity >= 1 THEN 0.7 WHEN valid THEN 1 WHEN ai THEN 0.2 ELSE 0.5 END)::DOUBLE AS real_prob,
 (CASE WHEN valid AND ai THEN 0.95 WHEN valid AND severity >= 3 THEN 0.7 WHEN valid AND severity >= 1 THEN 0.8 WHEN valid THEN 0.95 WHEN ai THEN 0.6 ELSE 0.3 END)::DOUBLE AS confidence FROM s"""
