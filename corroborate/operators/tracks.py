"""Tracks: runs of frames, boxes as of a frame, overlaps, coverage, smoothing, breaker states."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rounded
from . import pairs


def longest_runs(boxes: DataFrame) -> DataFrame:
    """(case_id, track, start, end, length): the longest run of frames in a row, the first of equals; end is exclusive."""
    frames = boxes.select("case_id", "track", "frame").distinct()
    run = F.col("frame") - F.row_number().over(Window.partitionBy("case_id", "track").orderBy("frame"))
    runs = frames.withColumn("run", run).groupBy("case_id", "track", "run").agg(F.min("frame").alias("start"), F.count("*").alias("length"))
    best = runs.groupBy("case_id", "track").agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("r"))
    return best.select("case_id", "track", "r.start", (F.col("r.start") + F.col("r.length")).alias("end"), "r.length")


def as_of(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Backward as-of join: each frame with the last known box of its track; frames before the first have none and go.

    Both sides are one stream ordered by frame, boxes before the frames they are known at; one window, no range join."""
    both = boxes.select("case_id", "track", "frame", F.struct("x1", "y1", "x2", "y2").alias("box"), F.lit(0).alias("kind")).unionByName(frames.select("case_id", "track", "frame", F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>").alias("box"), F.lit(1).alias("kind")))
    known = Window.partitionBy("case_id", "track").orderBy("frame", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("box", F.last("box", True).over(known)).where("kind = 1 AND box IS NOT NULL").select("case_id", "track", "frame", "box.*")


def overlaps(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of tracks that overlap in a frame: (case_id, frame, a, b, iou), a < b."""
    a, b = boxes.select("case_id", "frame", F.col("track").alias("a"), *pairs.BOX), boxes.select("case_id", "frame", F.col("track").alias("b"), *pairs.BOX)
    return pairs.by_frame(a, b, ["case_id", "frame"], "a", "b", pairs.at_least(least))


def coverage(boxes: DataFrame, total_frames: int) -> DataFrame:
    """(case_id, frames_with_faces_pct, max_track_coverage, max_area)."""
    tracks = boxes.groupBy("case_id", "track").agg(F.count_distinct("frame").alias("n"), F.max((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"))
    seen = boxes.select("case_id", "frame").distinct().groupBy("case_id").agg(F.count("*").alias("frames"))
    g = tracks.groupBy("case_id").agg(F.max("n").alias("n"), F.max("area").alias("max_area")).join(seen, "case_id")
    share = lambda c: F.round(F.col(c) / F.lit(float(total_frames)), 6)
    return g.select("case_id", share("frames").alias("frames_with_faces_pct"), share("n").alias("max_track_coverage"), "max_area")


def best_track(boxes: DataFrame, least_frames: int = 90) -> DataFrame:
    """(case_id, track, start, end, insufficient): the track with the longest run, the least id of equals."""
    r = longest_runs(boxes)
    best = r.groupBy("case_id").agg(F.max_by(F.struct("track", "start", "end", "length"), F.struct("length", -F.col("track"))).alias("r"))
    return best.select("case_id", "r.track", "r.start", "r.end", (F.col("r.length") < least_frames).alias("insufficient"))


def upper_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median): the value at place n div 2 from 0, so the upper one of an even number; by rank, not by a list."""
    w = Window.partitionBy(key)
    ranked = values.select(key, value, F.row_number().over(w.orderBy(value)).alias("rank"), F.count("*").over(w).alias("n"))
    return ranked.where("rank = floor(n / 2) + 1").select(key, F.col(value).alias("median"))


def stride_sample(rows: DataFrame, key: str, order: str, parts: int = 10) -> DataFrame:
    """Every k-th row of a key, where k makes about ``parts`` of them."""
    w = Window.partitionBy(key)
    n = rows.withColumn("rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    return n.where("rn % greatest(1, floor(n / %d)) = 0".replace("%d", str(parts))).drop("n")


def smoothed(scores: DataFrame, alpha: float = 0.30) -> DataFrame:
    """Exponential smoothing for each subject: (subject, seq, score, smooth). An inconclusive row passes as it is and
    clears the state; the state is not rounded, what is returned is.

    Runs between inconclusive rows are independent. What a value adds fades by 1 - alpha with each row, so a row folds the
    last few values only, as many as matter at 1e-12: memory for a row is bounded however long a run is."""
    order = Window.partitionBy("subject").orderBy("seq")
    rows = scores.withColumn("run", F.sum(F.col("inconclusive").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    live = rows.where("NOT inconclusive")
    depth = math.ceil(math.log(1e-12) / math.log(1 - alpha)) if alpha < 1 else 1
    inside = Window.partitionBy("subject", "run").orderBy("seq").rowsBetween(-depth, 0)
    live = live.withColumn("values", F.collect_list("score").over(inside))
    fold = F.aggregate(F.slice("values", 2, F.greatest(F.size("values") - 1, F.lit(0))), F.get("values", F.lit(0)), lambda s, x: (1 - alpha) * s + alpha * x)
    return live.select("subject", "seq", "score", rounded(fold).alias("smooth")).union(rows.where("inconclusive").select("subject", "seq", "score", "score"))


def smoothed_in_tasks(scores: DataFrame, alpha: float = 0.30) -> DataFrame:
    """The same in one pass over each sorted partition, carrying only the state: for subjects with very long runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, state = None, None
        for b in batches:
            out = []
            for key, raw, skip in zip(b["subject"], b["score"], b["inconclusive"]):
                if key != subject:
                    subject, state = key, None
                state = None if skip else raw if state is None else (1 - alpha) * state + alpha * raw
                out.append(raw if state is None else math.floor((state + 1e-7) * 1e4 + 0.5) / 1e4)
            yield b[["subject", "seq", "score"]].assign(smooth=out)

    kind = dict(scores.dtypes)
    return scores.repartition("subject").sortWithinPartitions("subject", "seq").select("subject", "seq", "score", "inconclusive").mapInPandas(run, f"subject {kind['subject']}, seq {kind['seq']}, score double, smooth double")


def breaker_state(calls: DataFrame, failures: int = 3) -> DataFrame:
    """(tool, seq, in_row, state): consecutive failures so far, reset by a success; OPEN from ``failures`` on."""
    order = Window.partitionBy("tool").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("run", F.sum(F.col("success").cast("int")).over(order))
    in_row = F.sum((~F.col("success")).cast("int")).over(Window.partitionBy("tool", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("in_row", in_row).select("tool", "seq", "in_row", F.when(F.col("in_row") >= failures, "OPEN").otherwise("CLOSED").alias("state"))


def admission(length: Column, n_frames: Column) -> Column:
    """Tracks long enough to count."""
    return length >= F.least(F.lit(5), F.greatest(F.lit(3), F.floor(n_frames / 30)))


def breaker(calls: DataFrame, failures: int = 3, recovery: float = 60.0) -> DataFrame:
    """(tool, seq, allowed, state): calls (tool, seq, at in seconds, success) through a breaker for each tool. From ``failures``
    failures in a row it is OPEN and lets nothing through until ``recovery`` seconds have passed; then HALF_OPEN: calls are
    let through, a success closes it, a failure opens it again. What isn't let through has no outcome.

    One pass over each sorted partition, carrying the state only, so a tool with very many calls costs no memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, state, count, tripped = None, "CLOSED", 0, 0.0
        for b in batches:
            out = []
            for key, seq, at, ok in zip(b["tool"], b["seq"], b["at"], b["success"]):
                if key != tool:
                    tool, state, count, tripped = key, "CLOSED", 0, 0.0
                if state == "OPEN" and at - tripped > recovery:
                    state = "HALF_OPEN"
                allowed = state != "OPEN"
                if allowed and ok:
                    state, count = "CLOSED", 0
                elif allowed:
                    count += 1
                    if count >= failures:
                        state, tripped = "OPEN", at
                out.append((key, seq, allowed, state))
            yield pd.DataFrame(out, columns=["tool", "seq", "allowed", "state"])

    kinds = dict(calls.dtypes)
    rows = calls.repartition("tool").sortWithinPartitions("tool", "at", "seq").select("tool", "seq", F.col("at").cast("double").alias("at"), "success")
    return rows.mapInPandas(run, f"tool {kinds['tool']}, seq {kinds['seq']}, allowed boolean, state string")
