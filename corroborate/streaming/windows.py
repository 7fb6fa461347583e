"""Event-time windows with watermarks, smoothing with state, and the pipeline's progress as rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _summed(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def timed(events: DataFrame, watermark: str | None = None) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", watermark) if watermark else out


def windowed(events: DataFrame, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling, or with ``slide`` sliding, windows; batch and stream alike."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _summed(timed(events, watermark).groupBy(w.alias("w"), "event_type")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """(start, finish, user_id, n, total) by sessions of a user that end after a gap."""
    return _summed(timed(events, watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id")).select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "user_id", "n", "total")


def smoothed_stream(scores: DataFrame, alpha: float = 0.30) -> DataFrame:
    """Smoothing with one number of state for each subject, dropped after a day without rows; subject, seq, score,
    inconclusive in, (subject, seq, score, smooth) out. Rows of a subject count in order of seq inside a micro-batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for raw, skip in zip(rows["score"], rows["inconclusive"]):
            now = None if skip else raw if now is None else (1 - alpha) * now + alpha * raw
            out.append(raw if now is None else math.floor((now + 1e-7) * 1e4 + 0.5) / 1e4)
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update((now,))
            state.setTimeoutDuration(86_400_000)
        yield rows[["subject", "seq", "score"]].assign(smooth=out)

    return scores.groupBy("subject").applyInPandasWithState(step, "subject string, seq long, score double, smooth double", "now double", "append", GroupStateTimeout.ProcessingTimeTimeout)
