"""The box tracker over a stream: tracks are state that lives from micro-batch to micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.forensic import TRACKED, Tracker

STATE = "number long, first long, before long, frame long, boxes array<array<double>>, tracks array<array<double>>"
BOX = ["x1", "y1", "x2", "y2"]


def track_stream(detections: DataFrame, least: float = 0.3, retire_after: int = 24, idle_ms: int = 3_600_000) -> DataFrame:
    """What ``forensic.track`` returns, for a stream of detections (case_id, frame, x1..y2), however it is cut into micro-batches.

    A frame may come in several micro-batches, so the newest frame of a case stays open until a later one comes, a row without
    frame ends the case, or no row has come for ``idle_ms``, which ends the case too. Frames come in order; a row of
    a frame that is closed is left out. The state of a case is its open frame and the tracks seen in the last ``retire_after``
    frames, so it is bounded by the boxes of as many frames, however long the case."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = ["case_id", "frame", "track", *BOX]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, frame, boxes = Tracker(least, retire_after), None, []
        if state.exists:
            number, first, before, frame, boxes, tracks = state.get
            own.load((number, first, before, tracks))
        close = lambda: [(key[0], frame, *r) for r in own.frame(frame, np.array(sorted(map(list, boxes)), float))] if boxes else []
        if state.hasTimedOut:
            yield pd.DataFrame(close(), columns=names)
            state.remove()
            return
        rows = pd.concat(list(batches))
        ended, out = bool(rows["frame"].isna().any()), []
        rows = rows[rows["frame"].notna()].sort_values(["frame", *BOX])
        for f, *box in rows[["frame", *BOX]].itertuples(index=False, name=None):
            if frame is not None and f < frame:
                continue
            if f != frame:
                out += close()
                frame, boxes = int(f), []
            boxes.append([float(x) for x in box])
        if ended:
            out += close()
            if state.exists:
                state.remove()
        elif frame is not None:
            number, first, before, tracks = own.saved()
            state.update((number, first, before, frame, boxes, tracks))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    rows = detections.select("case_id", F.col("frame").cast("double"), *[F.col(c).cast("double") for c in BOX])
    return rows.groupBy("case_id").applyInPandasWithState(step, TRACKED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
