"""Sinks: results as CSV, JSON or Parquet, and events as server-sent frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def results_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


def metrics_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def event_frame(*columns: str) -> Column:
    """One frame of a server-sent event stream."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


def event_sink(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch's frames as text, once: a batch that runs again replaces its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select(event_frame(*batch.columns).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).start()


def calibration(bands: DataFrame, path: str) -> None:
    """Write the one-row calibration of band shares; ``load_calibration`` reads it."""
    from ..operators.signal import calibration as summed

    summed(bands).coalesce(1).write.json(path)


# What is taken where no calibration is found.
DEFAULTS = {"mean_base": 0.70, "std_base": 0.10, "mean_mid": 0.25, "std_mid": 0.08, "mean_high": 0.05, "std_high": 0.03}


def load_calibration(spark, path: str | None) -> dict[str, float]:
    """Six numbers from a calibration file; the defaults where it is missing or lacks one."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.json(path).first() if path else None
    except AnalysisException:
        row = None
    found = row.asDict() if row else {}
    return {k: float(found[k]) for k in DEFAULTS} if all(found.get(k) is not None for k in DEFAULTS) else dict(DEFAULTS)
