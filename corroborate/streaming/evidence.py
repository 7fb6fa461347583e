"""Cases decided while their evidence comes in, and decided anew when some comes late.

Keyed state holds a case's evidence, one row for each tool as ``fusion.dedup`` would keep it, so its size is bounded by
the number of tools. A case settles once all tools that its plan may run have reported, verified provenance has, a row without
tool says that no more will come, or none has come for ``idle_ms``. From then on each change gives a new version. What
leaves the state is evidence: of the new version with sign 1, and of the one before with sign -1. Both go through the same
plan as a batch does, so a retraction is the very verdict that was given before. Each micro-batch's verdicts replace their
own folder, so one that runs again counts once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import routing
from ..plans import pipeline

FIELDS = "tool string, seq long, success boolean, real_prob double, confidence double, error boolean, error_msg string, peak_ratio double, c2pa_verified boolean, is_ai_generated boolean, liveness_label string, execution_time double, flags array<string>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
VERDICTS = "case_id string, version int, sign int, path string, decision string, ensemble_score double, verdict string, degraded boolean"
DAY = 86_400_000


def _kept(rows: dict[str, dict], row: dict) -> None:
    """Of a tool's rows the last success, else the last one."""
    old = rows.get(row["tool"])
    rank = lambda r: (bool(r["success"]), r["seq"])
    if old is None or rank(row) > rank(old):
        rows[row["tool"]] = row


def snapshots(evidence: DataFrame, media: DataFrame, idle_ms: int = 60_000, forget_ms: int = DAY) -> DataFrame:
    """(case_id, version, sign, evidence): the versions of settled cases, and the ones they take the place of. ``evidence``: a
    stream of rows as ``bridge.tool_results`` has them; a null tool: the case's evidence is complete. ``media``: a table
    with a row for each case; a case it doesn't have has no plan and is left out. A settled case without rows
    for ``forget_ms`` is forgotten; rows after that would begin a case anew."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    plans = media.withColumn("gate", routing.face_gate()).select("case_id", F.array_union(routing.cheap_tools(), routing.expensive_tools(F.lit("FULL_GPU"), F.col("gate"))).alias("needed"))
    rows = evidence.join(plans, "case_id").select("case_id", "needed", F.to_json(F.struct(*NAMES)).alias("row"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, given, known = state.get if state.exists else (0, "{}", "{}")
        now, settled = json.loads(known), version > 0
        if state.hasTimedOut:
            if settled:
                state.remove()
                return
            settled = True
        for b in batches:
            for row, needed in zip(b["row"], b["needed"]):
                row = json.loads(row)
                if row.get("tool") is None:
                    settled = True
                    continue
                _kept(now, {n: row.get(n) for n in NAMES})
                certain = row["tool"] == "check_c2pa" and row.get("success") and row.get("c2pa_verified")
                settled = settled or bool(certain) or all(t in now for t in needed)
        known, out = json.dumps(now, sort_keys=True), []
        if settled and now and known != given:
            if version:
                out += [(key[0], version, -1, json.dumps(r)) for r in json.loads(given).values()]
            version, given = version + 1, known
            out += [(key[0], version, 1, json.dumps(r)) for r in now.values()]
        state.update((version, given, known))
        state.setTimeoutDuration(forget_ms if settled else idle_ms)
        yield pd.DataFrame(out, columns=["case_id", "version", "sign", "row"])

    out = rows.groupBy("case_id").applyInPandasWithState(step, "case_id string, version int, sign int, row string", "version int, given string, known string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select("case_id", "version", "sign", F.from_json("row", FIELDS).alias("e")).select("case_id", "version", "sign", "e.*")


def judged(snapshot: DataFrame, media: DataFrame) -> DataFrame:
    """The verdict of each version in a batch of ``snapshots``, by the plan that batches go through."""
    one = F.to_json(F.struct("case_id", "version", "sign"))
    rows = snapshot.withColumn("of", one)
    names = rows.select("of", "case_id").distinct().join(media, "case_id").drop("case_id").withColumnRenamed("of", "case_id")
    found = pipeline.verdicts(rows.drop("case_id", "version", "sign").withColumnRenamed("of", "case_id"), names)
    return found.withColumn("of", F.from_json("case_id", "case_id string, version int, sign int")).drop("case_id").select("of.*", "path", "decision", "ensemble_score", "verdict", "degraded")


def verdict_sink(evidence: DataFrame, media: DataFrame, path: str, checkpoint: str, every: str = "0 seconds", **options):
    """A running query that writes each micro-batch's verdicts and retractions below ``path``. It runs until it is stopped:
    timers need micro-batches without rows too."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            judged(batch, media).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = snapshots(evidence, media, **options).writeStream.option("checkpointLocation", checkpoint)
    return stream.trigger(processingTime=every).foreachBatch(put).start()


def standing(spark, path: str) -> DataFrame:
    """The verdicts that stand: for each case its last version, which no retraction takes back."""
    rows = spark.read.schema(VERDICTS).parquet(f"{path}/batch=*")
    fields = ["path", "decision", "ensemble_score", "verdict", "degraded"]
    net = rows.groupBy("case_id", "version").agg(F.sum("sign").alias("n"), F.max(F.struct("sign", *fields)).alias("v")).where("n > 0")
    return net.select("case_id", *[F.col(f"v.{c}").alias(c) for c in fields])
