"""Boxes against the boxes of their frame: equal to a plain join, with frames dealt to several tasks, odd rows and ties."""

import random

import pytest
from pyspark.sql import functions as F

from corroborate.functions.scores import iou, nearest
from corroborate.operators import faces, pairs, tracks

BOXES = "case_id string, frame long, track long, x1 int, y1 int, x2 int, y2 int"


def boxes(spark):
    rng, rows = random.Random(3), []
    for case, frame, n in (("a", 1, 60), ("a", 2, 1), ("b", 1, 9), (None, 1, 3), ("c", None, 3)):
        for k in range(n):
            x, y = rng.randrange(0, 60, 5), rng.randrange(0, 60, 5)
            rows.append((case, frame, k, x, y, x + rng.choice([0, 40, 50]), y + rng.choice([30, 40])))
    rows += [("b", 1, 20, 0, 0, None, 40), ("b", 1, 3, 5, 5, 45, 45), ("b", 2, 1, 100, 100, 100, 100), ("b", 2, 2, 100, 100, 100, 100)]
    return spark.createDataFrame(rows, BOXES).repartition(3)


def joined(b, when):
    box = F.struct("x1", "y1", "x2", "y2")
    p, q = b.select("case_id", "frame", F.col("track").alias("a"), box.alias("p")), b.select("case_id", "frame", F.col("track").alias("b"), box.alias("q"))
    return p.join(q, ["case_id", "frame"]).where(when).select("case_id", "frame", "a", "b", nearest(iou(F.col("p"), F.col("q")), 6).alias("iou"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("own", [4096, 4])
def test_equal_to_a_join(spark, monkeypatch, own):
    monkeypatch.setattr(pairs, "OWN", own)
    b = boxes(spark)
    for least in (0.1, 0.3, 0.7):
        assert rows(tracks.overlaps(b, least)) == rows(joined(b, "a < b").where(F.col("iou") >= least))
    want = joined(b, "true").groupBy("case_id", "frame", "a").agg(F.max_by(F.struct("b", "iou"), F.struct("iou", -F.col("b"))).alias("m")).select("case_id", "frame", "a", "m.b", "m.iou")
    assert rows(faces.nearest_set(b, b.withColumnRenamed("track", "ord"), ["case_id", "frame"])) == rows(want)
    once = b.where("NOT (track = 3 AND x1 = 5 AND x2 = 45)")
    hit = {(r.case_id, r.frame, r.a) for r in joined(once, "a != b").where("iou >= 0.3").collect()}
    alone = faces.unmatched(once, ["case_id", "frame"]).select("case_id", "frame", "track")
    assert rows(alone) == sorted((t for t in map(tuple, once.select("case_id", "frame", "track").collect()) if t not in hit), key=repr)


def test_pairs_are_no_rows(spark):
    """Neither shuffled nor sorted: what grows with the square of a frame stays inside a task."""
    b = boxes(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (tracks.overlaps(b), faces.nearest_set(b, b.withColumnRenamed("track", "ord"), ["case_id", "frame"])):
        assert "MapInArrow" in plan(df) and "least(" not in plan(df)
    alone = plan(faces.unmatched(b, ["case_id", "frame"]))
    assert "LeftAnti" in alone and "Aggregate" not in alone and "Inner" not in alone
