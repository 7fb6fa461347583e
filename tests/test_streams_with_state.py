"""Streams with state: equal to batch for any cut into micro-batches, late rows, and a restart from a checkpoint."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.operators import forensic
from corroborate.plans import pipeline
from corroborate.sources import bridge
from corroborate.streaming import evidence, tracking

from .conftest import SF, drained

BOXES = "case_id string, frame long, x1 double, y1 double, x2 double, y2 double"


def write(df, folder, number):
    """One file of a source, newer than those before."""
    part = f"{folder}-{number}"
    df.coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    (name,) = [n for n in os.listdir(part) if n.startswith("part-") and n.endswith(".parquet")]
    os.rename(f"{part}/{name}", f"{folder}/{number:03d}.parquet")
    os.utime(f"{folder}/{number:03d}.parquet", (1_700_000_000 + number * 10,) * 2)


def boxes(rng):
    rows = []
    for case in "ab":
        x, frame = [50.0 * k for k in range(4)], 0
        for _ in range(40):
            frame += rng.choice([1, 1, 1, 2, 30])
            for k in range(4):
                x[k] += rng.uniform(-4, 6)
                if rng.random() < 0.8:
                    rows.append((case, frame, x[k], 20.0 * k, x[k] + 60, 20.0 * k + 50 + rng.random()))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_tracker_stream_equals_batch_for_any_cut_and_after_a_restart(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = boxes(rng)
    want = sorted(tuple(r) for r in forensic.track(spark.createDataFrame(rows, BOXES), retire_after=24).collect())
    rows.sort(key=lambda r: r[1])  # frames in order; a cut may go through a frame
    cuts = sorted(rng.sample(range(1, len(rows)), 5))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])] + [[(c, None, None, None, None, None) for c in "ab"]]
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(BOXES).option("maxFilesPerTrigger", 1).parquet(folder)
        q = tracking.track_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        drained(q)

    for k, part in enumerate(parts[:4]):
        write(spark.createDataFrame(part, BOXES), folder, k)
    run()
    for k, part in enumerate(parts[4:], 4):
        write(spark.createDataFrame(part, BOXES), folder, k)
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want


def test_long_gaps_and_many_tracks_are_walked_at_once():
    """Frame by frame or over a gap: the same state; a shrinking area stops above zero."""
    rng = np.random.default_rng(5)
    for steps in (1, 2, 7, 200):
        one, many = forensic.Tracker(), forensic.Tracker()
        for t in (one, many):
            t.numbers, t.hits, t.last = (np.arange(50) for _ in range(3))
            gen = np.random.default_rng(steps)
            t.states = np.column_stack([gen.uniform(0, 100, (50, 2)), gen.uniform(1, 5000, 50), gen.uniform(0.5, 2, 50), gen.normal(size=(50, 2)), gen.normal(size=50) * 300])
            a = gen.normal(size=(50, 7, 7))
            t.covs = a @ a.transpose(0, 2, 1)
        one.ahead(steps)
        for _ in range(steps):
            many.ahead(1)
        assert np.allclose(one.states, many.states) and np.allclose(one.covs, many.covs) and (one.states[:, 2] > 0).all()
    far = forensic.Tracker()
    assert far.frame(0, np.array([[0.0, 0, 10, 10]])) and far.frame(10**9, np.array([[0.0, 0, 10, 10]])) is not None
    a, b = rng.uniform(0, 50, (9, 4)), rng.uniform(0, 50, (7, 4))
    a[:, 2:] += a[:, :2]
    b[:, 2:] += b[:, :2]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            w, h = min(x[2], y[2]) - max(x[0], y[0]), min(x[3], y[3]) - max(x[1], y[1])
            shared = w * h if w > 0 and h > 0 else 0.0
            size = lambda z: (z[2] - z[0]) * (z[3] - z[1])
            assert forensic.overlaps(a, b)[i, j] == pytest.approx(shared / (size(x) + size(y) - shared))


def test_late_evidence_changes_verdicts(spark, tmp_path):
    rows, media = bridge.tool_results(spark, SF, dense=True), bridge.media_summary(spark, SF)
    want = {r.case_id: tuple(r) for r in pipeline.verdicts(rows, media).collect()}
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    h = F.pmod(F.xxhash64("seq"), F.lit(10))
    end = media.select("case_id").unionByName(rows.limit(0).select("case_id"))
    end = rows.limit(0).unionByName(end, allowMissingColumns=True)

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = evidence.verdict_sink(stream, media, out, check)
        drained(q)

    write(rows.where(h < 4), folder, 0)
    write(rows.where(h.isin(4, 5)), folder, 1)
    run()
    early = {r.case_id for r in evidence.standing(spark, out).collect()}
    write(end, folder, 2)  # no more will come
    run()
    settled = {r.case_id: tuple(r) for r in evidence.standing(spark, out).collect()}
    part = {r.case_id: tuple(r) for r in pipeline.verdicts(rows.where(h < 6), media).collect()}
    assert settled == part and early < set(settled)
    write(rows.where(h == 9), folder, 3)  # but more comes, in any order
    write(rows.where(h.isin(6, 7, 8)), folder, 4)
    run()
    assert {r.case_id: tuple(r) for r in evidence.standing(spark, out).collect()} == want
    every = spark.read.schema(evidence.VERDICTS).parquet(f"{out}/batch=*").collect()
    given = {(r.case_id, r.version): tuple(r)[3:] for r in every if r.sign == 1}
    taken = {(r.case_id, r.version): tuple(r)[3:] for r in every if r.sign == -1}
    assert taken and all(given[k] == v for k, v in taken.items())  # a retraction is the verdict that was given


def test_cases_settle_by_time(spark, tmp_path):
    rows, media = bridge.tool_results(spark, SF, dense=True).where("case_id = '3' OR case_id = '4'"), bridge.media_summary(spark, SF)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(rows.where("tool = 'run_dct'"), folder, 0)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    seen = []
    q = evidence.snapshots(stream, media, idle_ms=1000).writeStream.option("checkpointLocation", out).trigger(processingTime="1 second").foreachBatch(lambda b, n: seen.extend(b.collect())).start()
    try:
        for _ in range(60):
            if seen:
                break
            q.awaitTermination(1)
        assert {(r.case_id, r.version, r.sign, r.tool) for r in seen} == {("3", 1, 1, "run_dct"), ("4", 1, 1, "run_dct")}
    finally:
        q.stop()


def test_assignment_is_best_and_tracks_out_of_sight_are_not_compared(monkeypatch):
    rng = np.random.default_rng(11)
    for n, m in ((4, 6), (6, 4), (5, 5)):
        for _ in range(30):
            x = rng.random((n, m)) * (rng.random((n, m)) < 0.5)
            x[rng.integers(n)] = 0.0
            small = x if n <= m else x.T
            best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
            pairs = forensic.assign(x, 0.0)
            assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            if (x > 0).sum(axis=1).max() > 1 or (x > 0).sum(axis=0).max() > 1:
                assert sum(x[i, j] for i, j in pairs) == pytest.approx(best)
    seen = []
    monkeypatch.setattr(forensic, "overlaps", lambda a, b, f=forensic.overlaps: seen.append(b.shape[0]) or f(a, b))
    t = forensic.Tracker()
    t.frame(0, np.array([[1000.0 * k, 0, 1000 * k + 50, 50] for k in range(300)]))
    assert [r[0] for r in t.frame(1, np.array([[2000.0, 2, 2050, 52]]))] == [3] and seen == [0, 1]


def test_cases_are_dealt_to_many_tasks(spark):
    b = spark.createDataFrame([(c, f, 0.0, 0.0, 9.0, 9.0) for c in "abcdefghij" for f in range(3)], BOXES)
    assert forensic.track(b).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
