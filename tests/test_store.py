"""The case store kept up to date: files, failures, moments and words after any mix of merges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corroborate.operators import casestore, store

FIELDS = "file_hash string, doc_id long, ts timestamp, verdict string, tool_scores map<string,double>, reasoning string, feedback_label string"


def cases(spark, rows):
    """rows: (hash, id, day, scores, reasoning, label)."""
    df = spark.createDataFrame([(h, i, d, "REAL", s, r, f) for h, i, d, s, r, f in rows], "file_hash string, doc_id long, d int, verdict string, tool_scores map<string,double>, reasoning string, feedback_label string")
    return df.select("file_hash", "doc_id", F.timestamp_seconds(F.lit(1.7e9) + F.col("d") * 86400).alias("ts"), "verdict", "tool_scores", "reasoning", "feedback_label")


@pytest.fixture
def made(spark, tmp_path):
    return lambda ranges=8: store.CaseStore(spark, f"file://{tmp_path}/store", StructType.fromDDL(FIELDS), ranges=ranges, token_ranges=8)


def rebuilt(rows):
    keys = sorted({k for r in rows for k in (r.tool_scores or {})})
    x = np.array([[(r.tool_scores or {}).get(k, 0.0) for k in keys] for r in rows]).reshape(len(rows), len(keys))
    d = x - x.mean(axis=0)
    return keys, x.mean(axis=0), d.T @ d


def test_any_mix_of_merges_equals_a_rebuild(spark, made):
    rng, s = random.Random(3), made()
    words = ["red", "fox", "over", "the", "lazy", "dog", "Zebra", "ünder"]
    known, ids = {}, iter(range(10_000))
    for turn in range(4):
        rows = [(f"h{rng.randrange(60)}", next(ids), rng.randrange(9), {k: rng.random() * 10 for k in rng.sample("abcd"[: 2 + turn], min(2, 2 + turn))} if rng.random() < 0.9 else None, rng.choice([None, "", " ".join(rng.choices(words, k=6))]), rng.choice([None, "FAKE"])) for _ in range(25)]
        gone = rng.sample(sorted(known), min(len(known), 5))
        s.merge(cases(spark, rows), spark.createDataFrame([(h,) for h in gone] + [("never",)], "file_hash string"))
        for h in gone:
            del known[h]
        best = {}
        for r in rows:
            if r[0] not in best or (r[2], r[1]) > (best[r[0]][2], best[r[0]][1]):
                best[r[0]] = r
        for h, r in best.items():
            old = known.get(h)
            known[h] = (old[0], r[3], r[4], old[3] or r[5]) if old else (r[1], r[3], r[4], r[5])
        if turn == 2:
            s.compact()
            s.drop_old()
        got = {r.file_hash: (r.doc_id, r.tool_scores, r.reasoning, r.feedback_label) for r in s.read().collect()}
        assert got == known
        keys, mean, m2 = rebuilt(s.read().collect())
        m = s.moments
        at = [m.keys.index(k) for k in keys]
        assert m.n == len(known) and np.allclose(m.mean[at], mean) and np.allclose(m.m2[np.ix_(at, at)], m2)
        again = s.rebuild()
        assert np.allclose(m.m2, again.m2) and np.allclose(m.mean, again.mean)
        for asked in (["fox"], ["the", "Dog"], ["zebra", "red", "over"], ["nowhere"]):
            scan = sorted(r.doc_id for r in casestore.containing(s.read(), asked).collect())
            assert sorted(r.doc_id for r in s.search(asked).collect()) == scan
    reopened = store.CaseStore(spark, s.path)
    assert reopened.state == s.state


def test_untouched_ranges_keep_their_files(spark, made):
    s = made(ranges=16)
    s.merge(cases(spark, [(f"h{i}", i, 1, {"a": 0.5}, "word", None) for i in range(200)]))
    before = set(s.read().inputFiles())
    s.merge(cases(spark, [("h7", 900, 2, {"a": 0.9}, "other", None)]))
    after = set(s.read().inputFiles())
    assert len(before) == 16 and len(before - after) == len(after - before) == 1
    one = s.get(["h7"])
    assert len(one.inputFiles()) == 1 and [(r.doc_id, r.reasoning) for r in one.collect()] == [(7, "other")]


@pytest.mark.parametrize("step", ["_write_postings", "_commit", "_numbers"])
def test_a_failed_merge_leaves_the_version_before(spark, made, monkeypatch, step):
    s = made()
    s.merge(cases(spark, [(f"h{i}", i, 1, {"a": i / 9}, "first words", None) for i in range(30)]))
    state, rows = s.state, sorted(s.read().collect())

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(s, step, fail)
        with pytest.raises(OSError):
            s.merge(cases(spark, [("h3", 99, 2, {"a": 5.0}, "second", None)]))
    other = store.CaseStore(spark, s.path)
    assert other.state == state and sorted(other.read().collect()) == rows and not other.search(["second"]).collect()
    other.merge(cases(spark, [("h3", 99, 2, {"a": 5.0}, "second", None)]))
    assert [r.doc_id for r in other.search(["second"]).collect()] == [3] and other.moments.n == 30
    other.drop_old()
    assert sorted(store.CaseStore(spark, s.path).read().collect()) == sorted(other.read().collect())
    with pytest.raises(RuntimeError):  # the writer of the old version is late
        s.merge(cases(spark, [("h4", 98, 2, {"a": 5.0}, "third", None)]))


def test_a_search_reads_the_ranges_of_its_words(spark, made):
    s = made()
    s.merge(cases(spark, [(f"h{i}", i, 1, None, f"common w{i} x{i % 7}", None) for i in range(100)]))
    parts = {t: r["p"] for t in ("common", "w5", "x5") for r in spark.createDataFrame([(t,)], "t string").select(s._part_of("t").alias("p")).collect()}
    files = s._postings(sorted(set(parts.values()))).inputFiles()
    assert {int(f.split("part=")[1].split("/")[0]) for f in files} == set(parts.values()) and len(set(parts.values())) <= 3
    assert [r.doc_id for r in s.search(["common", "w5", "x5"]).collect()] == [5]


def test_invalid_scores_stop_the_merge_or_are_set_apart(spark, made):
    s = made()
    rows = cases(spark, [("a", 1, 1, {"k": 0.5}, "fine", None), ("b", 2, 1, {"k": float("nan")}, "not", None), ("c", 3, 1, {"k": float("inf")}, "not", None)])
    with pytest.raises(ValueError, match="finite"):
        s.merge(rows)
    assert s.state["version"] == 0
    s.merge(rows, invalid="quarantine")
    assert [r.file_hash for r in s.read().collect()] == ["a"] and s.moments.n == 1
    assert sorted(r.file_hash for r in spark.read.parquet(f"{s.path}/quarantine").collect()) == ["b", "c"]


def test_moments_are_made_anew_when_rounding_eats_them(spark, made):
    big = store.Moments(["a"], 2, np.array([1e8]), np.array([[2.0]]))
    assert big.minus(store.Moments(["a"], 1, np.array([1e8 + 5]), np.array([[0.0]]))) is None
    s = made()
    s.merge(cases(spark, [("a", 1, 1, {"k": 1e9}, None, None), ("b", 2, 1, {"k": 1.0}, None, None), ("c", 3, 1, {"k": 1.5}, None, None)]))
    s.merge(cases(spark, []), spark.createDataFrame([("a",)], "file_hash string"))
    assert s.moments.n == 2 and s.moments.mean[0] == pytest.approx(1.25, rel=1e-6)


def test_empty_store_and_empty_merges(spark, made):
    s = made()
    assert s.read().count() == 0 and s.moments.n == 0
    s.merge(cases(spark, []))
    assert s.read().count() == 0 and s.search(["x"]).count() == 0
    s.merge(cases(spark, [("a", 1, 1, {}, "x", None)]))
    s.merge(cases(spark, []), spark.createDataFrame([("a",)], "file_hash string"))
    assert s.read().count() == 0 and s.moments.n == 0 and s.search(["x"]).count() == 0
