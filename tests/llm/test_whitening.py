"""Whitening against a plain version, and on odd rows."""

import math

import numpy as np
import pytest

from corroborate.llm import queries, whitening

from ..conftest import SF

ROWS = "vec_id long, embedding array<float>, n long, whitened string"


def plain(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    centred = (off / n).astype(float)
    v = sum(np.outer(r, r) for r in centred) / n
    e, u = np.linalg.eigh(v)
    return n, [int(d) for d in (off * off).sum(axis=1)], centred, e[::-1], u[:, ::-1], np.trace(v)


def compare(got, ids, vectors, components):
    n, deviation, centred, e, u, trace = plain(vectors)
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) == n * components
    for k in range(components):
        own = np.array([rows[i, k + 1].whitened for i in ids])
        want = centred @ u[:, k] / np.sqrt(e[k])
        sign = np.sign(own @ want)
        assert np.abs(sign * own - want).max() < 1e-8
        assert {rows[i, k + 1].explained for i in ids} == {rows[ids[0], k + 1].explained} and rows[ids[0], k + 1].explained == pytest.approx(e[k] / trace, rel=1e-9)
    for i, d in zip(ids, deviation):
        r = rows[i, 1]
        assert r.n == n and r.deviation_text == str(d) and r.deviation == (d if d < 2**63 else None)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_equals_the_plain_version(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op11_embedding_whitening(spark, SF).collect()
    compare(got, [r.vec_id for r in table], [r.embedding for r in table], 8)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(40, 3)))]
    good += [(90, good[0][1]), (91, good[0][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in good + bad], ROWS).repartition(3)
    compare(whitening.whitened(df).collect(), [i for i, _ in good], [v for _, v in good], 3)


def test_flat_directions_have_no_component(spark):
    rows = [(i, [float(i % 7), 2.0, float(i % 7)], 1, "") for i in range(30)]
    got = whitening.whitened(spark.createDataFrame(rows, ROWS)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and {r.component for r in got} == {1, 2, 3}
    assert got[0].identity_error < 1e-9
    one = whitening.whitened(spark.createDataFrame(rows[:1], ROWS)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(k, 1, 0, None, 0.0) for k in (1, 2, 3)]


def test_no_rows_and_rows_without_id(spark):
    assert whitening.whitened(spark.createDataFrame([], ROWS)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 1, "")], ROWS)).collect() == []
    got = whitening.whitened(spark.createDataFrame([(None, [1.0], 1, ""), (None, [2.0], 1, ""), (3, [4.0], 1, "")], ROWS)).collect()
    assert [r.vec_id for r in got].count(None) == 2 and len(got) == 3


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [float(np.float32(1e6 * (-1) ** i * (i + 1))), 1.0], 1, "") for i in range(60)]
    df = spark.createDataFrame(rows, ROWS)
    got = whitening.whitened(df).collect()
    _, deviation, *_ = plain([v for _, v, *_ in rows])
    assert max(deviation) >= 2**63 and {r.vec_id: r.deviation_text for r in got} == {i: str(d) for i, d in enumerate(deviation)}
    assert all(r.deviation is None for r in got if deviation[r.vec_id] >= 2**63)


def test_too_large_entries_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30], 1, ""), (2, [0.0], 1, "")], ROWS)
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(df).collect()
