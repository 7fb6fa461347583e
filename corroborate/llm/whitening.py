"""Embeddings whitened to their leading components, by the covariance of all of them.

Entries are turned to integers first (``scaled``), so counts and sums are exact whatever the order of the tasks. Rows are
centred as ``(n*x - S) / n``: the numerator is an exact integer, the quotient is rounded once. MLlib's
``RowMatrix.computeGramianMatrix`` adds up the products of the centred rows in a tree, one matrix of dimension squared for
each task; divided by n this is the covariance. It is all that the driver gets, and only there eigenvectors are computed.
Means and eigenvectors (numbers of the size of a vector) are broadcast in the closure of ``mapInPandas``. The whitened
rows are written once and their own covariance is taken from that table, so the reported error is measured.

Rows with a null vector, or null or non-finite entries, are dropped, and so are those whose length isn't the one most rows
have (the longer of equals). A dimension along which nothing varies gives no component: eigenvalues of at most 1e-12 of the
trace have null ``whitened`` and don't count for the error. Rows without or with a repeated id stay rows of their own; an
empty table gives no rows. ``deviation`` is null where it doesn't fit a long; ``deviation_text`` has all its digits. Entries
of 2**42 and more in size, which leave no room for exact products, raise an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

SCALE, SHIFT, FLAT = 1024, 100_000, 1e-12
LARGEST = float(1 << 42)
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # long, by dimension
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each of them
    trace: float


def scaled(embeddings: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(1024 * c) + 100000 of every entry c, without the rows that have none or a bad one."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where("size(v) > 0").where(~F.exists("v", bad))
    entry = lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry of a vector is too large")).cast("long"))
    return rows.select("vec_id", F.transform("v", entry).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension, of the rows of the most frequent length. Tasks send one partial sum for
    each length; the driver gets one number for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0)
            sizes = x.value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = found.setdefault(d, [0, np.zeros(d, np.int64)])
                part = _matrix(x.filter(pa.array(sizes == d)))
                own[0] += len(part)
                own[1] += part.sum(axis=0)
        if found:
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()]), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], ["d", "n", "s"])

    parts = rows.select("x").mapInArrow(run, "d int, n long, s array<long>")
    sums = parts.select("d", "n", F.posexplode("s").alias("at", "s")).groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = sums.where("at = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).select("d")
    got = sorted((r["at"], r.n, r.s) for r in sums.join(F.broadcast(most), "d").collect())
    return (got[0][1], np.array([s for _, _, s in got], np.int64)) if got else (0, np.zeros(0, np.int64))


def covariance(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Of the exactly centred rows, by MLlib; ``rows`` have the length of ``sums``."""
    total = F.lit(sums.tolist()).cast("array<long>")
    centred = F.zip_with("x", total, lambda x, s: (x * n - s).cast("double") / float(n))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(centred).alias("v")), "v")
    return RowMatrix(vectors, n, len(sums)).computeGramianMatrix().toArray() / n


def fit(rows: DataFrame) -> Whitening:
    n, sums = totals(rows)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    v = covariance(rows.where(F.size("x") == len(sums)), n, sums)
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    return Whitening(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(v)))


def projected(rows: DataFrame, model: Whitening, components: int = 8) -> DataFrame:
    """(vec_id, deviation, deviation_text, whitened array of up to ``components``), a row for each row of the fitted length."""
    n, sums = model.n, model.sums
    values = model.values[:components]
    flat = ~(values > FLAT * model.trace)
    weights = model.vectors[:, : len(values)] / np.sqrt(np.where(flat, 1.0, values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(sums)), np.int64)
            off = x * n - sums
            wide = off if len(off) == 0 or float(np.abs(off).max()) ** 2 * len(sums) < 2**62 else off.astype(object)
            exact = [int(s) for s in (wide * wide).sum(axis=1)]
            white = (off / n) @ weights
            lists = [[None if gone else w for gone, w in zip(flat, row)] for row in white.tolist()]
            fits = pd.array([s if s < 2**63 else None for s in exact], dtype="Int64")
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "deviation": fits, "deviation_text": [str(s) for s in exact], "whitened": lists})

    own = rows.where(F.size("x") == len(sums))
    return own.mapInPandas(run, "vec_id long, deviation long, deviation_text string, whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves, one pass."""
    w = [F.col("whitened")[k] for k in range(components)]
    pairs = [(a, b) for a in range(components) for b in range(a + 1)]
    got = white.agg(*[F.covar_pop(w[a], w[b]) for a, b in pairs]).first()
    return max((abs(c - (a == b)) for c, (a, b) in zip(got, pairs) if c is not None), default=0.0)


def whitened(embeddings: DataFrame, components: int = 8, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text."""
    spark = embeddings.sparkSession
    rows = scaled(embeddings, id_col, column)
    model = fit(rows)
    if not model.n:
        return spark.createDataFrame([], RESULT)
    found = min(components, len(model.sums))
    white = Scratch(spark, "whitening").table(projected(rows, model, found), "rows")
    error = identity_error(white, found)
    share = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values[:found]]
    out = white.select("vec_id", "deviation", "deviation_text", F.posexplode("whitened").alias("at", "whitened"))
    n, explained = F.lit(model.n).cast("long"), F.lit(share)[F.col("at")]
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), n.alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"), "deviation_text")
