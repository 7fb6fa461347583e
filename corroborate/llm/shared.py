"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a new one of this machine if Spark runs
    in this one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Intermediate tables in a folder of their own below the shared one.

    A table cuts the lineage, and survives the loss of any executor, unlike cached blocks. ``drop`` deletes those that
    nothing will read any more."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as one table of a new folder, read back."""
    return Scratch(df.sparkSession, name).table(df, "rows")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator needs, so no other column's name can clash with a result; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Ids that are broadcast at most: a hash table of them takes some 50 MB.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with all their columns, without the rows whose id is in ``gone`` (one column of ids). The ids are written and
    counted first: up to ``most`` are broadcast, so no text is shuffled; beyond that both sides are shuffled by id. Rows
    without an id stay; rows that repeat one stay or go together."""
    own = unused(docs, "gone_id")
    ids = written(gone.select(F.col(gone.columns[0]).cast("long").alias(own)).where(F.col(own).isNotNull()).distinct(), "gone")
    side = F.broadcast(ids) if ids.count() <= most else ids
    return docs.join(side, F.col(id_col).cast("long") == F.col(own), "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` hasn't got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_bytes(sizes: Sequence[int], most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``sizes`` bytes: at most ``most`` bytes and ``rows`` texts each, or one text."""
    start = size = 0
    for k, n in enumerate(sizes):
        if k > start and (size + n > most or k - start >= rows):
            yield start, k
            start, size = k, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], place: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of the texts in column ``place``, so that what is made of a slice's texts is bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()
        for a, b in by_bytes(sizes, most):
            yield batch.slice(a, b - a)


def give_back() -> None:
    """This process gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def given_back(run: Callable) -> Callable:
    """``run`` of a task, after which the worker, which lives on for other tasks, gives freed memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker process keeps from task to task under ``key``. It keeps one thing at a time: processes are reused,
    so tables of an operator that is done would otherwise stay beside those of the next."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def fold(values: Column, zero: Column, step, finish=None) -> Column:
    return F.aggregate(values, zero, step, finish) if finish else F.aggregate(values, zero, step)
