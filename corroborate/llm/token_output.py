"""Token ids in Parquet files, laid out for selective reads.

Documents are dealt by ranges of doc_id, so files hold ascending ids and their statistics prune reads by doc_id. Ids are
an ``array<int>`` column with delta or dictionary encoding, metadata are columns of their own (token counts can be read
without any ids), and row groups and pages are of a stated size; the writer adds column and offset indexes, so a reader
can skip pages. Each file carries the ordinal of its range and, for each row, its place in it; global offsets come from
the files: counts summed by range, then running sums inside each range by place, so nothing is ever in one task but a row
for each range.

Null texts count as empty (just the end id); rows that repeat a doc_id stay together, in the order of their texts; rows
without doc_id come first; an empty table gives files without rows. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text, shared_dir
from .token_counts import encoded

ROW_GROUP_BYTES, PAGE_BYTES = 8 << 20, 1 << 18
FORMAT = "range int, place long, doc_id long, n_tokens int, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", encoding: str = "delta", row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write (range int, place long, doc_id long, n_tokens int, ids array<int>) to ``path``, ascending by doc_id over the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            for a, b, size, ids in encoded(batch.column(2), tokenizer_path):
                ends = np.cumsum(size)
                values = np.insert(ids.astype(np.int32, copy=False), ends, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends + np.arange(1, b - a + 1)).astype(np.int32)), pa.array(values))
                own = pa.array(np.arange(place, place + b - a))
                yield pa.record_batch([batch.column(0).slice(a, b - a), own, batch.column(1).slice(a, b - a), pa.array((size + 1).astype(np.int32)), lists], ["range", "place", "doc_id", "n_tokens", "ids"])
                place += b - a

    rows = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.spark_partition_id().alias("range"), "doc_id", "text")
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "v2" if encoding == "delta" else "v1", "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "compression": "zstd" if encoding == "dictionary" else "snappy"}
    rows.mapInArrow(run, FORMAT).write.options(**options).parquet(path)


def read_token_ids(spark, path: str) -> DataFrame:
    return spark.read.schema(FORMAT).parquet(path)


def token_index(files: DataFrame) -> DataFrame:
    """From what the files hold, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            data, cuts = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), lists.offsets.to_numpy()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())], ["range", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.select("range", "place", "doc_id", "ids").mapInArrow(run, "range int, place long, doc_id long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("range").agg(F.sum("n_tokens").alias("total"))  # reads the metadata columns only
    before = totals.select("range", (F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    inside = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return running.join(F.broadcast(before), "range").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write ``docs``' ids to a new folder in the shared directory; return what ``read_token_ids`` reads there."""
    path = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_token_ids(docs, path, tokenizer_path, **options)
    return read_token_ids(docs.sparkSession, path)
