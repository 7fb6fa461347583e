"""A corpus pipeline of five stages, each of which works on all that the stage before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import byte_bpe, decontamination, minmax_dedup, pii, toxicity as toxic
from corroborate.llm.shared import Scratch, without


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted on the labelled ones, scores one half or more go. Each row is judged by its own
    text, a null one as an empty one, whatever its doc_id; repeated rows go or stay together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxic.held_out())
    return toxic.clean(docs, toxic.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of least id; shingles of five words. Null and empty
    texts and rows without doc_id stay; rows that repeat a doc_id stay or go together."""
    gone = minmax_dedup.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id")
    return without(docs, gone).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and rows without doc_id stay; rows that repeat a doc_id
    go together if any of them holds one."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked; n_chars follows. Null texts stay null, and so does their n_chars; no row goes."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id (null where it is), n_tokens, ids_sha256, decoded_sha256; a null text counts as empty."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", redact), ("byte_bpe", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What a stage kept is written and read back; it is deleted once the next stage has
    written its own."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = tables.table(docs, name)
            if k:
                tables.drop(STAGES[k - 1][0])
    return docs
