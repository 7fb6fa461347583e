"""The case store: upserts, statistics of score vectors, nearest cases, words and metadata. Tables are plain DataFrames."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE, FLOOR = 1e-6, 1e-10
BROADCAST_BYTES = 16 << 20


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def upsert(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after ``incoming`` (keyed by file_hash; of several rows the one of greatest ``ts``, then doc_id, counts):
    known hashes keep their id and feedback, all else is replaced."""
    fields = [c for c in store.columns if c != "file_hash"]
    new = incoming.groupBy("file_hash").agg(F.max_by(F.struct(*fields), F.struct("ts", "doc_id")).alias("n"))
    old = store.select("file_hash", F.struct(*fields).alias("o"))
    keep = {"doc_id", "feedback_label"}
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return old.join(new, "file_hash", "full").select("file_hash", *[pick(c).alias(c) for c in fields])


def insert_or_ignore(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of ``incoming`` that get in: hashes not in the store, the first (least doc_id) of each."""
    fields = [c for c in incoming.columns if c != "file_hash"]
    first = incoming.groupBy("file_hash").agg(F.min_by(F.struct(*fields), "doc_id").alias("r")).select("file_hash", "r.*")
    return first.join(store.select("file_hash"), "file_hash", "left_anti")


def feedback(store: DataFrame, labels: DataFrame) -> DataFrame:
    """The store with feedback set by hash; ``labels``: file_hash, label. ``assert_known`` tells of unknown hashes."""
    return store.join(labels, "file_hash", "left").withColumn("feedback_label", F.coalesce("label", "feedback_label")).drop("label")


def assert_known(store: DataFrame, labels: DataFrame) -> None:
    if not labels.join(store, "file_hash", "left_anti").isEmpty():
        raise KeyError("feedback for a hash that the store doesn't have")


def vector(scores: Column, keys: list[str], mask: bool = False) -> list[Column]:
    """The values of ``keys``; a missing one is 0, or null if ``mask``."""
    values = [F.try_element_at(scores, F.lit(k)) for k in keys]
    return values if mask else [F.coalesce(v, F.lit(0.0)) for v in values]


def global_stats(store: DataFrame, keys: list[str]) -> DataFrame:
    """(key, n, mean, m2): count, mean and sum of squared differences of each key's scores."""
    g = store.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("x")) for k, v in zip(keys, vector(F.col("tool_scores"), keys))])).alias("s"))
    return g.groupBy(F.col("s.key").alias("key")).agg(F.count("s.x").alias("n"), F.round(F.avg("s.x"), 9).alias("mean"), F.round(F.var_pop("s.x") * F.count("s.x"), 6).alias("m2"))


def covariance(store: DataFrame, keys: list[str], ridge: float = RIDGE) -> DataFrame:
    """(a, b, cov) of all pairs of keys, with a ridge on the diagonal, in one aggregate."""
    xs = dict(zip(keys, vector(F.col("tool_scores"), keys)))
    pairs = [(a, b) for a in keys for b in keys]
    one = store.agg(F.count("*").alias("n"), *[F.covar_samp(xs[a], xs[b]).alias(f"{a}|{b}") for a, b in pairs])
    value = lambda a, b: F.when(F.col("n") < 2, 1.0 if a == b else 0.0).otherwise(F.col(f"{a}|{b}") + (ridge if a == b else 0.0))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(value(a, b), 9).alias("cov")) for a, b in pairs])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def positive(matrix: np.ndarray, floor: float = FLOOR) -> np.ndarray:
    """The nearest matrix with eigenvalues of at least ``floor``; a matrix of a few tools' size."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, floor)) @ vectors.T


def covariance_matrix(store: DataFrame, keys: list[str]) -> np.ndarray:
    """On the driver: as many numbers as pairs of keys."""
    got = {(r.a, r.b): r["cov"] for r in covariance(store, keys).collect()}
    return positive(np.array([[got[a, b] for b in keys] for a in keys]))


def presence(scores: Column, keys: list[str]) -> Column:
    """Which of ``keys`` have a value: bit i for the i-th, 0 for none; null scores have none."""
    bits = [F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(vector(scores, keys, mask=True))]
    return sum(bits, F.lit(0)).cast("long")


def inverses(matrix: np.ndarray, present: list[int]) -> dict[int, np.ndarray]:
    """For each presence the inverse of the matrix of its keys, 0 elsewhere; the identity of a singular one."""
    out = {}
    for bits in present:
        at = [i for i in range(len(matrix)) if bits >> i & 1]
        out[bits] = np.zeros(matrix.shape)
        try:
            out[bits][np.ix_(at, at)] = np.linalg.inv(matrix[np.ix_(at, at)])
        except np.linalg.LinAlgError:
            out[bits][at, at] = 1.0
    return out


def distances(rows: DataFrame, query: dict[str, float], keys: list[str], inverse: dict[int, np.ndarray], scores: str = "tool_scores") -> DataFrame:
    """``rows`` that share a key with ``query``, with ``distance``: Mahalanobis' over the keys that a row has, Euclid's where the
    form isn't a non-negative finite number. ``inverse``: by presence; it is a table of a row for each, broadcast if it is small,
    and the form is a sum over its entries, so the size of the code doesn't depend on the number of keys."""
    n = len(keys)
    spark, bits = rows.sparkSession, "presence_"
    table = spark.createDataFrame([(b, m.ravel().tolist()) for b, m in sorted(inverse.items())], f"{bits} long, inverse_ array<double>")
    if len(inverse) * n * n * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    off = F.array(*[F.coalesce(v - F.lit(float(query[k])), F.lit(0.0)) for k, v in zip(keys, vector(F.col(scores), keys, mask=True))])
    form = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(n * n - 1)), F.lit(0.0), lambda t, i: t + F.get(s["off"], (i / n).cast("int")) * F.get(s["off"], i % n) * F.get(s["inverse_"], i))
    plain = lambda s: F.aggregate(s["off"], F.lit(0.0), lambda t, x: t + x * x)
    both = once(F.struct(off.alias("off"), F.col("inverse_")), lambda s: once(form(s), lambda f: F.sqrt(F.when((f >= 0) & (f < float("inf")), f).otherwise(plain(s)))))
    return rows.withColumn(bits, presence(F.col(scores), keys)).join(table, bits).withColumn("distance", both).drop(bits, "inverse_")


def nearest(store: DataFrame, query: dict[str, float], as_of: str, k: int = 3, inverse: np.ndarray | None = None, per: int | None = None) -> DataFrame:
    """The k labelled cases of least penalised distance: (file_hash, doc_id, distance, days, penalised). All labelled cases are
    candidates; with ``per``, the newest ``per`` * k of them only. A case is measured
    over the keys it has, by the inverse of their part of the covariance (``inverse``, if given, is that of all keys); one
    without any is no candidate."""
    from ..functions.scores import recency_penalty

    keys = sorted(query)
    labelled = store.where("feedback_label IS NOT NULL")
    # On the driver: a number for each set of keys that occurs.
    present = sorted(r.bits for r in labelled.select(presence(F.col("tool_scores"), keys).alias("bits")).distinct().collect() if r.bits)
    own = inverses(covariance_matrix(store, keys) if inverse is None else np.linalg.inv(inverse), present)
    if per is not None:
        labelled = labelled.orderBy(F.desc("ts"), "doc_id").limit(per * k)
    days = F.greatest(F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("ts")) / 86400), F.lit(0))
    rows = distances(labelled.select("file_hash", "doc_id", "tool_scores", days.alias("days")), query, keys, own)
    rows = rows.withColumn("penalised", F.col("distance") * recency_penalty(F.col("days"))).orderBy("penalised", "doc_id").limit(k)
    return rows.select("file_hash", "doc_id", F.round("distance", 6).alias("distance"), "days", F.round("penalised", 6).alias("penalised"))


def words_of(text: Column) -> Column:
    return F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+")


def containing(store: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id) of the cases whose reasoning has all words: one scan, nothing shuffled."""
    asked = sorted({w.lower() for w in words})
    every = lambda found: F.forall(F.array(*map(F.lit, asked)), lambda w: F.array_contains(found, w))
    return store.where(once(words_of(F.col("reasoning")), every)).select("doc_id")


def postings(store: DataFrame) -> DataFrame:
    """(token, doc_id): an inverted index of the words of the reasoning, to be stored where many searches follow."""
    words = F.array_distinct(F.filter(words_of(F.col("reasoning")), lambda w: w != ""))
    return store.select("doc_id", F.explode(words).alias("token"))


def match(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id) of the cases with all words."""
    asked = sorted({w.lower() for w in words})
    return index.where(F.col("token").isin(asked)).groupBy("doc_id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(asked)).select("doc_id")


def metadata_filter(store: DataFrame, key: str, value: str) -> DataFrame:
    """Cases whose metadata has ``value`` under ``key``; keys are words only."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", key):
        raise ValueError("a key has letters, digits and underscores only")
    return store.where(F.try_element_at("metadata", F.lit(key)) == value)


def common_keys(store: DataFrame, current: list[str]) -> DataFrame:
    """(keys): those of ``current`` that the store has, sorted."""
    have = store.select(F.explode(F.map_keys("tool_scores")).alias("k")).distinct().agg(F.collect_set("k").alias("have"))
    return have.select(F.array_sort(F.array_intersect(F.array(*map(F.lit, current)), "have")).alias("keys"))


def latest(store: DataFrame) -> DataFrame:
    """The newest row of each hash, the least doc_id of equals: a rewrite that takes the place of compaction. An aggregate
    with map-side combine, so a hash with very many copies isn't sorted in one task."""
    fields = [c for c in store.columns if c != "file_hash"]
    g = store.groupBy("file_hash").agg(F.max_by(F.struct(*fields), F.struct(F.col("ts"), -F.col("doc_id"))).alias("r"))
    return g.select("file_hash", "r.*")
