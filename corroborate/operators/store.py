"""A case store that is kept up to date: what a merge costs follows what it changes.

Cases lie in Parquet folders by range of their hash. A merge rewrites only the ranges that it touches; all others keep their
files. One small manifest for each version names the folder of every range; a merge writes its folders first and its
manifest last, under another name and then renamed. So readers see a whole version or the one before, and a merge that fails
leaves the last version as it was. One writer at a time.

The manifest also holds the moments of the scores (count, means, sums of products of differences), to which a merge adds
those of the rows it brings and from which it takes those of the rows it replaces: no other row is read. If a variance comes
out negative by rounding, the moments are computed anew.

The words of the reasoning are postings (token, doc_id) by range of the token, a segment for each merge, which holds the
words of the changed cases only. Replaced and removed cases are listed by segment, and postings of older segments don't
count for them. ``compact`` makes one segment of all.

Hashes are never null; of several incoming rows of one hash the one of greatest ``ts``, then doc_id, counts. A known hash keeps
its doc_id and feedback. Missing scores count as 0 in the moments. Null reasoning has no words. Ties beyond that are broken
by the order of the input.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .casestore import vector, words_of
from .service import valid_scores

#: A variance below this share of the values' size is taken for an error of rounding, and the moments are made anew.
NEGATIVE = -1e-10


class Moments(NamedTuple):
    """Count, means and sums of products of differences of the scores of ``keys``."""

    keys: list[str]
    n: int
    mean: np.ndarray
    m2: np.ndarray

    def over(self, keys: list[str]) -> Moments:
        """With more keys, whose scores are 0 in all rows so far."""
        at = [keys.index(k) for k in self.keys]
        mean, m2 = np.zeros(len(keys)), np.zeros((len(keys), len(keys)))
        mean[at], m2[np.ix_(at, at)] = self.mean, self.m2
        return Moments(keys, self.n, mean, m2)

    def plus(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(self.keys, n, self.mean + d * other.n / n, self.m2 + other.m2 + np.outer(d, d) * self.n * other.n / n)

    def minus(self, other: Moments) -> Moments | None:
        """Without rows that are part of these; None if rounding has eaten up what is left."""
        n = self.n - other.n
        if n <= 0:
            return Moments(self.keys, 0, np.zeros(len(self.keys)), np.zeros(self.m2.shape)) if n == 0 else None
        mean = (self.mean * self.n - other.mean * other.n) / n
        d = other.mean - mean
        m2 = self.m2 - other.m2 - np.outer(d, d) * n * other.n / self.n
        return None if (np.diag(m2) < NEGATIVE).any() else Moments(self.keys, n, mean, np.where(np.eye(len(self.keys)) == 1, np.maximum(m2, 0), m2))

    def covariance(self) -> np.ndarray:
        return self.m2 / (self.n - 1) if self.n > 1 else np.eye(len(self.keys))


def moments(rows: DataFrame, keys: list[str], scores: str = "tool_scores") -> Moments:
    """In one aggregate; the driver gets a number for each pair of keys."""
    k = len(keys)
    if not k:
        return Moments([], rows.count(), np.zeros(0), np.zeros((0, 0)))
    x = rows.select(F.array(*vector(F.col(scores), keys)).alias("x"))
    at = [F.get("x", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    got = x.agg(F.count("*"), *[F.avg(c) for c in at], *[F.covar_pop(at[i], at[j]) for i, j in pairs]).first()
    n, mean, m2 = got[0], np.array([v or 0.0 for v in got[1 : k + 1]]), np.zeros((k, k))
    for (i, j), c in zip(pairs, got[k + 1 :]):
        m2[i, j] = m2[j, i] = (c or 0.0) * n
    return Moments(keys, n, mean, m2)


class CaseStore:
    """``fields``: schema of the cases, with file_hash, doc_id, ts, tool_scores, reasoning and feedback_label. ``ranges`` are of
    the hashes, ``token_ranges`` of the words; both stay as they were when the store was made."""

    def __init__(self, spark: SparkSession, path: str, fields: StructType | None = None, ranges: int = 64, token_ranges: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._latest()
        if not self.state:
            if fields is None:
                raise FileNotFoundError(f"no store at {path}")
            self.state = {"version": 0, "fields": fields.json(), "ranges": ranges, "token_ranges": token_ranges, "cases": {}, "segments": [], "parts": {}, "gone": [], "keys": [], "n": 0, "mean": [], "m2": []}
        self.fields = StructType.fromJson(json.loads(self.state["fields"]))

    # Manifests

    def _p(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _children(self, *parts: str) -> list[str]:
        at = self._p(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _latest(self) -> dict | None:
        found = [n for n in self._children("manifest") if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{found[-1]}", wholetext=True).first().value) if found else None

    def _commit(self, state: dict) -> None:
        name = f"{state['version']:012d}.json"
        if self.fs.exists(self._p("manifest", name)):
            raise RuntimeError("another writer was there first")
        draft = self._p("manifest", f"_{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        if not self.fs.rename(draft, self._p("manifest", name)):
            raise RuntimeError("the manifest could not be put in place")
        self.state = state

    # Reading

    def _read(self, kind: str, schema: str | StructType, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*[f"{self.path}/{kind}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _cases(self, ranges: list[int] | None = None) -> DataFrame:
        own = self.state["cases"]
        return self._read("cases", self.fields, [f"v={own[str(r)]}/range={r}" for r in (sorted(map(int, own)) if ranges is None else ranges) if str(r) in own]).select(*self.fields.names)

    def read(self) -> DataFrame:
        return self._cases()

    def range_of(self, column: str = "file_hash"):
        return F.pmod(F.xxhash64(column), F.lit(self.state["ranges"])).cast("int")

    def get(self, hashes: list[str]) -> DataFrame:
        """The cases of a few hashes: their ranges are read."""
        asked = self.spark.createDataFrame([(h,) for h in hashes], "file_hash string")
        ranges = [r[0] for r in asked.select(self.range_of()).distinct().collect()]
        return self._cases(ranges).join(F.broadcast(asked), "file_hash", "left_semi")

    @property
    def moments(self) -> Moments:
        s, k = self.state, len(self.state["keys"])
        return Moments(s["keys"], s["n"], np.array(s["mean"], float), np.array(s["m2"], float).reshape(k, k))

    # Writing

    def merge(self, incoming: DataFrame, removed: DataFrame | None = None, invalid: str = "raise") -> int:
        """Put in ``incoming`` (columns as the store's) and take out the hashes of ``removed`` (file_hash) before; the new version.
        Rows with a score that is no finite number stop the merge, or are set apart in ``quarantine`` if ``invalid`` says so."""
        version = self.state["version"] + 1
        folder = f"{version}-{uuid.uuid4().hex[:8]}"
        names = self.fields.names
        rows = incoming.select(*names).withColumn("row", F.monotonically_increasing_id()).withColumn("valid", F.coalesce(valid_scores(F.col("tool_scores")), F.lit(True)))
        rows.withColumn("range", self.range_of()).write.parquet(f"{self.path}/staged/v={folder}")
        staged = self.spark.read.schema(StructType([*self.fields.fields, *StructType.fromDDL("row long, valid boolean, range int").fields])).parquet(f"{self.path}/staged/v={folder}")
        bad = staged.where("NOT valid").select(*names)
        if not bad.isEmpty():
            if invalid != "quarantine":
                self.fs.delete(self._p("staged", f"v={folder}"), True)
                raise ValueError("a score is not a finite number")
            bad.write.parquet(f"{self.path}/quarantine/v={folder}")
        # The winners' numbers alone are aggregated; their payload follows by join.
        best = staged.where("valid").groupBy("file_hash").agg(F.max(F.struct("ts", "doc_id", (-F.col("row")).alias("back"))).alias("b"), F.first("range").alias("range"))
        best.select("file_hash", (-F.col("b.back")).alias("row"), "range").write.parquet(f"{self.path}/best/v={folder}")
        best = self.spark.read.schema("file_hash string, row long, range int").parquet(f"{self.path}/best/v={folder}")
        delta = staged.drop("range").join(best.select("file_hash", "row"), ["file_hash", "row"], "left_semi").select(*names)
        # What goes is written too, so that each later step reads the same rows.
        out = (removed if removed is not None else self.spark.createDataFrame([], "file_hash string")).select("file_hash").distinct().withColumn("range", self.range_of())
        out.write.parquet(f"{self.path}/removed/v={folder}")
        out = self.spark.read.schema("file_hash string, range int").parquet(f"{self.path}/removed/v={folder}")

        touched = sorted(r.range for r in best.select("range").union(out.select("range")).distinct().collect())
        old = self._cases(touched)
        stays = old.join(out.select("file_hash"), "file_hash", "left_anti")
        o, n = stays.alias("o"), delta.alias("n")
        kept = {"doc_id", "feedback_label"}
        new = F.col("n.file_hash").isNotNull()
        pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in {*kept, "file_hash"} else F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        merged = o.join(n, F.col("o.file_hash") == F.col("n.file_hash"), "full").select(*[pick(c).alias(c) for c in names])
        merged.withColumn("range", self.range_of()).repartition("range").sortWithinPartitions("range", "file_hash").write.partitionBy("range").parquet(f"{self.path}/cases/v={folder}")

        state = self.state | {"version": version, "cases": {r: v for r, v in self.state["cases"].items() if int(r) not in touched}}
        for name in self._children("cases", f"v={folder}"):
            if name.startswith("range="):
                state["cases"][name.removeprefix("range=")] = folder
        changed = best.select("file_hash").union(out.select("file_hash")).distinct()
        before = old.join(changed, "file_hash", "left_semi")
        before.select("doc_id").write.parquet(f"{self.path}/gone/v={folder}")
        after = self._read("cases", self.fields, [f"v={folder}/range={r}" for r, v in state["cases"].items() if v == folder]).join(best.select("file_hash"), "file_hash", "left_semi")
        self._write_postings(after.select("doc_id", "reasoning"), folder)

        keys = sorted({*self.state["keys"], *(r.k for r in delta.select(F.explode(F.map_keys("tool_scores")).alias("k")).distinct().collect())})
        found = self.moments.over(keys).plus(moments(delta, keys)).minus(moments(before, keys))
        state |= {"segments": [*self.state["segments"], folder], "gone": [*self.state["gone"], folder], "parts": self.state["parts"] | {folder: self._parts(folder)}}
        state |= self._numbers(found or self._rebuilt(state, keys))
        self._commit(state)
        for kind in ("staged", "best", "removed"):
            self.fs.delete(self._p(kind, f"v={folder}"), True)
        return version

    def _numbers(self, m: Moments) -> dict:
        return {"keys": m.keys, "n": m.n, "mean": m.mean.tolist(), "m2": m.m2.ravel().tolist()}

    def _rebuilt(self, state: dict, keys: list[str]) -> Moments:
        return moments(self._read("cases", self.fields, [f"v={v}/range={r}" for r, v in state["cases"].items()]), keys)

    def rebuild(self) -> Moments:
        """The moments from all cases."""
        return self._rebuilt(self.state, self.state["keys"])

    # Words

    def _part_of(self, column):
        return F.pmod(F.xxhash64(column), F.lit(self.state["token_ranges"])).cast("int")

    def _parts(self, folder: str) -> list[int]:
        return [int(n.removeprefix("part=")) for n in self._children("postings", f"v={folder}") if n.startswith("part=")]

    def _write_postings(self, cases: DataFrame, folder: str) -> None:
        words = F.array_distinct(F.filter(words_of(F.col("reasoning")), lambda w: w != ""))
        rows = cases.select("doc_id", F.explode(words).alias("token")).withColumn("part", self._part_of("token"))
        rows.repartition("part").sortWithinPartitions("part", "token", "doc_id").write.partitionBy("part").parquet(f"{self.path}/postings/v={folder}")

    def _postings(self, parts: list[int] | None = None) -> DataFrame:
        """(token, doc_id, place of the segment) of live and dead postings."""
        folders = [f"v={s}/part={p}" for s in self.state["segments"] for p in self.state["parts"][s] if parts is None or p in parts]
        rows = self._read("postings", "token string, doc_id long, v string", folders)
        return rows.select("token", "doc_id", self._place("v").alias("place"))

    def _place(self, column: str):
        """The number of a segment, which is that of the version that wrote it."""
        return F.split(column, "-")[0].cast("int")

    def _gone(self) -> DataFrame:
        rows = self._read("gone", "doc_id long, v string", [f"v={g}" for g in self.state["gone"]])
        return rows.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max(self._place("v")).alias("gone_at"))

    def _live(self, postings: DataFrame) -> DataFrame:
        return postings.join(self._gone(), (F.col("doc_id") == F.col("gone_id")) & (F.col("place") < F.col("gone_at")), "left_anti")

    def search(self, words: list[str]) -> DataFrame:
        """(doc_id) of the cases that have all words: the token ranges of the words are read, and what was replaced is left out."""
        asked = sorted({w.lower() for w in words})
        if not asked:
            raise ValueError("a search needs a word")
        tokens = self.spark.createDataFrame([(w,) for w in asked], "token string")
        parts = [r[0] for r in tokens.select(self._part_of("token")).distinct().collect()]
        hits = self._postings(parts).where(F.col("token").isin(asked)).groupBy("doc_id", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(asked))
        return self._live(hits).select("doc_id")

    def compact(self) -> None:
        """One segment of all live postings."""
        version = self.state["version"] + 1
        folder = f"{version}-{uuid.uuid4().hex[:8]}"
        rows = self._live(self._postings()).select("token", "doc_id").withColumn("part", self._part_of("token"))
        rows.repartition("part").sortWithinPartitions("part", "token", "doc_id").write.partitionBy("part").parquet(f"{self.path}/postings/v={folder}")
        self._commit(self.state | {"version": version, "segments": [folder], "gone": [], "parts": {folder: self._parts(folder)}})

    def drop_old(self) -> None:
        """Delete what the last version doesn't name: folders of versions before it and of merges that failed."""
        named = {"cases": {*self.state["cases"].values()}, "postings": {*self.state["segments"]}, "gone": {*self.state["gone"]}, "staged": set(), "best": set(), "removed": set()}
        for kind, keep in named.items():
            for name in self._children(kind):
                if name.startswith("v=") and name.removeprefix("v=") not in keep:
                    self.fs.delete(self._p(kind, name), True)
        for name in self._children("manifest")[:-1]:
            self.fs.delete(self._p("manifest", name), True)
