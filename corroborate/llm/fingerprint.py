"""Fingerprints of documents: the k least hashes of their word shingles.

A sketch is the sorted array of the k least distinct 64-bit hashes of a set of shingles. The sketch of a union is made of the
sketches alone (the k least of both), so a long text is read in parts of bounded size, each merged into what was kept before
it, and sketches of rows are merged for whole sources or collections. From two sketches follow estimates: of resemblance
(the share of the k least of the union that both have), of the number of distinct shingles ((k - 1) over the k-th hash as a
fraction; exact below k), and of containment. With fewer than k shingles in the union all of them are exact; otherwise the
error of resemblance r has a deviation of sqrt(r * (1 - r) / k).

Words are what lies between white space, in lower case; a shingle is five words. A text with fewer words has one shingle of
all of them; one without any, or a null one, has an empty sketch, which resembles an empty one only. Equal texts have equal
sketches.

All is done by built-in functions. ``with_next`` finds each document's follower by ranges of (doc_id, hash of the text):
ids and hashes are shuffled to find where ranges start (at most ``RANGES`` pairs of numbers come to the driver), then each
text is shuffled once; the first row of each range is copied to the range before it. Rows without doc_id come first, rows
of one doc_id are in order of the hash, and equal rows follow each other. An empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_and_text

K, WORDS = 128, 5
PART = 1 << 16  # code points of a text that are split into words at a time
ROWS, RANGES = 1024, 1 << 16
LEAST = -(1 << 63)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def _shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of n of the hashed words."""
    ends = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def sketch(text: Column, k: int = K, words: int = WORDS, part: int = PART) -> Column:
    """The k least shingle hashes of a text, read part by part."""
    none = F.array().cast("array<long>")
    zero = F.struct(none.alias("low"), none.alias("last"), F.lit("").alias("rest"))

    def step(whole: Column, parts: Column):
        def add(acc: Column, i: Column) -> Column:
            done = i == parts - 1
            pieces = F.split(F.concat(acc["rest"], F.substring(whole, i * part + 1, F.lit(part))), r"[ \t-\r]+")

            def with_pieces(p: Column) -> Column:
                complete = F.filter(F.when(done, p).otherwise(F.slice(p, 1, F.size(p) - 1)), lambda w: w != "")
                rest = F.when(done, "").otherwise(F.element_at(p, -1))
                return _let(F.concat(acc["last"], F.transform(complete, lambda w: F.xxhash64(w))), lambda h: F.struct(_least(F.concat(acc["low"], _shingles(h, words)), k).alias("low"), F.slice(h, F.greatest(F.size(h) - words + 2, F.lit(1)), words - 1).alias("last"), rest.alias("rest")))

            return _let(pieces, with_pieces)

        return F.aggregate(F.sequence(F.lit(0), parts - 1), zero, add, lambda acc: F.when((F.size(acc["low"]) == 0) & (F.size(acc["last"]) > 0), F.array(F.xxhash64(acc["last"]))).otherwise(acc["low"]))

    parts = lambda t: F.greatest(F.ceil(F.length(t) / part), F.lit(1)).cast("int")
    return _let(F.lower(F.coalesce(text, F.lit(""))), lambda t: _let(parts(t), lambda n: step(t, n)))


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both sets together."""
    return _least(F.concat(a, b), k)


def distinct_shingles(low: Column, k: int = K) -> Column:
    share = F.get(low, F.lit(k - 1)).cast("double") / float(1 << 64) + 0.5
    return F.when(F.size(low) < k, F.size(low).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union's shingles that are in both; 1 for two empty sketches."""
    both = _let(union(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))
    return both.cast("double")


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b too; 1 for an empty a."""
    shared = resemblance(a, b, k) * distinct_shingles(union(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def as_text(low: Column) -> Column:
    """16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(low, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(sketches: DataFrame, key: str, column: str = "low", k: int = K) -> DataFrame:
    """(key, low): the sketch of all rows of each key. Before the shuffles each task keeps the distinct hashes it has, and
    then the k least of each key, so a key with very many rows costs a task no more than k of them."""
    rows = sketches.select(F.col(key).alias("key"), F.explode_outer(column).alias("h")).distinct()
    least = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_last("h")))).where(F.col("rank") <= k)
    return least.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("low")).withColumnRenamed("key", key)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, low, n_shingles) for each document."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", sketch(F.col("text"), k).alias("low"))
    return rows.withColumn("n_shingles", distinct_shingles(F.col("low"), k))


def _starts(keys: DataFrame, rows: int) -> list[tuple[int, int]]:
    """The least (id, hash) of ranges of about ``rows`` rows, ascending."""
    n = min(max(-(-keys.count() // rows), 1), RANGES)
    least = keys.repartitionByRange(n, "id", "hash").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("id", "hash")).alias("s"))
    return sorted((r.s["id"], r.s["hash"]) for r in least.collect())


def _numbers(values: list[int]) -> Column:
    """A constant array, from one string."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame | None:
    """(doc_id, text, low, next_text, next_low) by ascending doc_id, the first after the last; None without rows."""
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(LEAST)).alias("id"), F.xxhash64("text").alias("hash"))
    starts = _starts(keyed.select("id", "hash"), rows)
    if not starts:
        return None
    ids, hashes = _numbers([s for s, _ in starts]), _numbers([h for _, h in starts])

    def search(at: Column, step: Column) -> Column:
        id_, hash_ = F.get(ids, at + step), F.get(hashes, at + step)
        return F.when((id_ < F.col("id")) | ((id_ == F.col("id")) & (hash_ <= F.col("hash"))), at + step).otherwise(at)

    steps = F.array(*[F.lit(1 << b) for b in range(len(starts).bit_length() - 1, -1, -1)])
    ranged = keyed.withColumn("range", F.aggregate(steps, F.lit(0), search))
    first = (F.get(ids, F.col("range")) == F.col("id")) & (F.get(hashes, F.col("range")) == F.col("hash"))
    place = lambda r, guest: F.struct(r.alias("range"), F.lit(guest).alias("guest"))
    before = F.pmod(F.col("range") - 1, F.lit(len(starts)))
    places = F.explode(F.when(first, F.array(place(F.col("range"), 0), place(before, 1))).otherwise(F.array(place(F.col("range"), 0))))
    dealt = ranged.select("doc_id", "text", "id", "hash", places.alias("p")).select("doc_id", "text", "id", "hash", "p.range", "p.guest")
    dealt = dealt.repartition("range").withColumn("low", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", "id", "hash")
    follow = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_low", F.lead("low").over(order))
    return follow.where("guest = 0").select("doc_id", "text", "low", "next_text", "next_low")


def edited_fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per document its fingerprint, that of its text with the last half replaced by the start of the next document, and
    how like both are and it is to the next one: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and estimates: n_shingles, contained (share of the document's shingles left in the edited text)."""
    found = with_next(id_and_text(docs), rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained double")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    both = found.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "low", "next_low").withColumn("edited_low", sketch(F.col("edited")))
    low, other, following = F.col("low"), F.col("edited_low"), F.col("next_low")
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(low).alias("fingerprint"), as_text(other).alias("edited_fingerprint"), resemblance(low, other).alias("near_edited"), resemblance(low, following).alias("near_next"), distinct_shingles(low).alias("n_shingles"), containment(low, other).alias("contained"))
