"""Fingerprints against a plain version, and on odd rows."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from corroborate.llm import fingerprint, queries

from ..conftest import SF

ROWS = "doc_id long, text string, low string, range int, edited string"


def chained(numbers):
    h = 42
    for n in numbers:
        h = xxhash.xxh64_intdigest(struct.pack("<q", n), seed=h)
    return h - (1 << 64) if h >> 63 else h


def hashes(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    own = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    own = [h - (1 << 64) if h >> 63 else h for h in own]
    return {chained(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else {chained(own)} if own else set()


def least(found, k=128):
    return sorted(found)[:k]


def like(a, b, k=128):
    u = set(least(a | b, k))
    return len(set(least(a, k)) & set(least(b, k)) & u) / len(u) if u else 1.0


def plain(rows):
    """doc_id -> row; ids are distinct."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = hashes(text), hashes(edited), hashes(following)
        digits = lambda s: "".join(f"{h & (1 << 64) - 1:016x}" for h in least(s))
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(a), digits(b), like(a, b), like(a, c))
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == want[r.doc_id][:4], r.doc_id
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][4:], abs=1e-12), r.doc_id


def test_query_equals_the_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    compare(queries.op13_fingerprint(spark, SF).collect(), plain(rows))


ODD = [None, "", " \n\t", "One", "one  TWO\nthree four", "a b c d e", "É Ü 日本語　x 😀 b c d", "word " * 30000, "x" * 70000, "same text of a few words here", "same text of a few words here", " ".join(map(str, range(20000)))]


@pytest.mark.parametrize("rows", [2, 3, 1000])
def test_odd_texts_and_ranges(spark, rows):
    own = [(10 * i - 30, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in own], ROWS).repartition(3)
    compare(fingerprint.edited_fingerprints(df, rows).collect(), plain(own))


def test_frequent_and_missing_ids(spark):
    own = [(None, f"text number {i} of those without an id") for i in range(40)] + [(5, f"five {i} and so on it goes") for i in range(40)] + [(5, "five again and again it is")] * 30 + [(9, "the last one of them all")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in own], ROWS).repartition(3)
    got = fingerprint.edited_fingerprints(df, 8).collect()
    assert len(got) == len(own) and sum(r.doc_id is None for r in got) == 40
    copies = [r for r in got if r.near_next == 1.0]
    assert len(copies) == 29
    follow = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next(df.select("doc_id", "text"), 8).collect()}
    assert follow[9, "the last one of them all"] in {t for i, t in own if i is None}
    assert sorted(r.next_text for r in fingerprint.with_next(df.select("doc_id", "text"), 8).collect()) == sorted(t for _, t in own)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "a b c d e f g h", "", 1, "")], ROWS)
    (r,) = fingerprint.edited_fingerprints(one).collect()
    compare([r], plain([(3, "a b c d e f g h")]))
    assert r.near_next == 1.0 and fingerprint.edited_fingerprints(one.limit(0)).collect() == []


def test_parts_give_the_sketch_of_the_whole(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice([" ", "  ", "\n", "a", "bb", "é"]) for _ in range(rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for part in (1, 7, 1 << 16):
        for r in df.select("text", fingerprint.sketch(F.col("text"), 6, 3, part).alias("low")).collect():
            assert r.low == least(hashes(r.text, 3), 6), (part, r.text)


def test_merged_sketches_and_estimates(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    common = [word() for _ in range(3000)]
    rows = [("a", " ".join(common)), ("b", " ".join(common[:1500] + [word() for _ in range(1500)])), ("none", "")]
    rows += [("hot", " ".join(common[i : i + 9])) for i in range(0, 2900, 5)] + [("hot", " ".join(common[:9]))] * 50
    df = spark.createDataFrame(rows, "source string, text string").repartition(5).withColumn("low", fingerprint.sketch(F.col("text")))
    got = {r.source: r.low for r in fingerprint.merged(df, "source").collect()}
    want = {}
    for s, t in rows:
        want.setdefault(s, set()).update(hashes(t))
    assert got == {s: least(h) for s, h in want.items()}
    one = spark.createDataFrame([(got["a"], got["b"])], "a array<long>, b array<long>")
    r = one.select(fingerprint.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprint.containment(F.col("a"), F.col("b")).alias("c"), fingerprint.distinct_shingles(F.col("a")).alias("n"), fingerprint.containment(F.col("a"), F.col("a")).alias("all")).first()
    assert abs(r.r - 1 / 3) < 0.13 and abs(r.c - 0.5) < 0.2 and abs(r.n / 2996 - 1) < 0.3 and r["all"] == 1.0


def test_estimates_are_close_on_the_table(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op13_fingerprint(spark, SF).collect()}
    errors = []
    for (i, text), (_, following) in zip(rows, rows[1:]):
        a, b = hashes(text), hashes(text[: len(text) - len(text) // 2] + following[: len(text) // 2])
        if a and b:
            errors.append(abs(got[i].near_edited - len(a & b) / len(a | b)))
    assert sum(errors) / len(errors) < 0.03


def test_main_path_has_no_python(spark):
    plan = queries.op13_fingerprint(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
