"""Near-duplicates by min-max hashing.

Each hash function gives two values of a set, its minimum and its maximum, so half the evaluations fill a signature.
Bands of it are bucket keys. Every member of a bucket is first compared with one hub (the bucket's least id) only, links
so found are contracted to components, and only buckets that still hold several components go on. Of those, each member
outside the largest component is compared with the members of other components, unless their known distances to the hub
rule a link out (the Jaccard distance is a metric), or their sizes do, or the rest of their signatures does. Buckets are
dealt out in blocks of members, the same way at every size. All candidates are confirmed on full shingle sets. Exact
copies of a set are one node throughout. Components come from alternating star contraction; nothing but counts reaches
the driver.

What hashing misses: a pair at the threshold shares no band with probability (1 - s^rows)^bands, 5.2e-6 at 0.8, and its
signatures differ by more than ``SURE`` standard deviations with probability 3e-7; pairs above the threshold are missed
far more rarely, and links to others often join them anyway. No rule depends on the size of a bucket or a table.

Null and empty texts have an empty set and link with nothing. Each row is placed by its own text, so rows that repeat a
doc_id each get a row, and those of one text the same one. A row without doc_id is left out of linking (component_id
null, kept true). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, by_bytes, given_back, id_and_text, kept

BANDS, ROWS = 40, 6
#: 16 values of four bits in each; 480 hash functions give 960 values.
SKETCH_LONGS = 60
#: A candidate's sketches may differ by so many standard deviations more than those of a pair at the threshold.
SURE = 5.0
#: Texts hashed at once: bytes, and sets.
BATCH_BYTES, BATCH_SETS = 1_000_000, 500
#: Partners that one hub's set goes to in one group of rows, members whose buckets are met in one, and sets held at once.
BLOCK, HELD = 256, 64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of the base and of its inverse modulo 2^64; a worker keeps those of an ordinary batch."""
    size = BATCH_BYTES + 2 * BATCH_SETS
    if n <= size:
        return tuple(x[:n] for x in kept("powers", lambda: _raised(size)))
    return _raised(n)


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _UNBASE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words. A-Z are lower-cased; words are
    runs without ASCII white space; with fewer words than ``words``, all of them are one shingle."""
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(space, np.uint64(0), _BYTE[data] * up[: len(data)]), out=total[1:])
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    cuts = np.searchsorted(starts, np.append(0, np.cumsum([len(t) + 1 for t in texts]))).tolist()
    n = len(word) - words + 1
    if n > 0:
        x = word[:n].copy()
        for k in range(1, words):
            x = _mixed(x * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n])
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= words:
            s = np.sort(x[a : b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            y = word[a : a + 1].copy()
            for k in range(a + 1, b):
                y = _mixed(y * np.uint64(0xD6E8FEB86659FD93) + word[k])
            out.append(_mixed(y + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set (none of them empty) a row of ``bands`` bucket keys, and a sketch: four bits of each value."""
    draw = np.random.default_rng(7)
    functions = SKETCH_LONGS * 8
    multiply, add = draw.integers(0, 1 << 32, (2, functions), dtype=np.uint32)
    weight = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    values = np.empty((len(sets), 2 * functions), np.uint32)
    h = np.empty_like(x)
    for k in range(functions):
        np.multiply(x, multiply[k] | np.uint32(1), out=h)
        np.add(h, add[k], out=h)
        values[:, 2 * k] = np.minimum.reduceat(h, at)
        values[:, 2 * k + 1] = np.maximum.reduceat(h, at)
    terms = _mixed(values[:, : bands * rows] + weight) * weight
    keys = _mixed(terms.reshape(len(sets), bands, rows).sum(axis=2) + np.arange(bands, dtype=np.uint64))
    sketch = np.zeros((len(sets), SKETCH_LONGS), np.uint64)
    for k in range(16):  # four bits of every sixteenth value at a time
        sketch |= (_mixed(values[:, k::16].astype(np.uint64)) & np.uint64(15)) << np.uint64(4 * k)
    return keys.view(np.int64), sketch.view(np.int64)


def sketch_differences(a: Column, b: Column) -> Column:
    """How many of the values behind two sketches differ (as far as four bits tell)."""

    def one(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda p, q: p + q, map(one, range(SKETCH_LONGS)))


def hashed_sets(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (digest of the set, null if empty), bands and sketch array<long>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            for a, b in by_bytes(list(map(len, texts)), BATCH_BYTES, BATCH_SETS):
                sets = shingle_sets(texts[a:b], words)
                full = [s for s in sets if len(s)]
                keys = signatures(full, bands, rows) if full else (np.empty(0, np.int64),) * 2
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                ends = np.append(0, np.cumsum([bool(len(s)) for s in sets])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends * np.int32(n)), pa.array(x.ravel())) for n, x in zip((bands, SKETCH_LONGS), keys)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), *lists], ["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.mapInArrow(given_back(run), "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """Per row: id, and shingles: the sorted hashes of the whole set, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            for a, b in by_bytes(list(map(len, texts)), BATCH_BYTES, BATCH_SETS):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], words)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(given_back(run), "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact similarity of each pair (a, b) of ids: columns a, b, shared, either (sizes of intersection and union).

    ``sets``: id, shingles. The partners of each ``a`` are dealt out in blocks; a block gets the set of ``a`` once, ahead
    of its partners' sets, which stream past it. An id with several sets has a row for each pair of sets."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    of = lambda side: sets.select(F.col("id").alias(side), "shingles")
    first = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(of("a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")
    dealt = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    rows = first.union(dealt.join(of("b"), "b").select("a", "block", "b", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, open_ = None, [], False
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for a, block, b, cell in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                s = np.frombuffer(cell.as_buffer(), np.uint64)
                if b is None:
                    own = [*own, s.copy()] if open_ and at == (a, block) else [s.copy()]
                    at, open_ = (a, block), True
                    continue
                open_ = False
                for t in own:
                    place = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    same = int((t[place] == s).sum())
                    out.append((a, b, same, len(s) + len(t) - same))
            yield pa.record_batch([pa.array(list(x), pa.int64()) for x in (zip(*out) if out else [[]] * 4)], ["a", "b", "shared", "either"])

    grouped = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return grouped.mapInArrow(given_back(run), "a long, b long, shared long, either long")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (main, block, x, y) whose sets link: columns a, b, the lesser id first.

    A block has at most about HELD different x. Their sets are held while the sets of all y of the block stream past, each
    once, with the list of the x it is compared with. So a set is sent once for each block, not for each pair."""
    of = lambda rows, side: rows.join(sets.select(F.col("id").alias(side), "shingles"), side)
    held = of(pairs.select("main", "block", "x").distinct(), "x").select("main", "block", F.lit(None).cast("long").alias("y"), F.array("x").alias("xs"), "shingles")
    past = of(pairs.groupBy("main", "block", "y").agg(F.collect_set("x").alias("xs")), "y").select("main", "block", "y", "xs", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            for main, block, y, xs, cell in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if at != (main, block):
                    at, own = (main, block), {}
                s = np.frombuffer(cell.as_buffer(), np.uint64)
                if y is None:
                    own.setdefault(xs[0], []).append(s.copy())
                    continue
                for x in xs:
                    for t in own.get(x, ()):
                        same = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                        if 100 * same >= percent * (len(s) + len(t) - same):
                            out.append((min(x, y), max(x, y)))
            yield pa.record_batch([pa.array(list(k), pa.int64()) for k in (zip(*out) if out else [[]] * 2)], ["a", "b"])

    grouped = held.union(past).repartition("main", "block").sortWithinPartitions("main", "block", F.col("y").asc_nulls_first())
    return grouped.mapInArrow(given_back(run), "a long, b long").distinct()


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(id, component: the least id reachable) of every id with a link; ``edges``: columns a, b."""
    scratch = Scratch(edges.sparkSession, name)
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "0")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, after, k = None, state(now), 0
    while before != after:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        now = scratch.table(small.distinct(), str(k + 1))
        scratch.drop(str(k))
        before, after, k = after, state(now), k + 1
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id). Linked: 100 * shared >= percent * either."""
    own, tables = id_and_text(docs, id_col, text_col), Scratch(docs.sparkSession, "minmax")
    sets = tables.table(hashed_sets(own, words, bands, rows), "sets")
    first = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    nodes = tables.table(sets.join(first, "set_key").where("doc_id = rep").select("rep", "n_shingles", "bands", "sketch"), "nodes")
    keys = nodes.select("rep", F.posexplode("bands").alias("i", "key"))
    buckets = tables.table(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = tables.table(keys.join(buckets, "key").distinct(), "members")
    # Only texts that share a bucket are hashed again, and shuffled at all.
    shared = members.select(F.col("rep").alias("doc_id")).distinct()
    full = tables.table(full_sets(own.join(shared, "doc_id", "left_semi"), words), "full")
    members = members.where("rep <> hub")
    to_hub = members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    near = F.when(F.count("*") == 1, F.max(F.col("shared") / F.col("either")))  # ids with several sets have no one distance
    to_hub = tables.table(to_hub, "to-hub")
    known = tables.table(confirmed(to_hub, full).groupBy("a", "b").agg(near.alias("near"), F.max(F.expr(f"100 * shared >= {percent} * either")).alias("linked")), "known")
    label = components(known.where("linked"))
    # What the hubs didn't settle: members of one bucket in different components. Pairs with the hub itself are known.
    open_ = members.where("size > 2").join(known.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "near"), ["hub", "rep"])
    open_ = open_.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    held = open_.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("most < n")
    open_ = open_.join(held, "key").select("key", "i", "rep", "near", "component", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("blocks"))
    outside = open_.where("component <> main").select("main", "rep").distinct().groupBy("main").agg(F.ceil(F.count("*") / HELD).alias("groups"))
    open_ = tables.table(open_.join(outside, "main").join(nodes, "rep"), "open")
    # Those outside the main component are dealt out in blocks; the whole bucket meets each block.
    x = open_.where("component <> main").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("x")
    y = open_.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("y")
    both = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    s_ = percent / 100
    chance = (1 - s_) * 15 / 16  # that a value of two sets at the threshold differs in its four bits
    most = 16 * SKETCH_LONGS * chance + SURE * (16 * SKETCH_LONGS * chance * (1 - chance)) ** 0.5
    ok = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    ok = ok & (100 * F.least(*both("n_shingles")) >= percent * F.greatest(*both("n_shingles")))
    ok = ok & F.coalesce(F.abs(F.col("x.near") - F.col("y.near")) <= 1 - s_ + 1e-9, F.lit(True)) & (sketch_differences(*both("sketch")) <= most)
    # Of several buckets that hold a pair, the first names it.
    ok = ok & (F.array_position(F.zip_with(*both("bands"), lambda p, q: p == q), True) - 1 == F.col("x.i"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & ok)
    pairs = tables.table(pairs.select("x.main", F.pmod(F.xxhash64("x.rep"), F.col("x.groups")).alias("block"), F.col("x.rep").alias("x"), F.col("y.rep").alias("y")), "pairs")
    more = tables.table(links_of(pairs, full, percent), "more")
    tables.drop("nodes", "buckets", "members", "to-hub", "full", "known", "open", "pairs")
    if not more.isEmpty():
        label = components(label.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    out = sets.select("doc_id", "n_shingles", "set_key").join(first, "set_key", "left").join(label, F.col("rep") == F.col("id"), "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
