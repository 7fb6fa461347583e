"""Benchmark decontamination by the q-gram lemma.

A passage of m characters that survives in a document with at most k edits shares at least m + 1 - q - k q of its
q-grams, all on diagonals that differ by at most k. So shared q-grams are counted in bands of 2 (k + 1) diagonals that
overlap by half: every such passage fills one. Bands that reach the bound are regions, and an alignment of just their
diagonals decides whether a region holds the item within its edits. Text is compared lower-cased, with any white space as one blank.

Items are a stated query set: they travel to the tasks in blocks of at most ``block_chars`` characters, each block
against all documents, so no join or shuffle of documents is needed. Items of fewer than q characters have no q-gram;
they match verbatim, as words of their own: no letter, digit or underscore goes on at either end. Items without any
character but white space match nothing. Null and empty texts match nothing; repeated rows each give their matches; empty tables give an empty
result. Of the documents only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, given_back, id_and_text, without

Q, RATE = 8, 0.10
#: Characters of items in one block; its tables take about 40 bytes for each.
BLOCK_CHARS = 4_000_000
BATCH_CHARS = 1_500_000
#: Pairs of a place in a text and a place in an item that are held at once, and cells of alignments.
PRODUCTS, CELLS = 4_000_000, 1_000_000
_FILTER_BITS = 23
_BASE = 0x9E3779B97F4A7C15


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q codepoints: runs of twice the length from two of the length, then by q's binary digits."""
    x, size, out, have = points.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    while True:
        if q & size:
            out = x[:n].copy() if out is None else out * power(size) + x[have : have + n]
            have += size
        if 2 * size > q:
            break
        x = x[:-size] * power(size) + x[size:]
        size *= 2
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def budget(length: int, q: int, rate: float) -> int:
    """Edits allowed: ``rate`` of the length, and few enough for the lemma's bound to be at least 1."""
    return max(0, min(int(rate * length), (length - q) // q))


def aligned(item: np.ndarray, text: np.ndarray, first: np.ndarray, width: int, k: int) -> list[tuple[int, int, int]]:
    """The best (edits, start, end) of all of ``item`` in ``text`` within at most k edits, in each of some bands of ``width``
    diagonals (place in the text less place in the item) that begin at ``first``; bands without any are left out.

    A row of cells for each character of the item, for all bands at once; begin and end in the text are free."""
    n, out = len(text), []
    step, far = n + 2, k + 2  # cost and begin are one number, so that minima carry the begin with them
    many = max(1, CELLS // width)
    for part in range(0, len(first), many):
        place = first[part : part + many, None] + np.arange(width)
        pack = np.where((place >= 0) & (place <= n), np.maximum(place, 0), far * step)
        insert = np.arange(width) * step
        for c in item:
            inside = (place >= 0) & (place < n)
            down = np.where(inside, pack + (text[np.clip(place, 0, n - 1)] != c) * step, far * step)
            down[:, :-1] = np.minimum(down[:, :-1], pack[:, 1:] + step)
            place += 1
            down[(place < 0) | (place > n)] = far * step
            pack = np.minimum(np.minimum.accumulate(down - insert, axis=1) + insert, far * step)
            pack[place > n] = far * step
            live = pack.min(axis=1) < (k + 1) * step
            if not live.all():
                pack, place = pack[live], place[live]
                if not len(pack):
                    break
        for row, at in zip(pack, place):
            d = int(np.argmin(row))
            out.append((int(row[d]) // step, int(row[d]) % step, int(at[d])))
    return [x for x in out if x[0] <= k]


class Items:
    """A block of items with the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float) -> None:
        self.q = q
        self.short: dict[int, dict[str, list[int]]] = {}
        for i, t in items:
            if 0 < len(t) < q:
                self.short.setdefault(len(t), {}).setdefault(t, []).append(i)
        found = [(i, t, np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for i, t in items if len(t) >= q]
        self.ids, self.texts, self.points = [x[0] for x in found], [x[1] for x in found], [x[2] for x in found]
        length = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([budget(n, q, rate) for n in length.tolist()], np.int64)
        self.least = length + 1 - q - self.edits * q
        every = [grams(p, q) for p in self.points]
        gram = np.concatenate(every) if every else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(every)), [len(g) for g in every]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for g in every]) if every else np.empty(0, np.int64)
        by = np.argsort(gram, kind="stable")
        self.gram, self.first = np.unique(gram[by], return_index=True)
        self.item, self.place = item[by], place[by]
        self.count = np.diff(np.append(self.first, len(gram)))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.gram >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def short_matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(index of the text, item_id, start, end) of the first place of each item of fewer than q characters."""
        if not self.short or not texts:
            return []
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        inner = lambda c: c.isalnum() or c == "_"
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for n, known in self.short.items():
            own = np.sort(np.concatenate([grams(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), n) for t in known]))
            hashes = grams(points, n)
            at = np.flatnonzero(own[np.minimum(np.searchsorted(own, hashes), len(own) - 1)] == hashes)
            for d, a in zip((np.searchsorted(starts, at, side="right") - 1).tolist(), at.tolist()):
                a -= int(starts[d])
                text, b = texts[d], a + n
                t = text[a:b]
                if t not in known or a and inner(t[0]) and inner(text[a - 1]) or b < len(text) and inner(t[-1]) and inner(text[b]):
                    continue
                for i in known[t]:
                    out.setdefault((d, i), (a, b))
        return [(*k, *v) for k, v in out.items()]

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(index of the text, index of the item, edits, start, end) for each text and item that match."""
        if not len(self.gram) or not texts:
            return []
        points = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        hashes = grams(points, self.q)
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.gram, hashes[at]), len(self.gram) - 1)
        same = self.gram[k] == hashes[at]
        at, k = at[same], k[same]
        if not len(at):
            return []
        # Shared q-grams by text, item and band; a q-gram that many items have is multiplied out in parts.
        longest = int(np.diff(starts).max()) + 2 * int(self.edits.max() + 1) + 2
        total = np.cumsum(self.count[k])
        cuts = np.searchsorted(total, np.arange(0, total[-1], PRODUCTS), side="right")
        tallies = [self._tally(at[a:b], k[a:b], starts, longest) for a, b in zip(cuts, np.append(cuts[1:], len(at))) if a < b]
        key, where = np.unique(np.concatenate([x for x, _ in tallies]), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([x for _, x in tallies])).astype(np.int64)
        lone = np.append(True, key[1:] != key[:-1] + 1)  # the band before holds no q-gram, but the rest of the passage may lie there
        key, count = np.append(key, key[lone] - 1), np.append(count, np.zeros(lone.sum(), np.int64))
        by = np.argsort(key)
        key, count = key[by], count[by]
        both = count + np.where(np.append(key[1:] == key[:-1] + 1, False), np.append(count[1:], 0), 0)
        owner = key // longest
        good = both >= self.least[owner % len(self.ids)]
        out = []
        pairs, first = np.unique(owner[good], return_index=True)
        bands = np.split((key[good] % longest).astype(np.int64), first[1:])
        for p, own in zip(pairs.tolist(), bands):
            d, j = divmod(p, len(self.ids))
            w, m = int(self.edits[j]) + 1, len(self.points[j])
            diagonal = (own - 2) * w
            if (exact := texts[d].find(self.texts[j], max(0, int(diagonal[0])), int(diagonal[-1]) + 2 * w + m)) >= 0:
                out.append((d, j, 0, exact, exact + m))
            elif found := aligned(self.points[j], points[starts[d] : starts[d + 1] - 1], diagonal, 2 * w, w - 1):
                out.append((d, j, *min(found)))
        return out

    def _tally(self, at: np.ndarray, k: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of each text, item and band in which places ``at`` of texts hold the q-grams ``k``, and how often."""
        n = self.count[k]
        entry = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        item = self.item[entry]
        text = np.searchsorted(starts, at, side="right") - 1
        width = self.edits[item] + 1
        diagonal = at - starts[text] - self.place[entry] + 2 * width  # so that bands begin at 1 and have one before them
        return np.unique((text * len(self.ids) + item) * longest + np.maximum(diagonal // width, 1), return_counts=True)


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that match: doc_id, item_id, edits, start, end (in the normal form of the text;
    the best match, the first of equals), allowed (edits)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    rows = id_and_text(docs, id_col, text_col)

    def against(block: int) -> DataFrame:
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        listed = [(r.item_id, normal(r.text)) for r in mine.orderBy("item_id", "text").toLocalIterator()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items(listed, q, rate)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), list(map(normal, batch.column(1).to_pylist()))
                found = [(ids[a + d], own.ids[j], e, s, t, int(own.edits[j])) for a, b in by_bytes(list(map(len, texts)), BATCH_CHARS) for d, j, e, s, t in own.matches(texts[a:b])]
                found += [(ids[a + d], i, 0, s, t, 0) for a, b in by_bytes(list(map(len, texts)), BATCH_CHARS) for d, i, s, t in own.short_matches(texts[a:b])]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*found) if found else [[]] * 6, kinds)], ["doc_id", "item_id", "edits", "start", "end", "allowed"])

        return rows.mapInArrow(given_back(run), "doc_id long, item_id long, edits int, start int, end int, allowed int")

    return reduce(DataFrame.union, map(against, range(blocks)))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with all their columns, without those that hold an item. Rows without an id stay: no match
    can name them."""
    return without(docs, contaminated(docs, benchmark, id_col=id_col, **options).select("doc_id"), id_col)
