"""Byte-level BPE encoding and decoding by a rank file.

Pre-tokenisation runs without regex over arrays of all codepoints of a batch. Each codepoint has a class (letter, number,
white space, other). As a transition function on "where the current run began", a codepoint that changes the class
(or begins a text) is constant, any other is the identity; such functions compose associatively, and a running maximum
composes them for all prefixes at once. Where pre-tokens begin then follows from the run starts and the neighbouring
classes. The slices feed a bounded table of merged pieces, so pair merging runs once for each new piece. Offsets of the
vocabulary's bytes are kept, and decoding gathers bytes through them, again for a whole batch at once.

Null texts count as empty: no ids, empty bytes. Repeated rows each give a row; an empty table gives an empty result.
Other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .shared import by_bytes, given_back, id_and_text, kept, slices

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Characters encoded at once; bounds the arrays.
BATCH_CHARS = 1_000_000
REMEMBERED, LONGEST_REMEMBERED = 500_000, 64
#: The code points that Unicode calls white space.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]
#: The endings after an apostrophe that are one pre-token with it.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_QUOTE, _BLANK = ord("'"), ord(" ")


@cache
def classes() -> np.ndarray:
    """The class of each codepoint. The character database is the tiktoken library's own, asked once for each worker
    (with one id for each byte, it returns the bytes of all that is in a category); texts themselves meet no regex."""
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    every = points[(points < 0xD800) | (points > 0xDFFF)].tobytes().decode("utf-32-le")
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        ask = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([x]): x for x in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(ask.encode_ordinary(every)).decode("utf-8").encode("utf-32-le"), np.uint32)] = kind
    out[WHITE_SPACE] = SPACE
    return out


def pretoken_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sorted positions at which pre-tokens begin. ``points``: codepoints of all texts; ``first``: True where a text begins."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes()[points]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    where = np.arange(n)
    run = np.maximum.accumulate(np.where(change, where, 0))  # the scan: where the run around each codepoint began
    last = np.append(change[1:], True)  # of its run
    text_end = np.append(first[1:], True)
    before_blank = np.zeros(n, bool)  # the codepoint before is a blank of the same text
    before_blank[1:] = (points[:-1] == _BLANK) & ~first[1:]
    space = kind == SPACE
    start = change & ~(before_blank & ~space)  # a blank belongs to what follows it
    start |= space & last & ~text_end & (run < where)  # of several white spaces, the last stands apart before a word
    # a blank that ends its run begins the next pre-token, whatever stood before it: both cases above cover it
    quote = np.flatnonzero((points == _QUOTE) & change & last & ~before_blank & ~text_end)
    for ending in ENDINGS:
        at = quote[quote + len(ending) < n]
        for k, c in enumerate(ending, 1):
            at = at[(points[at + k] == ord(c)) & ~first[at + k]]
        start[at + 1] = False
        after = at + 1 + len(ending)
        start[after[after < n]] = True
        if not len(quote):
            break
        quote = np.setdiff1d(quote, at, assume_unique=True)
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of a file, a bounded table of merged pieces, and offsets into the bytes of all tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.known: dict[bytes, bytes] = {}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers: always the pair of least rank, leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        parts = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) > 100:
            parts = self._merge_long(parts)
        else:
            none = 1 << 30
            pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            while pair and (least := min(pair)) < none:
                i = pair.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pair[i]
                if i:
                    pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
                if i < len(pair):
                    pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        return b"".join([ranks[p].to_bytes(4, "little") for p in parts])

    def _merge_long(self, parts: list[bytes]) -> list[bytes]:
        """The same with a heap and links, for long pieces."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := ranks.get(x := parts[i] + parts[after[i]])) is not None:
                heappush(heap, (r, i, x))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x = heappop(heap)
            if not parts[i] or after[i] >= n or parts[i] + parts[after[i]] != x:
                continue
            j = after[i]
            parts[i], parts[j] = x, b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        joined = "".join(texts)
        data = joined.encode("utf-8")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(points):
            return [b""] * len(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        first = np.zeros(len(points) + 1, bool)
        first[0] = True
        first[ends] = True
        starts = pretoken_starts(points, first[:-1])
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        cuts = at[np.append(starts, len(points))].tolist()
        pieces = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = set(pieces).difference(known)
        known.update((x, self.merge(x)) for x in new)
        ids = list(map(known.__getitem__, pieces))
        for x in new:
            if len(x) > LONGEST_REMEMBERED:
                del known[x]
        bounds = [0, *np.searchsorted(starts, ends).tolist()]
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids."""
        own = np.frombuffer(b"".join(ids), "<u4")
        size = self.length[own]
        ends = np.cumsum(size)
        gather = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offset[own] - (ends - size), size)
        data = self.bytes[gather].tobytes()
        stops = np.append(0, ends)[np.append(0, np.cumsum([len(x) // 4 for x in ids]))].tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:])]


def vocabulary(path: str) -> Vocabulary:
    return kept(("ranks", path), lambda: Vocabulary(path))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(ranks_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in by_bytes(list(map(len, texts)), BATCH_CHARS):
                ids = own.encode(texts[a:b])
                ends = np.append(0, np.cumsum([len(x) // 4 for x in ids])).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, decoded binary. Null ids count as none."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(ranks_path)
        for batch in batches:
            ids = [np.asarray(x, "<u4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(own.decode(ids), pa.binary())], ["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids. Per row: doc_id, n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded bytes), both lowercase hex. Ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(ranks_path)
        for batch in slices(batches, 1, BATCH_CHARS):
            ids = own.encode(batch.column(1).to_pylist())
            out = own.decode(ids)
            hexes = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (ids, out)]
            yield pa.record_batch([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(hexes[0], pa.string()), pa.array(hexes[1], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs, id_col, text_col).mapInArrow(given_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
