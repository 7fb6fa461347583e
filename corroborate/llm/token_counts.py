"""Token counts: Arrow functions return lengths only.

Texts go to the tokenizer library in batches balanced by bytes, cut at safe boundaries: places where a byte-level
pre-tokeniser always begins a new pre-token, so that the library gives the same tokens for the pieces as for the whole.
Those are a single blank or line end between two characters that are not white space, and a comma, full stop or other
mark right after an ASCII letter. Cuts are found in the bytes of a whole batch at once. Pieces repeat a lot: Arrow numbers
the different ones of a batch, each worker process keeps the ids of those it met in a bounded table, and the library sees
each new piece once, many of them in one string. A text longer than a batch is worked on in parts of about a batch.

Nulls count as empty texts (0 tokens); repeated rows each give a row; an empty table gives an empty result. Other
columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import by_bytes, id_and_text, kept

#: Bytes of text that are worked on together.
BATCH_BYTES = 4_000_000
#: Pieces each worker process keeps, and their bytes.
KEPT_PIECES, KEPT_BYTES = 600_000, 20_000_000
#: Characters of new pieces in one string for the library.
ASK_CHARS = 50_000
#: Marks that begin a pre-token after a letter.
_MARKS = np.isin(np.arange(256), list(b",.!?;:"))
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: ASCII white space; separators 28 to 31 are taken for it too, since not to cut is always safe.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])


def safe_cuts(data: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
    """For each of some UTF-8 bytes, whether a piece may begin there; ``begins``: where texts do."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        at = np.flatnonzero((data[1:-1] == 32) | (data[1:-1] == 10)) + 1
        before, after = data[at - 1], data[at + 1]
        safe = ~(_BLANK[before] | _BLANK[after])
        if data.max() >= 0x80:  # white space of several bytes begins with C2 or E1 to E3: any such character next to it is doubt enough
            third = data[np.maximum(at - 3, 0)]
            safe &= ~((after == 0xC2) & np.isin(data[np.minimum(at + 2, n - 1)], [0x85, 0xA0]) | (after >= 0xE1) & (after <= 0xE3))
            safe &= ~((before == 0x85) | (before == 0xA0) | (before >= 0x80) & (third >= 0xE1) & (third <= 0xE3))
        cut[at[safe]] = True
        mark = np.flatnonzero(_MARKS[data[1:]]) + 1
        cut[mark[_LETTER[data[mark - 1]]]] = True
    if begins is not None:
        cut[begins] = True
    return cut


@cache
def library(path: str) -> tuple:
    """(function from texts to lists of ids, special strings recognised in texts); loaded once for each worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), ()
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = tuple(x.content for x in own.get_added_tokens_decoder().values())
    return (lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]), special


@cache
def vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def is_byte_level(path: str) -> bool:
    """True if pieces can be encoded on their own: byte-level pre-tokens without normaliser or added prefix space."""
    if path.endswith(".model"):
        return False
    x = vocabulary(path)
    before = x.get("pre_tokenizer") or {}
    plain = all(not t.get(k) for t in x.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not x.get("normalizer")


class Pieces:
    """Ids of the pieces met so far: piece -> number; of each number the place and count of its ids."""

    def __init__(self, path: str) -> None:
        self.encode, self.special = library(path)
        known = vocabulary(path)["model"]["vocab"]
        self.width = np.zeros(max(known.values()) + 1, np.int64)  # bytes of each id: its string has a character for each
        self.width[list(known.values())] = list(map(len, known))
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes = 0
        self.ids, self.start, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Ask the library for new pieces: those of one word with a blank or line end before it, many in one string; cut
        the ids by the bytes they stand for. All others one by one."""
        words, rest = [], []
        for x in new:
            (words if x[:1] in b" \n" and len(x.split()) == 1 and x[1:2].strip() else rest).append(x)
        sizes = list(map(len, words))
        groups = [words[a:b] for a, b in by_bytes(sizes, ASK_CHARS)]
        asked = [b"".join(g) for g in groups]
        got = self.encode([x.decode() for x in asked]) if asked else []
        lists: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for g, x, ids in zip(groups, asked, got):
            own = np.array(ids, np.uint32)
            ends = np.cumsum(self.width[own])
            cuts = np.cumsum(list(map(len, g)))
            last = np.searchsorted(ends, cuts)
            if len(own) and ends[-1] == len(x) and (ends[last] == cuts).all():
                lists.append(own)
                counts.append(np.diff(np.append(-1, last)))
            else:
                each = [np.array(y, np.uint32) for y in self.encode([y.decode() for y in g])]
                lists += each
                counts.append(np.array(list(map(len, each))))
        for a, b in by_bytes(list(map(len, rest)), ASK_CHARS * 10):
            each = [np.array(y, np.uint32) for y in self.encode([y.decode() for y in rest[a:b]])]
            lists += each
            counts.append(np.array(list(map(len, each)), np.int64))
        self.number.update(zip(words + rest, range(len(self.number), len(self.number) + len(new))))
        self.bytes += sum(map(len, new))
        count = np.concatenate(counts).astype(np.int64)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, *lists))

    def of(self, data: np.ndarray, ends: np.ndarray, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Texts as bytes in a row, each ending at one of ``ends``: tokens of each, and the ids of all."""
        if len(self.number) > KEPT_PIECES or self.bytes > KEPT_BYTES:
            self.clear()
        begins = np.append(0, ends[:-1])
        starts = np.flatnonzero(safe_cuts(data, begins[begins < ends]))  # empty texts have no piece
        if not len(starts):
            return np.zeros(len(ends), np.int64), np.empty(0, np.uint32)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        different = pieces.dictionary.to_pylist()
        if new := [x for x in different if x not in self.number]:
            self.learn(new)
        number = np.fromiter(map(self.number.__getitem__, different), np.int64, len(different))[pieces.indices.to_numpy()]
        count = self.count[number]
        total = np.append(0, np.cumsum(count))
        tokens = np.diff(total[np.searchsorted(starts, np.append(0, ends))])
        if not with_ids:
            return tokens, None
        return tokens, self.ids[np.repeat(self.start[number] - total[:-1], count) + np.arange(total[-1])]


def _parts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts of ``most`` bytes, each as much longer as the next safe cut asks."""
    at = 0
    while len(data) - at > most:
        cut, step = 0, 1 << 16
        while not cut and at + most + step // 2 < len(data):
            near = np.flatnonzero(safe_cuts(data[at + most - 4 : at + most + step]))
            near = near[(near > 3) & (near < step)]  # what stands at the window's ends isn't known whole
            cut, step = int(near[0]) if len(near) else 0, step * 4
        if not cut:
            break
        yield data[at : at + most - 4 + cut]
        at += most - 4 + cut
    yield data[at:]


def encoded(column: pa.Array, path: str, batch_bytes: int = BATCH_BYTES, with_ids: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """Texts a to b of a column without nulls: (a, b, tokens of each, ids of all), batch by batch."""
    sizes = pc.binary_length(column).to_pylist()
    encode, special = library(path)
    if not is_byte_level(path):  # no boundary is safe for every such model: whole texts
        for a, b in by_bytes(sizes, batch_bytes):
            yield a, b, *_whole(encode(column.slice(a, b - a).to_pylist()))
        return
    own = kept(("pieces", path), lambda: Pieces(path))
    for a, b in by_bytes(sizes, batch_bytes):
        part = column.slice(a, b - a)
        if any(pc.any(pc.match_substring(part, s)).as_py() for s in special):  # the library cuts at them itself
            yield a, b, *_whole(encode(part.to_pylist()))
            continue
        offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + b - a + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if len(data) <= batch_bytes:
            yield a, b, *own.of(data, offsets[1:] - offsets[0], with_ids)
        else:
            got = [own.of(x, np.array([len(x)]), with_ids) for x in _parts(data, batch_bytes)]
            yield a, b, sum(n for n, _ in got), np.concatenate([x for _, x in got]) if with_ids else None


def _whole(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(map(len, lists)), np.int64), np.array([x for y in lists for x in y], np.uint32)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens (without special tokens), over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n, _ in encoded(batch.column(1), tokenizer_path, batch_bytes, with_ids=False):
                size = pc.binary_length(batch.column(1).slice(a, b - a)).cast(pa.int64())
                yield pa.record_batch([batch.column(0).slice(a, b - a), size, pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
