"""Toxicity: a linear-chain conditional random field tags tokens as toxic or clean.

Token labels are derived from document labels: in a toxic document, a token is labelled toxic if one of its features (the
word, its beginnings) goes with toxic documents far beyond chance. The field has weights for features and for neighbouring
tags and is fitted by gradient ascent on a bounded sample of labelled rows, by hash of the id: at most ``sample_rows``
rows and ``sample_bytes`` bytes, and of its clean rows at most ``clean_per_toxic`` for each toxic one. With two tags,
each token is a 2 x 2 matrix that takes one message to the next. Products of blocks of tokens are made for all blocks of a
batch at once, so a very long text costs few steps more than short ones. Marginals aggregate to a document's score: the sum of their squares stands for the number of
toxic tokens, and a logistic function of its logarithm, fitted on the same sample, is the score. Spans are the tokens whose marginal is at least one half.

Null and empty texts have no tokens; they get the score of a document without toxic tokens. Without any labelled row of
either kind every score is the share of toxic rows (0 if there are none). Repeated rows each get a row; an empty table
gives an empty result. Only id and text of the documents and id and label of the labels are read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, give_back, given_back, id_and_text, kept, slices

#: Labelled rows the field is fitted on at most, and their bytes; clean rows at most for each toxic one.
SAMPLE_ROWS, SAMPLE_BYTES, CLEAN_PER_TOXIC = 4000, 12_000_000, 2.0
BATCH_CHARS = 2_000_000
#: Tokens whose emissions a worker keeps.
REMEMBERED = 250_000
#: Tokens in a block of the messages' scan at most.
LONGEST_BLOCK = 128
STEPS, RATE, RIDGE = 60, 0.3, 1e-3
#: Training sequences are cut after so many tokens (all tokens are used); marginals are made of so many sequences at once.
SEQUENCE, AT_ONCE = 200, 500
#: Evidence, in nats, that a feature must give before it labels tokens.
EVIDENCE = 11.0
#: A toxic document of which more than this share of five-word runs stood in others is a copy and labels nothing.
COPIED = 0.2
_STRIP = ".,;:!?\"'()[]{}«»…-*|"


def features(token: str) -> list[str]:
    """Of a token as it stands in lower-cased text: the word without punctuation around it, and its beginnings."""
    w = token.strip(_STRIP)
    return ["=" + w, *[f"{w[:k]}^" for k in (4, 5, 6) if len(w) >= k]] if w else []


@dataclass
class Field:
    weights: dict[str, float]
    bias: float
    #: Potential of a tag after a tag: clean-clean, clean-toxic, toxic-clean, toxic-toxic.
    after: tuple[float, float, float, float]
    #: The score is a logistic function of the logarithm of a document's evidence.
    slope: float
    level: float

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))


def marginals(emission: np.ndarray, ends: np.ndarray, after: tuple[float, float, float, float]) -> np.ndarray:
    """P(toxic) of each token. ``emission``: log odds of the tokens of all sequences; ``ends``: where each ends, none empty."""
    n, size = len(emission), np.diff(np.append(0, ends))
    if not n:
        return np.empty(0)
    width = int(np.clip(n // len(size), 8, LONGEST_BLOCK))
    per = -(-size // width)  # blocks of each sequence
    sequence = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(sequence)) - np.repeat(np.cumsum(per) - per, per)
    at = (np.append(0, ends[:-1])[sequence] + nth * width)[:, None] + np.arange(width)
    inside = at < np.asarray(ends)[sequence][:, None]
    at = np.minimum(at, n - 1)
    first = np.zeros(n, bool)
    first[np.append(0, ends[:-1])] = True
    odds, t = np.exp(np.clip(emission, -30, 30)), np.exp(np.asarray(after))
    # A token's matrix: (clean, toxic) <- ((a, b), (c, d)); the first of a sequence has no tag before it, padding does nothing.
    begins, o = first[at], odds[at]
    a, b = np.where(inside & ~begins, t[0], 1.0), np.where(inside & ~begins, t[2], 0.0)
    c, d = np.where(inside & ~begins, o * t[1], 0.0), np.where(inside, np.where(begins, o, o * t[3]), 1.0)
    blocks = len(sequence)
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(width):  # the product of each block
        p, q, r, s = a[:, k] * p + b[:, k] * r, a[:, k] * q + b[:, k] * s, c[:, k] * p + d[:, k] * r, c[:, k] * q + d[:, k] * s
        most = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / most, q / most, r / most, s / most
    before, behind = np.ones((blocks, 2)), np.ones((blocks, 2))  # the messages that enter a block from either side
    by = np.argsort(nth, kind="stable")
    steps = np.split(by, np.cumsum(np.bincount(nth))[:-1])
    for x in steps[1:]:  # from one block of a sequence to the next
        u, v = before[x - 1, 0], before[x - 1, 1]
        y = np.stack((p[x - 1] * u + q[x - 1] * v, r[x - 1] * u + s[x - 1] * v), 1)
        before[x] = y / y.max(1, keepdims=True)
    for x in steps[:0:-1]:
        u, v = behind[x, 0], behind[x, 1]
        y = np.stack((p[x] * u + r[x] * v, q[x] * u + s[x] * v), 1)
        behind[x - 1] = y / y.max(1, keepdims=True)
    ratio = np.empty((blocks, width))
    u = before[:, 1] / before[:, 0]
    for k in range(width):
        u = (c[:, k] + d[:, k] * u) / (a[:, k] + b[:, k] * u)
        ratio[:, k] = u
    u = behind[:, 1] / behind[:, 0]
    for k in range(width - 1, -1, -1):
        ratio[:, k] *= u
        u = (b[:, k] + d[:, k] * u) / (a[:, k] + c[:, k] * u)
    both = ratio[inside]
    return both / (1 + both)


def _transitions(emission: np.ndarray, m: np.ndarray, first: np.ndarray, after: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Expected counts of the four tag pairs, by differences of the log partition function."""
    out = np.zeros(4)
    base = _log_partition(emission, ends, after)
    for k in range(4):
        step = after.copy()
        step[k] += 1e-3
        out[k] = (_log_partition(emission, ends, step) - base) / 1e-3
    return out


def _log_partition(emission: np.ndarray, ends: np.ndarray, after: np.ndarray) -> float:
    size = np.diff(np.append(0, ends))
    by = np.argsort(-size, kind="stable")
    begin, length = (ends - size)[by], size[by]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    zero = np.zeros(len(size))
    one = emission[begin[: len(size)]].copy()
    for t in range(1, steps):
        n = active[t]
        a = np.logaddexp(zero[:n] + after[0], one[:n] + after[2])
        b = np.logaddexp(zero[:n] + after[1], one[:n] + after[3]) + emission[begin[:n] + t]
        zero[:n], one[:n] = a, b
    return float(np.logaddexp(zero, one).sum())


def label_features(texts: list[str], toxic: np.ndarray, copied: float = COPIED) -> set[str]:
    """Features that go with toxic documents far beyond chance."""
    seen, hits = Counter(), Counter()
    runs: set[int] = set()
    for text, y in zip(texts, toxic):
        if y:
            words = text.lower().split()
            own = {hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))}
            if len(own & runs) <= copied * len(own):  # else its words would count again and again
                hits.update({f for w in set(words) for f in features(w)})
            runs |= own
    least = EVIDENCE / -np.log(max(1e-6, toxic.mean()))  # fewer toxic documents can't give the evidence
    hits = {f: n for f, n in hits.items() if n >= least}
    for text, y in zip(texts, toxic):
        if not y:
            seen.update(f for w in set(text.lower().split()) for f in features(w) if f in hits)
    base = max(1e-6, toxic.mean())
    out = set()
    for f, n in hits.items():
        total = n + seen[f]
        p = min(n / total, 1 - 1e-9)
        if p >= 0.5 and total * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base) if base < 1 else 1)) >= EVIDENCE:
            out.add(f)
    return out


def fit(texts: list[str], toxic: list[int], steps: int = STEPS, clean_per_toxic: float = CLEAN_PER_TOXIC, copied: float = COPIED) -> Field:
    """The field from whole labelled texts; ``toxic`` is 0 or 1 for each. Tags are learned from the toxic texts and from
    the first of the clean ones, ``clean_per_toxic`` for each toxic one; features and calibration use all texts."""
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return Field({}, -20.0, (0.0, 0.0, 0.0, 0.0), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    marked = label_features(texts, y, copied)
    # All tokens of the documents, cut into sequences.
    clean = np.flatnonzero(y == 0)[: int(y.sum() * clean_per_toxic)]
    words: dict[str, int] = {}
    ids, tags, ends = array("l"), array("d"), array("l")
    hit: list[bool] = []
    for d in np.append(np.flatnonzero(y == 1), clean).tolist():
        tokens = texts[d].lower().split()
        for k, w in enumerate(tokens):
            if w not in words:
                words[w] = len(words)
                hit.append(any(f in marked for f in features(w)))
            ids.append(words[w])
            tags.append(float(y[d] and hit[words[w]]))
            if k % SEQUENCE == SEQUENCE - 1 or k == len(tokens) - 1:
                ends.append(len(ids))
    ids_, tags_, ends_ = np.array(ids), np.array(tags), np.array(ends)
    kept = sorted({f for w, k in words.items() if hit[k] for f in features(w)})
    number = {f: k for k, f in enumerate(kept)}
    rows = [(k, number[f]) for w, k in words.items() for f in features(w) if f in number]
    word, feature = (np.array(x, int) for x in zip(*rows)) if rows else (np.empty(0, int), np.empty(0, int))
    count = np.bincount(ids_, minlength=len(words)).astype(float)
    seen = np.bincount(ids_, weights=tags_, minlength=len(words))
    weights, bias, after = np.array([3.0 if f in marked else 0.0 for f in kept]), -9.0, np.zeros(4)
    first = np.zeros(len(ids_), bool)
    first[np.append(0, ends_[:-1])] = True
    pair = (2 * tags_[:-1] + tags_[1:])[~first[1:]].astype(int)
    observed = np.bincount(pair, minlength=4).astype(float)
    scale = [np.zeros(len(kept)), 0.0, np.zeros(4)]
    for step in range(steps):
        level = bias + np.bincount(word, weights=weights[feature], minlength=len(words))
        emission = level[ids_]
        m = np.empty(len(ids_))
        for k in range(0, len(ends_), AT_ONCE):
            a, b = ends_[k - 1] if k else 0, ends_[min(k + AT_ONCE, len(ends_)) - 1]
            m[a:b] = marginals(emission[a:b], ends_[k : k + AT_ONCE] - a, tuple(after))
        lack = seen - np.bincount(ids_, weights=m, minlength=len(words))
        gradient = [np.bincount(feature, weights=lack[word], minlength=len(kept)) - RIDGE * len(ends_) * weights, float(lack.sum()), np.zeros(4)]
        if step % 4 == 0:
            gradient[2] = observed - _transitions(emission, m, first, after, ends_) - RIDGE * len(ends_) * after
        for k, g in enumerate(gradient):
            scale[k] = scale[k] + np.square(g)
        weights = weights + RATE * 3 * gradient[0] / np.sqrt(scale[0] + 1e-9)
        bias += RATE * gradient[1] / np.sqrt(scale[1] + 1e-9)
        after = after + RATE * gradient[2] / np.sqrt(scale[2] + 1e-9)
    field = Field({f: round(float(w), 6) for f, w in zip(kept, weights)}, float(bias), tuple(map(float, after)), 1.0, 0.0)
    del words, hit, ids, tags
    expected = np.array([evidence(m) for a, b in by_bytes(list(map(len, texts)), 500_000) for m in tag(field, texts[a:b])])
    x = np.log(expected + 1e-3)
    mean, spread = x.mean(), x.std() or 1.0
    z, a, b = (x - mean) / spread, 0.0, 0.0
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        each = np.full(len(y), 1 / len(y))
        g = np.array([(each * (y - p) * z).sum() - 1e-3 * a, (each * (y - p)).sum()])
        h = each * p * (1 - p)
        hessian = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        a, b = np.array([a, b]) + np.linalg.solve(hessian, g)
    return Field(field.weights, field.bias, field.after, float(a / spread), float(b - a * mean / spread))


class _Levels(dict):
    """Emissions of the tokens met so far."""

    def __init__(self, field: Field) -> None:
        self.field = field

    def __missing__(self, token: str) -> float:
        x = self[token] = self.field.emission(token)
        return x


def _levels_of(field: Field) -> _Levels:
    """Those of the field that this worker last worked with."""
    found = kept("toxicity", lambda: _Levels(field))
    if found.field != field:
        found.clear()
        found.field = field
    if len(found) > REMEMBERED:
        found.clear()
    return found


def tag(field: Field, texts: list[str], levels: dict[str, float] | None = None) -> list[np.ndarray]:
    """Marginals of the tokens of each text."""
    levels = levels if levels is not None else _Levels(field)
    out: list[np.ndarray] = []
    for a, b in by_bytes(list(map(len, texts)), BATCH_CHARS):
        words = [t.lower().split() for t in texts[a:b]]
        size = np.fromiter(map(len, words), np.int64, b - a)
        emission = np.concatenate([np.fromiter(map(levels.__getitem__, w), float, len(w)) for w in words])
        full = size > 0
        m = marginals(emission, np.cumsum(size[full]), field.after)
        out += np.split(m, np.cumsum(size)[:-1])
    return out


def evidence(m: np.ndarray) -> float:
    """Sum of squared marginals: near the expected number of toxic tokens where those are certain, and next to nothing
    for the faint marginals of many clean tokens."""
    return float(np.square(m).sum())


def score(field: Field, expected: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(field.slope * np.log(expected + 1e-3) + field.level, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, clean_per_toxic: float = CLEAN_PER_TOXIC, copied: float = COPIED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field:
    """Fit the field on a bounded sample of the labelled rows; ``labels``: a row for each labelled document. Rows are taken
    by hash of the id; those of an id whose texts would bring the sample beyond ``sample_bytes`` or ``sample_rows`` are passed
    over, and those after it still get in. A toxic row of whose five-word runs more than ``copied`` stood in rows before it
    is a copy and labels no tokens."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    own = id_and_text(docs, id_col, text_col)
    # Numbers only are ordered: an id, its rows and their bytes, for at most sample_rows labels.
    sizes = own.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.xxhash64("doc_id").alias("h"))
    picked, rows, total = [], 0, 0
    for r in sorted(sizes.collect(), key=lambda r: (r.h, r.doc_id)):
        if rows + r.n <= sample_rows and total + r.bytes <= sample_bytes:
            picked.append(r.doc_id)
            rows, total = rows + r.n, total + r.bytes
    if not picked:
        return fit([], [], clean_per_toxic=clean_per_toxic, copied=copied)
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id long")
    place = {i: k for k, i in enumerate(picked)}
    found = own.join(F.broadcast(ids), "doc_id").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").collect()
    found = sorted((place[r.doc_id], r.text, r.y) for r in found)
    field = fit([text for _, text, _ in found], [y for *_, y in found], clean_per_toxic=clean_per_toxic, copied=copied)
    del found
    give_back()  # the driver's Python lives on beside all that follows
    return field


def toxicity(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, n_toxic (tokens with a marginal of one half or more), expected (sum of squared marginals), spans
    (start:end of those tokens in code points, comma-joined)."""
    import re

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, BATCH_CHARS):
            levels = _levels_of(field)
            texts = batch.column(1).to_pylist()
            found = tag(field, texts, levels)
            expected = np.array([evidence(m) for m in found])
            hits = [np.flatnonzero(m >= 0.5) for m in found]
            places = [""] * len(texts)
            for k, h in enumerate(hits):
                if len(h):
                    words = [(x.start(), x.end()) for x in re.finditer(r"\S+", texts[k])]
                    places[k] = ",".join(f"{words[i][0]}:{words[i][1]}" for i in h.tolist() if i < len(words))
            yield pa.record_batch([batch.column(0), pa.array(score(field, expected)), pa.array([len(h) for h in hits], pa.int64()), pa.array(expected), pa.array(places, pa.string())], ["doc_id", "score", "n_toxic", "expected", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(given_back(run), "doc_id long, score double, n_toxic long, expected double, spans string")


def clean(docs: DataFrame, field: Field, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with all their columns, without the rows whose text scores ``least`` or more. Each row is judged by its own
    text, so rows without an id and rows that repeat one are no different; nothing is shuffled. A null text scores as an
    empty one."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place, BATCH_CHARS):
            found = tag(field, [x or "" for x in batch.column(place).to_pylist()], _levels_of(field))
            yield batch.filter(pa.array(score(field, np.array([evidence(m) for m in found])) < least))

    return docs.mapInArrow(given_back(run), docs.schema)


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for rows that training must not see."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
