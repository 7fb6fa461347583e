"""Boxes against the boxes of the same frame, where pairs are too many to be rows of a join.

Both sides of a frame come sorted to one task, or to several if it has very many boxes. The right side is held as columns,
the left side streams by, and pairs exist only as small tables of numbers: nothing of their number is shuffled or spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]
#: Left boxes of a frame that one task takes, numbers in a table of pairs, and rows of a batch that leaves a task.
OWN, CELLS, ROWS = 4096, 1 << 15, 1 << 17


def rounded(x: np.ndarray) -> np.ndarray:
    """To six digits, half up, by the product: for numbers from 0."""
    scaled = x * 1e6
    low = np.floor(scaled)
    return (low + (scaled - low >= 0.5)) / 1e6


def _spans(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared, union) of each box of ``left`` with each of ``right``, boxes as columns; NaN where a corner is unknown."""
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    w = np.minimum(left[2][:, None], right[2])
    w -= np.maximum(left[0][:, None], right[0])
    h = np.minimum(left[3][:, None], right[3])
    h -= np.maximum(left[1][:, None], right[1])
    shared = np.maximum(w, 0, out=w)
    shared *= np.maximum(h, 0, out=h)
    union = np.add(size(left)[:, None], size(right), out=h)
    union -= shared
    return shared, union


def _iou(shared: np.ndarray, union: np.ndarray) -> np.ndarray:
    some = union > 0
    return np.divide(shared, union, out=shared) if some.all() else np.divide(shared, union, out=np.zeros_like(shared), where=some)


def at_least(least: float) -> Callable:
    """Pairs whose right id is the greater one and whose overlap, rounded, is at least ``least``."""

    def found(ids: np.ndarray, left: np.ndarray, others: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        first = int(np.searchsorted(others, ids[0], "right"))
        if first == len(others):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        shared, union = _spans(left, right[:, first:])
        i, j = np.nonzero(shared >= (least - 1e-6) * union)
        shared, union = shared[i, j], union[i, j]
        iou = rounded(_iou(shared, union))
        keep = (iou >= least) & (others[first:][j] > ids[i])
        return i[keep], j[keep] + first, iou[keep]

    return found


def best(ids: np.ndarray, left: np.ndarray, others: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each left box the right one of the greatest overlap, rounded; the first of equals."""
    iou = _iou(*_spans(left, right))
    i, j = np.nonzero(iou >= iou.max(axis=1)[:, None] - 1e-6)
    iou = rounded(iou[i, j])
    top = np.maximum.reduceat(iou, np.searchsorted(i, np.arange(len(ids))))
    hit = np.flatnonzero(iou == top[i])
    _, first = np.unique(i[hit], return_index=True)
    at = hit[first]
    return i[at], j[at], iou[at]


def by_frame(left: DataFrame, right: DataFrame, key: list[str], a: str, b: str, found: Callable) -> DataFrame:
    """(key, a, b, iou): what ``found`` tells of boxes (key, a, x1 ..) and those (key, b, x1 ..) of the same key, which come by id.

    A key of more than ``OWN`` left boxes is dealt by their ids to several tasks, each of which reads all its right boxes."""
    kinds = dict(left.dtypes)
    names = [*key, a, b, "iou"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, a]) + f", `{b}` {dict(right.dtypes)[b]}, iou double"
    sizes = left.groupBy(*key).agg(F.ceil(F.count("*") / OWN).cast("int").alias("parts"))
    own = left.select(*key, F.lit(1).alias("side"), F.col(a).alias("id"), *BOX).join(sizes, key).withColumn("part", F.pmod(F.hash("id"), "parts"))
    all_ = right.select(*key, F.lit(0).alias("side"), F.col(b).alias("id"), *BOX).join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = own.unionByName(all_).where(F.col("id").isNotNull()).drop("parts").repartition(*key, "part").sortWithinPartitions(*key, "part", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, others, table, out, n = None, [], None, None, [], 0

        def batch() -> pa.RecordBatch:
            places = np.repeat(np.arange(len(out)), [len(o[1]) for o in out])
            of_key = pa.table({c: [o[0][k] for o in out] for k, c in enumerate(key)}, schema=arrow).take(pa.array(places))
            cells = [*of_key.columns, *(pa.chunked_array([pa.array(np.concatenate([o[k] for o in out]))]) for k in (1, 2, 3))]
            return pa.table(dict(zip(names, cells))).combine_chunks().to_batches()[0]

        for b_ in batches:
            arrow = pa.schema([b_.schema.field(c) for c in key])
            of = b_.select([*key, "part", "side"]).to_pandas()
            ids, boxes = b_["id"].to_numpy(zero_copy_only=False), np.stack([b_[c].to_numpy(zero_copy_only=False).astype(float) for c in BOX])
            starts = np.flatnonzero((of != of.shift()).any(axis=1).to_numpy())
            for s, e in zip(starts, [*starts[1:], len(of)]):
                *here, side = of.iloc[s].tolist()
                if here != at:
                    at, held, others = here, [], None
                if side == 0:
                    held.append((ids[s:e], boxes[:, s:e]))
                    continue
                if not held:
                    continue
                if others is None:
                    others, table = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
                step = max(1, CELLS // len(others))
                for k in range(s, e, step):
                    z = min(e, k + step)
                    i, j, iou = found(ids[k:z], boxes[:, k:z], others, table)
                    if len(i):
                        out.append((at, ids[k:z][i], others[j], iou))
                        n += len(i)
                    if n >= ROWS:
                        yield batch()
                        out, n = [], 0
        if out:
            yield batch()

    return rows.select(*key, "part", "side", "id", *BOX).mapInArrow(run, schema)
