"""Repair of the structure of conversations: the cheapest edits that make their turns alternate.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``, which four states decide: nothing yet, after s,
after u, after a. What the edits of one row can do is a 4 x 4 matrix: its entry (i, j) is the least (cost, audit) of edits
that lead from state i to j, insertions before the row included (the closure of insertions times the edits of the row).
Sequences of rows are products of matrices in which costs add up, audits are joined and the lesser pair wins. The product
is associative: within an entry every audit ends with the edit of a row and has as many of those, so none begins with
another and joining keeps their order. So a conversation is cut into chunks of rows, each chunk is a product of halves, and
chunks are multiplied in a tree, up to ``FAN`` at a time: no task holds more of a long conversation than one product.

The rows are dealt by ranges of (conversation, turn, role, text) once, and numbered in that order; a conversation
may lie in many partitions. Duplicates are found by an aggregate over (conversation, role, digest of the text). The cheapest
audit is a string as long as the conversation, in one row of the result. Edits are applied in one pass over the rows of
each conversation in order, next to the edits of each chunk, in constant memory; a SHA-256 can't be had any other way.

Edits: K keep, 0; R give the role user or assistant, 3; D delete, 4, and the only one for blank and duplicate rows; I insert
an empty row of user or assistant, 3. A truncated row that isn't deleted costs 3 more. Equal costs: the least audit.

Null roles and texts count as one space, which no structure allows in a role; so does a null turn where it is hashed, and
rows without turn come first; a row with an empty role can't be kept either. Rows without conversation id are one
conversation. Rows of one turn are in order of role, then of the text's digest; of equal rows all but one are duplicates.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

WHITE, ENDS, BLANKS = " \t\n\x0b\x0c\r", ".!?", " "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK_BITS, FAN = 8, 16
#: A row's symbol: initial of its role (o: any other), by its fault: none, truncated, must go.
INITIALS, SYMBOLS = "suao", {"": "suao", "truncated": "SUAO", "gone": "1234"}
ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing, 1 after s, 2 after u, 3 after a. 0 and 3 may end a conversation.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END = (0, 3)
LEGAL = ("su", "ua", "au")

Matrix = tuple  # 16 entries (cost, audit) or None, by row


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product: the least (cost, audit) over the state in between."""
    out = []
    for i in range(4):
        for j in range(4):
            found = [(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := a[4 * i + m]) and (y := b[4 * m + j])]
            out.append(min(found, default=None))
    return tuple(out)


def _insertions() -> Matrix:
    """The closure of insertions: as many as lead anywhere by the least cost (two at most)."""
    none = tuple((0, "") if i == j else None for i in range(4) for j in range(4))
    one = list(none)
    for (i, role), j in STEP.items():
        if role in ROLES:
            one[4 * i + j] = (INSERT, "I")
    return product(tuple(one), tuple(one))


INSERTIONS = _insertions()


def _initial(symbol: str) -> str:
    return INITIALS[next(own for own in SYMBOLS.values() if symbol in own).index(symbol)]


@lru_cache(maxsize=None)
def of_row(symbol: str) -> Matrix:
    """Insertions, then the edits of one row; there are twelve symbols."""
    edits: list = [None] * 16
    role, more = _initial(symbol), TRUNCATED * (symbol in SYMBOLS["truncated"])
    for i in range(4):
        choices = [(i, (DELETE, "D"))]
        if symbol not in SYMBOLS["gone"]:
            choices += [(STEP[i, role], (KEEP + more, "K"))] if (i, role) in STEP else []
            choices += [(STEP[i, r], (REROLE + more, "R")) for r in ROLES if (i, r) in STEP]
        for j, edit in choices:
            edits[4 * i + j] = min(edit, edits[4 * i + j] or edit)
    return product(INSERTIONS, tuple(edits))


@lru_cache(maxsize=20_000)
def of_rows(symbols: str) -> Matrix:
    """Product over at most 16 rows; such stretches repeat, so they are kept."""
    return of_row(symbols) if len(symbols) == 1 else product(of_rows(symbols[: len(symbols) // 2]), of_rows(symbols[len(symbols) // 2 :]))


def of_chunk(symbols: str) -> Matrix:
    return of_rows(symbols) if len(symbols) <= 16 else product(of_chunk(symbols[: len(symbols) // 2]), of_chunk(symbols[len(symbols) // 2 :]))


def of_all(parts: list[Matrix]) -> Matrix:
    """Product of a few matrices, by halves."""
    return parts[0] if len(parts) == 1 else product(of_all(parts[: len(parts) // 2]), of_all(parts[len(parts) // 2 :]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """Cost and audit from the first state to one that may end, insertions after the last row included."""
    whole = product(matrix, INSERTIONS)
    return min(whole[j] for j in END if whole[j])


def illegal_pairs(symbols: str) -> int:
    roles = [_initial(s) for s in symbols]
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))


def outcomes(audit: str, chunks: list[str]) -> tuple[list[str], str]:
    """What becomes of each row, by chunk, and the roles inserted at the end. Of a row: the initials of the roles inserted
    before it, then k (kept), d (deleted), U or A (given that role); rows are parted by commas."""
    state, at, out, before = 0, 0, [], ""

    def inserted() -> None:
        nonlocal state, at, before
        while at < len(audit) and audit[at] == "I":
            role = "a" if state == 2 else "u"
            state, before, at = STEP[state, role], before + role, at + 1

    for symbols in chunks:
        rows = []
        for symbol in symbols:
            inserted()
            edit, at = audit[at], at + 1
            if edit == "D":
                now = "d"
            else:
                role = _initial(symbol) if edit == "K" else "a" if state == 2 else "u"
                state, now = STEP[state, role], "k" if edit == "K" else role.upper()
            rows.append(before + now)
            before = ""
        out.append(",".join(rows))
    inserted()
    return out, before


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes
    away its sentence ends, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(BLANKS))
    fault = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _symbol(initial: Column, gone: Column, truncated: Column) -> Column:
    own = lambda kind: F.translate(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"), INITIALS, SYMBOLS[kind])
    return F.when(gone, own("gone")).when(truncated, own("truncated")).otherwise(own(""))


NODE = "costs array<long>, audits array<string>, first string, last string, illegal long, pieces array<struct<chunk: long, symbols: string>>"


def _node(matrix: Matrix, first: str, last: str, illegal: int, pieces: list) -> dict:
    return {"costs": [x and x[0] for x in matrix], "audits": [x and x[1] for x in matrix], "first": first, "last": last, "illegal": illegal, "pieces": pieces}


def _leaf(r: dict) -> dict:
    s = r["symbols"]
    return _node(of_chunk(s), _initial(s[0]), _initial(s[-1]), illegal_pairs(s), [{"chunk": r["chunk"], "symbols": s}])


def _joined(r: dict) -> dict:
    parts = r["parts"]
    matrix = of_all([tuple(c if c is None else (c, a) for c, a in zip(p["costs"], p["audits"])) for p in parts])
    between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    return _node(matrix, parts[0]["first"], parts[-1]["last"], between + sum(p["illegal"] for p in parts), [x for p in parts for x in p["pieces"]])


def _decided(r: dict) -> dict:
    cost, audit = cheapest(tuple(c if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])))
    tokens, tail = outcomes(audit, [p["symbols"] for p in r["pieces"]])
    return {"cost": cost, "audit": audit, "illegal": r["illegal"], "tail": tail, "edits": [{"chunk": p["chunk"], "tokens": t} for p, t in zip(r["pieces"], tokens)]}


def _rows(df: DataFrame, keep: list[str], make, made: str) -> DataFrame:
    """``keep`` and what ``make`` returns for each row. The rows are taken a few at a time from a batch."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in keep} | make(r) for r in rows], schema=target)

    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    return df.mapInArrow(run, out)


class Repair(NamedTuple):
    """What ``repaired`` found, in tables of the shared folder."""

    rows: DataFrame  # conv, k (order), turn, role, text, fault (blank, duplicate, truncated or null)
    plans: DataFrame  # conv, cost, audit, illegal, tail, edits by chunk


def plan(conversations: DataFrame) -> Repair:
    """The faults of all rows and the cheapest edits of all conversations. ``conversations``: conv_id, turn, role, text."""
    spark = conversations.sparkSession
    tables = Scratch(spark, "conversations")
    text = F.coalesce(F.col("text"), F.lit(BLANKS))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit(BLANKS)).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv", "turn", "role", "digest", "salt"]
    rows = tables.table(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("k"), "conv", "turn", "role", "text", "digest"), "ordered")

    repeated = rows.groupBy("conv", "role", "digest").agg(F.min("k").alias("first_k"), F.count("*").alias("n")).where("n > 1")
    repeated = tables.table(repeated.select(F.col("conv").alias("conv2"), F.col("role").alias("role2"), F.col("digest").alias("digest2"), "first_k"), "repeated")
    same = F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("role") == F.col("role2")) & (F.col("digest") == F.col("digest2"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    ends = rows.select("conv", "k", "role", "digest", (F.length(end) == 0).alias("blank"), (~F.right(end, F.lit(1)).isin(*ENDS)).alias("open"))
    kind = F.when(F.col("blank"), "blank").when(F.col("first_k") < F.col("k"), "duplicate").when(F.col("open"), "truncated")
    faults = ends.join(repeated, same, "left").select("conv", "k", kind.alias("fault"), _symbol(F.left("role", F.lit(1)), F.coalesce(kind.isin("blank", "duplicate"), F.lit(False)), F.coalesce(kind == "truncated", F.lit(False))).alias("symbol"))

    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "symbol"))), lambda x: x["symbol"]), "")
    counts = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    chunks = faults.groupBy("conv", F.shiftright("k", CHUNK_BITS).alias("chunk")).agg(joined.alias("symbols"), *counts)
    chunks = tables.table(chunks.withColumn("node", F.row_number().over(Window.partitionBy("conv").orderBy("chunk")) - 1), "chunks")

    counted = [c.alias(f) for c, f in zip((F.sum("blank"), F.sum("duplicate"), F.sum("truncated")), ("blank", "duplicate", "truncated"))]
    nodes = tables.table(_rows(chunks, ["conv", "node", "blank", "duplicate", "truncated"], _leaf, NODE), "nodes0")
    most, level = (nodes.agg(F.max("node")).first()[0] or 0) + 1, 0
    while most > 1:
        parts = F.sort_array(F.collect_list(F.struct("node", "costs", "audits", "first", "last", "illegal", "pieces")))
        grouped = nodes.groupBy("conv", F.floor(F.col("node") / FAN).cast("int").alias("up")).agg(parts.alias("parts"), *counted).withColumnRenamed("up", "node")
        most, level = -(-most // FAN), level + 1
        nodes = tables.table(_rows(grouped, ["conv", "node", "blank", "duplicate", "truncated"], _joined, NODE), f"nodes{level}")
        tables.drop(f"nodes{level - 1}")
    plans = tables.table(_rows(nodes, ["conv", "blank", "duplicate", "truncated"], _decided, "cost long, audit string, illegal long, tail string, edits array<struct<chunk: long, tokens: string>>"), "plans")
    tables.drop(f"nodes{level}", "chunks", "repeated")
    return Repair(rows, plans)


def _with_edits(found: Repair) -> DataFrame:
    """The rows of each conversation in order, each chunk of them after its edits, and at the end what is inserted there."""
    own = found.rows.select("conv", "k", F.lit(1).alias("kind"), "role", "text")
    edits = found.plans.select("conv", F.explode("edits").alias("e")).select("conv", F.shiftleft("e.chunk", CHUNK_BITS).alias("k"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"), F.col("e.tokens").alias("text"))
    tails = found.plans.select("conv", F.lit((1 << 63) - 1).alias("k"), F.lit(2).alias("kind"), F.lit(None).cast("string").alias("role"), F.col("tail").alias("text"))
    return own.unionByName(edits).unionByName(tails).repartition("conv").sortWithinPartitions("conv", "k", "kind")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, role, text) of what is left and inserted, in order, then (conversation, None, None) at its end."""
    todo: list[str] = []
    for batch in batches:
        for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text"))):
            if kind == 0:
                todo = text.split(",")[::-1]
                continue
            token = todo.pop() if kind == 1 else text
            for c in token[:-1] if kind == 1 else token:
                yield conv, ROLES[c], ""
            if kind == 2:
                yield conv, None, None
            elif token[-1] != "d":
                yield conv, role if token[-1] == "k" else ROLES[token[-1].lower()], text


def turns(found: Repair) -> DataFrame:
    """The repaired conversations: (conv_id, place from 0, role, text)."""
    kind = found.rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = 0, []
        for conv, role, text in _edited(batches):
            if role is None:
                place = 0
                continue
            out.append((conv, place, role, text))
            place += 1
            if len(out) == 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (to_arrow_type(kind), pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])

    return _with_edits(found).mapInArrow(run, f"conv_id {kind.simpleString()}, place long, role string, text string")


def digests(found: Repair) -> DataFrame:
    """(conv_id, repaired_sha256): of the lines ``role:text`` of each repaired conversation, joined by newlines."""
    kind = found.rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        own, empty, ids, sums = hashlib.sha256(), True, [], []
        for conv, role, text in _edited(batches):
            if role is None:
                ids.append(conv)
                sums.append(own.hexdigest())
                own, empty = hashlib.sha256(), True
                continue
            own.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
            empty = False
        yield pa.record_batch([pa.array(ids, to_arrow_type(kind)), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])

    return _with_edits(found).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def report(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ``ids`` (conv_id): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    One without rows in ``conversations`` has zeros, an empty audit and the digest of an empty text."""
    found = plan(conversations)
    turns_ = found.rows.groupBy(F.col("conv").alias("conv_id")).agg(F.max("turn").alias("hi"), F.min("turn").alias("lo"), F.count_distinct("turn").alias("distinct"))
    gaps = turns_.select("conv_id", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("distinct"), F.lit(0)).alias("gaps"))
    plans = found.plans.select(F.col("conv").alias("conv_id"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    parts = [ids.select("conv_id").distinct(), gaps, plans, digests(found)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = hashlib.sha256().hexdigest()
    return whole.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(none)).alias("repaired_sha256"))
