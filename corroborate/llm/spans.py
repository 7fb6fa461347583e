"""Spans of regular-expression matches with their places, in DataFrame functions only.

Spark returns matches without places. What ``split`` leaves between matches has the lengths that are missing: running
sums of gaps and matches are the places, in code points. Sums run in blocks, so a text with very many matches costs time
in proportion to them, and only texts that match at all pay for more than one search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
SPAN = "struct<start:int,kind:int,end:int,value:string,group:string>"
EMPTY = f"array<{SPAN}>"


def _struct(start, kind, end, value, group) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).cast("int").alias("kind"), end.alias("end"), value.alias("value"), group.alias("group"))


def found(text: Column, pattern: str, kind: int, group: int = 0, only_if: Column | None = None) -> Column:
    """array<struct<start, kind, end, value, group>> of the leftmost non-overlapping matches of ``pattern``.

    ``kind`` numbers the kind; ``only_if``: a cheap test that every text with a match passes."""
    gaps, whole = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    state = f"struct<at:int,out:{EMPTY}>"

    def within(m: Column) -> Column:
        """m: struct of gaps, whole, parts."""
        n = F.size(m["whole"])

        def one(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(m["gaps"], i))
            end = start + F.length(F.get(m["whole"], i))
            return F.struct(end.alias("at"), F.array_append(s["out"], _struct(start, kind, end, F.get(m["whole"], i), F.get(m["parts"], i))).alias("out")).cast(state)

        def block(s: Column, b: Column) -> Column:
            last = F.least(n, b + BLOCK) - 1
            inner = F.aggregate(F.sequence(b, last), F.struct(s["at"].alias("at"), F.array().cast(EMPTY).alias("out")).cast(state), one)
            bound = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(s["out"], x["out"]).alias("out")))
            return F.get(bound, F.lit(0)).cast(f"struct<at:int,out:array<{EMPTY}>>")

        zero = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(f"struct<at:int,out:array<{EMPTY}>>")
        return F.flatten(F.aggregate(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), zero, block)["out"])

    bound = F.transform(F.array(F.struct(gaps.alias("gaps"), whole.alias("whole"), parts.alias("parts"))), within)
    has = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(has, F.get(bound, F.lit(0))).otherwise(F.array().cast(EMPTY))


def digest(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each span, comma-joined, in the order of ``spans``."""
    name = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def in_order(*lists: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(F.concat(*lists))


def of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(values: Column, zero: Column, step, kind: str) -> Column:
    """The running state after each of ``values``: ``step(state, value)`` from ``zero`` on, of the SQL type ``kind``. In
    blocks, as sums are in ``found``."""
    one = f"struct<at:{kind},out:array<{kind}>>"
    all_ = f"struct<at:{kind},out:array<array<{kind}>>>"

    def within(xs: Column) -> Column:
        def each(s: Column, x: Column) -> Column:
            bound = F.transform(F.array(step(s["at"], x)), lambda now: F.struct(now.alias("at"), F.array_append(s["out"], now).alias("out")))
            return F.get(bound, F.lit(0)).cast(one)

        def block(s: Column, b: Column) -> Column:
            inner = F.aggregate(F.slice(xs, b, F.lit(BLOCK)), F.struct(s["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")).cast(one), each)
            bound = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.array_append(s["out"], x["out"]).alias("out")))
            return F.get(bound, F.lit(0)).cast(all_)

        start = F.struct(zero.alias("at"), F.array().alias("out")).cast(all_)
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)), start, block)["out"])).otherwise(F.array().cast(f"array<{kind}>"))

    return F.get(F.transform(F.array(values), within), F.lit(0))


def outside(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``, by start: both lists are merged, and each span compares with the
    furthest end before it and the next start behind it."""
    far = 1 << 30

    def merged(u: Column) -> Column:
        """u: all spans by start, those of ``others`` first, with own = 1 for those of ``spans``."""
        end = scan(u, F.lit(-1), lambda s, x: F.greatest(s, F.when(x["own"] == 0, x["s"]["end"]).otherwise(-1)), "int")
        next_ = F.reverse(scan(F.reverse(u), F.lit(far), lambda s, x: F.least(s, F.when(x["own"] == 0, x["s"]["start"]).otherwise(far)), "int"))
        rows = F.zip_with(F.arrays_zip(u.alias("u"), end.alias("end")), next_, lambda x, n: F.struct(x["u"].alias("u"), x["end"].alias("end"), n.alias("next")))
        return F.transform(F.filter(rows, lambda x: (x["u"]["own"] == 1) & (x["end"] <= x["u"]["s"]["start"]) & (x["next"] >= x["u"]["s"]["end"])), lambda x: x["u"]["s"])

    mark = lambda xs, own: F.transform(xs, lambda s: F.struct(s["start"].alias("at"), F.lit(own).alias("own"), s.alias("s")))
    both = F.array_sort(F.concat(mark(others, 0), mark(spans, 1)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.get(F.transform(F.array(both), merged), F.lit(0))).otherwise(spans)


CHUNK = 4096


def chunks(text: Column) -> Column:
    """``text`` in pieces of CHUNK code points: to find a place in a piece costs no walk through the whole text."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK)))


def cut(pieces: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` on (the first is 0) of a text given by its ``chunks``."""
    a, b = F.floor(start / CHUNK).cast("int"), F.floor((start + size - 1) / CHUNK).cast("int")
    first = F.get(pieces, a)
    longer = F.concat(F.substring(first, start - a * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(F.get(pieces, b), F.lit(1), start + size - b * CHUNK))
    return F.when(size <= 0, F.lit("")).when(a == b, F.substring(first, start - a * CHUNK + 1, size)).otherwise(longer)
