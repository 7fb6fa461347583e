"""Repair of conversations against a plain search, and on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from corroborate.llm import conversation_repair as repair
from corroborate.llm import queries

from ..conftest import SF

ROWS = "conv_id long, turn long, role string, text string, k int, digest string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_edits(rows, faults):
    """Uniform-cost search over (place, initials so far by a plain automaton), least (cost, audit) first; and what it leaves."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, kept = heapq.heappop(queue)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, list(kept)
        if (at, state, audit[-1:] == "I") in done:
            continue
        done.add((at, state, audit[-1:] == "I"))
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(queue, (cost + 3, audit + "I", at, step[state, role[0]], kept + ((role, ""),)))
        if at < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, kept))
            if faults[at] not in ("blank", "duplicate"):
                _, _, own, text = rows[at]
                for letter, role, price in (("K", own, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if (state, role[:1]) in step:
                        heapq.heappush(queue, (cost + price + 3 * (faults[at] == "truncated"), audit + letter, at + 1, step[state, role[:1]], kept + ((role, text),)))


def plain_row(ids, rows):
    """The expected row of each conversation; ``rows`` after damage."""
    out = {}
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults = plain_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        cost, audit, kept = plain_edits(own, faults)
        lines = "\n".join(f"{r}:{t}" for r, t in kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest()), kept
    return out


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[r.conv_id][0], r


def test_query_equals_a_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.op12_conversation_repair(spark, SF).collect(), plain_row({r[0] for r in rows}, plain_damage(rows)))


def random_rows(rng, convs, most):
    texts = ["Yes.", "No!", "why?", "", " \t", "open", "x. ", None, "again.", "ünd so 日本?\n"]
    roles = ["user", "assistant", "system", "tool", "u", "", None]
    rows = []
    for conv in convs:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"turn {turn} of {conv}."
            rows.append((conv, rng.choice([turn, turn, turn, None, turn // 2]), role, text))
    return rows


def test_odd_conversations(spark):
    rows = random_rows(random.Random(5), [None, *range(60)], 12)
    rows += [rows[3], rows[3], (70, None, None, None), (71, 4, "user", "Only this."), (72, 0, "system", "Rules.")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(5)
    want = plain_row({r[0] for r in rows}, plain_damage(rows))
    compare(repair.report(repair.damaged(df), df).collect(), want)
    found = repair.turns(repair.plan(repair.damaged(df))).collect()
    left = {}
    for r in sorted(found, key=lambda r: r["place"]):
        left.setdefault(r.conv_id, []).append((r.role, r.text))
    assert left == {c: kept for c, (_, kept) in want.items() if kept}
    assert all(LEGAL.fullmatch("".join(role[0] for role, _ in kept)) for kept in left.values())


def test_long_conversations_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(6)
    rows = random_rows(rng, [1], 9) + [r for r in random_rows(rng, [2], 1)]
    for turn in range(6000):
        rows.append((3, turn, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randint(0, 3000)}{rng.choice('.!?,')}"))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(4)
    compare(repair.report(df, df).collect(), plain_row({1, 2, 3}, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]))


def test_hot_text_and_many_equal_rows(spark):
    rows = [(1, 5, "user", "Same.")] * 700 + [(1, t, "user", "Same.") for t in range(6, 300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(4)
    got = repair.report(df, df).collect()
    compare(got, plain_row({1}, rows))
    assert got[0].duplicate == len(rows) - 1


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair.report(none, none).collect() == []
    ids = spark.createDataFrame([(7, 0, "user", "Gone.", 1, "")], ROWS)
    assert [tuple(r) for r in repair.report(none, ids).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("n", range(1, 5))
def test_products_equal_all_edits(n):
    """Every edit of every row and up to two insertions at every place, for all symbols of a few rows."""
    symbols = "suaoUA1" if n < 4 else "sua1"
    for word in itertools.product(symbols, repeat=n):
        best = None
        for edits in itertools.product("KDua", repeat=n):
            if any(s == "1" and e != "D" for s, e in zip(word, edits)):
                continue
            cost = sum({"K": 0, "D": 4}.get(e, 3) + 3 * (s.isupper() and e != "D") for s, e in zip(word, edits))
            kept = [(s.lower() if e == "K" else e, "K" if e == "K" else "R") if e != "D" else ("", "D") for s, e in zip(word, edits)]
            frontier = {"": [(0, "")]}
            step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
            for role, letter in [*kept, (None, "")]:
                for _ in range(2):
                    for state, found in list(frontier.items()):
                        for r in "ua":
                            if (state, r) in step:
                                frontier[step[state, r]] = list({*frontier.get(step[state, r], []), *((c + 3, a + "I") for c, a in found)})
                if role is not None:
                    moved = {}
                    for state, found in frontier.items():
                        if role == "":
                            moved.setdefault(state, []).extend((c, a + letter) for c, a in found)
                        elif (state, role) in step:
                            moved.setdefault(step[state, role], []).extend((c, a + letter) for c, a in found)
                    frontier = {s: [min(f)] + [x for x in set(f) if x[0] <= min(f)[0] + 6][:50] for s, f in moved.items()}
            ends = [x for s in ("", "a") for x in frontier.get(s, [])]
            if ends:
                found = min(ends)
                best = min(filter(None, [best, (cost + found[0], found[1])]))
        assert repair.cheapest(repair.of_chunk("".join(word))) == best, word


def test_products_associate():
    rng = random.Random(7)
    for _ in range(300):
        a, b, c = (repair.of_chunk("".join(rng.choices("suaoSUAO1234", k=rng.randint(1, 9)))) for _ in range(3))
        assert repair.product(repair.product(a, b), c) == repair.product(a, repair.product(b, c))
