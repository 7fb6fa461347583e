"""Personal data: high-recall generators propose overlapping spans, boosted trees on format and context features score
them, and a calibrated threshold selects what is redacted besides the base spans. DataFrame functions only.

Base spans (email, ip, card with Luhn, phone) are found by pattern. The trees learn from a bounded sample of them
(``sample_rows`` rows by hash of the id, ``sample_spans`` spans). From each, examples are made: personal data in other
formats than the base patterns take ("name at host dot org", numbers of phones inside a country, cards grouped in other
ways, bank accounts, social security numbers), and look-alikes (dates, times, spans of years, books, invoices, versions,
amounts, numbers that fail a check). Both stand after the words of the texts, after cues ("call me") and after none, so
neither the words nor the digits alone tell them apart. Half of the spans fit the trees, the other half sets the threshold: the lowest score at
which at least ``precision`` of its examples are right, but no lower than an even chance. Trees become CASE expressions, so scoring stays in the plan.
Candidates above the threshold that overlap no base span are added as kind ``likely``. Addresses without a domain
(``joe@localhost``) are proposed but not learned as personal data.

Null and empty texts have no spans; repeated rows each get a row; an empty table gives an empty result, and without base
spans nothing is learned and nothing added. Other columns are read by ``redacted`` only, which returns them unchanged.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import id_and_text, unused

KINDS = ["email", "ip", "card", "phone", "likely"]
# The patterns of the base spans. Possessive repeats and look-behinds change no match; they keep the search
# linear in long runs, and \G lets a match begin where the one before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The generators: anything around an at sign, from a delimiter on; addresses spelled out; digit groups with separators;
#: capitals that digits follow. None has an upper bound, and all repeats are possessive.
CANDIDATES = [
    r"""(?:(?<![^\s@"'()<>\[\],;=&:/])|\G)[^\s@"'()<>\[\],;=&:/]++@[^\s@"'()<>\[\],;=&/]++""",
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]?\x20?\bat\b\x20?[)\]]?\x20?[A-Za-z0-9-]++(?:\x20?[(\[]?\x20?\bdot\b\x20?[)\]]?\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().:/-]{0,2}+[0-9]){5,}+",
    r"(?<![0-9A-Za-z])[A-Z]{1,3}+[0-9](?:[\x20-]?+[0-9A-Z]){6,}+",
]
#: Words before a span that speak for personal data, and against it.
CUES = r"(?i)(mail|contact|reach|write|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|social|\bip\b|addr|host)[^\n]{0,9}$"
REFERENCES = r"(?i)\b(order|invoice|inv|version|release|isbn|page|pages|pp|section|dated|date|ref|reference|total|sum|score|item|part|serial|ticket|case|build|patent|since|between|from|until|v|no|nr|id)\b[^\n0-9A-Za-z]{0,4}$"
#: Words that training puts before spans, of either kind, besides those that stood there.
CUED = ["call me: ", "tel. ", "phone ", "mail to ", "contact ", "fax: ", "my mobile is ", "card ", "please reach me at ", "my account is "]
NEUTRAL = ["", "and then there was ", "they said that ", "it was on ", "we met at ", "she has ", "it is now ", "the word of the day: ", "in the garden ", "ask for "]
REFERRED = ["order no. ", "version ", "total of ", "dated ", "page ", "the score was ", "see section ", "invoice ", "ISBN ", "ticket #", "part no ", "between "]
#: A date with or without a time, as far as digits can tell; the shape of a bank account number.
_DAY, _MONTH, _YEAR, _TIME = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}", r"[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?(?:\.[0-9]+)?"
DATE = rf"^(?:{_TIME}[\x20-]+)?(?:{_YEAR}([-/.\x20]){_MONTH}\1{_DAY}|{_DAY}([-/.\x20]){_MONTH}\2(?:{_YEAR}|[0-9]{{2}})|{_MONTH}/{_DAY}/{_YEAR}|{_YEAR}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01]))(?:[\x20-]+{_TIME}|[\x20-]*[0-9]{{4,6}})?"
TIME = rf"^{_TIME}(?:[\x20-]+{_TIME})?$"
ACCOUNT = r"^[A-Z]{2}[0-9]{2}(?:[\x20-]?[0-9A-Z]{4}){2,7}(?:[\x20-]?[0-9A-Z]{1,3})?$"
FEATURES = [
    "length", "digits", "dots", "blanks", "hyphens", "colons", "at", "plus", "parentheses", "longest", "groups", "upper", "letters", "spelled", "luhn", "domain", "cue",
    "reference", "date", "time", "account", "first", "second", "last", "zero", "years", "book", "alike", "touching", "distinct",
]
SAMPLE_ROWS, SAMPLE_SPANS, TREES, RATE, PRECISION = 2000, 1000, 50, 0.4, 0.98


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes Luhn's test; every second digit from the right counts twice."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(2 * (F.ascii(c) - 48) - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x) % 10 == 0


def _ip_ok(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _card_ok(value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False)


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    email = spans.found(text, EMAIL, 0, only_if=text.contains("@"))
    ip = F.filter(spans.found(text, IP, 1), lambda s: _ip_ok(s["value"]))
    card = F.filter(spans.found(text, CARD, 2, only_if=text.rlike("[0-9][\\x20-]?[0-9]")), lambda s: _card_ok(s["value"]))
    phone = F.filter(spans.found(text, PHONE, 3, only_if=text.contains("+")), lambda s: F.length(_digits(s["value"])).between(9, 15))
    return spans.in_order(email, ip, card, phone)


def candidates(text: Column) -> Column:
    """Overlapping spans that may hold personal data, by start."""
    tests = [text.contains("@"), text.rlike(r"(?i)\bdot\b"), None, text.rlike("[A-Z][0-9]")]
    return F.array_sort(F.concat(*[spans.found(text, p, 4, only_if=test) for p, test in zip(CANDIDATES, tests)]))


def account_ok(value: Column) -> Column:
    """True if a bank account number's check digits are right: its letters as numbers, the first four characters last, mod 97."""
    plain = F.regexp_replace(value, "[^0-9A-Z]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))
    numbers = F.transform(F.split(turned, ""), lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48))
    return F.aggregate(numbers, F.lit(0), lambda s, n: (s * F.when(n > 9, 100).otherwise(10) + n) % 97) == 1


def features(before: Column, value: Column) -> list[Column]:
    """Format features of a candidate: counts of characters and lengths of its groups of digits; whether it passes Luhn, and the
    check of an account number (-1: not of that form); whether it reads as a date or a time; and whether a word that speaks
    for or against personal data, or a letter or digit, stands in the 24 code points before it."""
    count = lambda chars: F.length(value) - F.length(F.translate(value, chars, ""))
    groups = F.filter(F.split(value, "[^0-9]+"), lambda p: p != "")
    n, size = F.length(_digits(value)), lambda k: F.coalesce(F.length(F.try_element_at(groups, F.lit(k))), F.lit(0))
    passes = F.when((n < 12) | (n > 19), F.lit(-1)).otherwise(luhn(_digits(value)).cast("int"))
    account = F.when(value.rlike(ACCOUNT), account_ok(value).cast("int")).otherwise(-1)
    years = F.size(F.filter(groups, lambda p: p.rlike("^(19|20)[0-9]{2}$")))
    alike = F.size(F.array_distinct(F.transform(groups, lambda p: F.length(p))))
    exprs = [
        F.length(value), n, count("."), count(" "), count("-"), count(":/"), count("@"), count("+"), count("()"), F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda p: F.length(p))), F.size(groups),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz"), value.rlike(r"(?i)\bat\b").cast("int") + value.rlike(r"(?i)\bdot\b").cast("int"), passes, value.rlike(r"(?i)[a-z]{2,}$").cast("int"), before.rlike(CUES).cast("int"),
        before.rlike(REFERENCES).cast("int"), value.rlike(DATE).cast("int"), value.rlike(TIME).cast("int"), account, size(1), size(2), size(-1), value.rlike("^[(]?0").cast("int"), years, value.rlike("^97[89]").cast("int"), alike, before.rlike("[0-9A-Za-z#.:/_-]$").cast("int"), F.size(F.array_distinct(F.split(_digits(value), ""))),
    ]
    return [x.cast("int") for x in exprs]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> tuple[float, list]:
    """Boosted trees of depth 2 for the logistic loss: (bias, [(feature, cut, (feature, cut, leaf, leaf), (...)), ...])."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    score, out = np.full(len(y), bias), []

    levels = [np.unique(x[:, k], return_inverse=True) for k in range(x.shape[1])]

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Feature and cut of the greatest gain: sums of each level's rows, then running sums over the levels."""
        best = (-1.0, 0, 0.0)
        for k, (values, level) in enumerate(levels):
            own = np.flatnonzero(np.bincount(level[rows], minlength=len(values)))
            if len(own) < 2:
                continue
            a, c = (np.cumsum(np.bincount(level[rows], z[rows], len(values))[own]) for z in (g, h))
            gain = a[:-1] ** 2 / (c[:-1] + 1) + (a[-1] - a[:-1]) ** 2 / (c[-1] - c[:-1] + 1)
            top = int(gain.argmax())
            if gain[top] > best[0] + 1e-12:
                best = (float(gain[top]), k, float(values[own[top]]))
        return best[1], best[2]

    leaf = lambda rows, g, h: float(rate * g[rows].sum() / (h[rows].sum() + 1))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        every = np.ones(len(y), bool)
        k, cut = split(every, g, h)
        tree = [k, cut]
        for rows in (x[:, k] <= cut, x[:, k] > cut):
            k2, cut2 = split(rows, g, h) if rows.any() else (0, 0.0)
            a, b = rows & (x[:, k2] <= cut2), rows & (x[:, k2] > cut2)
            tree.append((k2, cut2, leaf(a, g, h), leaf(b, g, h)))
            score[a] += tree[-1][2]
            score[b] += tree[-1][3]
        out.append(tuple(tree))
    return bias, out


def raw_scores(x: np.ndarray, model: tuple[float, list]) -> np.ndarray:
    out = np.full(len(x), model[0])
    for k, cut, left, right in model[1]:
        side = [np.where(x[:, k2] <= cut2, a, b) for k2, cut2, a, b in (left, right)]
        out += np.where(x[:, k] <= cut, *side)
    return out


def score(f: list[Column], model: tuple[float, list]) -> Column:
    """The trees as CASE expressions over the feature columns."""
    total = F.lit(model[0])
    for k, cut, left, right in model[1]:
        side = [F.when(f[k2] <= int(cut2), F.lit(a)).otherwise(F.lit(b)) for k2, cut2, a, b in (left, right)]
        total = total + F.when(f[k] <= int(cut), side[0]).otherwise(side[1])
    return total


@dataclass(frozen=True)
class Trained:
    """Trees, threshold on their raw score, and what the held-out half says of it."""

    model: tuple[float, list]
    threshold: float
    precision: float
    recall: float
    examples: int


def _account(rng: random.Random) -> str:
    """Of one of a few lands, its check digits right."""
    land, size = rng.choice([("DE", 18), ("FR", 23), ("GB", 18), ("NL", 14), ("ES", 20), ("IT", 23)])
    body = "".join(rng.choice("0123456789") for _ in range(size))
    if land in ("GB", "NL"):
        body = "".join(rng.choice("ABCDEFGHKLMN") for _ in range(4)) + body[4:]
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
    return f"{land}{check:02d}{body}"


def _number(rng: random.Random, size: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(size - 1))


def _phones(rng: random.Random) -> str:
    """A number as it is written inside a country, or with two zeros before the country's."""
    n, sep = lambda k: _number(rng, k), rng.choice([" ", "-", ".", " "])
    area = "0" + n(rng.randint(2, 4))
    return rng.choice([
        f"({n(3)}) {n(3)}-{n(4)}", f"({area}) {n(rng.randint(3, 4))}{sep}{n(rng.randint(3, 4))}", f"({area}) {n(rng.randint(5, 8))}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"{area}{sep}{n(3)}{sep}{n(4)}", f"{area}{rng.choice(['-', '/', ' '])}{n(rng.randint(5, 8))}",
        f"00{n(2)}{sep}{n(3)}{sep}{n(rng.randint(4, 7))}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"1{sep}{n(3)}{sep}{n(3)}{sep}{n(4)}", f"{area} {n(2)} {n(2)} {n(2)}",
    ])


def _numbers(rng: random.Random) -> str:
    """What numbers mean otherwise: dates, times, spans of years and pages, books, invoices, versions, amounts, places."""
    n, two = lambda k: _number(rng, k), lambda a, b: f"{rng.randint(a, b):02d}"
    if rng.random() < 0.3:  # groups of any number and length
        sizes, sep = [rng.randint(1, 6) for _ in range(rng.randint(2, 9))], rng.choice(" .-:/")
        return sep.join("".join(rng.choice("0123456789") for _ in range(k)) for k in sizes)
    if rng.random() < 0.1:
        return "".join(rng.choice("0123456789") for _ in range(rng.randint(6, 22)))
    year, month, day, time = rng.randint(1900, 2049), two(1, 12), two(1, 28), f"{two(0, 23)}:{two(0, 59)}"
    return rng.choice([
        f"{year}-{month}-{day}", f"{year}-{month}-{day} {time}", f"{year}-{month}-{day} {time}:{two(0, 59)}", f"{day}.{month}.{year}", f"{day}/{month}/{year} {time}", f"{year}/{month}/{day}", f"{month}/{day}/{year}", f"{year}{month}{day}", f"{year}{month}{day}-{two(0, 23)}{two(0, 59)}{two(0, 59)}",
        f"{time}-{two(0, 23)}:{two(0, 59)}", f"{time}:{two(0, 59)}", f"{time}:{two(0, 59)}.{n(3)}", f"{year}-{year + rng.randint(1, 40)}", f"{year} - {year + rng.randint(1, 40)}", f"{n(3)}-{n(3)}", f"{n(2)}-{n(2)}-{n(2)}",
        f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"978{n(10)}", f"979-{n(2)}-{n(3)}-{n(4)}-{n(1)}", f"{n(4)}-{n(3)}X", f"{year}-{n(rng.randint(4, 6))}", f"{n(rng.randint(6, 14))}", f"{n(1)}.{n(1)}.{n(2)}.{n(rng.randint(4, 6))}", f"{n(1)}.{n(2)}.{n(3)}-{n(3)}", f"{n(2)}.{rng.randint(0, 9)}.{n(5)}.{n(rng.randint(2, 4))}",
        f"{n(1)} {n(3)} {n(3)}", f"{n(2)}.{n(3)}.{n(3)}", f"{n(1)} {n(3)} {n(3)}.{n(2)}", f"{n(2)}.{n(rng.randint(4, 8))}", f"{n(2)}.{n(4)} {n(2)}.{n(4)}", f"{n(3)} {n(3)} {n(3)} {n(3)}", f"{n(1)}:{n(2)}:{n(4)}", f"{n(3)}/{n(4)}/{n(2)}", f"{n(1)} {n(1)} {n(1)} {n(1)} {n(1)} {n(1)} {n(1)}",
        f"{rng.choice('ABX')}{n(rng.randint(7, 10))}", f"INV{n(4)}-{n(5)}", f"{rng.choice('KPS')}{rng.choice('QR')}{n(3)}-{n(4)}-{n(2)}", f"{rng.randint(256, 999)}.{n(2)}.{n(3)}.{n(2)}",
    ])


def examples(kind: int, before: str, value: str, turn: int = 0) -> list[tuple[str, str, int]]:
    """Of one base span: (words before, value, 1 or 0) of personal data in other formats, and of look-alikes. Either stands after
    any words: those that stood there, cues, others; a look-alike more often after a word of reference. ``turn``: another
    number, other examples."""
    rng = random.Random(crc32(f"{turn}{kind}{before}{value}".encode()))
    words = lambda more: rng.choice([before, rng.choice(CUED), rng.choice(NEUTRAL), rng.choice(more)])
    good, bad = lambda v: (words(NEUTRAL), v, 1), lambda v: (words(REFERRED), v, 0)
    d = "".join(c for c in value if "0" <= c <= "9")
    out = [bad(_numbers(rng)) for _ in range(6)]
    if kind == 0:
        name, host = value.split("@", 1)
        name = name[: rng.randint(2, 24)]
        at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" [at] ", "."), ("(at)", ".")])
        return [*out, good(name + at + host.replace(".", dot)), bad(f"{name}@{rng.randint(0, 9)}.{rng.randint(0, 31)}.{rng.randint(0, 9)}"), bad(f"{name} at {host.split('.')[0]}"), bad(f"@{name}@"), good(_account(rng))]
    if kind == 1:
        return [*out, good(_phones(rng))]
    if kind == 2:
        cut = lambda x, sep: sep.join(x[k : k + 4] for k in range(0, len(x), 4))
        wrong = d[:-1] + str((int(d[-1]) + rng.randint(1, 9)) % 10)
        account = _account(rng)
        off = account[:2] + f"{(int(account[2:4]) + rng.randint(1, 95)) % 97 + 2:02d}" + account[4:]
        return [*out, good(cut(d, rng.choice("./:"))), bad(cut(wrong, rng.choice(" -"))), bad(cut(wrong, rng.choice("./:"))), bad(wrong), good(account), good(cut(account, " ")), bad(off if off != account else wrong)]
    safe = f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    return [*out, good(_phones(rng)), good(_phones(rng)), (rng.choice(["SSN ", "social security number: ", "my ssn is ", before]), safe, 1), bad(d)]


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_spans: int = SAMPLE_SPANS, precision: float = PRECISION) -> Trained | None:
    """Trees and threshold, or None where there is nothing to learn from. ``docs``: doc_id, text."""
    text = F.col("text")
    likely = text.rlike("[0-9][\\x20().:/-]{0,2}[0-9]{2}") | text.contains("@")
    chosen = docs.where(likely).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "text", F.explode(base_spans(text)).alias("s"))
    at = F.greatest(F.col("s.start") - 24, F.lit(0))
    picked = rows.select(F.xxhash64("doc_id", "s.start").alias("h"), "s.kind", F.substring(text, at + 1, F.col("s.start") - at).alias("before"), "s.value").orderBy("h", "kind", "value").limit(sample_spans).collect()
    turns = -(-sample_spans // max(1, len(picked)))  # few spans give as many examples
    made = [(k % 2, *e) for k, r in enumerate(picked) for t in range(turns) for e in examples(r.kind, r.before, r.value, t)]
    if len({e[3] for e in made if not e[0]}) < 2 or len({e[3] for e in made if e[0]}) < 2:
        return None
    table = docs.sparkSession.createDataFrame(made, "half int, before string, value string, y int")
    got = table.select("half", "y", F.array(*features(F.col("before"), F.col("value"))).alias("x")).orderBy("half", "y", "x").collect()
    x, y, half = np.array([r.x for r in got], float), np.array([r.y for r in got], float), np.array([r.half for r in got])
    model = fit(x[half == 0], y[half == 0])
    got_, right = raw_scores(x[half == 1], model), y[half == 1]
    by = np.argsort(-got_, kind="stable")
    level, share = got_[by], np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero((share >= precision) & np.append(level[1:] < level[:-1], True))  # equal scores stand or fall together
    if not len(good):
        return Trained(model, float("inf"), 1.0, 0.0, len(made))
    threshold = max(float(level[good[-1]]) - 1e-9, 0.0)
    taken = got_ >= threshold
    return Trained(model, threshold, float(right[taken].mean()) if taken.any() else 1.0, float(right[taken].sum() / right.sum()), len(made))


def all_spans(text: Column, base: Column, trained: Trained | None) -> Column:
    """Base spans and the candidates selected besides them, by start, then kind."""
    if not trained:
        return base

    def chosen(found: Column) -> Column:
        def taken(pieces: Column, s: Column) -> Column:
            at = F.greatest(s["start"] - 24, F.lit(0))
            bound = F.transform(F.array(F.array(*features(spans.cut(pieces, at, s["start"] - at), s["value"]))), lambda f: score([F.get(f, F.lit(k)) for k in range(len(FEATURES))], trained.model))
            return F.get(bound, F.lit(0)) >= trained.threshold

        picked = F.get(F.transform(F.array(spans.chunks(text)), lambda pieces: F.filter(found, lambda s: taken(pieces, s))), F.lit(0))
        return F.when(F.size(found) > 0, picked).otherwise(found)

    return spans.in_order(base, F.get(F.transform(F.array(spans.outside(candidates(text), base)), chosen), F.lit(0)))


def personal_data(docs: DataFrame, trained: Trained | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text, base and all (arrays of spans by start, then kind; offsets in code points, end exclusive)."""
    own = id_and_text(docs, id_col, text_col)
    rows = own.withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("all", all_spans(F.col("text"), F.col("base"), trained or train(own)))


def personal_counts(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, n_likely, base_sha256, spans."""
    base, all_ = F.col("base"), F.col("all")
    return personal_data(docs, **options).select("doc_id", *[spans.of_kind(all_, k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(spans.digest(base, KINDS), 256).alias("base_sha256"), spans.digest(all_, KINDS).alias("spans"))


def mask(text: Column, found: Column, names: list[str] = KINDS) -> Column:
    """``text`` with each span (by start) replaced by its kind in brackets; of overlapping spans, the part not yet masked."""
    name = F.array(*map(F.lit, names))

    def whole(x: Column) -> Column:
        """x: struct of the spans, the furthest end up to each of them, and the text's chunks."""

        def one(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
            return F.when(s["start"] >= at, F.concat(spans.cut(x["pieces"], at, s["start"] - at), F.lit("["), F.upper(F.get(name, s["kind"])), F.lit("]"))).otherwise("")

        last = F.get(x["ends"], F.size(x["ends"]) - 1)
        return F.concat(F.array_join(F.transform(x["found"], one), ""), spans.cut(x["pieces"], last, F.length(text) - last))

    ends = spans.scan(found, F.lit(0), lambda s, v: F.greatest(s, v["end"]), "int")
    bound = F.transform(F.array(F.struct(found.alias("found"), ends.alias("ends"), spans.chunks(text).alias("pieces"))), whole)
    return F.when(F.size(found) > 0, F.get(bound, F.lit(0))).otherwise(text)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trained: Trained | None = None) -> DataFrame:
    """``docs`` with all its columns, personal data in the text masked. Null texts stay null; every row stays, whatever its
    id."""
    trained = trained or train(id_and_text(docs, id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, all_ = unused(docs, "base_spans"), unused(docs, "all_spans")
    rows = docs.withColumn(base, base_spans(text)).withColumn(all_, all_spans(text, F.col(base), trained))
    return rows.withColumn(text_col, mask(F.col(text_col), F.col(all_))).select(*docs.columns)
