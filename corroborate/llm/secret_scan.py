"""Secret scans: two character Markov models, one of random strings and one of ordinary identifiers, compared by their
log-likelihood ratio. DataFrame functions only.

Fixed formats (assignments, access keys, hex runs) are found by pattern, and label what is learned from: what they match is
random, tokens of the same alphabet beside them are ordinary. One pass over all rows counts each different token, and the
table of these counts is all that training reads from then on. Half of the occurrences (by hash of id and token) give the
bigram counts (what crosses to the driver is a table of at most 2 x 67 x 67), the other half the threshold: the least
step of a fixed scale that at most ``false_share`` of the ordinary ones exceed (a count for each step crosses to the
driver). Long tokens that overlap no base span and exceed it are added as kind ``random``, but not those in the common form
of a universally unique identifier. Counts are smoothed; without random strings nothing is added.

Null and empty texts have no spans; repeated rows each get a row; an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .shared import Scratch, id_and_text

KINDS = ["assign", "access", "hex", "random"]
#: The patterns whose matches are the base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A shorter run can't hold enough evidence; what ordinary tokens are learned from may be shorter.
TOKEN, LEARNED = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+/_=-]{8,}"
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
N = len(SYMBOLS)
#: Natural logarithm of the odds that a random string must have over an ordinary identifier, at least; thresholds are this
#: times a power of GROWTH.
LEAST, GROWTH = 8.0, 1.01
#: Share of held-out ordinary tokens that may exceed the threshold.
FALSE_SHARE = 0.001
BACKED = 20.0


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind."""
    assign = F.filter(spans.found(text, ASSIGN, 0, group=2), lambda s: F.length(s["group"]) >= 12)
    return spans.in_order(assign, spans.found(text, ACCESS, 1, only_if=text.contains("AKIA")), spans.found(text, HEX, 2))


def _codes(token: Column) -> Column:
    """The number of each character in SYMBOLS."""
    table = F.array(*[F.lit(SYMBOLS.find(chr(c)) if chr(c) in SYMBOLS else N - 1) for c in range(128)])
    return F.transform(F.split(token, ""), lambda c: F.get(table, F.least(F.ascii(c), F.lit(127))))


@dataclass(frozen=True)
class Trained:
    """Log-likelihood ratios of all bigrams (rows by first symbol), threshold on a token's sum, and what the held-out half
    says of it: the share of random tokens found and of ordinary ones taken for random."""

    ratios: list[float]
    threshold: float
    recall: float
    false_share: float
    tokens: int


def train(docs: DataFrame, false_share: float = FALSE_SHARE) -> Trained | None:
    """Both models from all rows, or None where they hold no random string to count. ``docs``: doc_id, text."""
    text, base = F.col("text"), F.col("base")
    scratch = Scratch(docs.sparkSession, "secret-tokens")
    secret = F.transform(base, lambda s: F.struct(F.lit(1).alias("y"), F.coalesce(F.when(s["kind"] == 0, s["group"]), s["value"]).alias("token")))
    # Without a base span nothing can overlap one, so no places are needed.
    beside = F.when(F.size(base) == 0, F.regexp_extract_all(text, F.lit(LEARNED), F.lit(0))).otherwise(F.transform(spans.outside(spans.found(text, LEARNED, 3), base), lambda s: s["value"]))
    ordinary = F.transform(beside, lambda t: F.struct(F.lit(0).alias("y"), t.alias("token")))
    each = docs.select("doc_id", "text", base_spans(text).alias("base")).select("doc_id", F.explode(F.concat(secret, ordinary)).alias("t"))
    each = each.select("t.*", F.pmod(F.xxhash64("doc_id", "t.token"), F.lit(2)).alias("half"))
    tokens = scratch.table(each.groupBy("half", "y", "token").agg(F.count("*").alias("n")), "tokens")
    codes = tokens.where("half = 0").select("y", "n", _codes(F.col("token")).alias("c"))
    pairs = codes.select("y", "n", F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))).alias("b"))).alias("p")).where("p.b IS NOT NULL")
    counts = {(r.y, r.a, r.b): r.n for r in pairs.groupBy("y", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n")).collect()}
    if not any(y for y, _, _ in counts):
        scratch.drop("tokens")
        return None
    model = ratios(counts)
    held = tokens.where("half = 1").select("y", "n", ratio(F.col("token"), model).alias("r"))
    step = F.when(F.col("r") > LEAST, F.ceil(F.log(F.col("r") / LEAST) / math.log(GROWTH))).otherwise(0)
    steps = {(r.y, r.step): r.n for r in held.groupBy("y", step.alias("step")).agg(F.sum("n").alias("n")).collect()}
    scratch.drop("tokens")
    total = [sum(n for (y, _), n in steps.items() if y == k) for k in (0, 1)]
    above = lambda k, level: sum(n for (y, at), n in steps.items() if y == k and at > level)
    level = next(k for k in sorted({0, *(at for _, at in steps)}) if above(0, k) <= false_share * total[0])
    recall, wrong = (above(k, level) / total[k] if total[k] else 0.0 for k in (1, 0))
    return Trained(model, LEAST * GROWTH**level, recall, wrong, sum(total))


def ratios(counts: dict[tuple[int, int, int], int]) -> list[float]:
    """Of each model, P(b | a) leans on P(b) with the weight of BACKED characters, and P(b) on the uniform one."""
    total = [[sum(counts.get((y, a, b), 0) for a in range(N)) + 0.5 for b in range(N)] for y in (0, 1)]
    single = [[x / sum(t) for x in t] for t in total]
    out = []
    for a in range(N):
        seen = [sum(counts.get((y, a, b), 0) for b in range(N)) for y in (0, 1)]
        p = [[(counts.get((y, a, b), 0) + BACKED * single[y][b]) / (seen[y] + BACKED) for b in range(N)] for y in (0, 1)]
        out += [math.log(p[1][b] / p[0][b]) for b in range(N)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: the sum over its bigrams."""
    table = F.array(*map(F.lit, model))
    bound = F.transform(F.array(_codes(token)), lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.get(table, F.get(c, i - 1) * N + F.get(c, i))))
    return F.when(F.length(token) > 1, F.get(bound, F.lit(0))).otherwise(F.lit(0.0))


def secrets(docs: DataFrame, trained: Trained | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and all (arrays of spans by start, then kind; offsets in code points, end exclusive)."""
    own = id_and_text(docs, id_col, text_col)
    trained = trained or train(own)
    text, base = F.col("text"), F.col("base")
    rows = own.withColumn("base", base_spans(text))
    if not trained:
        return rows.select("doc_id", "base", base.alias("all"))
    random = lambda s: ~s["value"].rlike(UUID) & (ratio(s["value"], trained.ratios) > trained.threshold)
    return rows.select("doc_id", "base", spans.in_order(base, F.filter(spans.outside(spans.found(text, TOKEN, 3), base), random)).alias("all"))


def secret_counts(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    base, all_ = F.col("base"), F.col("all")
    return secrets(docs, **options).select("doc_id", *[spans.of_kind(all_, k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(spans.digest(base, KINDS), 256).alias("base_sha256"), spans.digest(all_, KINDS).alias("spans"))
