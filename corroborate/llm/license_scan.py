"""License scans: canonical digest lookup. DataFrame functions only.

A text's canonical form has lower-case letters, no lines of copyright holders (a bare "(c)" makes none), one spelling of words that have several, and single
blanks for anything but letters and digits. Its digest is joined with the digests of known licences, made the same way.
Entire texts are looked up; so is each line, since a notice often stands on a line of its own among other text. Only
lines of a known licence's length are digested (others can't be equal), and the table of known digests has a fixed size.

Entire texts are also looked up as files, in a second form: wrapped at any width, with or without title lines on top,
comment marks, typographic quotes and lines of a copyright holder. Such a line has a sign, "(c)", a year or a bracket
after the word, so lines of a licence that begin with the word stay. The table of files has the texts below and those of
``license_texts``, and no others. ``digest`` is of the first form.

Null and empty texts have the digest of an empty form and no licence; repeated rows each get a row; an empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_and_text

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of a copyright holder: the word with a sign, "(c)" or a bracket after it, or the word or a sign with a year behind it.
COPYRIGHT = r"\n[^a-z0-9\n]*((portions )?copyright[ \t:,]*(\(c\)|©|[\[<{])|((portions )?copyright|©|\(c\))[^\n]*[^0-9\n](19|20)[0-9][0-9])[^\n]*"
BETWEEN = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
#: Spellings taken as equal.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("per cent", "percent"), ("https:", "http:"), ("&", " and "), ("copyright holder", "copyright owner"), ("analogue", "analog"), ("acknowledgement", "acknowledgment")]
#: Known licences and notices, as texts.
KNOWN = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0-line": "Released under CC0 1.0.",
}


# Fixed values of the second form: characters taken as equal; lines left out; titles left out on top.
_TYPED, _PLAIN = "\u201c\u201d\u2018\u2019\u2013\u2014\u2022\u00a0\ufeff\r", "\"\"''--*  \n"
_YEAR = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"
HOLDER = rf"\n[^a-z0-9\n]*(?:(?:portions )?copyright[ \t:,]*(?:\(c\)|©|[\[<{{]|[^\n]*{_YEAR})|©|\(c\)[^a-z0-9\n]*{_YEAR}|all rights reserved[^a-z0-9\n]*(?=\n|$)|spdx-license-identifier:)[^\n]*"
_BSD = "new|revised|modified|simplified|new or revised|zero clause"
TITLES = [
    r"(?:the )?(?:mit|isc|zlib|expat|mit/x11|zlib/libpng) licen[sc]e(?: \((?:mit|isc|zlib|expat|mit/x11)\))?",
    rf"(?:the )?(?:(?:{_BSD}) )?bsd(?:[ -][0-3][ -]clause)?(?: \"?(?:{_BSD})\"?)? licen[sc]e",
    rf"(?:the )?(?:bsd[ -])?(?:[0-3]|zero)[ -]clause(?: bsd)?(?: \"?(?:{_BSD})\"?)? licen[sc]e(?: \(0bsd\))?",
    r"(?:the )?unlicense",
    r"licen[sc]e",
]
HEAD = rf"^(?:\n[^a-z0-9\n]*(?:{'|'.join(TITLES)})[^a-z0-9\n]*(?=\n|$)){{1,6}}"
#: Every known licence has one of these words; texts without any aren't put in the second form.
WORDS = ["licen", "software", "cc0"]


@cache
def files() -> list[tuple[str, str]]:
    """(license_id, text) of the published texts, with variants that are as common: list marks in place of numbers (BSD),
    "and" in place of "and/or" (ISC), no appendix (Apache)."""
    found = [(p.stem, p.read_text("utf-8")) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]
    text = dict(found)
    found += [(k, re.sub(r"(?m)^[0-9]\. ", "* ", text[k])) for k in ("bsd-2-clause", "bsd-3-clause")]
    found += [("isc", KNOWN["isc"].replace("and/or", "and")), ("apache-2.0", text["apache-2.0"].split("APPENDIX:")[0])]
    return found


def by_lines(text: Column) -> Column:
    """Canonical form with line ends kept."""
    x = F.regexp_replace(F.concat(F.lit("\n"), F.translate(text, _A, _Z)), COPYRIGHT, "\n")
    x = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, x)
    return F.regexp_replace(x, BETWEEN, " ")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def as_file(text: Column) -> Column:
    """Canonical form of an entire text that may be a licence file."""
    x = F.regexp_replace(F.concat(F.lit("\n"), F.translate(text, _A + _TYPED, _Z + _PLAIN)), HOLDER, "\n")
    x = F.regexp_replace(F.regexp_replace(x, r"\n[^a-z0-9\x{80}-\x{10FFFF}]*\n", "\n"), HEAD, "\n")
    x = F.regexp_replace(x, r"[ \t]*\n[\s*#/;%!|>-]*|[ \t]{2,}", " ")
    x = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, x)
    return F.trim(F.regexp_replace(x, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def file_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> dict[str, str]:
    """On the driver: the licence of each digest of the second form."""
    rows = spark.createDataFrame([*sorted(known.items()), *files()], "license_id string, text string")
    return {r.digest: r.license_id for r in rows.select("license_id", F.sha2(as_file(F.col("text")), 256).alias("digest")).collect()}


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """(digest, license_id, length) of each known licence."""
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, text string")
    form = whole(by_lines(F.col("text")))
    return rows.select("license_id", F.sha2(form, 256).alias("digest"), F.length(form).alias("length"))


def licenses(docs: DataFrame, known: dict[str, str] = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, digest (of the entire text), license_id (null if unknown), line_licenses (those that stand on
    lines of their own, sorted, comma-joined; empty if none), n_lines (lines with such a licence)."""
    table = known_digests(docs.sparkSession, known)
    lengths = sorted({r.length for r in table.select("length").collect()})  # as many as the licences listed above
    lines = F.filter(F.transform(F.split(F.col("form"), "\n"), lambda x: F.trim(x)), lambda x: F.length(x).isin(lengths))
    as_map = lambda pairs: F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    lower = F.translate(F.col("text"), _A, _Z)
    may = reduce(lambda p, q: p | q, [lower.contains(w) for w in WORDS])
    file = F.when(may, F.try_element_at(as_map(file_digests(docs.sparkSession, known)), F.sha2(as_file(F.col("text")), 256)))
    rows = id_and_text(docs, id_col, text_col).select("doc_id", by_lines(F.col("text")).alias("form"), file.alias("file"))
    rows = rows.select("doc_id", "file", F.sha2(whole(F.col("form")), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("digests"))
    row = rows.join(F.broadcast(table.select("digest", "license_id")), "digest", "left")
    # The table is small and fixed: as a map in one row's reach, lines need neither explode nor shuffle.
    pairs = {r.digest: r.license_id for r in table.collect()}
    lookup = as_map(pairs)
    found = F.filter(F.transform("digests", lambda d: F.try_element_at(lookup, d)), lambda x: x.isNotNull())
    return row.select("doc_id", "digest", F.coalesce("license_id", "file").alias("license_id"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("line_licenses"), F.size(found).cast("long").alias("n_lines"))


def oracle_sql(known: dict[str, str] = KNOWN) -> str:
    """DuckDB SQL for ``licenses`` over the documents table."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = f"regexp_replace(chr(10) || translate(text, '{_A}', '{_Z}'), '{COPYRIGHT}', chr(10), 'g')"
    for a, b in SPELLINGS:
        form = f"replace({form}, {quote(a)}, {quote(b)})"
    form = f"regexp_replace({form}, '{BETWEEN}', ' ', 'g')"
    flat = r"trim(regexp_replace(form, '[ \n]+', ' ', 'g'))"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sorted(known.items()))
    return f"""
WITH k AS (SELECT license_id, sha256({flat}) AS digest FROM (SELECT license_id, {form} AS form FROM (VALUES {values}) v(license_id, text))),
d AS (SELECT doc_id, {form} AS form FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (SELECT doc_id, form, sha256({flat}) AS digest FROM d),
l AS (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM d),
m AS (SELECT doc_id, license_id FROM l JOIN k ON sha256(trim(line)) = digest),
g AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids, count(*) AS n FROM m GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(g.ids, '') AS line_licenses, coalesce(g.n, 0) AS n_lines
FROM w LEFT JOIN k USING (digest) LEFT JOIN g ON g.doc_id = w.doc_id"""
