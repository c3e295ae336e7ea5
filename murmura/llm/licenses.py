"""License scans by canonical digest, with DataFrame functions only.

A text is normalised in case, punctuation, copyright lines and equivalent
spellings; the digest of the whole result is joined to the digests of known
licences.  Single lines of a document are looked up the same way, since notices
of one line stand inside longer documents.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pattern and replacement, in order; the same in Java's and RE2's dialects.
STEPS = [
    (r"(^|\n)[ \t#*/;>-]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    (r"licence", "license"),
    (r"licens(ed|ing)", "license"),
    (r"https", "http"),
    (r"sub-?licens", "sublicens"),
    (r"non-?infring", "noninfring"),
    (r"acknowledgement", "acknowledgment"),
    (r"favour", "favor"),
    (r"version ([0-9])", "v$1"),
    (r"([0-9])\.0([^0-9.]|$)", "$1$2"),
    (r"[^\p{L}\p{N}]+", " "),
]

#: Known texts, at most.
MOST_KNOWN = 10_000

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Apache-2.0", APACHE_NOTICE),
]

# Digests of whole licences in their official wording and line breaks (``digest`` of the published plain text).
WHOLE = [
    ("Apache-2.0", "818596045fefc293ff99c1473fa62c6b7aeacd6427c201796adddf738457abd5"),
    ("CC0-1.0", "799ae186d902017b1dfb6c9496f02c4a1473be6430f0dd77208088fd74ff23d4"),
    ("GFDL-1.3-only", "f689383640198ef813444a795ca6f7532a66111abc3230a6b4cc5558de47e355"),
    ("GPL-2.0-only", "c02cd12db8d74827483eabb87bd82fba71d3f148d08b28086b001e356bd71dfc"),
    ("GPL-3.0-only", "f57df2a6e9f3aa519d90e6845aaaeab821b8accb3e24d8f00c21722a39e9135f"),
    ("LGPL-2.1-only", "4d0460616090cd093be1cb9e0c451733f5a1177a23adb5201195789ee9440d7c"),
    ("LGPL-3.0-only", "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6"),
    ("MPL-2.0", "b4bfc44b0418bb0cc5ff258710417a766aba39995650e1f0437a70e9e1f39b10"),
]

NAMES = [
    ("Apache-2.0", "the Apache License, Version 2.0"), ("Apache-2.0", "the Apache License 2.0"), ("Apache-2.0", "Apache-2.0"),
    ("MIT", "the MIT License"), ("MIT", "MIT"), ("ISC", "the ISC License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("GPL-2.0-only", "the GNU General Public License, version 2"), ("GPL-3.0-only", "the GNU General Public License, version 3"),
    ("LGPL-3.0-only", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0-only", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
]
SUBJECTS = ["", "This work is ", "This file is ", "This software is ", "This project is "]
VERBS = ["Licensed under ", "Released under ", "Distributed under "]


def known_texts() -> list[tuple[str, str]]:
    """``(SPDX id, text)`` of whole licences and of one-line notices."""
    lines = [(spdx, f"{s}{v}{name}") for (spdx, name), s, v in product(NAMES, SUBJECTS, VERBS)]
    marks = [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in sorted({x for x, _ in NAMES})]
    return TEXTS + lines + marks


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """``(digest, SPDX id)`` of the known texts, one for each digest.

    ``known`` are the caller's texts instead of those here, ``MOST_KNOWN`` at most:
    the digests travel with the plan.
    """
    texts, whole = (known_texts(), [(d, spdx) for spdx, d in WHOLE]) if known is None else (known, [])
    if len(texts) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    table = spark.createDataFrame(texts, "license_id string, text string")
    rows = table.select(digest(F.col("text")).alias("d"), "license_id").union(spark.createDataFrame(whole, "d string, license_id string"))
    return [tuple(r) for r in rows.groupBy("d").agg(F.min("license_id").alias("license_id")).orderBy("d").collect()]


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, text_digest, license_id, line_licenses and n_license_lines of every row.

    ``license_id`` is the known licence that the whole text is, or null;
    ``line_licenses`` are those that whole lines of it name, sorted.  Null texts
    have a null digest and no lines; empty ones, and those of copyright lines
    only, have the digest of nothing, which is no licence.  Ids may be null or
    repeated, an empty table gives an empty result, other columns are ignored.
    """
    spark = docs.sparkSession
    found = known_digests(spark, known)
    small = F.broadcast(spark.createDataFrame(found, "_digest string, license_id string"))
    # a set finds a digest faster than a map does, which is searched from its start
    known_set = [d for d, _ in found]
    names = F.create_map(*[F.lit(x) for pair in found for x in pair]) if found else F.create_map().cast("map<string,string>")
    lines = F.filter(F.transform(F.split(F.col("text"), "\n"), digest), lambda x: x.isin(known_set))
    hits = F.transform(lines, lambda x: F.try_element_at(names, x))
    rows = docs.select("doc_id", digest(F.col("text")).alias("text_digest"), F.coalesce(hits, F.array().cast("array<string>")).alias("_hits"))
    return rows.join(small, F.col("text_digest") == F.col("_digest"), "left").select(
        "doc_id", "text_digest", "license_id", F.array_sort(F.array_distinct("_hits")).alias("line_licenses"), F.size("_hits").cast("long").alias("n_license_lines")
    )


def canonical_sql(text: str) -> str:
    """``canonical`` in DuckDB's SQL."""
    out = f"lower({text})"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"trim({out}, ' ')".replace("'\n'", "chr(10)")


def scan_sql() -> str:
    """``scan`` over ``documents`` in DuckDB's SQL."""
    known = ",\n".join("('" + spdx + "', '" + text.replace("'", "''") + "')" for spdx, text in known_texts())
    whole = ", ".join(f"('{spdx}', '{d}')" for spdx, d in WHOLE)
    return f"""
WITH known(license_id, text) AS (VALUES {known}),
whole(license_id, d) AS (VALUES {whole}),
every AS (SELECT sha256({canonical_sql("text")}) AS d, license_id FROM known UNION ALL SELECT d, license_id FROM whole),
digests AS (SELECT d, min(license_id) AS license_id FROM every GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canonical_sql("text")}) AS text_digest FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
hits AS (
  SELECT r, list_sort(list_distinct(list(d.license_id))) AS ids, count(*) AS n
  FROM lines JOIN digests d ON d.d = sha256({canonical_sql("line")})
  GROUP BY r)
SELECT doc_id, text_digest, d.license_id, coalesce(h.ids, []::VARCHAR[]) AS line_licenses, coalesce(h.n, 0)::BIGINT AS n_license_lines
FROM docs LEFT JOIN digests d ON d.d = text_digest LEFT JOIN hits h USING (r)
"""
