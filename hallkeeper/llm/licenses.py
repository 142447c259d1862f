"""Licence texts by canonical digest, with DataFrame functions only.

A text is brought into a canonical form - lower case, copyright lines gone, equivalent spellings made equal, all but
letters and digits turned into single spaces - and its digest is looked up among those of known licences. Whole
documents are looked up, and each of their lines as a text of its own, since notices of one line are common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short licences, and the notices licences ask for.
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
    "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License."
)
KNOWN = (
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_BODY),
    ("ISC", _ISC_BODY),
    ("ISC", "ISC License\n\n" + _ISC_BODY),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)

# Spellings that mean the same, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("favour", "favor"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("https://", "http://"),
    ("version 2.0", "2.0"),
    ("version 3.0", "3"),
    ("version 3", "3"),
    ("version 2", "2"),
    ("v. 2.0", "2.0"),
    ("v2.0", "2.0"),
)

_NO_HOLDER = ("notice", "notices", "holder", "holders", "owner", "owners", "license", "licence", "law", "laws", "and", "or", "statement", "interest")


def _other_word(words: tuple[str, ...]) -> str:
    """A pattern, without look-ahead, for the beginning of a word that is none of ``words``."""
    firsts = sorted({w[0] for w in words if w})
    ways = [c + _other_word(tuple(w[1:] for w in words if w[:1] == c)) for c in firsts]
    ways.append(f"[^{''.join(firsts)}\\P{{L}}]" if firsts else r"\p{L}")
    if "" not in words:
        ways.append(r"(?:[^\p{L}\n]|$)")
    return "(?:" + "|".join(ways) + ")"


COPYRIGHT_LINE = (
    r"(?m)^[^a-z0-9\n]*(?:(?:copyright|\(c\)|©)[^\n]*(?:19|20)[0-9]{2}|copyright *(?:\(c\)|©|\[|<)|©"
    r"|copyright +" + _other_word(_NO_HOLDER) + r")[^\n]*$"
)
"""A line that begins so, in lower case, is left out: it holds a year or a holder."""


def canonical(text: Column) -> Column:
    """The canonical lines of a text: words parted by one space, lines by one line end, empty lines gone."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def _digest(text: Column) -> Column:
    """Of a whole canonical text: line ends are spaces."""
    return F.sha2(F.replace(text, F.lit("\n"), F.lit(" ")).cast("binary"), 256)


def known_digests(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license_id) of known licences; as many rows as the given list has, so it may be broadcast."""
    table = docs.sparkSession.createDataFrame(list(known), "license_id string, license_text string")
    return table.select(_digest(canonical(F.col("license_text"))).alias("digest"), "license_id").distinct()


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """One row per document: doc_id, digest, license_id of the whole text, line_licenses, n_license_lines.

    ``license_id`` is null if the whole text is no known licence. ``line_licenses`` are the distinct licences of
    lines, sorted and comma-joined, empty if there are none. A null text is empty and no licence. Repeated rows are
    judged each; other columns of ``docs`` are left aside.
    """
    digests = known_digests(docs, known)
    texts = docs.select("doc_id", canonical(F.col("text")).alias("canonical")).withColumn(
        "digest", _digest(F.col("canonical"))
    )
    # The lines that are licences, by text: equal texts have equal lines, so a digest of the lines names them.
    keyed = texts.withColumn("lines_key", F.sha2(F.col("canonical").cast("binary"), 256))
    lines = keyed.select("lines_key", F.posexplode(F.split("canonical", "\n")).alias("at", "line"))
    lines = lines.withColumn("line_digest", F.sha2(F.col("line").cast("binary"), 256))
    named = digests.select(F.col("digest").alias("line_digest"), F.col("license_id").alias("line_license"))
    found = (
        lines.join(F.broadcast(named), "line_digest")
        .groupBy("lines_key", "at").agg(F.min("line_license").alias("line_license"))
        .groupBy("lines_key")
        .agg(
            F.array_join(F.array_sort(F.collect_set("line_license")), ",").alias("line_licenses"),
            F.count(F.lit(1)).alias("n_license_lines"),
        )
    )
    whole = keyed.select("doc_id", "digest", "lines_key").join(F.broadcast(digests), "digest", "left")
    return whole.join(found, "lines_key", "left").select(
        "doc_id",
        "digest",
        "license_id",
        F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
    )


def oracle(table: str = "documents") -> str:
    """The same result as SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        out = f"regexp_replace({out}, {quoted(COPYRIGHT_LINE)}, '', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        out = f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')"
        return f"trim({out}, chr(32) || chr(10))"

    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
    WITH known AS (
        SELECT DISTINCT sha256(replace({form('t')}, chr(10), ' ')) AS digest, name FROM (VALUES {rows}) AS k(name, t)
    ), texts AS (
        SELECT row_number() OVER () AS n, doc_id, {form('text')} AS c FROM {table}
    ), lines AS (
        SELECT n, sha256(unnest(string_split(c, chr(10)))) AS digest FROM texts
    ), found AS (
        SELECT n, string_agg(DISTINCT name, ',' ORDER BY name) AS line_licenses, count(*) AS n_license_lines
        FROM lines JOIN known USING (digest) GROUP BY n
    )
    SELECT doc_id, sha256(replace(c, chr(10), ' ')) AS digest, name AS license_id,
        coalesce(line_licenses, '') AS line_licenses, coalesce(n_license_lines, 0) AS n_license_lines
    FROM texts LEFT JOIN known ON known.digest = sha256(replace(c, chr(10), ' ')) LEFT JOIN found USING (n)
    """
