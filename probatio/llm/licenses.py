"""License scan by canonical digest lookup, with DataFrame functions only.

A text is normalised (case, copyright lines, punctuation, equivalent spellings) and hashed; the digest of the entire
text is hash-joined to the digests of known licences. The same lookup runs over every line as an entire text of its
own, which finds one-line notices inside longer documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published licence texts and customary one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_TAIL = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + "." + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_2 + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
# Digests of further published licence texts, normalised as this module does.
DIGESTS = (
    ("Apache-2.0", "0d5838e6f6e5a374e58d608af5c01bc6a67cf18552dd7b346e5aef652b808ee9"),
    ("Artistic-1.0-Perl", "ddb49d591ecc4f65a223b9f53f330918100c323532a653c090d21b38e35a3a42"),
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3-only", "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0-only", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c"),
    ("GPL-2.0-only", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),
    ("GPL-3.0-only", "5272fb2d9117cba4ebb1b4a6612e61ab05ddddeff56bd30c3ac3798e23821b30"),
    ("LGPL-2.0-only", "b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c"),
    ("LGPL-2.1-only", "294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "35f82aa0956f78c6101000ae9662fa0b3da3f2baf46c72fa9abdf5f68325097c"),
    ("MPL-2.0", "92e88af3b436afcb6eef8128c9d1a7b2c6312377163ae31dfbacec094f33ab64"),
)
# Spellings that count as equal, applied in this order to the normalised text.
SPELLINGS = (
    ("licenc", "licens"),
    ("sub licens", "sublicens"),
    ("non infring", "noninfring"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)
_COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*"
_APART = r"[^\p{L}\p{N}\n]+"


def normalised_lines(text: Column) -> Column:
    """The lower-case text without copyright lines, words one space apart, lines still apart."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "$1"), _APART, " ")
    for spelt, as_ in SPELLINGS:
        plain = F.replace(plain, F.lit(spelt), F.lit(as_))
    return plain


def _entire(lines: Column) -> Column:
    """One line: words a single space apart, none at the ends."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def _digest(entire: Column) -> Column:
    return F.sha2(entire.cast("binary"), 256)


def known_digests(spark, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(digest, license_id) of the known texts and digests; of equal digests the first id by name stays."""
    texts = spark.createDataFrame(list(known), "license_id string, text string")
    made = texts.select("license_id", _digest(_entire(normalised_lines(F.col("text")))).alias("digest"))
    every = made.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return every.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """doc_id, text_digest, license_id, notices for every row of ``docs`` (doc_id, text).

    license_id: the licence whose normalised text the entire document is, else null. notices: the distinct ids of
    lines that are entire known texts, in order, comma-separated, empty if none. A null text counts as empty, which
    is no licence. Equal digests of two licences give the first id by name. Repeated rows are looked up each; other
    columns are ignored; no rows give no rows. ``known`` and ``digests`` are parameters of at most a few thousand
    entries: their digests are literals of the plan.
    """
    spark = docs.sparkSession
    lookup = known_digests(spark, known, digests).where(F.col("digest") != _digest(F.lit("")))
    rows = lookup.collect()
    ids = F.create_map(*(F.lit(x) for row in rows for x in (row.digest, row.license_id))) if rows else None
    lines = docs.select("doc_id", normalised_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    if ids is None:
        notices = F.lit("")
    else:
        found = F.transform(F.filter(F.split("lines", "\n"), lambda x: F.length(x) > 0), lambda x: F.try_element_at(ids, _digest(_entire(x))))
        notices = F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",")
    keyed = lines.select("doc_id", _digest(_entire(F.col("lines"))).alias("text_digest"), notices.alias("notices"))
    table = F.broadcast(spark.createDataFrame(rows, lookup.schema))
    return keyed.join(table, F.col("text_digest") == F.col("digest"), "left").select("doc_id", "text_digest", "license_id", "notices")


def _sql_quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(known=KNOWN, digests=DIGESTS) -> str:
    lines = r"regexp_replace(regexp_replace(lower(text), '(^|\n)[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*', '\1', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g')"
    for spelt, as_ in SPELLINGS:
        lines = f"replace({lines}, '{spelt}', '{as_}')"
    values = ", ".join(f"({_sql_quoted(i)}, {_sql_quoted(t)})" for i, t in known)
    given = ", ".join(f"({_sql_quoted(i)}, {_sql_quoted(d)})" for i, d in digests)
    return rf"""
WITH k AS (SELECT digest, min(license_id) AS license_id FROM (
             SELECT license_id, sha256(trim(regexp_replace({lines}, '[ \n]+', ' ', 'g'))) AS digest FROM (VALUES {values}) v(license_id, text)
             UNION ALL SELECT * FROM (VALUES {given}) g(license_id, digest)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, {lines.replace("lower(text)", "lower(coalesce(text, ''))")} AS lines FROM documents),
l AS (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM d),
n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
      FROM l JOIN k ON sha256(trim(line)) = digest WHERE length(line) > 0 GROUP BY r),
e AS (SELECT *, sha256(trim(regexp_replace(lines, '[ \n]+', ' ', 'g'))) AS text_digest FROM d)
SELECT e.doc_id, e.text_digest, k.license_id, coalesce(n.notices, '') AS notices
FROM e LEFT JOIN k ON e.text_digest = k.digest LEFT JOIN n USING (r)
"""
