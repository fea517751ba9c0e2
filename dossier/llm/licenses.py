"""Licence scans by canonical digest lookup (op10).

A text's canonical form is lower case, without copyright notices, with equivalent spellings made one, punctuation and white
space reduced to single spaces, and version numbers kept. Its SHA-256 is hash-joined to the digests of known licence texts.
Copyright notices are lines that name a year, a sign or a holder; a wrapped line of a licence's body that begins with the
word is none.

Besides a document's entire text, each of its lines that speaks of a licence is looked up the same way, since a document
mostly carries a notice in a line of its own; and where no line of a paragraph is known, the whole paragraph, since a notice
may be wrapped. Lookup is of entire texts, paragraphs and lines, never of parts.

Defined results: a null or empty text has the digest of the empty string and no licence. Repeated rows give repeated rows;
nothing is grouped but the list of known texts. Extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lines that are a copyright notice: after the word a sign, year, placeholder or "by", or nothing but a name; a sign and a
#: year; or that all rights are reserved. Comment marks may come first.
COPYRIGHT_LINE = (
    r"^[ \t/*#;]*(([Cc]opyright|COPYRIGHT)[ \t:,]*(\([cC]\)|©|[0-9]{4}|<|\[|\{|[Bb]y )[^\n]*|(\([cC]\)|©)[ \t]*([0-9]{4}|<|\[)[^\n]*"
    r"|[Cc]opyright[ \t]+[A-Z][A-Za-z.,'-]*([ \t]+([A-Z&][A-Za-z.,'-]*|and|of|the))*[ \t\r]*|[Aa]ll [Rr]ights [Rr]eserved\.?[ \t\r]*)$"
)
#: Steps on lower-case text, in order; fixed values. Patterns mean the same to Java and RE2.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F©\x{2010}-\x{205E}\x{00A0}]+"
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("https ", ""), ("http ", "")]
VERSION = r"(^| )(version|ver|v) ?([0-9])"
POINT_ZERO = r"([0-9]) 0( |$)"

_GRANT_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS_BSD = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Licence texts and notices by SPDX id; public texts, fixed values. Long licences are in DIGESTS.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License " + _GRANT_MIT + " " + _AS_IS_MIT),
    ("MIT", _GRANT_MIT + " " + _AS_IS_MIT),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS_ISC),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS_ISC),
    ("MIT", "The MIT License (MIT) " + _GRANT_MIT + " " + _AS_IS_MIT),
    ("MIT", "The MIT License " + _GRANT_MIT + " " + _AS_IS_MIT),
    *((name, head + body) for name, title, numbered in (("BSD-2-Clause", "BSD 2-Clause License ", _BSD_HEAD + _AS_IS_BSD), ("BSD-3-Clause", "BSD 3-Clause License ", _BSD_HEAD + _BSD_THIRD + _AS_IS_BSD))
        for head in ("", title) for body in (numbered, numbered.replace(" 1. ", " ").replace(" 2. ", " ").replace(" 3. ", " "))),
    *((name, head + body) for name, title, body in (
        ("Zlib", "zlib License ", _ZLIB), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 ", _BOOST), ("Unlicense", "", _UNLICENSE),
        ("Unlicense", "", _UNLICENSE + " For more information, please refer to <https://unlicense.org>"), ("Unlicense", "", _UNLICENSE + " For more information, please refer to <https://unlicense.org/>")) for head in {"", title}),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AS_IS_ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]

#: Digests of whole licences' canonical forms by SPDX id; fixed values, made by `digest` of the public texts that Linux
#: distributions and Python packages carry (Apache-2.0 with and without its appendix).
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "269880b05af75f05d146dc9975dd01eb5e4b492ae62835ba5f080ea80562fa8b"),
    ("Apache-2.0", "a3ed061dfa113730132756788ae06bff43c340237343b4c3a14378f7d1316157"),
    ("Apache-2.0", "f85c2352739831fd74acf9d61f55483b88b50e441c4a8a3c70592d2c30a9f6fa"),
    ("Artistic-1.0-Perl", "22d243c2fc90be48e05353a423c45b7c3be42e06805d8ad73eb2a4debe364967"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "ce1fbaffac9693dbaec03cc34ce3d04dc46f630d58e7bcbb6579c3f8277f0aa9"),
    ("CC0-1.0", "edfcae7e301ff2624e2aa67f2bb0171018ce8aa6befdf1154ec830eb85592f3d"),
    ("GFDL-1.2", "9153c6b871a82cfd5fe48618ee0eca5662abe5f4308e931b4063fe1940c8cc52"),
    ("GFDL-1.3", "7056fd710d72e71e247479f70736478d54a7df3010b31ef47c90060b0a843a15"),
    ("GPL-1.0", "09d5edd1d5949eb9d955904f8f091d7fe507fefe7b5f55be67d1168f66981120"),
    ("GPL-2.0", "02a257297733ef4b9db6b9992b5410835a77ef6af0555dd54340ac9ae0ef4979"),
    ("GPL-3.0", "7e5c48bfc0ead9edf832c6285a6c80e4205f980e14b82251965aec483e7260b7"),
    ("LGPL-2.0", "7910994d633a562ed1e5fbf186e5cbad404168bef4c0153edfcd9bc45d636cc9"),
    ("LGPL-2.1", "ad1c1812f6afd45d1be54c9c4f4428c0ebea04f040dfee7d55301c3c5fa94e1a"),
    ("LGPL-3.0", "297070d60ea6411d4a894602e68d90071b22d5d24b039421e865ee2caeaa5077"),
    ("MPL-1.1", "f21651b29a2e85f8463cd68d9809189841f9e10c3088258074195831ca8594f3"),
    ("MPL-2.0", "4f7d27efa0911680b111eeb5c457ab5bad18bb7b57cb74a8f3d013538a95bf9f"),
]
#: Lines worth a lookup: every known line notice has one of these in its lower-case form.
SPEAKS = r"(?i)licen[sc]|cc0|spdx"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), f"(?md){COPYRIGHT_LINE}", "")
    out = F.regexp_replace(F.translate(out, UPPER, UPPER.lower()), PUNCTUATION, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, VERSION, "$1$3")
    return F.trim(F.regexp_replace(out, POINT_ZERO, "$1$2"))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(__digest, license) of each known text, one licence for each digest."""
    texts = spark.createDataFrame(known, "license string, text string").select(digest(F.col("text")).alias("__digest"), "license")
    whole = spark.createDataFrame(digests, "license string, __digest string").select("__digest", "license")
    return texts.unionAll(whole).groupBy("__digest").agg(F.min("license").alias("license"))


#: Between paragraphs.
BLANK = r"\n[ \t\r]*\n"


def licenses(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """doc_id, canonical_sha256, license of the entire text (null if none), n_notices and the licences of its notices."""
    listed_rows = known_digests(docs.sparkSession, known, digests)
    pairs = [(r["__digest"], r["license"]) for r in listed_rows.collect()]  # as many as the list of known texts
    listed = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    text = F.coalesce(F.col("text"), F.lit(""))
    look = lambda x: F.try_element_at(listed, digest(x))

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.split(p, "\n"), lambda x: x.rlike(SPEAKS))
        by_line = F.filter(F.transform(lines, look), lambda x: x.isNotNull())
        whole = F.filter(F.array(look(p)), lambda x: x.isNotNull())
        # a one-element array binds what the lines gave once
        return F.flatten(F.transform(F.array(by_line), lambda f: F.when((F.size(f) > 0) | ~F.contains(p, F.lit("\n")), f).otherwise(whole)))

    speaking = F.filter(F.split(text, BLANK), lambda p: p.rlike(SPEAKS))
    found = F.when(text.rlike(SPEAKS), F.flatten(F.transform(speaking, paragraph))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", digest(text).alias("canonical_sha256"), found.alias("found"))
    named = rows.select("doc_id", "canonical_sha256", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
    return named.join(F.broadcast(listed_rows), F.col("canonical_sha256") == F.col("__digest"), "left").select("doc_id", "canonical_sha256", "license", "n_notices", "notices")


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(coalesce({text}, ''), {quote('(?m)' + COPYRIGHT_LINE)}, '', 'g')"
    out = f"regexp_replace(translate({out}, '{UPPER}', '{UPPER.lower()}'), {quote(PUNCTUATION)}, ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    out = f"regexp_replace({out}, {quote(VERSION)}, '\\1\\3', 'g')"
    return f"trim(regexp_replace({out}, {quote(POINT_ZERO)}, '\\1\\2', 'g'))"


def sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known)
    whole = "".join(f" UNION ALL SELECT '{d}', '{name}'" for name, d in digests)
    return f"""
WITH known AS (SELECT d, min(l) AS license FROM (SELECT sha256({_sql_canonical("t")}) AS d, l FROM (VALUES {values}) v(l, t){whole}) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM documents),
paragraphs AS (SELECT r, i, p FROM (SELECT r, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (SELECT r, string_split_regex(text, '{BLANK}') AS ps FROM docs WHERE regexp_matches(text, '{SPEAKS}'))) WHERE regexp_matches(p, '{SPEAKS}')),
lines AS (SELECT r, i, unnest(string_split(p, chr(10))) AS line FROM paragraphs),
by_line AS (SELECT r, i, license FROM lines JOIN known ON sha256({_sql_canonical("line")}) = d WHERE regexp_matches(line, '{SPEAKS}')),
wrapped AS (SELECT r, i, license FROM paragraphs ANTI JOIN by_line USING (r, i) JOIN known ON sha256({_sql_canonical("p")}) = d WHERE contains(p, chr(10))),
found AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT * FROM by_line UNION ALL SELECT * FROM wrapped) GROUP BY r)
SELECT doc_id, canonical_sha256, license, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON canonical_sha256 = d LEFT JOIN found USING (r)
"""
