"""Licence scans: canonical digest lookup.

A text is brought to a canonical form line by line: A-Z to lower case, copyright
lines dropped, hyphens dropped, every other run of characters that are no ASCII
letters or digits to one space, equivalent spellings to one.  The canonical lines of
a text, joined, are digested (SHA-256) and hash-joined to the digests of known
licences; so is every single line, which finds the usual one-line notices.  Only
DataFrame functions; one pass, one row a document is shuffled.

Defined results: a null text is empty; a text without a letter or digit has the digest
of the empty text and no licence; equal rows are each reported; a digest with several
names takes the first; texts of any length are digested whole.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

# Spellings that mean the same, as whole words of the canonical form.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "favour": "favor",
    "https": "http",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "licencing": "licensing",
    "organisation": "organization",
    "organisations": "organizations",
    "programme": "program",
    "recognise": "recognize",
    "whilst": "while",
}
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that only names a holder of rights.
COPYRIGHT = r"^[^a-z0-9]*(copyright[ \t:]*(\(c\)|©|[0-9][0-9][0-9][0-9]|<year>|\[yyyy\])|\(c\)[ \t]*[0-9][0-9][0-9][0-9]|©).*$"

# Short licences and notices as published.
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", _GRANT_MIT),
    ("MIT", "MIT License\n" + _GRANT_MIT),
    ("MIT", "The MIT License (MIT)\n" + _GRANT_MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", f"{_BSD_TWO}\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_TWO}\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_TWO}\n{_BSD_NAME}\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_TWO}\n{_BSD_NAME}\n{_BSD_END}"),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]
# Digests of the canonical forms of longer licences and their usual headers, as published.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "169d8dc129e392d132307c38128c5d06fa653e6a38f0fe8d57adb099aff6e12a"),  # whole
    ("Apache-2.0", "23b0c2864cae1b701487ecb2e085716852ef16a61b1acc529508201ed15b2151"),  # terms, with their last line
    ("Apache-2.0", "e7cb6556aa68f6b49d85e0dcb7b2baa2e447d1ef1aa7841cf44b13972e98f397"),  # terms
    ("Artistic-1.0-Perl", "2ab1002587383e8f2f203c7473367b0db41ba84b8e3a9d991cf55eb0fd0ea009"),  # whole
    ("BSD-3-Clause", "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),  # whole
    ("CC0-1.0", "ceb532d86c46f36dc35f5de73f0d9cb155567c40c3fcbf707a26f949df16c999"),  # whole
    ("GFDL-1.2", "218deda3396c747a643fcf1b1fabc8070dac3b005a4578a3a2aca0a03530bec9"),  # whole
    ("GFDL-1.3", "e0ca36c34a6cb322569cdf0e7456a91c8557ea7740f9eb346d8df66594cbf5f4"),  # whole
    ("GPL-1.0", "0d448bb90f7522301d96e182cfbfc871eda3f369f11f9854162f55b427a698ff"),  # whole
    ("GPL-1.0", "e4d6cde7fc825469bc8e7056eb3d4f6107886891f2161f0c010889be6ce4bf07"),  # terms, with their last line
    ("GPL-1.0", "891534dbaae5e86b5d1153e43de690fc5aa9e74e02135ab9fbbc0891fa0998ac"),  # terms
    ("GPL-2.0", "cf51760dc09decc3f8d4873a5e7393899d71e16d3bf8bc60372d23df3b6086d6"),  # whole
    ("GPL-2.0", "6f04be276689776d53dec0b62947a5bad478788bceeba6955cc8cebadf850de7"),  # terms, with their last line
    ("GPL-2.0", "67321e9d3d07b88b4244017b7f382520e5f1ddf893c5a9741c610c88c9a623b4"),  # terms
    ("GPL-3.0", "a94bd6c982192d99ca2070d633564e82009a713683086b27ef3ffa24cec0fe1c"),  # whole
    ("GPL-3.0", "466911bc73d6ad6018aa1cf1ada78f272c79ae395eeba2c3f755535572fef688"),  # terms, with their last line
    ("GPL-3.0", "8b94160dda20c41a80b10cbb1114ac9a169d2cffd1d028da3306bde0a5d42395"),  # terms
    ("LGPL-2.0", "6ede925fb751c1bfa72408e9226b26c41b33d95a81f54e233fa3dfedc0bec2f5"),  # whole
    ("LGPL-2.0", "b98e6545914ff43fb73620a7e58bbfff3a73eec2bf3375dd86c6066950d36987"),  # terms, with their last line
    ("LGPL-2.0", "6f7ba44dfcbfe720d8f5b68666082bf52696e5e53d8df0c01f9938b00656b3e8"),  # terms
    ("LGPL-2.1", "423a536e3a05f3687daec5e10a14b906757bcd7d407b4998ede8b084cbdfeac1"),  # whole
    ("LGPL-2.1", "9248f12a61d75e2b1a79176a89a3df95e36e318f99fa013ce41264028210afaa"),  # terms, with their last line
    ("LGPL-2.1", "2b5c0d63e549180d5c94652809aaa527e9c67ef170997e9c7c4ed356bea7175e"),  # terms
    ("LGPL-3.0", "a73ecf7261e42e15cefe1a19defface65a2b142e089cfbcb9218a595a27853c9"),  # whole
    ("MPL-1.1", "8207da9caee17d0b6e41bf6671b3ad5c9a760971dc16c4992543a2fa7eded463"),  # whole
    ("MPL-2.0", "4cf3cec9cbb2d1eadf13b9ac43726980c148eba815ce574e56e7689d30d36b23"),  # whole
    ("Apache-2.0", "d2f2414d80967b4a02b8a85332921699521d431b2a260e64317da881eba6656e"),  # header
    ("GPL-2.0", "867273c04915bd67541690a87c4a88132931c0124c80f8f8b200c727fc486064"),  # header
    ("GPL-3.0", "b1165b3a9c3ac2638585a8adb6e0c10814b7d97627160747134355b2690ff5af"),  # header
    ("LGPL-2.1", "6d40f34cf05aeff6f8f8b927336f5e5679a0fee548129c2398e047e1a97b5a1b"),  # header
]
#: More names than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 10_000


def canonical(text: str) -> str:
    """The canonical form, in Python; for known texts and tests."""
    out = []
    for line in text.split("\n"):
        low = line.translate(str.maketrans(_UPPER, _SMALL))
        low = re.sub(COPYRIGHT, "", low).replace("-", "")
        words = [SPELLINGS.get(w, w) for w in re.sub(r"[^a-z0-9]+", " ", low).split()]
        if words:
            out.append(" ".join(words))
    return " ".join(out)


def known_digests(texts: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = KNOWN_DIGESTS) -> list[tuple[str, str]]:
    """(digest, licence), the first name of each digest."""
    found: dict[str, str] = {}
    for name, text in texts:
        found.setdefault(hashlib.sha256(canonical(text).encode()).hexdigest(), name)
    for name, digest in digests:
        found.setdefault(digest, name)
    return sorted(found.items())


def _canonical_line(line: Column) -> Column:
    low = F.regexp_replace(F.translate(line, _UPPER, _SMALL), COPYRIGHT, "")
    text = F.trim(F.regexp_replace(F.translate(low, "-", ""), "[^a-z0-9]+", " "))
    # only a line with one of the spellings is taken apart
    some = r"\b(" + "|".join(SPELLINGS) + r")\b"
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.when(text.rlike(some), F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")).otherwise(text)


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license_id (of the whole text), line_licenses, n_lines for every document.

    ``known``: (digest of a canonical text, licence name); by default those of ``KNOWN`` and ``KNOWN_DIGESTS``.
    """
    spark = docs.sparkSession
    known = known_digests() if known is None else known
    names = spark.createDataFrame(known, "digest string, license_id string")
    if len(known) <= BROADCAST_ROWS:
        names = F.broadcast(names)
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), _canonical_line), lambda x: x != "")
    each = id_text(docs, doc_id, text).select("doc_id", lines.alias("lines"))
    each = each.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("whole"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("parts"))
    units = each.select("doc_id", "whole", F.posexplode(F.concat(F.array("whole"), "parts")).alias("unit", "digest")).join(names, "digest", "left")
    hit = (F.col("unit") > 0) & F.col("license_id").isNotNull()
    found = units.groupBy("doc_id", "whole").agg(
        F.sum(F.when(F.col("unit") == 0, 1)).alias("copies"),
        F.max(F.when(F.col("unit") == 0, F.col("license_id"))).alias("license_id"),
        F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("license_id")))), ",").alias("line_licenses"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("lines"),
    )
    # rows of equal id and text were taken together: one row for each again
    one = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select("doc_id", F.col("whole").alias("digest"), "license_id", "line_licenses", (F.col("lines") / F.col("copies")).cast("long").alias("n_lines"))


def oracle_sql() -> str:
    """The same scan of ``documents`` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ",\n    ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(KNOWN))
    longer = ",\n    ".join(f"({i}, '{name}', '{digest}')" for i, (name, digest) in enumerate(KNOWN_DIGESTS, len(KNOWN)))
    spell = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS.items())
    low = f"regexp_replace(translate(line, '{_UPPER}', '{_SMALL}'), {quoted(COPYRIGHT)}, '', 'gs')"
    plain = f"trim(regexp_replace(replace({low}, '-', ''), '[^a-z0-9]+', ' ', 'g'))"
    spelled = f"list_aggregate(list_transform(string_split(plain, ' '), lambda w: coalesce(MAP {{{spell}}}[w], w)), 'string_agg', ' ')"
    return f"""
WITH given(n, license_id, text) AS (VALUES
    {known}),
texts AS (
    SELECT 'd' AS kind, doc_id AS id, NULL AS license_id, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT 'k', n, license_id, text FROM given),
lines AS (
    SELECT kind, id, license_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM texts),
plained AS (SELECT kind, id, license_id, place, {plain} AS plain FROM lines),
canon AS (SELECT kind, id, license_id, place, CASE WHEN regexp_matches(plain, '{"|".join(SPELLINGS)}') THEN {spelled} ELSE plain END AS line FROM plained),
whole AS (
    SELECT kind, id, any_value(license_id) AS license_id, sha256(coalesce(string_agg(line, ' ' ORDER BY place) FILTER (line <> ''), '')) AS digest FROM canon GROUP BY kind, id),
longer(n, license_id, digest) AS (VALUES
    {longer}),
known AS (SELECT digest, arg_min(license_id, id) AS license_id FROM (SELECT id, license_id, digest FROM whole WHERE kind = 'k' UNION ALL SELECT n, license_id, digest FROM longer) GROUP BY digest),
hits AS (
    SELECT c.id, k.license_id FROM canon c JOIN known k ON sha256(c.line) = k.digest WHERE c.kind = 'd' AND c.line <> ''),
by_doc AS (SELECT id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n_lines FROM hits GROUP BY id)
SELECT w.id AS doc_id, w.digest, k.license_id, coalesce(b.line_licenses, '') AS line_licenses, CAST(coalesce(b.n_lines, 0) AS BIGINT) AS n_lines
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN by_doc b ON w.id = b.id WHERE w.kind = 'd'
"""
