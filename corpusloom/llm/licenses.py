"""Licence scans: Dice coefficient over word bigrams against licence templates (operator 4).

A text is normalised (ASCII letters in lower case, digits, all else one space) and cut into
units: each line, and the whole text where it has several lines. A unit is its set of word
bigrams A; a template with bigrams B fits at 2|A & B| / (|A| + |B|) >= THRESHOLD. As |A & B| is
at most the smaller set, only templates with t/(2 - t) <= |A|/|B| <= (2 - t)/t can fit; others
are never compared. All of it is row-wise DataFrame functions: no join, no shuffle.

Defined cases: a null or empty text fits nothing (licence null, dice 0). Of templates with equal
dice the first by name wins, of equal units the first. Repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.8

#: The wording of short licences as a whole, without names and years.
WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT_TEXT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + WARRANTY
)
ISC_TEXT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
)
BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ZLIB_TEXT = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)

#: The usual notices of common licences, and short licences whole.
TEMPLATES = {
    "BSD-2-Clause-text": BSD_CONDITIONS + BSD_WARRANTY,
    "BSD-3-Clause-text": BSD_CONDITIONS + BSD_THIRD + BSD_WARRANTY,
    "ISC-text": ISC_TEXT,
    "MIT-text": MIT_TEXT,
    "Zlib-text": ZLIB_TEXT,
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit."""
    words = F.split(unit, " ")
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df with license, dice, license_line (first such line from 1; 0: the whole text) and license_lines (how many fit), which replace columns of these names."""
    df = df.drop("license", "dice", "license_line", "license_lines")
    known = sorted((name, template_bigrams(t)) for name, t in (templates or TEMPLATES).items())
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    table_ = F.array(*[F.struct(F.lit(-i).alias("rank"), F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n"), F.lit(least * len(grams)).alias("low"), F.lit(most * len(grams)).alias("high")) for i, (name, grams) in enumerate(known)])
    fewest = int(min(len(g) for _, g in known) * least)
    largest = max(len(g) for _, g in known) * most

    def best(grams: Column) -> Column:
        n = F.size(grams)
        near = F.filter(table_, lambda t: (n >= t["low"]) & (n <= t["high"]))
        scored = F.transform(near, lambda t: F.struct((F.size(F.array_intersect(grams, t["grams"])) * 2.0 / (n + t["n"])).alias("dice"), t["rank"].alias("rank"), t["name"].alias("name")))
        return F.array_max(F.filter(scored, lambda s: s["dice"] >= threshold))

    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[^A-Za-z0-9\n]+", " "))
    lines = F.transform(F.split(plain, "\n"), lambda u, i: F.struct(F.trim(u).alias("unit"), (i + 1).alias("line")))
    whole = F.trim(F.regexp_replace(plain, "[ \n]+", " "))
    # a text of more words than the largest template allows can only fit by repeating itself; its distinct words decide
    lines = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.struct(whole.alias("unit"), F.lit(0).alias("line"))))).otherwise(lines)
    long_enough = F.filter(lines, lambda u: F.size(F.split(u["unit"], " ")) > fewest)
    graded = F.transform(long_enough, lambda u: F.struct(bigrams(u["unit"]).alias("grams"), u["line"].alias("line")))
    fitting = F.filter(graded, lambda u: F.size(u["grams"]) <= largest)
    hits = F.filter(F.transform(fitting, lambda u: F.struct(best(u["grams"]).alias("best"), (-u["line"]).alias("line"))), lambda h: h["best"].isNotNull())
    out = df.withColumn("_hits", hits)
    top = F.array_max(F.transform("_hits", lambda h: F.struct(h["best"]["dice"].alias("dice"), h["best"]["rank"].alias("rank"), h["line"].alias("line"), h["best"]["name"].alias("name"))))
    return out.withColumn("_top", top).select("*", F.col("_top.name").alias("license"), F.coalesce("_top.dice", F.lit(0.0)).alias("dice"), (-F.col("_top.line")).cast("int").alias("license_line"), F.size(F.filter("_hits", lambda h: h["line"] < 0)).alias("license_lines")).drop("_hits", "_top")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence that each document names, if any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "license", F.round("dice", 6).alias("dice"), "license_line", "license_lines")


def _templates_sql() -> str:
    rows = [(i, name, g) for i, (name, grams) in enumerate((n, template_bigrams(t)) for n, t in sorted(TEMPLATES.items())) for g in grams]
    return ", ".join(f"({i}, '{name}', '{g}')" for i, name, g in rows)


ORACLE_SQL = f"""
WITH templates(rank, name, gram) AS (VALUES {_templates_sql()}),
sizes AS (SELECT rank, name, count(*) AS n FROM templates GROUP BY ALL),
plain AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9' || chr(10) || ']+', ' ', 'g')) AS t FROM documents),
parts AS (SELECT doc_id, t, string_split(t, chr(10)) AS p FROM plain),
units AS (
  SELECT doc_id, i AS line, trim(p[i]) AS unit FROM parts, range(1, len(p) + 1) AS r(i)
  UNION ALL
  SELECT doc_id, 0, trim(regexp_replace(t, '[ ' || chr(10) || ']+', ' ', 'g')) FROM parts WHERE len(p) > 1),
words AS (SELECT doc_id, line, string_split(unit, ' ') AS w FROM units),
grams AS (SELECT DISTINCT doc_id, line, w[i] || ' ' || w[i + 1] AS gram FROM words, range(1, len(w)) AS r(i)),
counted AS (SELECT doc_id, line, count(*) AS n FROM grams GROUP BY ALL),
shared AS (SELECT doc_id, line, rank, name, count(*) AS k FROM grams JOIN templates USING (gram) GROUP BY ALL),
scored AS (SELECT s.doc_id, s.line, s.rank, s.name, 2.0::DOUBLE * k / (c.n + z.n) AS dice FROM shared s JOIN counted c USING (doc_id, line) JOIN sizes z USING (rank)),
fits AS (SELECT * FROM scored WHERE dice >= {THRESHOLD}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, rank, line) AS r FROM fits),
lines AS (SELECT doc_id, count(DISTINCT line) AS n FROM fits WHERE line > 0 GROUP BY doc_id)
SELECT d.doc_id, b.name AS license, coalesce(round(b.dice, 6), 0.0)::DOUBLE AS dice, b.line::INT AS license_line, coalesce(l.n, 0)::INT AS license_lines
FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (doc_id) LEFT JOIN lines l USING (doc_id)
"""
