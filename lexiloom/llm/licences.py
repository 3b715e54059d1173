"""Licence scan by canonical digests: a text, and each of its lines, is looked up among known licences and notices."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, whole_text

#: Pairs of spellings that count as equal, applied in this order to lower-cased text.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("whilst", "while"),
    ("&", " and "),
    ("https://", "http://"),
]
#: Licences by their whole text.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace(
    "\nTHIS SOFTWARE",
    "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE",
)
TEXTS["Unlicense"] = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
#: The header of a file under one of the family's licences, by name and version.
HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEXTS |= {
    "GPL-2.0-or-later": HEADER.format(name="General Public License", version=2),
    "GPL-3.0-or-later": HEADER.format(name="General Public License", version=3),
    "LGPL-2.1-or-later": HEADER.format(name="Lesser General Public License", version="2.1"),
    "LGPL-3.0-or-later": HEADER.format(name="Lesser General Public License", version=3),
    "AGPL-3.0-or-later": HEADER.format(name="Affero General Public License", version=3),
}
#: Whole texts in files of the licence's name.
TEXTS |= {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "texts").glob("*.txt"))}
#: One-line notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
}
#: A line that opens with a copyright mark and a year or another mark. Java ends lines at more signs than "\n" without d.
COPYRIGHT = r"(?dm)^[ \t]*(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4})[^\n]*$"
#: The mark of a list's item: a number, a letter in brackets or a bullet.
ITEM = r"(?dm)^[ \t]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\)|[*•+-])[ \t]+"
#: Lines in canonical form that aren't part of a licence's wording.
TITLES = [
    "all rights reserved",
    "license",
    "mit license",
    "the mit license",
    "the mit license mit",
    "mit license mit",
    "isc license",
    "the isc license",
    "isc license isc",
    "bsd license",
    "the bsd license",
    "bsd 2 clause license",
    "the bsd 2 clause license",
    "bsd 2 clause simplified license",
    "simplified bsd license",
    "bsd 3 clause license",
    "the bsd 3 clause license",
    "bsd 3 clause new or revised license",
    "new bsd license",
    "zero clause bsd license",
    "bsd zero clause license",
    "the unlicense",
    "unlicense",
]


def canonical_lines(text: Column) -> Column:
    """Each line in lower case, equal spellings, without punctuation and list marks, single spaces; copyright lines are empty."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), ITEM, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.transform(F.split(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "), "\n"), lambda x: F.trim(x))


def canonical(lines: Column) -> Column:
    """The whole text of canonical lines: those that aren't titles, in one line."""
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(TITLES)), " ")


def digest(text: Column) -> Column:
    return F.sha2(canonical(canonical_lines(text)), 256)


def known_licences(spark: SparkSession, texts: dict[str, str] = TEXTS, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """``digest, license``: one row for each known text or notice; equal canonical forms name the least licence."""
    rows = [*texts.items(), *((k, n) for k, names in notices.items() for n in names)]
    return spark.createDataFrame(rows, "license string, known string").groupBy(digest(F.col("known")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, digest, license, n_notices, notices`` for each row of ``docs`` (doc_id, text).

    license: that of the entire text, by its canonical digest; null if unknown. Titles, copyright lines, "All rights
    reserved" and list marks don't count in it. notices: the licences of single lines, distinct, sorted, comma-joined;
    n_notices counts such lines; every line is looked up. ``known`` (digest, license) is
    joined by digest, and broadcast by Spark only where its measured size allows. A null text is empty and unknown;
    repeated rows stay, as do null doc_ids; an empty table gives no rows; other columns aren't read.

    Texts are read once: what is written is the digests of the text and of its lines, with a number for the row, so that
    a lost executor can't number rows anew.
    """
    cut = docs.select("doc_id", canonical_lines(whole_text()).alias("lines"))
    rows = cut.select("doc_id", F.unhex(F.sha2(canonical(F.col("lines")), 256)).alias("digest"), F.transform("lines", lambda x: F.unhex(F.sha2(x, 256))).alias("lines"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    known = materialise(known.select(F.unhex("digest").alias("digest"), "license"), "known")
    found = (
        rows.select("row", F.explode("lines").alias("digest"))
        .join(known, "digest")
        .groupBy("row")
        .agg(F.count("*").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    )
    # written first: then both sides are plain exchanges
    out = rows.select("row", "doc_id", "digest").join(known, "digest", "left").join(materialise(found, "notices"), "row", "left")
    return out.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


SPELLED = "replace(" * len(SPELLINGS) + "{x}" + "".join(f", '{a}', '{b}')" for a, b in SPELLINGS)


def lines_sql(x: str) -> str:
    """The canonical lines in DuckDB SQL, to test against."""
    bare = "regexp_replace(regexp_replace(lower({}), '{}', '', 'g'), '{}', '', 'g')".format(x, *(r.replace("(?dm)", "(?m)") for r in (COPYRIGHT, ITEM)))
    return r"list_transform(string_split(regexp_replace({}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)), lambda l: trim(l))".format(SPELLED.format(x=bare))


def oracle() -> str:
    known = [*TEXTS.items(), *((k, n) for k, names in NOTICES.items() for n in names)]
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in known)
    titles = ", ".join(f"'{t}'" for t in TITLES)
    whole = f"sha256(array_to_string(list_filter(lines, lambda l: l <> '' AND l NOT IN ({titles})), ' '))"
    return f"""
    WITH known AS (SELECT {whole} AS digest, min(license) AS license FROM (SELECT license, {lines_sql("t")} AS lines FROM (VALUES {values}) v(license, t)) GROUP BY 1),
    cut AS (SELECT doc_id, {lines_sql("coalesce(text, '')")} AS lines FROM documents),
    each AS (SELECT doc_id, unnest(lines) AS line FROM cut),
    found AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
              FROM each JOIN known ON sha256(line) = digest
              GROUP BY 1),
    whole AS (SELECT doc_id, {whole} AS digest FROM cut)
    SELECT w.doc_id, w.digest, k.license, coalesce(f.n, 0)::BIGINT AS n_notices, coalesce(f.notices, '') AS notices
    FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN found f USING (doc_id)
    """
