"""Licence scan: canonical digests of whole texts and of lines, hash-joined to known licences.

A unit of text (a whole text, or one line of it, as notices stand on lines of their own) is brought to a
canonical form: lower case, copyright lines removed, equivalent spellings unified, punctuation and
blanks reduced to single blanks.  Its digest is joined to the digests of the known licence texts, so only
texts that are entirely a licence match.  DataFrame functions only.
"""

from __future__ import annotations

import re
import textwrap

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.license_texts import HEADINGS, LEFT_OUT, SPDX, STARTS, TEXTS

# Equivalent spellings (left is read as right).
EQUIVALENT = (
    ("licence", "license"), ("licensor's", "licensors"), ("https:", "http:"), ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("organisation", "organization"), ("judgement", "judgment"), ("fulfil ", "fulfill "), ("favour", "favor"),
    ("cc by-nc", "creative commons attribution noncommercial"), ("cc by-sa", "creative commons attribution sharealike"),
    ("gnu gpl", "gnu general public license"), (" v2", " version 2"), (" v3", " version 3"), ("’", "'"),
)
_COPYRIGHT = r"^[ \t]*(copyright|\(c\)|\x{A9})"
_COPYRIGHT_LINE = f"(?m){_COPYRIGHT}.*$"
_OTHER = r"[^\p{L}\p{N}]+"

# Texts and usual short notices of public licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""
_NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "MIT License " + _MIT),
    ("MIT", "The MIT License (MIT) " + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
)


def _layouts(body: str) -> set[str]:
    """A text on one line, without the lines that read as copyright lines in its usual layouts: as published,
    a line a paragraph and all on one line; a short text also wrapped at 60 to 100 columns."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", body)]
    layouts = [body.split("\n"), paragraphs, [" ".join(body.split())]]
    if len(body) < 2500:
        layouts += [[line for p in paragraphs for line in textwrap.wrap(p, w, break_on_hyphens=False)] for w in range(60, 101)]
    kept = ([x for x in lines if not re.match(r"[ \t]*(copyright|\(c\)|\u00a9)", x, re.IGNORECASE)] for lines in layouts)
    return {" ".join(" ".join(lines).split()) for lines in kept}


def _full_texts() -> list[tuple[str, str]]:
    """Every text of ``TEXTS`` with and without the parts that copies leave out, under its headings, in its layouts."""
    out = set()
    for name, text in TEXTS.items():
        bodies = [text, *(text[: text.rindex(part)] for part in LEFT_OUT.get(name, ()))]
        if name in STARTS:
            bodies += [b[b.index(STARTS[name]) :] for b in bodies]
        if name.startswith("BSD"):
            bodies += [re.sub(r"(?m)^\d\. ", "* ", b) for b in bodies]
            bodies += ["All rights reserved.\n\n" + b for b in bodies]
        bodies = [f"{h}\n\n{b}" if h else b for b in bodies for h in HEADINGS.get(name, ("",))]
        out.update((name, one) for b in bodies for one in _layouts(b))
    return sorted(out)


#: Notices, full texts and SPDX lines: a list that does not grow with the data.
KNOWN: tuple[tuple[str, str], ...] = (
    *_NOTICES, *_full_texts(), *((name, f"SPDX-License-Identifier: {i}") for name, ids in SPDX.items() for i in ids),
)


def canonical(c: Column) -> Column:
    """Canonical form of a unit of text (lines end with a line feed)."""
    c = F.regexp_replace(F.lower(c), "(?d)" + _COPYRIGHT_LINE, "")
    for a, b in EQUIVALENT:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, _OTHER, " "))


def first_words(known=KNOWN) -> str:
    """Pattern of the first words with which a unit can be a known licence.

    Unifying spellings can change a unit's first word only where an equivalent spelling begins in it, and then it
    holds that spelling's first word; any other must itself be the first word of a known text.  So a unit
    that fails the pattern cannot match.
    """
    first = sorted({re.split(r"[^a-z0-9]+", body.lower().strip())[0] for _, body in known})
    parts = sorted({w[0] for w in (re.findall(r"[a-z0-9]+", a) for a, _ in EQUIVALENT) if w})
    return f"^({'|'.join(first)})$|{'|'.join(parts)}"


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of the fixed list: one row per text, a bound that does not grow with the data."""
    texts = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(b).alias("body")) for n, b in known])
    rows = spark.range(1).select(F.explode(texts).alias("k")).select("k.*")
    return rows.select(F.md5(canonical(F.col("body")).cast("binary")).alias("digest"), "license").distinct()


def scan_licenses(docs: DataFrame, known=KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, whole_text (the whole text is the licence), n_lines (lines that are entirely it).

    The first word of a unit, copyright lines left out, tells most units apart from every licence; only the
    others are brought to canonical form.  One row per document id and licence found.  Null and empty texts, and
    units with no letter or digit, match nothing; rows of one id (or of a null id) are counted together;
    other columns are ignored; an empty table gives an empty result.  Whole texts and all lines are
    scanned in one narrow pass; only matches are shuffled.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.octet_length("text") > 0)
    lines = slim.withColumn("lines", F.split("text", "\n"))
    begins = first_words(known)

    def may_match(line: Column) -> Column:
        return F.lower(F.regexp_extract(line, r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]+)", 1)).rlike(begins)

    lead = F.get(F.filter("lines", lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike("(?i)" + _COPYRIGHT)), F.lit(0))
    whole = F.when(may_match(lead), F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))))
    single = F.transform(F.filter("lines", may_match), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))
    units = F.concat(F.coalesce(whole, F.array().cast("array<struct<whole:boolean,unit:string>>")), single)
    each = lines.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.whole", canonical(F.col("u.unit")).alias("body")).filter("body != ''")
    found = each.select("doc_id", "whole", F.md5(F.col("body").cast("binary")).alias("digest")).join(F.broadcast(known_digests(docs.sparkSession, known)), "digest")
    out = found.groupBy("doc_id", "license").agg(F.max("whole").alias("whole_text"), F.count(F.when(~F.col("whole"), 1)).alias("n_lines"))
    return out.select("doc_id", "license", "whole_text", "n_lines")


def _sql_canonical(c: str) -> str:
    c = f"regexp_replace(lower({c}), '{_COPYRIGHT_LINE}', '', 'g')"
    for a, b in EQUIVALENT:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace({c}, '{_OTHER}', ' ', 'g'))"


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, md5({_sql_canonical('body')}) AS digest FROM (VALUES {values}) AS v(license, body)),
units AS (
  SELECT doc_id, true AS whole, text AS unit FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, false, unnest(string_split(text, chr(10))) FROM documents WHERE length(text) > 0
), each_unit AS (SELECT doc_id, whole, {_sql_canonical('unit')} AS body FROM units)
SELECT doc_id, license, bool_or(whole) AS whole_text, count(*) FILTER (WHERE NOT whole) AS n_lines
FROM (SELECT doc_id, whole, md5(body) AS digest FROM each_unit WHERE body != '') JOIN known USING (digest)
GROUP BY doc_id, license
"""
