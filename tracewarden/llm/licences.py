"""Licence scans by canonical digest.

A text is put into canonical form (lower case, lines of copyright dropped, equivalent spellings unified, numbers and
signs of lists dropped, punctuation and white space folded to one blank) and digested.  Whole documents, each of
their paragraphs and each of their lines are then looked up by hash join among the digests of known licence texts and
notices: the texts in ``licence_texts``, with and without their headings, and the notices below.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence notices and short texts, each with its SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Headings with which texts are also known, and the number of lines of the heading with which a text begins.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "ISC": ("ISC License",),
}
BEGINS = {"Apache-2.0": 4, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-2.0": 2, "MPL-1.1": 4, "GFDL-1.3": 4, "CC0-1.0": 2}


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all notices and texts, these with and without their headings."""
    bodies = [(f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    out = list(NOTICES) + bodies + [(k, "\n".join(t.strip("\n").split("\n")[BEGINS[k] :])) for k, t in bodies if k in BEGINS]
    headed = bodies + [(k, t) for k, t in NOTICES if k in HEADINGS and len(t) > 500]
    return out + [(k, f"{h}\n\n{t}") for k, t in headed for h in HEADINGS.get(k, ())]


#: Spellings that count as one, after lower-casing.
SPELLINGS = (
    (r"\r\n?", "\n"),
    (r"licence", "license"),
    (r"sub-license", "sublicense"),
    (r"non-commercial", "noncommercial"),
    (r"https?://(www\.)?", ""),
    (r"\bversion\b|\bver\.|\bv\.", "v"),
    (r"acknowledgement", "acknowledgment"),
)
COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright\b|copr\b|\(c\)|©|all rights reserved)"
#: The number or sign of an item of a list; what parts paragraphs.
ITEM, GAP = r"^[^\p{L}\p{N}]*[0-9]{1,2}[.)]\s", r"\n(?:[ \t]*\n)+"


def canonical_paragraphs(text: Column) -> Column:
    """The lines of each paragraph of a text in canonical form, without blank ones and lines of copyright; null counts as empty."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in SPELLINGS:
        text = F.regexp_replace(text, pattern, to)

    def lines(paragraph: Column) -> Column:
        kept = F.filter(F.split(paragraph, "\n"), lambda x: ~x.rlike(COPYRIGHT))
        return F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, ITEM, ""), r"[^\p{L}\p{N}]+", " "))), lambda x: x != "")

    return F.transform(F.split(text, GAP), lines)


def digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts: a fixed list, so its size is bounded."""
    rows = spark.createDataFrame(known if known is not None else known_texts(), "license string, text string")
    return rows.select(F.md5(F.array_join(F.flatten(canonical_paragraphs(F.col("text"))), " ")).alias("digest"), "license").distinct()


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, license, whole, n_paragraphs, n_lines): licences whose text is a document's whole text, one of its paragraphs or one of its lines.

    whole tells whether the entire text is the licence; n_paragraphs counts the paragraphs of several lines that
    are, n_lines the lines.  Null and empty texts have none; repeated rows with one doc_id are counted together, as are
    null doc_ids; other columns are ignored; an empty table gives an empty result.
    """
    unit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("unit"))
    parts = docs.select("doc_id", canonical_paragraphs(F.col("text")).alias("_paragraphs")).withColumn("_lines", F.flatten("_paragraphs"))
    units = F.concat(
        F.array(unit("whole", F.array_join("_lines", " "))),
        F.transform(F.filter("_paragraphs", lambda p: F.size(p) > 1), lambda p: unit("paragraph", F.array_join(p, " "))),
        F.transform("_lines", lambda x: unit("line", x)),
    )
    each = parts.select("doc_id", F.inline(units)).select("doc_id", "kind", F.md5("unit").alias("digest"))
    hits = each.join(F.broadcast(digests(docs.sparkSession, known)), "digest")
    is_ = lambda k: F.col("kind") == k
    return hits.groupBy("doc_id", "license").agg(F.bool_or(is_("whole")).alias("whole"), F.count_if(is_("paragraph")).alias("n_paragraphs"), F.count_if(is_("line")).alias("n_lines"))


def oracle() -> str:
    """SQL for ``scan`` over ``documents``."""
    canon = "lower(coalesce(text, ''))"
    for pattern, to in SPELLINGS:
        to = "chr(10)" if to == "\n" else f"'{to}'"
        canon = f"regexp_replace({canon}, '{pattern}', {to}, 'g')"
    lines = rf"list_filter(list_transform(list_filter(string_split(p, chr(10)), lambda x: not regexp_matches(x, '{COPYRIGHT}')), lambda x: trim(regexp_replace(regexp_replace(x, '{ITEM}', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '')"
    paragraphs = f"list_transform(string_split_regex({canon}, '{GAP}'), lambda p: {lines})"
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in known_texts())
    return f"""
with k as (select distinct license, md5(array_to_string(flatten({paragraphs}), ' ')) as digest from (values {values}) t(license, text)),
d as (select doc_id, {paragraphs} as ps from documents),
u as (select doc_id, 'whole' as kind, md5(array_to_string(flatten(ps), ' ')) as digest from d
      union all select doc_id, 'paragraph', md5(array_to_string(p, ' ')) from (select doc_id, unnest(ps) as p from d) where len(p) > 1
      union all select doc_id, 'line', md5(x) from (select doc_id, unnest(flatten(ps)) as x from d))
select doc_id, license, bool_or(kind = 'whole') as whole, count(*) filter (where kind = 'paragraph') as n_paragraphs, count(*) filter (where kind = 'line') as n_lines
from u join k using (digest) group by doc_id, license
"""
