"""License scans by canonical digests. DataFrame functions only.

Whole documents, and each of their lines, are brought to a canonical form: lower case; lines that only state a
copyright dropped; equivalent spellings unified; everything but letters and digits of any script turned into single spaces. The
form's SHA-256 is joined with a table of known texts' digests, which is broadcast while it is small. The built-in table has
licenses of up to a page as whole texts, with and without their titles, and the usual notices of longer ones; whole texts of any
length come from a table or a folder of license files (`known_files`).

Only lines that may be a known text are brought to canonical form: a few words are chosen, none of which a spelling rule touches, so
that each known text has one of them, and a line without any of them can't be a known text. If a text has no such word all lines go on.

Defined cases: null and empty texts, and texts of no letters or digits, have the digest of the empty form and no license, as has
a text that is nothing but a copyright line; rows that repeat a doc_id share what is found in any of them; rows with a null doc_id
are returned without licenses; an empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored

MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
)
AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
#: Known notices, and licenses of up to a page as a whole (title, text).
KNOWN = {
    "Apache-2.0": (
        ("", "Licensed under the Apache License, Version 2.0."),
        ("", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ),
    "MIT": (("", "Released under the MIT License."), ("MIT License", MIT), ("The MIT License (MIT)", MIT), ("The MIT License", MIT)),
    "MIT-0": (("MIT No Attribution", MIT.replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n", "")),),
    "GPL-3.0": (
        ("", "This work is licensed under the GNU General Public License, version 3."),
        ("", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ),
    "MPL-2.0": (("", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),),
    "CC-BY-NC-4.0": (("", "Licensed under CC BY-NC 4.0."),),
    "CC-BY-4.0": (("", "Licensed under CC BY 4.0."),),
    "CC-BY-SA-4.0": (("", "Licensed under CC BY-SA 4.0."),),
    "CC0-1.0": (("", "Released under CC0 1.0."),),
    "BSD-2-Clause": (("BSD 2-Clause License", REDISTRIBUTION + AS_IS_BSD), ("The 2-Clause BSD License", REDISTRIBUTION + AS_IS_BSD)),
    "BSD-3-Clause": (("BSD 3-Clause License", REDISTRIBUTION + ENDORSEMENT + AS_IS_BSD), ("The 3-Clause BSD License", REDISTRIBUTION + ENDORSEMENT + AS_IS_BSD)),
    "ISC": (("", ISC_GRANT), ("ISC License", ISC_GRANT + "\n" + ISC_AS_IS), ("The ISC License", ISC_GRANT + "\n" + ISC_AS_IS)),
    "0BSD": (("BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + ISC_AS_IS), ("Zero-Clause BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + ISC_AS_IS)),
    "Zlib": (("zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),),
    "BSL-1.0": (("Boost Software License - Version 1.0 - August 17th, 2003", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),),
    "Unlicense": (("The Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org/>"),),
    "WTFPL": (("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),),
}
#: Spellings taken as equal, applied in this order to lower-case text.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("&", " and "), ("https:", "http:"), ("(c)", "copyright"))
#: A line, of any length, that states a copyright: with a sign, a year or a reservation.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]{0,20}(copyright[^\n]*(\(c\)|©|[0-9]{4}|all rights reserved)|\(c\)|©|all rights reserved)[^\n]*$"
OTHERS = r"[^\p{L}\p{N}]+"


def texts() -> list[tuple[str, str]]:
    """License and text of the built-in table: each text with its title and without."""
    return sorted({(name, t) for name, forms in KNOWN.items() for title, text in forms for t in (text, f"{title}\n\n{text}".strip())})


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, OTHERS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, rows: DataFrame | None = None) -> DataFrame:
    """license, digest, words (those that the text's lines hold in any spelling) of rows (license, text), the built-in ones if None."""
    rows = spark.createDataFrame(texts(), "license string, text string") if rows is None else rows.select("license", "text")
    touched = [b for _, b in SPELLINGS if b.strip().isalpha()] + ["http"]
    free = F.filter(F.split(canonical(F.col("text")), " "), lambda w: (F.length(w) >= 4) & w.rlike("^[a-z]+$") & ~w.rlike("|".join(x.strip() for x in touched)))
    return rows.select("license", digest(F.col("text")).alias("digest"), F.array_distinct(free).alias("words"))


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """The table of known texts from a folder of license files; a license's name is its file's."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(txt|md)$", "").alias("license"), F.col("value").alias("text"))
    return known(spark, rows)


#: Known texts up to which lines are sought by words first.
FILTERED = 10_000


def cover(texts_: list[list[str]]) -> list[str] | None:
    """Few words of which each text has one; None if a text has no word."""
    left, out = [set(t) for t in texts_], []
    while left:
        if not all(left):
            return None
        counts: dict[str, int] = {}
        for t in left:
            for w in t:
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        out.append(best)
        left = [t for t in left if best not in t]
    return out


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the whole document), n_matches, licenses (distinct, ascending, comma-joined) of each row of docs.

    table: license, digest, words of the known texts; the built-in ones if it is None. Lines are not sought by words if it has no words."""
    docs = docs.select("doc_id", "text")
    table = known(docs.sparkSession) if table is None else table
    listed = [r["words"] for r in table.select("words").limit(FILTERED + 1).collect()] if "words" in table.columns else []
    words = cover(listed) if len(listed) <= FILTERED and "words" in table.columns else None
    table = bounded_broadcast(table.select("license", "digest").distinct())
    maybe = lambda x: reduce(lambda a, b: a | b, [x.contains(w) for w in words], F.lit(False)) if words is not None else F.lit(True)
    low = F.lower("text")
    lines = F.filter(F.split(low, "\n"), lambda x: maybe(x) & (F.length(x) < F.length(low)))
    whole = stored(docs.select("doc_id", digest(F.col("text")).alias("digest")))
    units = docs.where("doc_id is not null").select("doc_id", F.explode(lines).alias("unit")).select("doc_id", digest(F.col("unit")).alias("digest"))
    found = units.unionByName(whole.where("doc_id is not null")).join(table, "digest")
    found = found.groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    out = whole.join(found, "doc_id", "left")
    return out.select("doc_id", "digest", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle() -> str:
    """The scan of documents in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), {quote(COPYRIGHT)}, ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quote(a)}, {quote(b)})"
        return f"sha256(trim(regexp_replace({out}, {quote(OTHERS)}, ' ', 'g')))"

    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in texts())
    return f"""
WITH k AS (SELECT DISTINCT license, {form("text")} AS digest FROM (VALUES {rows}) AS t(license, text)),
u AS (SELECT doc_id, unnest(list_concat([text], list_filter(string_split(text, chr(10)), lambda x: length(x) < length(text)))) AS unit FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM (SELECT doc_id, {form("unit")} AS digest FROM u) JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, {form("text")} AS digest, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN f USING (doc_id)
"""
