"""Licence texts by canonical digest.

A text is put in lower case, loses its copyright lines, gets one spelling for words that have several, and
loses punctuation and line breaks. What is left is hashed, and an equi-join with the digests of known texts,
made the same way, names the licence. Whole documents are looked up, and so is each line that mentions a
licence, against the known one-line notices.

Defined cases: a null text is an empty one (its digest is that of no words); equal rows get equal results; a
digest that several known texts share goes to the first of their names; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.common import row_keyed

#: Spellings that count as the same word (from the public licence matching guidelines).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("artefact", "artifact"), ("authoris", "authoriz"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("licence", "license"), ("merchantibility", "merchantability"), ("modelled", "modeled"),
    ("noncommercial", "non commercial"), ("organis", "organiz"), ("per cent", "percent"), ("recognis", "recogniz"), ("sub license", "sublicense"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)
COPYRIGHT = r"(^|\n)[^0-9a-z\n]*(?:copyright (?:\(c\)|©|[0-9]|by)|\(c\)|©|all rights reserved)[^\n]*"
SEPARATORS = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
#: Known whole texts and one-line notices.
KNOWN = (
    ("MIT", "text", "MIT License\n" + _MIT_GRANT),
    ("MIT", "text", _MIT_GRANT),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_WARRANTY),
    ("MIT-0", "text", "MIT No Attribution\n" + _MIT_GRANT.split(", subject to")[0] + ".\n" + _MIT_GRANT.split("\n")[-1]),
    ("BSD-2-Clause", "text", _BSD_CLAUSES + _BSD_WARRANTY),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n" + _BSD_CLAUSES + _BSD_WARRANTY),
    ("BSD-3-Clause", "text", _BSD_CLAUSES + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n" + _BSD_CLAUSES + _BSD_THIRD + _BSD_WARRANTY),
    ("Unlicense", "text", _UNLICENSE),
    ("Zlib", "text", _ZLIB),
    ("BSL-1.0", "text", _BOOST),
    ("Apache-2.0", "text", _APACHE_HEADER),
    ("GPL-3.0", "text", _GPL_HEADER.format(name="General Public License")),
    ("AGPL-3.0", "text", _GPL_HEADER.format(name="Affero General Public License")),
    ("LGPL-3.0", "text", _GPL_HEADER.format(name="Lesser General Public License")),
    ("MPL-2.0", "text", _MPL_HEADER),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
)


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no punctuation, one spelling."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "\n"), SEPARATORS, " "))
    spelt = words
    for a, b in SPELLINGS:
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    return F.when(words.rlike("|".join(a for a, _ in SPELLINGS)), spelt).otherwise(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, kind: str) -> DataFrame:
    """digest, licence_id: of the built-in texts, a fixed and small table."""
    rows = [(name, text) for name, k, text in KNOWN if k == kind]
    return spark.createDataFrame(rows, "licence_id string, text string").groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, key: str, text: str, *, texts: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """_rk, canon_sha256, licence_id (of the whole text) and notices (sorted ids of its notice lines).

    Known digests (digest, licence_id) may be given as tables of any size; Spark broadcasts them if they are small. With
    notices of the caller every line is looked up. The built-in texts are short licences and the headers that longer ones
    prescribe for files; the long texts themselves are to be given.
    """
    spark = docs.sparkSession
    keyed = row_keyed(docs.select(key, text), key, text)
    whole = keyed.select("_rk", digest(F.col(text)).alias("canon_sha256"))
    lines = keyed.select("_rk", F.explode(F.split(F.col(text), "\n")).alias("line"))
    if notices is None:  # each built-in notice holds the word
        lines = lines.where(F.lower("line").rlike("licen[sc]"))
    noticed = lines.select("_rk", digest(F.col("line")).alias("digest")).join(notices or known(spark, "notice"), "digest")
    per_doc = noticed.groupBy("_rk").agg(F.array_sort(F.collect_set("licence_id")).alias("notices"))
    named = whole.join((texts or known(spark, "text")).withColumnRenamed("digest", "canon_sha256"), "canon_sha256", "left")
    return named.join(per_doc, "_rk", "left").select("_rk", "canon_sha256", "licence_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def query(docs: DataFrame) -> DataFrame:
    return scan(docs, "doc_id", "text").select(F.col("_rk.k").alias("doc_id"), "canon_sha256", "licence_id", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    spelt = rf"trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT)}, chr(10), 'g'), {quoted(SEPARATORS)}, ' ', 'g'))"
    for a, b in SPELLINGS:
        spelt = f"replace({spelt}, {quoted(a)}, {quoted(b)})"
    return spelt


def _sql() -> str:
    values = ", ".join("('{}', '{}', '{}')".format(a, b, c.replace("'", "''")) for a, b, c in KNOWN)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, kind, min(id) AS id FROM (VALUES {values}) AS k(id, kind, t) GROUP BY ALL),
d AS (SELECT doc_id, text, sha256({_sql_canonical("text")}) AS canon_sha256 FROM documents),
n AS (
  SELECT doc_id, string_agg(id, ',' ORDER BY id) AS notices
  FROM (SELECT DISTINCT doc_id, k.id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l JOIN known k ON k.kind = 'notice' AND k.digest = sha256({_sql_canonical("line")}))
  GROUP BY doc_id
)
SELECT d.doc_id, canon_sha256, k.id AS licence_id, coalesce(notices, '') AS notices
FROM d LEFT JOIN known k ON k.kind = 'text' AND k.digest = canon_sha256 LEFT JOIN n USING (doc_id)
"""


ORACLE_SQL = _sql()
