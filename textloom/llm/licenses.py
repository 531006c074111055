"""License scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: lower case, lines that are only a copyright claim removed,
spellings that licence matching treats as equal made equal, everything but letters and digits read
as a separator. For known licences, only real claims (the word or sign with a year or another sign),
reservations of rights, numbers and bullets of lists, and titles are left out, so that the digest
doesn't depend on where lines break, and the digest of what remains is joined; the digest given out is
that of the canonical text, in which every line that begins with copyright is empty. Texts are joined
whole, however long, and the digest of each whole line is looked up among those of known notices, so
texts are compared entire and never by parts of a line. The module's register (a few dozen rows) is a
constant, hence the broadcast; a further register can be given as a table of any size.

Null text has no digest and no licence; an empty canonical form (also of a text of copyright lines
only) has a digest but matches nothing. Repeated rows give repeated results. Other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, sized

#: Spellings that the SPDX matching guidelines treat as equal, as parts of words.
SPELLINGS = [
    ("licenc", "licens"),
    ("favour", "favor"),
    ("labour", "labor"),
    ("honour", "honor"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("realis", "realiz"),
    ("utilis", "utiliz"),
    ("initialis", "initializ"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("programme", "program"),
    ("fulfill", "fulfil"),
    ("whilst", "while"),
    ("non-commercial", "noncommercial"),
    ("sub-licens", "sublicens"),
    ("per cent", "percent"),
    ("https:", "http:"),
]

#: Texts of short licences, and the grants by which files refer to long ones, without copyright lines.
_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
LICENSES = [
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", f"{_BSD} {_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_DISCLAIMER}"),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>'),
    ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]

#: Notices that stand on a line of their own.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line; copyright lines are empty."""
    form = F.lower(text)
    for a, b in SPELLINGS:
        form = F.replace(form, F.lit(a), F.lit(b))
    form = F.regexp_replace(form, r"(^|\n)[ \t]*(copyright|©|\(c\))[^\n]*", "$1")
    form = F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(form, "\n"), lambda line: F.trim(line))


#: A claim, perhaps behind comment marks: the word with a sign or a year, the sign ©, or (c) with a year; or the reservation of rights alone.
CLAIM = r"(^|\n)[^\p{L}\p{N}\n(©]*((copyright[ \t]*:?[ \t]*(\(c\)|©|[0-9]{4})|©|\(c\)[ \t]*(copyright|[0-9]{4}))[^\n]*|all rights reserved[. \t\r]*(?=\n|$))"
#: Numbers and letters of a list: 1. or (a), at the start of a line or after white space.
BULLET = r"(^|[\s#*/;-])\(?([0-9]{1,2}|[a-z])[.)](?=\s)"
TITLE = r"^(the )?(mit|isc|bsd [023] clause|bsd zero clause|zero clause bsd|zlib|zlib libpng) license( mit| isc| 0bsd)? "


def licence_form(text: Column) -> Column:
    """The canonical form of a whole text without claims, comment marks and title, as licences are matched by it."""
    form = F.lower(text)
    for a, b in SPELLINGS:
        form = F.replace(form, F.lit(a), F.lit(b))
    form = F.regexp_replace(F.regexp_replace(form, CLAIM, "$1"), BULLET, "$1")
    return F.regexp_replace(F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " ")), TITLE, "")


def digest(form: Column) -> Column:
    return F.sha2(form, 256)


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def known(spark: SparkSession) -> DataFrame:
    """digest, license, kind (text or notice) of the register, by the same functions as the documents'."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({quoted(kind)}, {quoted(name)}, {quoted(text)})" for kind, register in (("text", LICENSES), ("notice", NOTICES)) for name, text in register)
    register = spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, license, text)")
    form = F.when(F.col("kind") == "text", licence_form(F.col("text"))).otherwise(whole(canonical_lines(F.col("text"))))
    return register.select(digest(form).alias("digest"), "license", "kind").distinct()


def scan(docs: DataFrame, register: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the whole text, license (whole text), notices (names from whole lines, sorted, separated by commas; null if none).

    register: further texts (license, text), in a table of any size. Of licences of equal text, the first by name is told.
    """
    spark = docs.sparkSession
    own = known(spark).collect()  # the module's constant, a few dozen rows
    texts = ", ".join(f"('{x.digest}', '{x.license}')" for x in own if x.kind == "text")
    texts = spark.sql(f"SELECT * FROM VALUES {texts} AS t(form_digest, license)")
    if register is None:
        texts = F.broadcast(texts)
    else:
        more = register.where("text is not null and license is not null").select(digest(licence_form(F.col("text").cast("string"))).alias("form_digest"), F.col("license").cast("string").alias("license"))
        texts = Scratch(spark).write(texts.unionAll(more).groupBy("form_digest").agg(F.min("license").alias("license")), "register")
        texts = sized(texts, 160)
    notes = F.create_map(*[F.lit(v) for x in own if x.kind == "notice" for v in (x.digest, x.license)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(F.col("text").cast("string")).alias("lines"), digest(licence_form(F.col("text").cast("string"))).alias("form_digest"))
    found = F.transform(F.filter("lines", lambda line: line != ""), lambda line: F.element_at(notes, digest(line)))
    rows = rows.select("doc_id", "form_digest", digest(whole(F.col("lines"))).alias("digest"), F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ",").alias("notices"))
    return rows.join(texts, "form_digest", "left").select("doc_id", "digest", "license", F.nullif("notices", F.lit("")).alias("notices"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_form(text: str) -> str:
    form = f"lower({text})"
    for a, b in SPELLINGS:
        form = f"replace({form}, '{a}', '{b}')"
    form = rf"regexp_replace({form}, '(^|\n)[ \t]*(copyright|©|\(c\))[^\n]*', '\1', 'g')"
    form = rf"regexp_replace({form}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    return f"list_transform(string_split({form}, chr(10)), lambda s: trim(s))"


def _sql_register() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quoted(kind)}, {quoted(name)}, {quoted(text)})" for kind, register in (("text", LICENSES), ("notice", NOTICES)) for name, text in register)


ORACLE = f"""
WITH k AS (SELECT DISTINCT kind, license, sha256(array_to_string(list_filter({_sql_form('text')}, lambda s: s <> ''), ' ')) AS digest FROM (VALUES {_sql_register()}) t(kind, license, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_sql_form('text')} AS lines FROM documents),
w AS (SELECT r, doc_id, lines, sha256(array_to_string(list_filter(lines, lambda s: s <> ''), ' ')) AS digest FROM d),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT r, unnest(lines) AS l FROM d) JOIN k ON kind = 'notice' AND sha256(l) = digest AND l <> '' GROUP BY r)
SELECT doc_id, w.digest, k.license, n.notices FROM w LEFT JOIN n USING (r) LEFT JOIN k ON k.kind = 'text' AND k.digest = w.digest
"""
