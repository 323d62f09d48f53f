"""Licence scan: look whole texts up by the digest of their canonical form.

Native: DataFrame functions only.  Canonical form: copyright lines dropped,
lower case, every run of characters other than letters and digits one space,
equivalent spellings made one.  The digest of a whole document is joined to the
digests of known licences (one row each, a fixed list, so the joined side is
bounded by the list's length).  Lines are looked up alike: a one-line licence
statement inside a longer document is reported as a notice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from relaygrid.session import config_table

# Texts of public licences and the statements that name them, stated as they are published.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD2),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
)
#: Equivalent spellings, over words of the canonical form; the second replaces the first.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("organisation", "organization"), ("https", "http"),
)
# End of fixed values.

#: A line that states a copyright holder, or reserves all rights; over lower-cased text.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9]|by[ \t])|\(c\)|©)[^\n]*|all rights reserved\.?[ \t]*\r?)$"
#: What a line of that kind holds at least.
_HINTS = ("copyright", "(c)", "©", "all rights reserved")
#: Runs of white space, punctuation and signs; line feeds stay.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\xBF\x{2000}-\x{206F}\x{3000}-\x{303F}]+"


def _respell(form: Column) -> Column:
    padded = F.concat(F.lit(" "), F.trim(form), F.lit(" "))
    for spelled, other in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {spelled} "), F.lit(f" {other} "))
    return F.trim(padded)


def _digest(form: Column) -> Column:
    return F.sha2(F.nullif(form, F.lit("")).cast("binary"), 256)


def bare_lines(text: Column) -> Column:
    """The text without copyright lines, case and marks; its line feeds stay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hinted = F.lit(False)
    for hint in _HINTS:
        hinted = hinted | F.contains(low, F.lit(hint))
    return F.regexp_replace(F.when(hinted, F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low), MARKS, " ")


def _flat(bare: Column) -> Column:
    return _respell(F.regexp_replace(bare, "[ \\n]+", " "))


def canonical(text: Column) -> Column:
    """Canonical form of a text; null as empty."""
    return _flat(bare_lines(text))


def digest(text: Column) -> Column:
    """Digest of the canonical form; null where nothing is left of the text."""
    return _digest(canonical(text))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """digest, licence: one row per known digest; of licences with one digest the first by name."""
    kind = StructType([StructField("licence", StringType()), StructField("body", StringType())])
    rows = config_table(spark, list(known), kind)
    return rows.select(digest(F.col("body")).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN
) -> DataFrame:
    """One row per input row: ``id_col``, digest, licence, notices.

    * ``licence``: the known licence whose digest the whole text has, else null.
    * ``notices``: the known licences whose digest a line of the text has, each
      once, in order of name; empty if none.
    * Null, empty and purely punctuated texts have a null digest and match
      nothing.  Repeated rows give repeated rows; an empty table an empty
      result; other columns take no part.
    """
    digests = F.array(*[digest(F.lit(body)) for _, body in known])
    names = F.array(*[F.lit(name) for name, _ in known])
    rows = docs.select(F.col(id_col).alias(id_col), bare_lines(F.col(text_col)).alias("bare"))
    lines = F.transform(F.split("bare", "\n"), lambda line: _digest(_respell(line)))
    found = F.transform(F.array_intersect(lines, digests), lambda d: F.element_at(names, F.array_position(digests, d).cast("int")))
    rows = rows.select(id_col, _digest(_flat(F.col("bare"))).alias("digest"), F.array_sort(F.array_distinct(found)).alias("notices"))
    return rows.join(known_digests(docs.sparkSession, known), "digest", "left").select(id_col, "digest", "licence", "notices")
