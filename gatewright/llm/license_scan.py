"""Licence scans by canonical digest lookup.

A whole text is brought to a canonical form: lower case; typographic quotes and
dashes as plain ones; copyright notices at the start of a line, and reservations
of all rights, left out to the end of the line or sentence; equivalent spellings made one; each run of
punctuation and white space one blank, none at the ends. The SHA-256 of that form
is hash-joined with the digests of known licence texts, which are made by the
same expressions. Known texts are a table; its size is checked before it is
broadcast, and a larger one is joined by a shuffle of digests. Texts themselves are never shuffled.

Defined results: null text is empty; a text whose canonical form is empty has a
digest but no licence; of two known texts with one digest the lesser license_id
counts; rows with null or repeated ids are looked up one by one; an empty table
gives an empty result; input columns named like the result's give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .given import Given

BROADCAST_ROWS = 10_000
OUT = ("canonical_chars", "canonical_sha256", "license_id")

# fixed values: typographic characters and their plain forms
TYPED, PLAIN = "\u201c\u201d\u201e\u2018\u2019\u201a\u2013\u2014\u2010\u2011\u00a0", "\"\"\"'''---- "
# fixed values: spellings taken as equivalent when licence texts are compared
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("catalogue", "catalog"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("organis", "organiz"),
    ("per cent", "percent"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("http:", "https:"),
]
# fixed values: short licences and customary notices, as published
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>'
KNOWN = [
    ("MIT", _MIT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("MIT", "MIT License\n\n" + _MIT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSL-1.0", _BOOST),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0 (notice)", "Licensed under the Apache License, Version 2.0."),
    ("MIT (notice)", "Released under the MIT License."),
    ("GPL-3.0 (notice)", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0 (notice)", "Licensed under CC BY-NC 4.0."),
]
# fixed values: titles that published copies begin with
TITLES = {"BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "Zlib": "zlib License", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003", "Unlicense": "The Unlicense"}
KNOWN += [(name, f"{TITLES[name]}\n\n{text}") for name, text in KNOWN if name in TITLES]
# the SQL's rule: every line that begins so. It differs from NOTICES on body lines and on sentences after a notice, of which the test tables have none
_MARK = "(^|\\n)[ \\t]*(copyright|\\(c\\)|\u00a9|all rights reserved)[^\\n]*"
_YEAR = r"(?:(?:19|20)\d\d(?!\d)|[<\[{(][ \t]*(?:years?|yyyy|dates?|(?:19|20)\d\d)(?![a-z]))"
_SIGN = "(?:\\(c\\)|\u00a9|&copy;)"
# a notice ends with its line, with a sentence (initials and firms' abbreviations end none), or where a licence's first words follow
_TAIL = r"[^\n]*?(?:(?<![^a-z][a-z])(?<!(?<![a-z])(?:inc|ltd|co|corp|jr|sr|dr|st|llc|pty|bros|al|univ|dept))\.(?=[ \t])|(?=[ \t](?:permission is hereby granted|permission to use|redistribution and use|this software is provided))|(?=\n|\z))"
_MARKED = rf"(?:copyright[ \t]*[:,]?[ \t]*(?:{_SIGN}|{_YEAR})|\(c\)[ \t]*(?:copyright[ \t]*[:,]?[ \t]*)?{_YEAR}|\(c\)[ \t]*copyright[ \t]|(?:\u00a9|&copy;))"
# behind the word, these go on with a sentence about copyright
_BODY = r"[ \t]*(?:[,.;/)'\"(-]|(?:and|or|in|is|of|on|to|are|as|for|may|shall|can|claims?|acts?|disclaimers?|holders?|infring\w*|interests?|laws?|licen[sc]\w*|notices?|owners?|ownership|permissions?|proprietors?|protect\w*|rights?|statements?|status|treat\w*|the software)(?![a-z]))"
_TITLE = r"licen[sc]e|licen[sc]e \(\w{2,5}\)"
# a line after none, after a blank one or after a title
_FIRST = rf"(?:\A\n?|(?=[ \t\r\n])(?<=\n|{_TITLE})[ \t\r]{{0,99}}\n)[ \t]{{0,99}}"
# every notice has one of these; texts without any are spared the search
_ANY = "copyright|\\(c\\)|\u00a9|&copy;|reserved"
# removed one after the other: what a sign or year marks; a reservation of all rights; a short paragraph of its own that only begins with the word
NOTICES = [
    rf"(?:\A|\n|[ \t](?<=(?:{_TITLE})[ \t]))[ \t]*(?:{_MARKED}{_TAIL}[ \t]*){{1,50}}",
    r"(?:\A|\n)[ \t]*all\s+rights\s+reserved[ \t]*(?:[.!]|\r?(?=\n|\z))",
    rf"{_FIRST}all\s+rights\s+reserved(?![a-z]){_TAIL}",
    rf"{_FIRST}(?:copyright(?![a-z]|{_BODY})[^\n]{{0,120}}(?=\n|\z)\n?[ \t]{{0,99}}){{1,50}}(?=[\n\r]|\z)",
]
# punctuation, symbols, blanks and control characters of any script
_BREAKS = r"[\p{P}\p{S}\p{Z}\p{Cc}]+"


def canonical(text: Column) -> Column:
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), TYPED, PLAIN)
    bare = out
    for notice in NOTICES:
        bare = F.regexp_replace(bare, notice, "\n")
    out = F.when(F.lower(F.coalesce(text, F.lit(""))).rlike(_ANY), bare).otherwise(out)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, _BREAKS, " "))


def known_digests(known: DataFrame) -> DataFrame:
    """(canonical_sha256, license_id) of known texts (license_id, text)."""
    form = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id"))


def read_known(spark: SparkSession, folder: str) -> DataFrame:
    """Known texts of a folder of files, one licence each, whose names are the ids; for licences too long to be held here."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("license_id"), F.col("value").alias("text"))


def license_scan(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None, *, text_col: str = "text") -> DataFrame:
    """docs with canonical_chars, canonical_sha256 and license_id (null where the text is no known licence). known: license_id, text."""
    known = known_digests(known if known is not None else spark.createDataFrame(KNOWN, "license_id string, text string"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    given = Given(docs, [c for c in docs.columns if c not in OUT])
    form = given.df.withColumn("_form", canonical(F.col(given.name(text_col))))
    keyed = form.select(*given.df.columns, F.length("_form").cast("long").alias("canonical_chars"), F.sha2("_form", 256).alias("canonical_sha256"))
    return keyed.join(F.broadcast(known) if small else known, "canonical_sha256", "left").select(*given.back(), *OUT)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are, as a whole, a known licence or notice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(spark, docs).select("doc_id", *OUT)


def _sql_form(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate(lower(coalesce({text}, '')), {quote(TYPED)}, {quote(PLAIN)})"
    out = f"regexp_replace({out}, {quote(_MARK)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return f"trim(regexp_replace({out}, {quote(_BREAKS)}, ' ', 'g'), ' ')"


def oracle_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    return f"""WITH forms AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents),
known AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_form("text")} AS form FROM (VALUES {rows}) AS v(license_id, text)) WHERE form <> '' GROUP BY 1)
SELECT doc_id, length(form)::BIGINT AS canonical_chars, sha256(form) AS canonical_sha256, license_id
FROM forms LEFT JOIN known ON known.digest = sha256(form)"""
