"""Licence scans by canonical digest lookup.

A text unit (a whole document, a paragraph or a line) is brought to a canonical form:
lower case, copyright lines left out, equivalent spellings made equal, everything but
letters and digits turned into single spaces. Its SHA-256 digest is joined with the
digests of known licence texts and notices, brought to the same form. Only entire units
match, so prose that mentions a licence does not.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that licence texts use for one another; each lower-case word is replaced by the form it is compared in.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sub license", "sublicense": "sub license",
    "sublicensed": "sub licensed", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "honour": "honor", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial",
    "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "percent": "per cent", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while",
    "wilful": "willful", "wilfull": "willful", "willfull": "willful", "https": "http",
}

# Known notices and short licence texts.
_NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)


#: Notices, and the whole texts of the files beside this module, named by their licence.
KNOWN = (*_NOTICES, *((f.stem, f.read_text(encoding="utf-8")) for f in sorted(Path(__file__).with_name("known_licenses").glob("*.txt"))))


def canonical(text: Column) -> Column:
    """The form in which texts are compared; empty for a text of copyright lines and marks alone."""
    text = F.regexp_replace(F.lower(text), r"(?dm)^[^\p{L}\p{N}\n]*(copyright\b|©|\(c\)\s*(copyright\b|\d{4}))[^\n]*$", " ")
    words = F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    table = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license, canonical_chars) of (license, text); a text of two licences keeps the first by name."""
    form = known.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.first(F.length("form")).alias("canonical_chars"))


#: With more anchors than this, texts are not looked over for them first.
MOST_ANCHORS = 64


def _anchors(known: DataFrame) -> list[str] | None:
    """A word of each known form that a text must hold, whatever its spelling; None if there is none or they are too many."""
    changed = sorted({w for new in SPELLINGS.values() for w in new.split()})
    words = F.filter(F.split(canonical(F.col("text")), " "), lambda w: ~w.isin(*changed))
    longest = known.select(canonical(F.col("text")).alias("form"), F.array_max(F.transform(words, lambda w: F.struct(F.length(w), w.alias("w")))).alias("m")).where("form <> ''")
    found = [r[0] for r in longest.select("m.w").distinct().limit(MOST_ANCHORS + 1).collect()]
    return None if len(found) > MOST_ANCHORS or None in found else found


def default_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, T.StructType([T.StructField("license", T.StringType()), T.StructField("text", T.StringType())]))


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, unit_no, license): units of the texts that are a known licence text.

    ``unit`` is document, paragraph or line, and ``unit_no`` counts from 0 within the
    text. A text of one line or paragraph has no units of that kind besides the document.
    Units are whole, however long; those under half the shortest known form are passed
    over before they are digested, as no spelling lengthens a text that much. The join
    is left to the optimiser, which knows the sizes of both sides. A text is looked over
    for the known forms' anchor words first: one without any cannot hold a match.

    ``known`` is (license, text) of whole texts and notices, such as :func:`read_known`
    gives. A null or empty text has no units. Rows with one doc_id, and those with a null
    one, are scanned each. An empty table of documents or of licences gives an empty
    result; extra columns are not read.
    """
    digests = known_digests(known)
    shortest = digests.agg(F.min("canonical_chars")).collect()[0][0]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).where(F.length("_text") > 0)
    anchors = _anchors(known)
    if anchors:
        held = F.lit(False)
        for a in anchors:
            held = held | F.contains("_low", F.lit(a))
        texts = texts.withColumn("_low", F.lower("_text")).where(held).drop("_low")
    if shortest is None:
        texts = texts.limit(0)
    parts = texts.select("doc_id", "_text", F.split("_text", r"\n(?:[ \t\r]*\n)+").alias("_paragraphs"), F.split("_text", "\n").alias("_lines"))
    several = F.size("_paragraphs") > 1
    unit = lambda kind, number, text: F.struct(F.lit(kind).alias("unit"), number.cast("int").alias("unit_no"), text.alias("form"))
    units = F.concat(
        F.array(unit("document", F.lit(0), F.col("_text"))),
        F.when(several, F.transform("_paragraphs", lambda p, k: unit("paragraph", k, p))).otherwise(F.expr("array()")),
        F.when(F.size("_lines") > 1, F.transform("_lines", lambda x, k: unit("line", k, x))).otherwise(F.expr("array()")),
    )
    each = parts.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.unit_no", "u.form").where(F.length("form") >= max(1, (shortest or 0) // 2))
    found = each.withColumn("digest", F.sha2(canonical(F.col("form")), 256)).join(digests, "digest")
    return found.select("doc_id", "unit", "unit_no", "license")


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of whole licence texts, one file each, named by the licence: ``<license>.txt``."""
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    return files.select(F.regexp_extract(F.url_decode("_file"), r"([^/]+?)(?:\.txt)?$", 1).alias("license"), F.col("value").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in all ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_known(spark))


def _canonical_sql(text: str) -> str:
    text = rf"regexp_replace(lower({text}), '(?m)^[^\p{{L}}\p{{N}}\n]*(copyright\b|©|\(c\)\s*(copyright\b|\d{{4}}))[^\n]*$', ' ', 'g')"
    words = rf"string_split(trim(regexp_replace({text}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    forms = ", ".join(f"'{old}': '{new}'" for old, new in SPELLINGS.items())
    return f"list_aggregate(list_transform({words}, lambda w: coalesce(MAP {{{forms}}}[w], w)), 'string_agg', ' ')"


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)

ORACLE = rf"""
WITH known(license, text) AS (VALUES {_VALUES}),
digests AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license) AS license FROM known GROUP BY 1),
parts AS (SELECT doc_id, text, regexp_split_to_array(text, '\n(?:[ \t\r]*\n)+') AS paragraphs, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > 0),
units AS (
  SELECT doc_id, 'document' AS unit, 0 AS unit_no, text AS form FROM parts
  UNION ALL
  SELECT doc_id, 'paragraph', unnest(range(0, len(paragraphs))), unnest(paragraphs) FROM parts WHERE len(paragraphs) > 1
  UNION ALL
  SELECT doc_id, 'line', unnest(range(0, len(lines))), unnest(lines) FROM parts WHERE len(lines) > 1)
SELECT doc_id, unit, unit_no::INTEGER AS unit_no, license
FROM (SELECT doc_id, unit, unit_no, sha256({_canonical_sql("form")}) AS digest FROM units WHERE length(form) > 0)
JOIN digests USING (digest)
"""
