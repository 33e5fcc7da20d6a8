"""Licence recognition by sentences.

A text is cut into units (its lines, its sentences across line breaks, and its sentences within paragraphs,
where a blank line or a copyright notice ends a sentence too), each unit is normalised, and units equal to a
known licence sentence get that sentence's identifier. The identifiers in text order are
matched against ordered rules, longer rules first, of equal length the one listed first; sentences used by a
rule are not used again. What no rule explains is reported as ``unknown`` when a known sentence stands alone.

All of it happens inside the row of one document with DataFrame expressions: nothing is shuffled or
broadcast, and only texts that hold a word of the known sentences are cut at all.

Defined results: null and empty texts have no findings; repeated rows have equal findings each; a null
``doc_id`` is kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.arrays import rows_of
from chunkweave.functions.text import let
from chunkweave.llm.common import spans

#: Sentences of well-known licences and notices, by identifier.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-named": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-free": "This program is free software",
    "gpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2-work": "This work is licensed under the GNU General Public License, version 2",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl-3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd-3": "SPDX-License-Identifier: BSD-3-Clause",
}

#: Ordered rules: the licence, and the identifiers that must follow one another.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-later", "gpl-hope", "gpl-implied"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2-later", "gpl-hope", "gpl-implied"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2-later"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("MIT", ["mit-named"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["spdx-mit"]),
    ("GPL-3.0-only", ["gpl-3-work"]),
    ("GPL-2.0-only", ["gpl-2-work"]),
    ("GPL-3.0-or-later", ["spdx-gpl-3"]),
    ("BSD-3-Clause", ["spdx-bsd-3"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-4.0", ["cc-by-4-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
]
#: Every known sentence holds one of these.
ANCHORS = "(?i)licen[sc]|permission|redistribut|warrant|copyright|liable|free software"
LINE_BREAK = r"\n+"
SENTENCE_BREAK = r"[.!?;:]+[\x20\x09-\x0D]+"
#: Also lines without a letter or digit (blank, comment marks, rules), and copyright notices up to the end of
#: their line or sentence, however long. A notice always ends, so no position is searched twice.
PARAGRAPH_BREAK = (
    r"(?i:copyright)\x20+(?:\([cC]\)|\x{A9}|[0-9]{4})[^\n]*?(?:\n|[.!?;:]+[\x20\x09-\x0D]+|\z)"
    + r"|\n[^\p{L}\p{N}]*\n|"
    + SENTENCE_BREAK
)
#: Most other known sentences between two of a rule, unless a caller sets another number.
GAP = 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNIT = "array<struct<start:int,end:int,id:string,at:int,again:boolean>>"


def normal(text: Column) -> Column:
    """Lower-case letters and digits with single spaces between the runs."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def normal_text(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def _known_units(text: Column, separator: str, again: bool = False) -> Column:
    """Known units of the text between separators, with code point offsets; ``at`` is the first letter or
    digit, ``again`` marks the units of a cut that gives way to other cuts."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (normal_text(sentence), name)])

    def placed(breaks: Column) -> Column:
        units = F.split(text, separator, -1)
        marked = F.transform(
            units,
            lambda unit, i: let(
                F.when(i == 0, F.lit(0)).otherwise(F.get(breaks, i - 1)["end"]),
                lambda start: F.struct(start.alias("start"), (start + F.length(unit)).alias("end"), known[normal(unit)].alias("id"), unit.alias("unit")),
            ),
        )

        def begun(u: Column) -> Column:
            at = u["end"] - F.length(F.regexp_replace(u["unit"], "^[^A-Za-z0-9]+", ""))
            return F.struct(u["start"].alias("start"), u["end"].alias("end"), u["id"].alias("id"), at.alias("at"), F.lit(again).alias("again"))

        return F.transform(F.filter(marked, lambda u: u["id"].isNotNull()), begun)

    return let(spans(text, separator), placed)


def _distinct(units: Column) -> Column:
    """The units without those of the third cut that another cut found at the same first letter."""

    def once(s: Column) -> Column:
        return F.filter(s, lambda u, i: ~(u["again"] & F.coalesce((u["at"] == F.get(s, i - 1)["at"]) & (u["id"] == F.get(s, i - 1)["id"]), F.lit(False))))

    ordered = F.array_sort(
        F.transform(units, lambda u: F.struct(*[u[name].alias(name) for name in ("at", "id", "again", "start", "end")]))
    )
    return let(ordered, once)


def _sequence(units: Column) -> Column:
    """`` id:start:end`` of the units in text order. A line and a sentence at one place are one unit."""

    def once(s: Column) -> Column:
        kept = F.filter(s, lambda u, i: ~((u["start"].eqNullSafe(F.get(s, i + 1)["start"])) & u["id"].eqNullSafe(F.get(s, i + 1)["id"])))
        return F.array_join(
            F.transform(kept, lambda u: F.concat(F.lit(" "), u["id"], F.lit(":"), u["start"].cast("string"), F.lit(":"), u["end"].cast("string"))), ""
        )

    ordered = F.array_sort(F.transform(units, lambda u: F.struct(u["start"].alias("start"), u["id"].alias("id"), u["end"].alias("end"))))
    return let(ordered, once)


def _pattern(ids: list[str], gap: int | None = GAP) -> str:
    between = ".*?" if gap is None else r"(?: [^ :]+:\d+:\d+){0,%d}?" % gap
    return between.join(rf" {name}:\d+:\d+" for name in ids)


def scan_licenses(docs: DataFrame, gap: int | None = GAP) -> DataFrame:
    """``(doc_id, license, start, end, sentences)``, one row per finding; offsets in code points, end exclusive.

    ``gap``: how many other known sentences may stand between two sentences of a rule; None: any number, at
    a cost that grows with the square of a text's known sentences.
    """
    text = F.col("text")
    hinted = docs.select("doc_id", "text").filter(text.rlike(ANCHORS))
    units = F.concat(_known_units(text, LINE_BREAK), _known_units(text, SENTENCE_BREAK), _known_units(text, PARAGRAPH_BREAK, again=True))
    rest = hinted.select("doc_id", units.cast(_UNIT).alias("units")).filter(F.size("units") > 0).select("doc_id", _sequence(_distinct(F.col("units"))).alias("rest0"))
    ordered = sorted(enumerate(RULES), key=lambda r: (-len(r[1][1]), r[0]))
    for i, (_, (_, ids)) in enumerate(ordered):
        rest = rest.withColumns(
            {
                f"found{i}": F.regexp_extract_all(f"rest{i}", F.lit(_pattern(ids, gap)), F.lit(0)),
                f"rest{i + 1}": F.regexp_replace(f"rest{i}", _pattern(ids, gap), ""),
            }
        )

    def finding(license_name: str, found: Column) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(
                F.lit(license_name).alias("license"),
                F.regexp_extract(m, r"^ [^ :]+:(\d+):", 1).cast("int").alias("start"),
                F.regexp_extract(m, r":(\d+)$", 1).cast("int").alias("end"),
                F.regexp_replace(F.trim(m), r":\d+:\d+", "").alias("sentences"),
            ),
        )

    last = f"rest{len(ordered)}"
    every = F.concat(
        *[finding(name, F.col(f"found{i}")) for i, (_, (name, _)) in enumerate(ordered)],
        finding("unknown", F.regexp_extract_all(last, F.lit(r" [^ :]+:\d+:\d+"), F.lit(0))),
    )
    return rest.select("doc_id", F.explode(rows_of(every)).alias("f")).select("doc_id", "f.*")
