"""Licence scans: normalised text against licence templates by the Dice coefficient of their word bigrams.

Units of a document are its lines, its paragraphs (parted by blank lines) and its
whole text, so a notice inside prose and a licence file are both found. Text is
lower-cased, and what is neither letter nor digit parts words. With a Dice
coefficient of at least t, a unit's number of bigrams lies within t / (2 - t) and
(2 - t) / t of the template's; only such templates are compared.

Before, whole documents are passed over that hold none of the telling words. That
loses nothing: a unit that reaches t shares at least t / (2 - t) of a template's
bigrams, so of any set of the template's bigrams that leaves fewer than these, it
holds one; the telling words touch such a set for every template.

Defined cases: a null or empty text, and units of fewer than two words, match
nothing; rows with equal ids or texts are scanned one by one; an empty table gives
an empty result; further columns are kept, and a column named ``licences`` is
replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
SEPARATOR = r"[^\p{L}\p{N}]+"

#: Public licence notices and short licence texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
]


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def telling_words(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one; long words first, as they are rarer."""
    told: set[str] = set()
    for _, text in templates:
        grams = bigrams(text)
        shared = threshold / (2 - threshold) * len(grams)
        words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in told, -len(w), w))
        own: set[str] = set()
        for w in words:
            if len(grams) - sum(bool(own & set(g.split())) for g in grams) < shared - 1e-9:
                break
            own.add(w)
        told |= own
    return sorted(told)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR, -1), lambda w: w != "")


def _grams(text: Column) -> Column:
    words = _words(text)
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``licences``: array of struct (unit: line, paragraph or text; number, from 0; licence; dice), of units that reach the threshold."""
    templates = templates or TEMPLATES
    kept = [c for c in docs.columns if c.lower() != "licences"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))
    told = F.split(F.lit(" ".join(telling_words(templates, threshold))), " ")
    known = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(bigrams(t))).alias("n"), F.split(F.lit("|".join(bigrams(t))), r"\|").alias("grams")) for name, t in templates])
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold

    def unit(kind: str):
        return lambda text, i: F.struct(F.lit(kind).alias("unit"), i.alias("number"), _grams(text).alias("grams"))

    units = F.concat(
        F.transform(F.split("_text", "\n", -1), unit("line")),
        F.transform(F.split("_text", "\n[ \t\r]*\n", -1), unit("paragraph")),
        F.transform(F.array("_text"), unit("text")),
    )
    held = held.withColumn("_units", F.when(F.arrays_overlap(F.split(F.lower("_text"), SEPARATOR, -1), told), units))

    def against(u: Column) -> Column:
        n = F.size(u["grams"])
        fits = F.filter(known, lambda t: (n >= t["n"] * low - 1e-9) & (n <= t["n"] * high + 1e-9))
        scored = F.transform(fits, lambda t: F.struct(u["unit"].alias("unit"), u["number"].alias("number"), t["licence"].alias("licence"), (2 * F.size(F.array_intersect(u["grams"], t["grams"])) / (n + t["n"])).alias("dice")))
        return F.filter(scored, lambda s: s["dice"] >= threshold - 1e-9)

    found = F.flatten(F.transform(F.filter("_units", lambda u: F.size(u["grams"]) > 0), against))
    empty = F.array().cast("array<struct<unit:string,number:int,licence:string,dice:double>>")
    return held.select(*[F.col(f"_doc.`{c}`") for c in kept], F.coalesce(found, empty).alias("licences"))


def report(docs: DataFrame, id_column: str = "doc_id", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and licence found: the best coefficient and the number of its lines that match."""
    hits = scan(docs, templates, threshold).where(F.size("licences") > 0)
    each = F.array_distinct(F.transform("licences", lambda s: s["licence"]))
    hits = hits.select(id_column, "licences", F.explode(each).alias("licence"))
    own = F.filter("licences", lambda s: s["licence"] == F.col("licence"))
    lines = F.array_distinct(F.transform(F.filter(own, lambda s: s["unit"] == "line"), lambda s: s["number"]))
    return hits.select(id_column, "licence", F.array_max(F.transform(own, lambda s: s["dice"])).alias("dice"), F.size(lines).cast("long").alias("n_lines"))


def oracle(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``report`` over documents, comparing every unit with every template."""
    values = ", ".join("({}, '{}', {})".format(i, name, "['" + "', '".join(bigrams(t)) + "']") for i, (name, t) in enumerate(TEMPLATES))
    return rf"""
WITH templates(t, licence, grams) AS (VALUES {values}),
d AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, r, 1 AS is_line, unnest(range(len(parts))) AS number, unnest(parts) AS body FROM (SELECT doc_id, r, string_split(text, chr(10)) AS parts FROM d)
  UNION ALL
  SELECT doc_id, r, 0, 0, text FROM d
  UNION ALL
  SELECT doc_id, r, 0, unnest(range(len(parts))), unnest(parts) FROM (SELECT doc_id, r, regexp_split_to_array(text, '\n[ \t\r]*\n') AS parts FROM d)
),
worded AS (SELECT doc_id, r, is_line, number, list_filter(regexp_split_to_array(lower(body), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM units),
grams AS (SELECT doc_id, r, is_line, number, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM worded WHERE len(w) > 1),
scored AS (
  SELECT doc_id, r, is_line, number, licence, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice
  FROM grams JOIN templates ON len(g) BETWEEN {threshold / (2 - threshold)} * len(grams) - 1e-9 AND {(2 - threshold) / threshold} * len(grams) + 1e-9
)
SELECT doc_id, licence, max(dice)::DOUBLE AS dice, (count(DISTINCT CASE WHEN is_line = 1 THEN number END))::BIGINT AS n_lines
FROM scored WHERE dice >= {threshold - 1e-9} GROUP BY doc_id, r, licence
"""
