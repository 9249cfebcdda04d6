"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are its lines, its paragraphs (parted by blank lines) and the whole text, so a notice is found
alone on a line, wrapped over several, or as the document itself. A unit and a template are compared by
their sets of distinct word bigrams: dice = 2 * common / (unit's + template's). Two bounds prune before any set
is intersected, and neither can lose a match of ``least`` or more:

- size: common is at most the smaller set, so sizes too far apart cannot reach ``least``;
- anchors: a match shares at least least / (2 - least) of a template's n bigrams, so it holds one of any
  n - that + 1 of them; a unit without a word of those anchor bigrams is left out before its bigrams are made.

Templates are a small dictionary the caller hands over; they travel as one literal, and everything happens in
the row, so only the matches found are shuffled. DataFrame functions only.

Defined cases: null, empty and one-word units have no bigrams and match nothing; repeated rows count as
further units of their doc_id; of templates with equal dice the first id wins; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public licence notices.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
LEAST = 0.8
# What is not a letter or digit parts words.
BETWEEN = r"[^\p{L}\p{N}]+"


def normal_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_bigrams(notices: dict[str, list[str]] = NOTICES) -> list[tuple[str, list[str]]]:
    """(template id, distinct bigrams), in order of ids; the n-th notice of a licence is named licence#n."""
    out = []
    for licence, texts in sorted(notices.items()):
        for n, text in enumerate(texts, 1):
            w = normal_words(text)
            out.append((f"{licence}#{n}", sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return out


def anchor_words(templates: list[tuple[str, list[str]]], least: float) -> list[str]:
    """Words of which every matching unit holds one: the longer word of each anchor bigram, long bigrams first."""
    found = set()
    for _, bigrams in templates:
        spare = len(bigrams) - math.ceil(least / (2 - least) * len(bigrams) - 1e-9) + 1
        for b in sorted(bigrams, key=lambda b: (-max(map(len, b.split())), b))[:spare]:
            found.add(max(b.split(), key=len))
    return sorted(found)


def units(text: Column) -> Column:
    """Distinct lines, paragraphs and the whole of a text."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.array(text)))


def _once(value: Column) -> Column:
    """``value`` behind a generator, so that filters and later columns read it and do not compute it again."""
    return F.explode(F.array(value))


def scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> DataFrame:
    """Licences of (doc_id, text): doc_id, license_id, score (best dice), n_units (units where it is the best)."""
    templates = template_bigrams(notices)
    # one literal each, folded to a constant when the query is planned
    known = F.from_json(F.lit(json.dumps([{"id": name, "n": len(b), "bigrams": b} for name, b in templates])),
                        "array<struct<id:string,n:int,bigrams:array<string>>>")
    anchors = F.split(F.lit(" ".join(anchor_words(templates, least))), " ")
    each = docs.select("doc_id", F.explode_outer(units(docs["text"])).alias("unit"))
    each = each.select("doc_id", _once(F.split(F.trim(F.regexp_replace(F.lower("unit"), BETWEEN, " ")), " ")).alias("words"))
    each = each.where(F.arrays_overlap("words", anchors) & (F.size("words") > 1))
    pairs = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1),
                                        lambda a, b: F.concat(a, F.lit(" "), b)))
    each = each.select("doc_id", _once(pairs).alias("bigrams")).select("doc_id", "bigrams", _once(F.size("bigrams")).alias("n"))
    near = F.filter(known, lambda t: F.least(t["n"], F.col("n")) * 2.0 / (t["n"] + F.col("n")) >= least)
    scored = F.transform(near, lambda t: F.struct(
        (F.size(F.array_intersect(F.col("bigrams"), t["bigrams"])) * 2.0 / (t["n"] + F.col("n"))).alias("dice"), t["id"].alias("id")))
    # the best, of equals the first: templates are in order of ids
    best = F.aggregate(scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("id")), lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))
    found = each.select("doc_id", _once(best).alias("best")).where(F.col("best.dice") >= least)
    return found.groupBy("doc_id", F.substring_index("best.id", "#", 1).alias("license_id")).agg(
        F.max("best.dice").alias("score"), F.count("*").alias("n_units"))
