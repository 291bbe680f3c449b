"""Licence notices in texts: Dice coefficient of word bigrams with templates, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import read

#: Notices as the licences' own pages or the SPDX list give them (fixed values).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
]
_WORD = "[a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def normalized(text: Column) -> Column:
    """Words of a text: runs of letters and digits of ASCII, in lower case."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), 0)


def template_bigrams(text: str) -> list[str]:
    import re

    w = re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, licenses, n_matches, best_permille) for every row of docs(doc_id, text).

    Units of a text are its lines and, where a paragraph (between blank lines) has several lines, the paragraph. A unit
    matches a template if twice the number of shared distinct word bigrams is at least 0.8 of the sum of both numbers; as
    no more are shared than either has, templates that are too small or too large for a unit are left out unseen.
    best_permille is the greatest coefficient in thousandths, rounded down. licenses: names in order, joined by commas.

    Null and empty texts match nothing; rows that share a doc_id (or have none) all get the matches of each of them.
    """
    # A literal of a few dozen templates: its size is the constant list above.
    known = [(name, g) for name, text in templates if (g := template_bigrams(text))]
    table = F.array(*(F.struct(F.lit(n).alias("license"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for n, g in known))
    least = min(-(-2 * len(g) // 3) for _, g in known)
    paragraphs = F.filter(F.split("text", "\n[ \t\r]*\n"), lambda p: p.contains("\n"))
    # A row's lines are read where it lies: only its matches move.
    units = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.concat(F.split("text", "\n"), paragraphs)).alias("unit"))
    words = units.select("doc_id", normalized(F.col("unit")).alias("w")).where(F.size("w") > least)
    grams = words.select("doc_id", _bigrams(F.col("w")).alias("g")).withColumn("n", F.size("g"))
    fits = lambda t: 5 * F.least(t["n"], F.col("n")) >= 2 * (t["n"] + F.col("n"))
    pairs = grams.withColumn("t", F.explode(F.filter(table, fits))).withColumn("shared", F.size(F.array_intersect("g", "t.grams")))
    found = pairs.where(5 * F.col("shared") >= 2 * (F.col("n") + F.col("t.n")))
    each = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("t.license")), ",").alias("licenses"), F.count("*").alias("n_matches"), F.max(F.floor(2000 * F.col("shared") / (F.col("n") + F.col("t.n")))).alias("best_permille"))
    each = each.withColumnRenamed("doc_id", "id")
    out = docs.select("doc_id").join(each, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("best_permille", F.lit(0)).cast("long").alias("best_permille"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every whole text; null and empty texts have none."""
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in TEMPLATES)
    words = lambda x: f"regexp_extract_all(translate({x}, '{_UPPER}', '{_LOWER}'), '{_WORD}')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates(license, text) AS (VALUES {rows}),
t AS (SELECT license, {grams} AS tg FROM (SELECT license, {words('text')} AS w FROM templates)),
u AS (
  SELECT doc_id, unnest(list_concat(string_split(text, chr(10)),
    list_filter(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda p: contains(p, chr(10))))) AS unit
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, {grams} AS ug FROM (SELECT doc_id, {words('unit')} AS w FROM u)),
c AS (
  SELECT doc_id, license, len(ug) AS a, len(tg) AS b, len(list_intersect(ug, tg)) AS s
  FROM g, t WHERE 5 * least(len(ug), len(tg)) >= 2 * (len(ug) + len(tg)) AND len(ug) > 0),
m AS (SELECT * FROM c WHERE 5 * s >= 2 * (a + b)),
r AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, count(*) AS n_matches, max(2000 * s // (a + b)) AS best
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0) AS n_matches, CAST(coalesce(best, 0) AS BIGINT) AS best_permille
FROM documents d LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()
