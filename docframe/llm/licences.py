r"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from ancestor directories.

In DataFrame functions only.  A file's headers are its lines that name a
licence, wherever they stand, one by one and taken together; a licence file
(by name) is compared as a whole.  Equal headers of many files are compared
once.  A short header that has a term which tells a family's licences apart
(share-alike, Affero, Lesser) is matched only to templates that have it.
Terms are words and version numbers; a term's weight is its count times
its inverse document frequency among the templates, and terms that no template
has count fully in a header's norm.  A file without a licence of its own gets
that of the nearest directory at or above its own that holds a licence file,
or a file that is mostly licence text; directories are made distinct before
the path join, so there a directory of a third of all files costs one row.  Rows
get their own and their directory's licence by joins on path and directory: one
row on the right for each key, and large keys on the left are split by adaptive
execution.

The templates are a parameter of bounded size, and only they are broadcast.

Cases: null and empty texts have no licence of their own; a null path gets
none and inherits none; rows of one path are one file, whose best match
counts, and each row is returned; ties go to the licence that sorts first; very
long texts are searched whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.arrowmap import shared_dir, written

LEAST = 0.5
MOSTLY = 50  # percent of a file's words that its headers make up
CUE = r"(?i)(licen[sc]e|copyright|spdx-|permission is hereby granted|redistribution and use|neither the name of|permission to use, copy, modify)"
LICENCE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Terms that tell licences of a family apart: a notice of at most NOTICE terms that has one is matched only to templates that have it too.
MARKERS = (
    "affero", "agpl", "apache", "boost", "bsd", "cc0", "eclipse", "epl", "gpl", "isc", "lesser", "lgpl", "mit", "mozilla", "mpl", "nc", "nd", "neither", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike", "unlicense", "zlib",
)
NOTICE = 80

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
_MIT_TEXT = (
    _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    _BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def _free(kind: str, version: str) -> tuple[str, ...]:
    """The notices of a GNU licence."""
    name = f"GNU {kind}General Public License"
    what = "This library" if kind in ("Lesser ", "Library ") else "This program"
    return (
        f"This work is licensed under the {name}, version {version}.",
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"Licensed under the {name} v{version}.0 or later, see the file COPYING.",
        f"{name} Version {version}",
    )


def _commons(marks: str, words: str) -> tuple[str, ...]:
    return (f"Licensed under CC {marks} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.", f"Creative Commons {words} 4.0 International Public License CC {marks} 4.0 Legal Code")


#: Notices by which works are commonly put under a licence, and the texts of the short ones (fixed values: the wordings in use).
NOTICES = {
    "AGPL-3.0": _free("Affero ", "3"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed to the Foundation under one or more contributor license agreements under the Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": ("Licensed under the two-clause BSD license.", "BSD 2-Clause License, Simplified BSD License, FreeBSD License", _BSD_TWO + _BSD_END),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD, "BSD 3-Clause License, New BSD License, Modified BSD License", _BSD_NAMES, _BSD + ". " + _BSD_NAMES, _BSD_TWO + "3. " + _BSD_NAMES + " " + _BSD_END),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "CC-BY-4.0": _commons("BY", "Attribution"),
    "CC-BY-NC-4.0": _commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0": _commons("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": _commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": _commons("BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Eclipse Public License - v 2.0"),
    "GPL-2.0": (*_free("", "2"), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2"),
    "GPL-3.0": (*_free("", "3"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License"),
    "ISC": ("Released under the ISC License.", _ISC, "ISC License " + _ISC),
    "LGPL-2.1": _free("Lesser ", "2.1"),
    "LGPL-3.0": _free("Lesser ", "3"),
    "MIT": ("Released under the MIT License.", "The MIT License (MIT)", "Licensed under the MIT license. See LICENSE in the project root for license information.", _MIT, _MIT_TEXT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "Released under the Unlicense."),
    "Zlib": ("Licensed under the zlib license.", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
}
#: And the line by which files name their licence to programs.
TEMPLATES = {name: (*texts, f"SPDX-License-Identifier: {name}") for name, texts in NOTICES.items()}


def _templates(spark, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """licence, template, term, idf and the term's share of the template's unit vector."""
    rows = [(name, i, text) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
    one = spark.createDataFrame(rows, "licence string, template int, text string")
    terms = one.select("licence", "template", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("licence", "template", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg((F.log(F.lit(1.0 + len(rows)) / (1 + F.count("*"))) + 1).alias("idf"))
    weighed = terms.join(F.broadcast(df), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("licence", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(F.broadcast(norm), ["licence", "template"]).select("licence", "template", "term", "idf", (F.col("w") / F.col("norm")).alias("w"))


def match(units: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """The best licence of each distinct unit (unit_id, unit), with its cosine, if that is at least LEAST.

    Terms travel with the id of their unit, not with its text."""
    spark = units.sparkSession
    table = _templates(spark, templates)
    known = spark.createDataFrame(table.collect(), table.schema)  # as many rows as the templates have terms
    idf = known.select("term", "idf").distinct()
    unseen = F.log(F.lit(1.0 + sum(map(len, templates.values())))) + 1
    distinct = units.groupBy("unit_id").agg(F.first("unit").alias("unit"))
    tf = distinct.select("unit_id", F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("tf"))
    whole = Window.partitionBy("unit_id")
    marker = F.when(F.col("term").isin(*MARKERS), 1).otherwise(0)
    weighed = tf.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", unseen))
    weighed = weighed.withColumn("norm", F.sqrt(F.sum(F.col("x") * F.col("x")).over(whole))).withColumn("marks", F.sum(marker).over(whole)).withColumn("terms", F.sum("tf").over(whole))
    dots = weighed.join(F.broadcast(known.drop("idf")), "term").groupBy("unit_id", "licence", "template").agg((F.sum(F.col("x") * F.col("w")) / F.max("norm")).alias("cosine"), (F.sum(marker) == F.max("marks")).alias("told"), F.max("terms").alias("terms"))
    dots = dots.where(F.col("told") | (F.col("terms") > NOTICE))
    best = dots.groupBy("unit_id").agg(F.min(F.struct((-F.round("cosine", 6)).alias("c"), "licence")).alias("best"))
    return best.select("unit_id", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine")).where(F.col("cosine") >= LEAST)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """A row per row of files: the columns named by keep, path, licence, cosine, origin (header, file, inherited or null)
    and from_dir."""
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    rows = files.select(*kept, F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    named = F.col("path").rlike(LICENCE_NAME)
    marked = rows.withColumn("lines", lines).where(F.col("path").isNotNull() & (named | (F.size("lines") > 0)))
    words = lambda c: F.size(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)))
    joined = F.array_join("lines", "\n")
    whole = F.when(named, F.array(F.col("text"))).when(F.size("lines") > 1, F.array(joined)).otherwise(F.array().cast("array<string>"))
    marked = marked.select("path", F.concat(whole, "lines").alias("units"), (named | (words(joined) * 100 >= words(F.col("text")) * MOSTLY)).alias("rules"))
    # Written once: the texts are read and searched a single time, and what follows is of the size of the headers.
    folder = shared_dir(files.sparkSession)
    units = written(marked.select("path", "rules", F.explode("units").alias("unit")).withColumn("unit_id", F.unhex(F.md5("unit"))), folder, "units")
    found = units.drop("unit").join(match(units, templates), "unit_id").groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best"), F.max("rules").alias("rules"))
    own = written(found.select("path", F.col("best.licence").alias("licence"), (-F.col("best.c")).alias("cosine"), "rules"), folder, "own")
    of = F.regexp_replace("path", r"/?[^/]*$", "")
    rulers = own.where("rules").withColumn("dir", of).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best")).select(F.col("dir").alias("above"), F.col("best.licence").alias("licence"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    dirs = rows.select(of.alias("dir")).where("dir is not null").distinct().withColumn("parts", parts)
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", 1, k), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = above.join(rulers, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "licence")).alias("near"))
    nearest = nearest.select("dir", F.col("near.above").alias("from_dir"), F.col("near.licence").alias("inherited"))
    named_own = own.select("path", F.col("licence").alias("own"), "cosine", "rules")
    paths = rows.drop("text").withColumn("dir", of).join(named_own, "path", "left").join(nearest, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("path").rlike(LICENCE_NAME), "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited")
    return paths.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], "path", F.coalesce("own", "inherited").alias("licence"), "cosine", origin.alias("origin"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))


def _values(templates: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"('{name}', {i}, '{text}')" for name, texts in sorted(templates.items()) for i, text in enumerate(texts))


#: Where the query puts documents: those of a source in folders of 1,024 and in them of 64, the first of each a licence file.
PATH_SQL = "source || '/' || (doc_id {div} 1024) || '/' || (doc_id {div} 64) || '/' || CASE WHEN doc_id % 64 = 0 THEN 'LICENSE' ELSE 'doc' || doc_id || '.txt' END"

ORACLE = rf"""
WITH doc AS (SELECT doc_id, {PATH_SQL.format(div="//")} AS path, coalesce(text, '') AS text FROM documents),
template AS (SELECT * FROM (VALUES {_values(TEMPLATES)}) v(licence, template, text)),
tterm AS (SELECT licence, template, term, count(*) AS tf FROM (SELECT licence, template, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM template) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM template)) / (1 + count(*))) + 1 AS idf FROM tterm GROUP BY term),
tw AS (SELECT licence, template, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY licence, template)) AS norm FROM tterm JOIN idf USING (term)),
marked AS (
  SELECT path, text, regexp_matches(path, '{LICENCE_NAME}') AS named, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')) AS lines FROM doc
), cued AS (SELECT * FROM marked WHERE named OR len(lines) > 0),
unit AS (
  SELECT path, named OR len(regexp_extract_all(lower(array_to_string(lines, chr(10))), '{TERM}')) * 100 >= len(regexp_extract_all(lower(text), '{TERM}')) * {MOSTLY} AS rules,
         unnest(list_concat(CASE WHEN named THEN [text] WHEN len(lines) > 1 THEN [array_to_string(lines, chr(10))] ELSE [] END, lines)) AS unit FROM cued
), uterm AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM (SELECT DISTINCT unit FROM unit)) GROUP BY ALL),
uw AS (SELECT unit, term, tf, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM template)) + 1) AS x FROM uterm LEFT JOIN idf USING (term)),
unorm AS (SELECT unit, sqrt(sum(x * x)) AS n, count(*) FILTER (term IN {MARKERS}) AS marks, sum(tf) AS terms FROM uw GROUP BY unit),
dot AS (SELECT unit, licence, template, round(sum(x * w / norm) / max(n), 6) AS cosine, count(*) FILTER (term IN {MARKERS}) = max(marks) AS told, max(terms) AS terms FROM uw JOIN tw USING (term) JOIN unorm USING (unit) GROUP BY unit, licence, template),
best AS (SELECT unit, licence, cosine FROM dot WHERE told OR terms > {NOTICE} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY cosine DESC, licence) = 1),
found AS (SELECT path, rules, licence, cosine FROM unit JOIN best USING (unit) WHERE cosine >= {LEAST}),
own AS (SELECT path, bool_or(rules) OVER (PARTITION BY path) AS rules, licence, cosine, regexp_replace(path, '/?[^/]*$', '') AS dir FROM found QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) = 1),
ruler AS (SELECT dir, licence FROM own WHERE rules QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM doc),
near AS (
  SELECT p.dir, r.dir AS from_dir, r.licence AS inherited FROM (SELECT DISTINCT dir FROM placed) p JOIN ruler r ON r.dir = p.dir OR r.dir = '' OR starts_with(p.dir, r.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(r.dir) DESC) = 1
)
SELECT doc_id, path, coalesce(licence, inherited) AS licence, cosine,
       CASE WHEN licence IS NOT NULL THEN CASE WHEN regexp_matches(path, '{LICENCE_NAME}') THEN 'file' ELSE 'header' END WHEN inherited IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM placed LEFT JOIN (SELECT path, licence, cosine FROM own) USING (path) LEFT JOIN near USING (dir)
"""
