"""Licence scans in DataFrame functions only.

* pieces: of every file each line and each paragraph with a licence cue (headers,
  footers), of a file that is named as a licence file also its whole text;
* each distinct piece, known by its digest, is compared once with the templates
  (names, notices, SPDX tags, headers and short whole licences) by the cosine of
  sparse TF-IDF vectors, as joins of (piece, term) with (template, term); a line
  that a third of all files share is one piece;
* a file's own licence is its best piece's, at ``THRESHOLD`` or more; a
  directory's is the best among the files right in it, licence files first;
* a file without its own takes the licence of the nearest directory above it
  that has one: the distinct directories are joined with their ancestors'
  paths, files only with their directory.

Defined results: a null text has no pieces, a null path is a file in the root;
ties go to the larger cosine, then the licence's name; rows that repeat a path
share their pieces; files under no licensed directory have a null licence; an
empty table gives no rows; whole texts are scanned whatever their length; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.llm.common import broadcast_if_small, staged

# SPDX identifiers, names and short names of common licences.
LICENCES = (
    ("Apache-2.0", "Apache License, Version 2.0", "Apache 2.0"),
    ("MIT", "MIT License", "MIT"),
    ("ISC", "ISC License", "ISC"),
    ("BSD-2-Clause", "BSD 2-Clause License", "BSD-2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause License", "BSD-3-Clause"),
    ("GPL-2.0", "GNU General Public License, version 2", "GNU GPL v2"),
    ("GPL-3.0", "GNU General Public License, version 3", "GNU GPL v3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "GNU AGPL v3"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0", "MPL 2.0"),
    ("EPL-2.0", "Eclipse Public License, Version 2.0", "EPL 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "BSL 1.0"),
    ("Zlib", "zlib License", "zlib"),
    ("Unlicense", "The Unlicense", "Unlicense"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal", "CC0 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"),
)
# How a licence is named in a line.
FORMS = ("SPDX-License-Identifier: {id}", "{name}", "Licensed under the {name}.", "Released under the {name}.",
         "This file is licensed under the {name} (see LICENSE).", "This work is licensed under the {name}.",
         "Licensed under {short}.", "This text is released under {short}.")
# Ends of the identifiers of licences that have versions.
VERSIONED, ENDS = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"), ("-only", "-or-later")
# Public headers and short whole licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
                   " compliance with the License. You may obtain a copy of the License at"
                   " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
                   " software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR"
                   " CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
                   " governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in"
                   " compliance with the License."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files, to deal in the Software without restriction."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this"
            " software and associated documentation files (the Software), to deal in the Software without restriction,"
            " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or"
            " sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
            " following conditions: The above copyright notice and this permission notice shall be included in all copies or"
            " substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR"
            " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
            " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
            " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
            " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
            " granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
                " General Public License as published by the Free Software Foundation, either version 3 of the License,"
                " or any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"
                     " provided that the following conditions are met: 1. Redistributions of source code must retain the above"
                     " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary"
                     " form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
                     " in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"
                     " provided that the following conditions are met: 1. Redistributions of source code must retain the above"
                     " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary"
                     " form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
                     " in the documentation and/or other materials provided with the distribution. 3. Neither the name of the"
                     " copyright holder nor the names of its contributors may be used to endorse or promote products derived"
                     " from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"
                     " provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL"
                " was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Public domain,"
                " CC0 1.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)


def templates() -> list[tuple[str, str]]:
    """Licence and text of every template: each licence in each form, and the
    notices."""
    out = []
    for spdx, name, short in LICENCES:
        out += [(spdx, form.format(id=spdx, name=name, short=short)) for form in FORMS]
        if spdx in VERSIONED:
            out += [(spdx, FORMS[0].format(id=spdx + end)) for end in ENDS]
    return [*out, *NOTICES]


TEMPLATES = tuple(templates())
CUE = "(?i)licen[cs]|copyright|permission|redistribut|warrant|public domain|spdx|released under|creative commons|(^|[^a-z])cc[ -]?(by|0)"
PARAGRAPH = "\n[ \t]*\n"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
THRESHOLD = 0.6


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("licence"), F.lit(t).alias("piece"))
                     for i, (n, t) in enumerate(TEMPLATES)])
    return spark.range(1, numPartitions=1).select(F.inline(rows))


def _terms(pieces: DataFrame, *key: str) -> DataFrame:
    """``key, term, tf``: damped term frequency."""
    term = F.explode(F.regexp_extract_all(F.lower("piece"), F.lit(TERM), F.lit(0))).alias("term")
    return (pieces.select(*key, term).groupBy(*key, "term").agg(F.count("*").alias("n"))
            .select(*key, "term", (1 + F.log("n")).alias("tf")))


def match_pieces(pieces: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``digest, licence, cosine`` of the distinct pieces (``digest, piece``)
    that match a template."""
    spark = pieces.sparkSession
    n = len(TEMPLATES)
    of_template = _terms(_templates(spark), "template", "licence")
    idf = of_template.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    rare = F.log(F.lit(1.0 + n)) + 1  # of a term that no template has
    template = of_template.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = template.groupBy(F.col("template").alias("_t")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    # the templates are fixed: some thousand rows, written once
    template = staged(template.join(length, F.col("template") == F.col("_t")).select("template", "licence", "term", "w", "idf", "t_norm"),
                      "licence-templates")
    weights = template.select("term", "idf").distinct()
    own = _terms(pieces.dropDuplicates(["digest"]), "digest").join(F.broadcast(weights), "term", "left")
    own = own.withColumn("pw", F.col("tf") * F.coalesce("idf", rare)).drop("idf")
    norm = own.groupBy(F.col("digest").alias("_p")).agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("p_norm"))
    dots = (own.join(F.broadcast(template.drop("idf")), "term").groupBy("digest", "template", "licence", "t_norm")
            .agg(F.sum(F.col("w") * F.col("pw")).alias("dot")))
    cosine = F.round(F.col("dot") / (F.col("t_norm") * F.col("p_norm")), 6)
    best = (dots.join(norm, F.col("digest") == F.col("_p")).select("digest", "licence", cosine.alias("cosine"))
            .where(F.col("cosine") >= threshold)
            .groupBy("digest").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")))
    return best.select("digest", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"))


def parent(path: Column) -> Column:
    """The directory of a path; the root is empty."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, with the root."""
    parts = F.split(folder, "/")
    return F.concat(F.array(F.lit("")), F.when(folder == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, path, own_licence, cosine, licence, licence_dir`` of every row
    of ``files`` (``doc_id, path, text``); ``licence_dir`` is the directory that
    an inherited licence comes from."""
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    # a paragraph of one line is that line
    cues = F.filter(F.array_union(F.split(text, "\n"), F.split(text, PARAGRAPH)), lambda x: x.rlike(CUE))
    pieces = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(named, F.array_union(cues, F.array(text))).otherwise(cues)
    found = staged(files.select(F.coalesce("path", F.lit("")).alias("path"), named.alias("named"), F.explode(pieces).alias("piece"))
                   .withColumn("digest", F.md5("piece")), "licence-pieces")
    matched = broadcast_if_small(staged(match_pieces(found, threshold), "licence-matches"))
    rank = F.struct((~F.col("named")).alias("other"), (-F.col("cosine")).alias("c"), "licence")
    declared = staged(found.drop("piece").join(matched, "digest").groupBy(F.col("path").alias("_path"))
                      .agg(F.min(rank).alias("best")), "licence-files")
    folders = (declared.groupBy(parent(F.col("_path")).alias("_dir")).agg(F.min("best").alias("dir_best")))
    every = files.select("doc_id", "path", parent(F.col("path")).alias("dir"))
    above = every.select("dir").distinct().select(F.col("dir").alias("_of"), F.explode(ancestors(F.col("dir"))).alias("_up"))
    nearest = (above.join(folders, F.col("_up") == F.col("_dir"))
               .groupBy("_of").agg(F.max_by(F.struct("_dir", "dir_best"), F.length("_dir")).alias("near")))
    return (every.join(declared, F.coalesce("path", F.lit("")) == F.col("_path"), "left")
            .join(nearest, F.col("dir") == F.col("_of"), "left")
            .select("doc_id", "path", F.col("best.licence").alias("own_licence"), (-F.col("best.c")).alias("cosine"),
                    F.coalesce(F.col("best.licence"), F.col("near.dir_best.licence")).alias("licence"),
                    F.when(F.col("best").isNull(), F.col("near._dir")).alias("licence_dir")))


def document_paths(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: a folder per source, in it one per
    1,024 ids and in that, for two of three ids, one per 32.  One of 97 is named
    as a licence file.  A row without id is named by its text's digest."""
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce(F.expr("doc_id div 1024").cast("string"), F.lit("none")))
    folder = F.when(F.col("doc_id").isNull() | (F.expr("doc_id % 3") == 0), top).otherwise(F.concat_ws("/", top, F.expr("doc_id div 32")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), F.md5(F.coalesce("text", F.lit("")))))
    name = F.concat(F.when(F.expr("doc_id % 97") == 0, F.lit("LICENSE-")).otherwise(F.lit("")), name, F.lit(".txt"))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(threshold: float = THRESHOLD) -> str:
    """The same scan of ``documents`` in DuckDB SQL."""
    values = ", ".join(f"({i}, {_literal(n)}, {_literal(t)})" for i, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH templates(template, licence, piece) AS (VALUES {values}),
files AS (
  SELECT doc_id, text, coalesce(doc_id % 97 = 0, false) AS named,
         coalesce(source, 'none') || '/' || coalesce((doc_id // 1024)::VARCHAR, 'none') ||
         CASE WHEN doc_id IS NULL OR doc_id % 3 = 0 THEN '' ELSE '/' || (doc_id // 32) END || '/' ||
         CASE WHEN doc_id % 97 = 0 THEN 'LICENSE-' ELSE '' END ||
         coalesce(doc_id::VARCHAR, 'none-' || md5(coalesce(text, ''))) || '.txt' AS path
  FROM documents),
pieces AS (
  SELECT DISTINCT path, named, piece FROM (
    SELECT path, named, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '{PARAGRAPH}'))) AS piece
    FROM files WHERE text <> '')
  WHERE regexp_matches(piece, '{CUE}')
  UNION SELECT path, named, text FROM files WHERE named AND text <> ''),
tt AS (
  SELECT template, licence, term, 1 + ln(count(*)) AS tf
  FROM (SELECT template, licence, unnest(regexp_extract_all(lower(piece), '{TERM}')) AS term FROM templates)
  GROUP BY ALL),
idf AS (SELECT term, ln({1.0 + len(TEMPLATES)} / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, licence, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS t_norm
       FROM tt JOIN idf USING (term)),
pt AS (
  SELECT piece, term, 1 + ln(count(*)) AS tf
  FROM (SELECT piece, unnest(regexp_extract_all(lower(piece), '{TERM}')) AS term FROM (SELECT DISTINCT piece FROM pieces))
  GROUP BY ALL),
pw AS (SELECT piece, term, tf * coalesce(idf, ln({1.0 + len(TEMPLATES)}) + 1) AS pw FROM pt LEFT JOIN idf USING (term)),
pn AS (SELECT piece, sqrt(sum(pw * pw)) AS p_norm FROM pw GROUP BY piece),
dots AS (SELECT piece, template, licence, t_norm, sum(w * pw) AS dot FROM pw JOIN tw USING (term) GROUP BY ALL),
cos AS (SELECT piece, licence, round(dot / (t_norm * p_norm), 6) AS cosine FROM dots JOIN pn USING (piece)),
best AS (SELECT piece, licence, cosine,
                row_number() OVER (PARTITION BY piece ORDER BY cosine DESC, licence) AS k
         FROM cos WHERE cosine >= {threshold}),
own AS (
  SELECT path, named, licence, cosine FROM (
    SELECT path, named, licence, cosine, row_number() OVER (PARTITION BY path ORDER BY cosine DESC, licence) AS k
    FROM pieces JOIN (SELECT * FROM best WHERE k = 1) USING (piece)) WHERE k = 1),
dirs AS (
  SELECT dir, licence FROM (
    SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence,
           row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY named DESC, cosine DESC, licence) AS k
    FROM own) WHERE k = 1),
f AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir FROM files),
near AS (
  SELECT f_dir, arg_max(dir, length(dir)) AS dir, arg_max(licence, length(dir)) AS licence
  FROM (SELECT DISTINCT f.dir AS f_dir FROM f) JOIN dirs ON f_dir = dirs.dir OR starts_with(f_dir, dirs.dir || '/')
  GROUP BY f_dir)
SELECT doc_id, f.path, own.licence AS own_licence, own.cosine, coalesce(own.licence, near.licence) AS licence,
       CASE WHEN own.licence IS NULL THEN near.dir END AS licence_dir
FROM f LEFT JOIN own ON f.path = own.path LEFT JOIN near ON f.dir = near.f_dir
"""
