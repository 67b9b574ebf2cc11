"""Common notices, licence files, paragraphs, rows without id."""

from pyspark.sql import functions as F

from binscore.llm import licences


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    return {(r.doc_id, r.path): r for r in licences.scan(df).collect()}


def test_common_notices_and_files(spark):
    want = {"SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
            "SPDX-License-Identifier: MIT": "MIT", "This text is released under CC BY 4.0.": "CC-BY-4.0",
            "BSD 3-Clause License": "BSD-3-Clause", "Mozilla Public License Version 2.0": "MPL-2.0",
            "This file is part of Foo, licensed under the Apache License 2.0 (see LICENSE).": "Apache-2.0",
            "our license is silent on this": None, "no permission, no copyright, no warranty of mine": None}
    rows = [(i, f"d{i}/x.c", f"code\n{t}\ncode") for i, t in enumerate(want)]
    mit = dict(licences.NOTICES[4:6])["MIT"]
    rows += [(50, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Someone Else\n\n" + mit.split("(c) ")[1].replace(". ", ".\n")),
             (51, "m/a/b/c.txt", "nothing here"),
             # a header over several lines is one paragraph
             (52, "h/x.py", "#!/bin/sh\n\n" + "\n".join("# " + x for x in licences.NOTICES[0][1].split(" to ")) + "\n\ncode")]
    got = scanned(spark, rows)
    assert {t: got[i, f"d{i}/x.c"].own_licence for i, t in enumerate(want)} == want
    assert got[50, "m/LICENSE"].own_licence == "MIT" and got[50, "m/LICENSE"].cosine > 0.9
    assert got[51, "m/a/b/c.txt"].licence == "MIT" and got[51, "m/a/b/c.txt"].licence_dir == "m"
    assert got[52, "h/x.py"].own_licence == "Apache-2.0" and got[52, "h/x.py"].cosine > 0.9


def test_rows_without_id_keep_to_themselves(spark):
    rows = [(None, "s", "Released under the MIT License."), (None, "s", "a plain text"), (None, "s", "a plain text"), (None, "s", None),
            (5, "s", "another plain text")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    files = licences.document_paths(docs)
    paths = {r.text: r.path for r in files.collect()}
    assert len(set(paths.values())) == 4
    got = licences.scan(files).join(files.select(F.col("path").alias("p"), "text").distinct(), F.col("path") == F.col("p")).collect()
    assert {r.text: r.own_licence for r in got} == {"Released under the MIT License.": "MIT", "a plain text": None, None: None,
                                                   "another plain text": None}


def test_some_documents_are_licence_files(spark):
    files = licences.document_paths(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("text")))
    assert files.where(F.col("path").rlike(licences.LICENCE_FILE)).count() == 5


def test_templates_are_distinct_terms(spark):
    # no two licences share a template's terms, or the name would decide
    seen = {}
    import re
    for licence, text in licences.TEMPLATES:
        key = tuple(sorted(re.findall(licences.TERM, text.lower())))
        assert seen.setdefault(key, licence) == licence
