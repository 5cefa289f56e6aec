"""License scans, in DataFrame functions only.

Statements are the lines of a whole text that hold a cue; a license file (by its name, or because statements make up
half of its words) counts as one statement as a whole, which is compared with complete license texts too. Statements and templates are sparse TF-IDF vectors; document
frequencies come from all statements of the corpus. A file's own license is the template of the highest cosine, from
LEAST on. Headers wrapped over lines are put together again: comment blocks and paragraphs around a cue are scored
too, but don't count in document frequencies, since their lines are there already. A file without one inherits that of the license file in its nearest ancestor directory, found by joins of
directory paths.

Equal statements are scored once, however often they occur; what is joined back is a few bytes for each statement.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, shared, table, word_count

#: License statements and the heads of license texts, by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
CUE = r"licen[cs]e|copyright|spdx|all rights reserved|public domain|creative commons|permission is hereby|permission to use"
#: Cues of blocks: those above, also broken over lines and comment marks, and those of headers that don't say `license`.
GAP = "[^a-z0-9]+"
BLOCK_CUE = CUE.replace(" ", GAP) + f"|redistribution|hereby{GAP}granted|free{GAP}software"
#: Statements that headers are compared with besides TEMPLATES, so that they aren't taken for their nearest relatives.
HEADERS = [
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]
#: Where comments begin and end, what marks a line as a comment, and lines of nothing but decoration.
DELIMITER = r"/\*+|\*+/|<!--|-->|\"\"\"|'''"
MARK = r"[ \t]*(?:#|//|--|;|%|!|\"|dnl\b|rem\b)"
DECORATION = r"[ \t#/*;%!\"'=~+|_-]*"
CUT = "\x01"
FILE_NAME = r"(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a match. Prose shares many a "the" and "of" with a long text: of a complete text, and of any template
#: if the unit is a block, that many of its distinct terms must be there too.
LEAST = 0.6
LEAST_TERMS = 0.5
BROADCAST_ROWS = 100_000


@cache
def complete_texts() -> list[tuple[str, str]]:
    """Complete license texts by SPDX identifier. A text alone doesn't say `or later`, so it counts as `only`."""
    found = resources("tessella.llm").joinpath("license_texts").iterdir()
    return sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in found if f.name.endswith(".txt"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def statements(text: Column) -> Column:
    """Lines of a text that hold a cue."""
    return F.when(F.lower(text).rlike(BLOCK_CUE), F.filter(F.split(text, "\n", -1), lambda x: F.lower(x).rlike(CUE))).otherwise(F.array().cast("array<string>"))


def blocks(text: Column) -> Column:
    """Paragraphs and comment blocks of a text that hold a cue, each as one line without comment marks. A block is what
    lies between comment delimiters, or a run of lines that all have or all lack a comment mark."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t\x0B\f\n]*\n", "\n\n")
    cut = F.regexp_replace(flat, DELIMITER, f"\n{CUT}\n")
    cut = F.regexp_replace(cut, rf"(?mi)^(?!{MARK})([ \t]*\S.*\n)(?=\n?{MARK})", f"$1{CUT}\n")
    cut = F.regexp_replace(cut, rf"(?mi)^({MARK}.*\n)(?=\n?[ \t]*\S)(?!\n?{MARK})", f"$1{CUT}\n")
    runs = F.split(cut, CUT, -1)
    paragraphs = lambda t: F.split(t, rf"(?i)\n(?:[ \t]*(?:dnl|rem)\b)?{DECORATION}\n", -1)
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, rf"(?mi)^(?:[ \t]*(?:dnl|rem)\b)?{DECORATION}", " "), r"\s+", " "))
    found = F.concat(paragraphs(flat), runs, F.flatten(F.transform(runs, paragraphs)))
    kept = F.filter(F.array_distinct(F.transform(found, bare)), lambda x: F.lower(x).rlike(BLOCK_CUE))
    return F.when(F.lower(text).rlike(BLOCK_CUE), kept).otherwise(F.array().cast("array<string>"))


def counted(units: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, term, tf) of each unit's terms."""
    return units.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def scored(units: DataFrame) -> DataFrame:
    """Rows (digest, kind, spdx, score): each distinct statement's best template, from rows (digest, unit, kind), repeated
    as they occur. A kind is line, file or block; files and blocks are compared with complete texts and HEADERS as well.
    Blocks don't count in document frequencies. A statement's text is kept once; all else goes by its number."""
    spark = units.sparkSession
    distinct = shared(units.groupBy("digest", "kind").agg(F.first("unit").alias("unit"), F.sum(F.when(F.col("kind") == "block", 0).otherwise(1)).alias("n")).withColumn("k", F.monotonically_increasing_id()))
    tf = shared(counted(distinct, "k", "unit").join(distinct.select("k", "kind", "n"), "k"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = tf.groupBy("term").agg(F.sum("n").alias("df"))
    idf = lambda: F.log(F.lit(total + 1) / (F.coalesce("df", F.lit(0)) + 1)) + F.lit(1.0)
    bodies = [(s, t, False) for s, t in TEMPLATES] + [(s, t, True) for s, t in [*HEADERS, *complete_texts()]]
    templates = spark.createDataFrame([(i, s, c) for i, (s, _, c) in enumerate(bodies)], "template int, spdx string, complete boolean")
    texts = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(bodies)], "template int, body string")
    t = counted(texts, "template", "body").join(df, "term", "left").select("template", "term", (F.col("tf") * idf()).alias("tw"))
    t = shared(t.join(F.broadcast(templates.select("template", "complete")), "template"))  # some 15,000 rows: the terms of all templates
    t_norm = t.groupBy("template", "complete").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("t_norm"), F.count("*").alias("t_terms"))
    w = tf.join(df, "term").select("k", "kind", "term", (F.col("tf") * idf()).alias("w"))
    w = shared(w)
    norm = w.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    met = w.join(F.broadcast(t), (w["term"] == t["term"]) & ((w["kind"] != "line") | ~t["complete"]))
    dots = met.groupBy("k", "kind", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.count("*").alias("met"))
    enough = (F.col("met") >= F.col("t_terms") * LEAST_TERMS) | ((F.col("kind") != "block") & ~F.col("complete"))
    names = templates.select("template", "spdx").join(t_norm, "template")
    cos = dots.join(norm, "k").join(F.broadcast(names), "template").filter(enough).select("k", "spdx", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("score"))
    best = cos.groupBy("k").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("spdx").alias("spdx"))).alias("b"))
    best = best.select("k", F.col("b.spdx").alias("spdx"), (-F.col("b.minus")).alias("score")).filter(F.col("score") >= LEAST)
    return best.join(distinct.select("k", "digest", "kind"), "k").select("digest", "kind", "spdx", "score")


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """Rows (id, path, n_statements, license_file, own_license, own_score, license, inherited_from), one for each row.

    Null and empty texts have no statements; a null path has no directory and inherits nothing, nor does anyone from
    it. Of several licenses in one place the one of the higher cosine counts, then the first in order. Repeated rows
    get equal results; an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), text.alias("text")).withColumn("lines", statements(F.col("text")))
    named = F.lower("path").rlike(FILE_NAME)
    much = F.when(F.size("lines") > 0, word_count(F.array_join("lines", " ")) * 2 >= word_count(F.col("text"))).otherwise(F.lit(False))
    d = d.withColumn("license_file", F.coalesce(named, F.lit(False)) | much)
    whole = F.col("license_file") & (F.col("text") != "")
    unit = lambda kind: lambda x: F.struct(x.alias("unit"), F.lit(kind).alias("kind"))
    parts = F.concat(F.transform("lines", unit("line")), F.transform(blocks(F.col("text")), unit("block")))
    units = F.when(whole, F.array(unit("file")(F.col("text")))).otherwise(parts)
    d = shared(d.select(F.monotonically_increasing_id().alias("row"), "id", "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.size("lines").cast("long").alias("n_statements"), "license_file", units.alias("units")))
    u = d.select("row", F.inline("units")).withColumn("digest", F.md5("unit"))
    best = shared(scored(u.drop("row")))
    # a statement that very many files hold meets its license without a shuffle, unless there are very many licenses
    own = u.drop("unit").join(bounded_broadcast(best, best.count(), BROADCAST_ROWS), ["digest", "kind"]).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), F.col("spdx").alias("spdx"))).alias("b")).select("row", F.col("b.spdx").alias("own_license"), (-F.col("b.minus")).alias("own_score"))
    d = shared(d.drop("units").join(own, "row", "left"))
    holders = d.filter("license_file and own_license is not null and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own_license").alias("spdx"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.spdx").alias("spdx"))
    dirs = d.filter("own_license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/", -1)
    steps = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "above"))
    nearest = steps.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "spdx")).alias("b")).select("dir", F.col("b.above").alias("from"), F.col("b.spdx").alias("theirs"))
    out = d.join(nearest, "dir", "left")
    none = F.col("own_license").isNull()
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "n_statements", "license_file", "own_license", "own_score", F.coalesce("own_license", "theirs").alias("license"), F.when(none, F.col("from")).alias("inherited_from"))


#: `documents` have no paths. This view puts them into /source/lang, and all but every 64th into a folder of 64 below.
PATH = "concat('/', coalesce(source, ''), '/', coalesce(lang, ''), CASE WHEN doc_id % 64 = 0 THEN '' ELSE concat('/', CAST(CAST(floor(doc_id / 64) AS BIGINT) AS STRING)) END, '/', CAST(doc_id AS STRING), '.txt')"


def license_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan_licenses` over all of `documents`, at the paths of PATH; what it says of nulls, ties, repeated rows and empty
    tables holds. A null doc_id has a null path."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.expr(PATH).alias("path"), "text")
    return scan_licenses(files, "doc_id", "path", "text")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE = rf"""
WITH f AS MATERIALIZED (
  SELECT doc_id, {PATH.replace("STRING", "VARCHAR")} AS path, coalesce(text, '') AS text FROM documents
), l AS MATERIALIZED (
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), '{CUE}')) AS lines FROM f
), k AS MATERIALIZED (
  SELECT *, regexp_matches(lower(path), '{FILE_NAME}') OR (len(lines) > 0 AND len(regexp_extract_all(array_to_string(lines, ' '), '[^\x20\x09-\x0D]+')) * 2 >= len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS license_file FROM l
), u AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN license_file AND text <> '' THEN [text] ELSE lines END) AS unit FROM k
), tokens AS MATERIALIZED (
  SELECT unit, n, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM (SELECT unit, count(*) AS n FROM u GROUP BY unit)
), tf AS MATERIALIZED (
  SELECT unit, term, any_value(n) AS n, count(*) AS tf FROM tokens GROUP BY unit, term
), df AS MATERIALIZED (
  SELECT term, sum(n) AS df FROM tf GROUP BY term
), total AS (
  SELECT count(*) AS total FROM u
), w AS MATERIALIZED (
  SELECT unit, tf.term, tf * (ln((total + 1) / (df + 1)) + 1.0::DOUBLE) AS w FROM tf JOIN df ON tf.term = df.term, total
), template(template, spdx, body) AS (
  VALUES {", ".join(f"({i}, {_quoted(s)}, {_quoted(t)})" for i, (s, t) in enumerate(TEMPLATES))}
), t AS MATERIALIZED (
  SELECT template, spdx, q.term, q.tf * (ln((total + 1) / (coalesce(df, 0) + 1)) + 1.0::DOUBLE) AS tw
  FROM (SELECT template, spdx, term, count(*) AS tf FROM (SELECT template, spdx, unnest(regexp_extract_all(lower(body), '{TERM}')) AS term FROM template) GROUP BY ALL) AS q
  LEFT JOIN df ON q.term = df.term, total
), cosines AS (
  SELECT d.unit, n.spdx, round(d.dot / (a.norm * n.norm), 6) AS score
  FROM (SELECT unit, template, sum(w * tw) AS dot FROM w JOIN t ON w.term = t.term GROUP BY unit, template) AS d
  JOIN (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit) AS a ON a.unit = d.unit
  JOIN (SELECT template, any_value(spdx) AS spdx, sqrt(sum(tw * tw)) AS norm FROM t GROUP BY template) AS n ON n.template = d.template
), best AS (
  SELECT unit, spdx, score FROM cosines WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, spdx) = 1
), own AS (
  SELECT doc_id, spdx, score FROM u JOIN best ON u.unit = best.unit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, spdx) = 1
), o AS MATERIALIZED (
  SELECT k.doc_id, k.path, k.dir, CAST(len(k.lines) AS BIGINT) AS n_statements, k.license_file, own.spdx AS own_license, own.score AS own_score FROM k LEFT JOIN own ON own.doc_id = k.doc_id
), holder AS (
  SELECT dir, own_license AS spdx FROM o WHERE license_file AND own_license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) = 1
), nearest AS (
  SELECT o.doc_id, h.dir, h.spdx FROM o JOIN holder AS h ON o.dir = h.dir OR starts_with(o.dir, h.dir || '/')
  WHERE o.own_license IS NULL QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(h.dir) DESC) = 1
)
SELECT o.doc_id, o.path, o.n_statements, o.license_file, o.own_license, o.own_score, coalesce(o.own_license, n.spdx) AS license, n.dir AS inherited_from
FROM o LEFT JOIN nearest AS n ON n.doc_id = o.doc_id
"""
