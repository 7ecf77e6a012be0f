"""Licence scans: TF-IDF cosine of header lines and licence files to templates, then inheritance along directories.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import ascii_lower, table, written

# Usual wordings of public licence notices, headers, titles and short licences, a paragraph each.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal public domain dedication"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("Unlicense", "Free and unencumbered software released into the public domain"),
]
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BODIES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", _GNU.format("GNU General Public License", 2)),
    ("GPL-3.0", _GNU.format("GNU General Public License", 3)),
    ("AGPL-3.0", _GNU.format("GNU Affero General Public License", 3)),
    ("LGPL-3.0", _GNU.format("GNU Lesser General Public License", 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: An identifier line names its licence twice: the three words that all such lines share must not make it similar.
TEMPLATES = NOTICES + TITLES + BODIES + [(name, f"SPDX-License-Identifier: {name} {name}") for name in sorted({n for n, _ in NOTICES})]
#: Least cosine of a licence line or block; share of a document's terms in such that makes it a licence file.
COSINE, FILE_SHARE = 0.72, 0.2
SPLIT = "[^a-z0-9]+"
#: What parts the blocks of a text: a line that is empty but for white space.
GAP = r"\n[\x20\x09-\x0D]*\n"


def _terms(text: str) -> Counter:
    return Counter(t for t in re.split(SPLIT, text.lower()) if t)


def vocabulary() -> list[str]:
    return sorted({t for _, text in TEMPLATES for t in _terms(text)})


def _entries() -> list[tuple]:
    return [(k, name, t, n) for k, (name, text) in enumerate(TEMPLATES) for t, n in sorted(_terms(text).items())]


def path_of(source: Column, doc_id: Column) -> Column:
    """A document's directory: its source, then thousands and hundreds of its id."""
    part = lambda n: F.coalesce(F.floor(F.abs(doc_id) / n).cast("long").cast("string"), F.lit("none"))
    return F.concat_ws("/", F.coalesce(source.cast("string"), F.lit("none")), part(1000), part(100))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SPLIT), lambda t: t != "")


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def telling(idf: dict[str, float], threshold: float) -> list[str]:
    """Of each template its rarest terms, over a share 1 - threshold ** 2 of its squared norm: a text without any of them
    holds less than threshold ** 2 of it, and so has a cosine under the threshold to each template."""
    out: set[str] = set()
    for _, text in TEMPLATES:
        weights = sorted((idf[t], n * idf[t], t) for t, n in _terms(text).items())  # a rare term has a large idf
        whole, held = sum(w * w for _, w, _ in weights), 0.0
        while held <= (1 - threshold * threshold) * whole * (1 + 1e-9):
            _, w, t = weights.pop()
            held += w * w
            out.add(t)
    return sorted(out)


def units_of(base: DataFrame, keep) -> DataFrame:
    """base (o, r, text) -> (o, r, kind, pos, ts: terms) of all lines (kind 0) and blocks of several lines (kind 1) that
    ``keep`` (a condition on the terms) keeps."""
    low = ascii_lower(F.col("text"))
    unit = lambda kind: lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("pos"), F.filter(F.split(x, SPLIT), lambda t: t != "").alias("ts"))
    blocks = F.filter(F.split(low, GAP, -1), lambda x: F.contains(x, F.lit("\n")))
    units = F.concat(F.transform(F.split(low, "\n", -1), unit(0)), F.transform(blocks, unit(1)))
    return base.select("o", "r", F.explode(F.filter(units, lambda u: keep(u.ts))).alias("u")).select("o", "r", "u.*")


def licence_units(docs: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(o, r, kind, pos, terms, license, cosine): the lines and blocks of all documents that are near a template, with
    the nearest.

    A term weighs its frequency times ln((1 + rows) / (1 + rows that hold it)) + 1, counted over all rows; terms that no
    template holds weigh as if one row held them. Ties go to the licence first in alphabetical order.

    Only units that two bounds leave possible are weighed term by term. A cosine is at most the share of a template's
    norm that lies in terms that the unit holds: documents without any of the ``telling`` terms go. And it is at most the
    share of the unit's norm that lies in terms of templates: that part is computed, the rest is at least that of as many
    other terms, each as often as the mean.
    """
    spark = docs.sparkSession
    vocab = vocabulary()
    words = F.array(*[F.lit(t) for t in vocab])
    base = docs.select("o", "r", "text")
    counted = base.select(F.explode(F.array_intersect(F.array_append(terms_of(F.col("text")), F.lit("")), F.array_append(words, F.lit("")))).alias("term"))
    # "" stands for the row itself; as many rows as the templates have terms, a fixed number
    held = {r.term: r.df for r in counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    rows = held.pop("", 0)
    idf = {t: math.log((1 + rows) / (1 + held.get(t, 0))) + 1 for t in vocab}
    rare = math.log((1 + rows) / 2) + 1
    weighed = spark.createDataFrame([(k, name, t, n * idf[t]) for k, name, t, n in _entries()], "template int, license string, term string, tw double")
    norms = spark.createDataFrame([(k, math.sqrt(sum((n * idf[t]) ** 2 for t, n in _terms(text).items()))) for k, (_, text) in enumerate(TEMPLATES)], "k int, tnorm double")
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")

    weights = F.create_map(*[F.lit(x) for t in vocab for x in (t, idf[t])])
    least = threshold - 1e-6  # cosines are rounded
    share = least * least / (1 - least * least)
    total = lambda xs, zero: F.aggregate(xs, F.lit(zero), lambda a, x: a + x)

    def bound(ts: Column, ks: Column, cs: Column) -> Column:
        inside = total(F.zip_with(ks, cs, lambda k, n: F.pow(n * F.element_at(weights, k), F.lit(2.0))), 0.0)
        others = (F.size(ts) - total(cs, 0)).cast("double")
        different = F.greatest(F.size(F.array_distinct(ts)) - F.size(ks), F.lit(1))
        return share * others * others / different * (rare * rare) <= inside * (1 + 1e-9)

    def keep(ts: Column) -> Column:
        times = lambda ks: F.transform(ks, lambda k: F.size(ts) - F.size(F.array_remove(ts, k)))
        return _let(F.array_intersect(ts, words), lambda ks: F.when(F.size(ks) == 0, False).otherwise(_let(times(ks), lambda cs: bound(ts, ks, cs))))

    marks = F.array(*[F.lit(t) for t in telling(idf, least)])
    possible = units_of(base.filter(F.arrays_overlap(terms_of(F.col("text")), marks)), keep)
    counted = (
        possible.select("o", "r", "kind", "pos", F.explode("ts").alias("term")).groupBy("o", "r", "kind", "pos", "term").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(known), "term", "left").select("o", "r", "kind", "pos", "term", "n", (F.col("n") * F.coalesce("idf", F.lit(rare))).alias("w"))
    )
    unit = ["o", "r", "kind", "pos"]
    same = lambda a: [a.o.eqNullSafe(F.col("lo")), a.r == F.col("lr"), a.kind == F.col("lk"), a.pos == F.col("lp")]
    length = counted.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("terms")).toDF("lo", "lr", "lk", "lp", "norm", "terms")
    dots = counted.join(F.broadcast(weighed), "term").groupBy(*unit, "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(length, same(dots)).join(F.broadcast(norms), F.col("template") == F.col("k")).withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6))
    best = scored.filter(F.col("cosine") >= threshold).groupBy(*unit, "terms").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select(*unit, "terms", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def scan(docs: DataFrame, path: Column | None = None, threshold: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """Licence of every document: doc_id, path, license, via, cosine, depth.

    * via "header": the document's own best licence line or block of lines (ties: lines first, then the first). Its cosine
      is given; depth is that of its own directory.
    * via "directory": else, the licence of the nearest ancestor directory (its own included) that holds a licence file,
      a document of whose terms ``file_share`` or more stand in licence lines, or in licence blocks. Of several there the
      best cosine counts, then the smallest doc_id. cosine is the file's, depth the directory's.
    * via "none": no licence; license, cosine and depth are null.

    Null or empty text: no lines. Null source or doc_id: "none" in the path. Repeated doc_id: each row for itself.
    Empty table: no rows. Extra columns are ignored. The whole text is scanned, line by line.
    """
    path = path if path is not None else path_of(F.col("source"), F.col("doc_id"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").alias("o"), F.xxhash64(text).alias("r"), text.alias("text"), path.alias("path"))
    found = written(licence_units(base, threshold), "licence-units")  # few rows: notices only
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("terms"))), F.lit(0))
    own = found.groupBy("o", "r").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "kind", "pos", "license")).alias("b"), F.greatest(part(0), part(1)).alias("licensed"))
    own = own.select(F.col("o").alias("ho"), F.col("r").alias("hr"), F.col("b.license").alias("h_license"), (-F.col("b.c")).alias("h_cosine"), "licensed")
    rows = base.select("o", "r", "path", F.size(terms_of(F.col("text"))).alias("n")).join(own, F.col("o").eqNullSafe(F.col("ho")) & (F.col("r") == F.col("hr")), "left")
    rows = written(rows.select("o", "r", "path", "h_license", "h_cosine", (F.col("licensed") >= file_share * F.col("n")).alias("is_file")), "licence-rows")

    files = rows.filter("is_file").groupBy(F.col("path").alias("dir")).agg(F.min(F.struct((-F.col("h_cosine")).alias("c"), "o", "h_license")).alias("b"))
    files = files.select("dir", F.col("b.h_license").alias("d_license"), (-F.col("b.c")).alias("d_cosine"))
    # Distinct directories climb, not documents: a directory of many documents asks once.
    steps = F.split("path", "/")
    climbs = rows.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("depth")).withColumn("dir", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    nearest = climbs.join(files, "dir").groupBy("path").agg(F.max(F.struct("depth", "d_license", "d_cosine")).alias("b"))
    nearest = written(nearest.select(F.col("path").alias("p"), "b.depth", "b.d_license", "b.d_cosine"), "licence-dirs")
    out = rows.join(nearest, F.col("path") == F.col("p"), "left")
    header, inherited = F.col("h_license").isNotNull(), F.col("d_license").isNotNull()
    return out.select(
        F.col("o").alias("doc_id"), "path", F.coalesce("h_license", "d_license").alias("license"),
        F.when(header, "header").when(inherited, "directory").otherwise("none").alias("via"),
        F.when(header, F.round("h_cosine", 4)).otherwise(F.round("d_cosine", 4)).alias("cosine"),
        F.when(header, F.size(F.split("path", "/"))).otherwise(F.col("depth")).cast("long").alias("depth"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"({k}, '{name}', '{t}', {n})" for k, name, t, n in _entries())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = "list_filter(regexp_split_to_array({}, '[^a-z0-9]+'), lambda t: t <> '')"
    parts = lambda kind, split: f"SELECT d.doc_id, {kind} AS kind, u.pos, u.unit FROM d, LATERAL (SELECT unnest({split}) AS unit, generate_subscripts({split}, 1) AS pos) u"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS path, {low.format("coalesce(text, '')")} AS low FROM documents
), e(template, license, term, tn) AS (VALUES {values})
, vocab AS (SELECT DISTINCT term FROM e)
, tt AS (SELECT doc_id, unnest(list_distinct({terms.format('low')})) AS term FROM d)
, df AS (SELECT term, count(*) AS df FROM tt SEMI JOIN vocab USING (term) GROUP BY term)
, n AS (SELECT count(*) AS n FROM documents)
, we AS (SELECT template, license, term, ln((1 + n.n) / (1 + coalesce(df.df, 0))) + 1 AS idf, tn * (ln((1 + n.n) / (1 + coalesce(df.df, 0))) + 1) AS tw FROM e LEFT JOIN df USING (term), n)
, norms AS (SELECT template, sqrt(sum(tw * tw)) AS tnorm FROM we GROUP BY template)
, known AS (SELECT DISTINCT term, idf FROM we)
, li AS ({parts(0, "string_split(d.low, chr(10))")} UNION ALL SELECT * FROM ({parts(1, f"regexp_split_to_array(d.low, '{GAP}')")}) WHERE contains(unit, chr(10)))
, lt AS (SELECT doc_id, kind, pos, unnest({terms.format('unit')}) AS term FROM li)
, lc AS (SELECT doc_id, kind, pos, term, count(*) AS c FROM lt GROUP BY ALL)
, lw AS (SELECT lc.*, c * coalesce(idf, ln((1 + n.n) / 2) + 1) AS w FROM lc LEFT JOIN known USING (term), n)
, ln_ AS (SELECT doc_id, kind, pos, sqrt(sum(w * w)) AS norm, sum(c) AS terms FROM lw GROUP BY ALL)
, sc AS (
  SELECT doc_id, kind, pos, license, terms, round(dot / (norm * tnorm), 6) AS cosine
  FROM (SELECT doc_id, kind, pos, template, license, sum(w * tw) AS dot FROM lw JOIN we USING (term) GROUP BY ALL) JOIN ln_ USING (doc_id, kind, pos) JOIN norms USING (template)
), best AS (SELECT * FROM sc WHERE cosine >= {COSINE} QUALIFY row_number() OVER (PARTITION BY doc_id, kind, pos ORDER BY cosine DESC, license) = 1)
, tot AS (SELECT doc_id, greatest(coalesce(sum(terms) FILTER (WHERE kind = 0), 0), coalesce(sum(terms) FILTER (WHERE kind = 1), 0)) AS licensed FROM best GROUP BY doc_id)
, hd AS (SELECT doc_id, license, cosine FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, kind, pos, license) = 1)
, r AS (
  SELECT d.doc_id, d.path, hd.license AS hl, hd.cosine AS hc, coalesce(tot.licensed >= {FILE_SHARE} * len({terms.format('d.low')}), false) AS is_file
  FROM d LEFT JOIN hd USING (doc_id) LEFT JOIN tot USING (doc_id)
), fi AS (SELECT path AS dir, hl, hc FROM r WHERE is_file QUALIFY row_number() OVER (PARTITION BY path ORDER BY hc DESC, doc_id) = 1)
, cl AS (
  SELECT DISTINCT path, k AS depth, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') AS dir
  FROM r, (SELECT unnest(range(1, 4)) AS k) WHERE k <= len(string_split(path, '/'))
), ne AS (SELECT path, depth, hl, hc FROM cl JOIN fi USING (dir) QUALIFY row_number() OVER (PARTITION BY path ORDER BY depth DESC) = 1)
SELECT r.doc_id, r.path, coalesce(r.hl, ne.hl) AS license,
       CASE WHEN r.hl IS NOT NULL THEN 'header' WHEN ne.hl IS NOT NULL THEN 'directory' ELSE 'none' END AS via,
       round(CASE WHEN r.hl IS NOT NULL THEN r.hc ELSE ne.hc END, 4) AS cosine,
       (CASE WHEN r.hl IS NOT NULL THEN len(string_split(r.path, '/')) ELSE ne.depth END)::BIGINT AS depth
FROM r LEFT JOIN ne USING (path)
"""


ORACLE = _oracle()
