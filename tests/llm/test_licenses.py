import pytest

from ravelin.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
PROSE = "The river ran past the old mill and nobody in the village could say how long it had been standing there under the trees before the bridge was built"


@pytest.fixture(scope="module")
def found(spark):
    lines = {
        1: "Subject to the terms of the Mozilla Public Licence, version 2.0", 2: "This work is under the GNU Lesser General Public Licence, version 3", 3: "Under the Apache, Version 2.0", 4: "CC BY-SA 4.0",
        5: "SPDX-License-Identifier: MIT", 6: "// SPDX-License-Identifier: Apache-2.0", 7: "SPDX-License-Identifier: WTFPL", 8: "MIT License", 9: "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", 10: MIT,
        11: "the license of his driver was lost in the woods and never found by anyone at all", 12: "released under", 13: "The the the the of of of", 14: f"{PROSE}\n{PROSE}, licensed", 15: "",
    }
    rows = [(k, line, f"s{k}") for k, line in lines.items()] + [(100 + k, f"{PROSE} {k}", "p") for k in range(40)]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}


@pytest.mark.parametrize("doc_id, name", [(1, "MPL-2.0"), (2, "LGPL-3.0"), (3, "Apache-2.0"), (4, "CC-BY-SA-4.0"), (5, "MIT"), (6, "Apache-2.0"), (8, "MIT"), (9, "GPL-3.0"), (10, "MIT")])
def test_notices_titles_identifiers_and_bodies(found, doc_id, name):
    assert (found[doc_id].license, found[doc_id].via) == (name, "header")


def test_other_lines_are_none(found):
    assert {found[k].via for k in (7, 11, 12, 13, 14, 15, *range(100, 140))} == {"none"}


def test_a_licence_file_serves_its_directory_and_those_below(spark):
    rows = [(1, MIT, "a"), (2, PROSE, "a/b/c"), (3, PROSE, "z"), (4, "MIT License " + PROSE * 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.via, r.depth) for r in licenses.scan(df.selectExpr("doc_id", "text", "path", "path AS source"), path=df["path"]).collect()}
    assert got == {1: ("MIT", "header", 1), 2: ("MIT", "directory", 1), 3: (None, "none", None), 4: (None, "none", None)}


def test_a_hot_directory(spark):
    """Two thousand documents of one directory ask once; the one licence file there serves all."""
    df = spark.createDataFrame([(0, MIT)], "doc_id long, text string").unionByName(spark.range(1, 2001).selectExpr("id AS doc_id", "'nothing to see' AS text"))
    from pyspark.sql import functions as F

    got = licenses.scan(df.withColumn("source", F.lit("s")), path=F.lit("hot/dir")).groupBy("license", "via").count().collect()
    assert {(r.license, r.via): r["count"] for r in got} == {("MIT", "header"): 1, ("MIT", "directory"): 2000}


def test_bounds_lose_no_unit(spark):
    """Lines made of pieces of templates and of other words: what the bounds drop is under the threshold."""
    import random

    rnd = random.Random(1)
    pieces = [t for _, text in licenses.TEMPLATES for t in licenses._terms(text)]
    lines = []
    for _ in range(400):
        _, text = rnd.choice(licenses.TEMPLATES)
        words = text.split()
        kept = [w for w in words if rnd.random() < rnd.choice([0.4, 0.7, 1.0])] + rnd.choices(pieces, k=rnd.randint(0, 3)) + [f"w{rnd.randint(0, 50)}" for _ in range(rnd.randint(0, 6))]
        lines.append(" ".join(kept))
    docs = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "o long, r int, text string")
    got = {r.o: (r.license, round(r.cosine, 5)) for r in licenses.licence_units(docs).collect()}
    import math
    from collections import Counter

    vocab, n = set(licenses.vocabulary()), len(lines)
    df = Counter(t for x in lines for t in licenses._terms(x) if t in vocab)
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in vocab else 1))) + 1
    want = {}
    for k, x in enumerate(lines):
        w = {t: c * idf(t) for t, c in licenses._terms(x).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        scores = []
        for name, text in licenses.TEMPLATES:
            tw = {t: c * idf(t) for t, c in licenses._terms(text).items()}
            dot = sum(v * tw.get(t, 0) for t, v in w.items())
            scores.append((-round(dot / (norm * math.sqrt(sum(v * v for v in tw.values()))), 6) if norm else 0, name))
        c, name = min(scores)
        if -c >= licenses.COSINE:
            want[k] = (name, round(-c, 5))
    assert got == want and 50 < len(want) < 400
