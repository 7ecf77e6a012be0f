"""Stored indexes, readers and configurations."""

import json
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from ravelin import config
from ravelin.functions import text as T
from ravelin.operators import retrieval as R
from ravelin.operators import sampling as M
from ravelin.sources import corpus as C
from ravelin.sources.index import LexicalIndex


def test_a_stored_index(spark, tmp_path):
    docs = {1: "tea and rye and tea", 2: "rye bread", 3: "", 4: "oat tea"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    index = LexicalIndex(spark, str(tmp_path / "i"))
    assert not index.exists() and not index.delete()
    index.create(df, buckets=4)
    assert index.exists() and index.corpus().N == 4
    with pytest.raises(FileExistsError):
        index.create(df)
    terms = R.query_terms(spark.createDataFrame([(9, "tea rye tea"), (8, "none")], "query_id long, q string"), F.col("q"))
    got = {(r.query_id, r.doc_id): round(r.score, 9) for r in R.bm25(LexicalIndex(spark, index.path), terms).collect()}
    words = {d: t.split() for d, t in docs.items()}
    mean = sum(map(len, words.values())) / 4
    want = {}
    for d, ws in words.items():
        n = Counter(ws)
        s = sum(log(1 + (4 - df + 0.5) / (df + 0.5)) * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in ("tea", "rye") for df in [sum(t in x for x in words.values())] if n[t])
        if s:
            want[9, d] = round(s, 9)
    assert got == want
    index.create(df.filter("doc_id = 2"), force=True)
    assert index.corpus().N == 1 and index.delete() and not index.exists()


def test_lines_batches_and_resuming(spark, tmp_path):
    path = str(tmp_path / "p.tsv")
    with open(path, "w") as f:
        f.write("id\ttext\ttitle\n" + "".join(f"{k}\ttext {k}\tt{k}\n" for k in range(1, 41)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        lines = C.numbered_lines(spark, path).collect()
        assert sorted((r.line, r.value.split("\t")[0]) for r in lines) == [(0, "id"), *[(k, str(k)) for k in range(1, 41)]]
        got = C.passages_tsv(spark, path, start_line=10, batch=8).collect()
        assert sorted((int(r.id), r.batch) for r in got) == [(k, (k - 1) // 8) for k in range(11, 41)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    done = spark.createDataFrame([(str(k),) for k in range(1, 31)], "id string")
    assert C.passages_tsv(spark, path, done).count() == 10


def test_results_are_reloaded(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("".join(json.dumps({"question_id": q, "answer": a}) + "\n" for q, a in (("a", "1"), ("b", "2"), ("a", "3"))) + "broken\n")
    got = C.reload_results(spark, str(path), "question_id string, answer string")
    assert {r.question_id: r.answer for r in got.collect()} == {"a": "3", "b": "2"}
    C.write_results(got, str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).count() == 2
    log_ = spark.createDataFrame([("q", "Z", 0.123456, "M", True, "nq", 'a "quoted", question')], C.ROUTING_LOG)
    C.write_routing_log(log_, str(tmp_path / "log"))
    assert tuple(C.read_routing_log(spark, str(tmp_path / "log")).first()) == ("q", "Z", 0.1235, "M", True, "nq", 'a "quoted", question')


def test_configurations(tmp_path):
    path = str(tmp_path / "c.json")
    config.save({"a": {"b": "${HOST}", "c": 1}, "d": ["${PORT:-80}"]}, path)
    got = config.load(path, [{"a": {"c": 2}}], {"a.e.f": 3}, {"HOST": "x"})
    assert got == {"a": {"b": "x", "c": 2, "e": {"f": 3}}, "d": ["80"]}
    with pytest.raises(KeyError):
        config.load(path, variables={})


def test_numbers_and_articles(spark):
    numbers = ["10", "1e7", "12345678.5", "123456789012345680", "1e16", "1.5e17", "0.0001", "0.00001", "0.00012345", "1e-7", "-2.50", "inf", "nan", "1e22", "0", "100000000"]
    got = spark.createDataFrame([(n,) for n in numbers], "n string").select(T.float_text(F.col("n").try_cast("double")).alias("t")).collect()
    assert [r.t for r in got] == [str(float(n)) for n in numbers]
    text = "The l’a, an–a the_x. A"
    assert spark.createDataFrame([(text,)], "x string").select(T.normalize_answer(F.col("x")).alias("n")).first().n == "l’ –a thex".replace("–a", "–")


def test_samples_of_large_groups(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    got = M.stratified(df, "g", "id", 101).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {0: 51, 1: 50}
    rows = df.select("id", "g", M.order_hash(F.col("id")).alias("h")).collect()
    want = {r.id for g, n in ((0, 51), (1, 50)) for r in sorted((r for r in rows if r.g == g), key=lambda r: r.h)[:n]}
    assert {r.id for r in M.stratified(df, "g", "id", 101).collect()} == want
    assert M.stratified(df.limit(0), "g", "id", 5).count() == 0
