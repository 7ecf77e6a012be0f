"""Batches, removals and merges of the lexical index against rebuilds; bounded top-k; vectors that are added."""

import random
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions.stem import stemmed
from ravelin.operators import retrieval as R
from ravelin.operators.vectors import VectorIndex, cells_for
from ravelin.sources import index as I
from ravelin.sources.index import LexicalIndex

WORDS = [f"w{i}" for i in range(40)]


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


def scores(index, terms):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in R.bm25(index, terms).collect()}


def test_batches_removals_and_merges_are_rebuilds(spark, tmp_path):
    rnd = random.Random(3)
    say = lambda: " ".join(rnd.choices(WORDS, k=rnd.randint(0, 12)))
    docs = {i: say() for i in range(40)}
    terms = R.query_terms(spark.createDataFrame([(1, "w1 w2 w3"), (2, "w30"), (3, "none")], "query_id long, q string"), F.col("q"))
    index = LexicalIndex(spark, str(tmp_path / "i")).create(frame(spark, docs), buckets=3)
    built = 0

    def check():
        nonlocal built
        built += 1
        whole = LexicalIndex(spark, str(tmp_path / f"whole{built}")).create(frame(spark, docs), buckets=3)
        assert index.corpus() == whole.corpus() and scores(index, terms) == scores(whole, terms)

    batch = {i: say() for i in range(35, 50)}  # some are there already
    index.add(frame(spark, batch))
    docs |= batch
    check()
    index.remove(spark.createDataFrame([(i,) for i in (1, 2, 36, 999)], "doc_id long"))
    docs = {i: x for i, x in docs.items() if i not in (1, 2, 36)}
    check()
    index.remove(spark.createDataFrame([(1,), (999,)], "doc_id long"))  # nothing is left of these
    again = {2: "w30 w30 w1"}
    index.add(frame(spark, again))
    docs |= again
    check()
    index.merge()
    check()
    assert len(index._listed()) == 1
    index.add(frame(spark, {77: "w30"}))
    docs[77] = "w30"
    check()


def test_a_stale_index_is_known(spark, tmp_path):
    source = str(tmp_path / "docs")
    frame(spark, {1: "a b"}).write.parquet(source)
    index = LexicalIndex(spark, str(tmp_path / "i")).create(spark.read.parquet(source), source=source)
    assert index.fresh(source)
    frame(spark, {2: "c"}).write.mode("append").parquet(source)
    assert not index.fresh(source)
    assert not LexicalIndex(spark, str(tmp_path / "none")).fresh(source)


def test_stems_as_an_analyzer(spark, tmp_path):
    docs = frame(spark, {1: "cats and a cat", 2: "hopping", 3: "dogs"})
    index = LexicalIndex(spark, str(tmp_path / "i")).create(docs, stem=stemmed)
    terms = stemmed(R.query_terms(spark.createDataFrame([(1, "cat hopped")], "query_id long, q string"), F.col("q"))).distinct()
    assert {r.doc_id for r in R.bm25(index, terms).collect()} == {1, 2}
    assert {(r.term, r.tf) for r in index.postings().filter("doc_id = 1").collect()} == {("cat", 2), ("and", 1), ("a", 1)}


@pytest.mark.parametrize("removed", [False, True])
def test_the_best_are_found_with_fewer_postings(spark, tmp_path, removed):
    rnd = random.Random(7)
    docs = {i: " ".join(rnd.choices(WORDS, k=rnd.choice([5, 30])) + ["rare"] * (i // 64 in (3, 9) and i % 5 == 0) * 3) for i in range(1500)}
    index = LexicalIndex(spark, str(tmp_path / "i")).create(frame(spark, docs), buckets=2)
    if removed:
        index.remove(spark.createDataFrame([(i,) for i in range(0, 1500, 10)], "doc_id long"))
    terms = R.query_terms(spark.createDataFrame([(1, "rare w1"), (2, "w2 w3 w4"), (3, "w5")], "query_id long, q string"), F.col("q"))
    near = R.near_terms(terms)
    best = lambda x: [tuple(r) for r in R.ranked(x.withColumn("score", F.round("score", 9)), 10).select("query_id", "rank", "doc_id", "score").orderBy("query_id", "rank").collect()]
    assert best(index.top(terms, 10, near)) == best(R.bm25(index, terms))
    read, all_ = index.candidates(terms, 10, near).filter("query_id = 1").count(), index.of_terms(terms.filter("query_id = 1"), near).count()
    assert read < all_ / 3


def test_vectors_are_added_and_found(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "v")).create(df.filter("vec_id < 2000"), cells=64)
    index.add(df.filter("vec_id >= 2000"))
    queries = df.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in index.search(queries, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: set(np.argsort(-(unit @ unit[i]))[:10].tolist()) for i in range(0, 3000, 30)}
    assert np.mean([len(got[i] & want[i]) / 10 for i in want]) >= 0.9
    assert [cells_for(n) for n in (0, 100, 10_000, 10**6, 10**9)] == [16, 16, 128, 1024, 32768]


def test_pairs_of_queries_and_documents_are_not_shuffled(spark, tmp_path):
    """Postings go to the tasks of their documents; what queries make of them is added up there."""
    index = LexicalIndex(spark, str(tmp_path / "i")).create(frame(spark, {i: f"w{i % 7} w{i % 5} x" for i in range(200)}), buckets=2)
    terms = R.query_terms(spark.createDataFrame([(q, f"w{q} x") for q in range(9)], "query_id long, q string"), F.col("q"))
    for df in (R.bm25(index, terms), index.top(terms, 5, F.broadcast)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]


def test_terms_are_counted_within_a_document(spark):
    from ravelin.sources.index import _counted

    base = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, ["a"]), (3, []), (4, None)], "doc_id long, ts array<string>")
    got = _counted(base)
    assert sorted(map(tuple, got.collect())) == [(1, 4, "a", 1), (1, 4, "b", 3), (2, 1, "a", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_asked_cells_are_not_broadcast(spark, tmp_path):
    """Their vectors are repeated for every cell, which files hide: many times more than their size on disk."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5) + 1, 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "v")).create(df, cells=4)
    found = index.search(df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 3, probes=4)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 12


def test_postings_are_sorted_by_as_many_tasks_as_the_corpus_needs(spark, monkeypatch):
    from ravelin.sources import index as I

    monkeypatch.setattr(I, "SORTED", 10)
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a b c d e f g h ', id) AS text")
    with tempfile.TemporaryDirectory() as d:
        I.LexicalIndex(spark, f"{d}/i").create(docs)
        tasks = {f.name.split("-")[1] for f in Path(d).rglob("postings/**/part-*.parquet")}
        assert len(tasks) > 4  # the session's number of partitions


def test_the_best_of_each_task_are_those_of_all_pairs(spark, tmp_path):
    rnd = random.Random(9)
    docs = {i: " ".join(rnd.choices(WORDS[:15], k=rnd.choice([0, 3, 20]))) for i in range(400)} | {i: "w1 w2" for i in range(400, 450)}
    index = LexicalIndex(spark, str(tmp_path / "i")).create(frame(spark, docs), buckets=2)
    terms = R.query_terms(spark.createDataFrame([("a", "w1 w2 w3"), ("b", "w14"), ("c", "none"), ("d", "w1")], "query_id string, q string"), F.col("q"))
    want = R.ranked(R.bm25(index, terms).withColumn("score", F.round("score", 6)), 7)
    got = R.lexical(index, terms, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "HashAggregate" not in plan  # no row for each pair of query and document
    assert R.lexical(index, terms.filter("false"), 7).count() == 0
    # queries that are too many to be broadcast
    assert sorted(map(tuple, R.ranked(index.best(terms, 7, lambda df: df).withColumn("score", F.round("score", 6)), 7).select(got.columns).collect())) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("cells", "pairs"), [(1, 1), (12, 10), (1000, 7), (9, 1000)])
def test_documents_are_scored_whole_and_a_few_at_a_time(monkeypatch, cells, pairs):
    import pandas as pd

    monkeypatch.setattr(I, "CELLS", cells)
    monkeypatch.setattr(I, "PAIRS", pairs)
    rnd = random.Random(4)
    rows = [(t, d, rnd.randint(1, 9), 5) for d in range(30) for t in sorted(rnd.sample(range(6), rnd.randint(1, 6)))]
    begins = np.array([0, 2, 3, 6, 7, 9, 10])
    frames = (pd.DataFrame(rows[i : i + 11], columns=["no", "doc_id", "tf", "dl"]) for i in range(0, len(rows), 11))
    parts = [list(zip(*(x.tolist() for x in p), strict=True)) for p in I._documents(frames, begins, 3)]
    assert [r for p in parts for r in p] == rows
    held = [{r[1] for r in p} for p in parts]
    assert sum(map(len, held)) == 30  # no document in two parts
    for p, d in zip(parts, held, strict=True):
        assert len(d) == 1 or len(d) * 3 <= cells and sum(begins[r[0] + 1] - begins[r[0]] for r in p) <= pairs
    assert list(I._documents(iter([]), begins, 3)) == []


def test_bounds_are_sorted_by_as_many_tasks_as_the_corpus_needs(spark, monkeypatch):
    monkeypatch.setattr(I, "SORTED", 10)
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('a b c d e f g h ', id) AS text")
    with tempfile.TemporaryDirectory() as d:
        index = I.LexicalIndex(spark, f"{d}/i").create(docs, buckets=2)
        index._bounds()
        assert len({f.name.split("-")[1] for f in Path(d).rglob("bounds/**/part-*.parquet")}) > 2  # the buckets


def _unbroadcast(spark, make):
    """The plan of make() where Spark broadcasts nothing by itself."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_texts_are_not_shuffled_to_meet_hits(spark, sf_dir):
    from ravelin.plans import dataflow, participants, retrieval

    asks = spark.createDataFrame([("s", "the of and")], "query_id string, q string")
    for make in (lambda: participants._retrieve(spark, sf_dir)(asks), lambda: retrieval.rerank_topk(spark, sf_dir), lambda: retrieval.hit_dedupe(spark, sf_dir), lambda: dataflow.rolling_eviction(spark, sf_dir)):
        assert "SortMergeJoin" not in _unbroadcast(spark, make)


def test_volume_looks_for_no_passages(spark, sf_dir, monkeypatch):
    from ravelin.plans import evaluation

    monkeypatch.setattr(evaluation.O, "containing", None)
    assert evaluation.retrieval_volume(spark, sf_dir).count() == 1


def test_sparse_weights_are_ranked_by_as_many_tasks_as_the_corpus_needs(spark, sf_dir, monkeypatch):
    from ravelin.plans import retrieval

    want = sorted(map(tuple, retrieval.sparse(spark, sf_dir).collect()))
    monkeypatch.setattr(retrieval, "SORTED", 10)
    got = retrieval.sparse(spark, sf_dir)
    assert got.rdd.getNumPartitions() == 20  # of 200 documents
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(retrieval, "MANY_TERMS", 0)  # no term is broadcast
    assert sorted(map(tuple, retrieval.sparse(spark, sf_dir).collect())) == want
