"""Participants, searches and their helpers on small tables, against plain versions."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.operators import agents as A
from ravelin.operators import retrieval as R
from ravelin.operators.execution import Step, kb_model, math_model
from ravelin.operators.models import retrying
from ravelin.operators.search import best_first
from ravelin.operators.similarity import fuzzy_duplicates, partial_ratio, ratio

CORPUS = [("Tea", "Tea is a drink made of leaves."), ("Rye", "Rye is a grass and a grain."), ("Oat", "Oat is a grain for porridge."), ("Leaf", "A leaf grows on a plant. " + "word " * 700)]


@pytest.fixture(scope="module")
def retrieve(spark):
    docs = spark.createDataFrame(CORPUS, "title string, paragraph_text string")

    def of(queries):
        w = F.split(F.lower(F.regexp_replace("q", "[^A-Za-z ]", "")), " ")
        hits = queries.crossJoin(F.broadcast(docs)).withColumn("score", F.size(F.array_intersect(w, F.split(F.lower(F.regexp_replace("paragraph_text", "[^A-Za-z ]", "")), " "))).cast("double"))
        return hits.filter("score > 0").select("query_id", "title", "paragraph_text", "score")

    return of


@pytest.fixture(scope="module")
def states(spark):
    return A.started(spark.createDataFrame([(1, "What is tea?"), (2, "which grain is grass")], "question_id int, question string"), "retrieve")


def rows(df):
    return {r.state_id: r for r in df.collect()}


def test_retrieval_holds_the_best(states, retrieve):
    got = rows(A.retrieve_and_reset(retrieve, "read", most=2)(states))
    assert got["1"].titles == ["Tea"] and got["1"].next == "read" and got["1"].answer == '["Tea"]' and got["1"].step == 1  # question words go
    assert got["2"].titles == ["Rye", "Oat"]
    more = states.withColumn("titles", F.array(F.lit("Tea"))).withColumn("paras", F.array(F.lit(CORPUS[0][1]))).withColumn("sentences", F.array(F.lit("Oat makes porridge."), F.lit("So it ends.")))
    got = rows(A.retrieve_and_reset(retrieve, "read", most=2, lexical=False)(more))
    assert got["1"].titles == ["Oat", "Tea"]  # by the last sentence that states a fact; what is held counts 0.6
    got = rows(A.retrieve_and_reset(retrieve, "read", source="last_answer")(states))
    assert got["1"].titles == [] and got["1"].answer == "[]"


def test_only_valid_titles(states, retrieve):
    allowed = states.withColumn("valid_titles", F.array(F.lit("o at")))
    got = rows(A.retrieve_and_reset(retrieve, "read", only_valid=True, returns="pids")(allowed))
    assert got["2"].titles == ["Oat"] and json.loads(got["2"].answer) == ["Oat Oat is a grain for porridge."]


def test_titles_are_mapped(states, retrieve):
    named = states.withColumn("answer", F.when(F.col("state_id") == "1", '["porridge", "drink"]').otherwise('"grass", [leaf]'))
    got = rows(A.map_titles(retrieve, "read")(named))
    assert got["1"].titles == ["Oat", "Tea"] == got["1"].valid_titles and got["2"].titles == ["Rye"]


def test_eviction():
    held = [("a", "one two three four"), ("b", "five six")]
    new = [("a", "one two three fours", 0.9), ("c", "x " * 601, 0.9), ("d", "seven", 0.7), ("e", "eight", 0.1), ("d", "seven", 0.2)]
    assert A.evicted(held, new, 3) == [("d", "seven"), *held]
    assert A.evicted(held, new, 9, None)[0][0] == "c"


def test_steps_of_reasoning(states):
    said = {0: "Tea is a drink. More.", 1: "So the answer is: green tea.", 2: ""}
    generate = lambda prompts: [said[p.count("Tea is") + (2 if "grain" in p else 0)] for p in prompts]
    step = A.step_by_step(generate, "think", pattern=r"(?i).*answer is:? (.*)")
    one = step(states)
    got = rows(one)
    assert (got["1"].next, got["1"].sentences, got["1"].answer) == ("think", ["Tea is a drink."], "Tea is a drink.")
    assert (got["2"].next, got["2"].answer) == (A.END, "EMPTY")
    two = rows(step(one.filter("state_id = '1'")))
    assert (two["1"].next, two["1"].answer, len(two["1"].sentences)) == (A.END, "green tea", 2)
    assert rows(A.step_by_step(generate, "think", most=0)(states))["1"].next == A.END


def test_other_participants(spark, states):
    assert rows(A.copy_question("go")(states))["1"].answer == "What is tea?" and rows(A.copy_question("go")(states.withColumn("step", F.lit(1))))["1"].next == A.END
    titles = A.generate_titles(lambda ps: ['["Tea", "Rye", "Tea"]' if "tea" in p else "Oat, Rye" for p in ps], "map")
    got = rows(titles(states))
    assert (got["1"].answer, got["2"].answer) == ('["Tea","Rye"]', '["Oat","Rye"]')
    answer = A.answer_question(lambda ps: ["1. tea\n2. rye\n1. tea" if "Key Information: Known." in p else "no" for p in ps], A.END, key_info=True, listed=True)
    assert rows(answer(states.withColumn("sentences", F.array(F.lit("Known."), F.lit("The answer is x.")))))["1"].answer == '["tea","rye"]'
    facts = spark.createDataFrame([("kin", "ann", "bob")], "predicate string, subject string, object string")
    ask = A.execute_steps([Step("select", "kin($1, ?)")], {"kb": kb_model(facts), "math": math_model()}, "done")
    got = rows(ask(A.started(spark.createDataFrame([(1, "ann"), (2, "eve")], "question_id int, question string"), "x")))
    assert (got["1"].next, got["1"].answer, got["2"].next, got["2"].answer) == ("done", '["bob"]', A.END, None)


def test_searches(spark):
    gains = {"ra": 1.0, "rb": 2.0, "rc": 2.0, "rba": 0.5, "rbb": 0.1, "rca": 0.2, "s": 0.0}
    g = spark.createDataFrame(list(gains.items()), "child string, gain double")

    def expand(nodes):
        kids = nodes.withColumn("child", F.explode(F.array(*[F.concat("node", F.lit(c)) for c in "abc"]))).join(g, "child")
        return kids.select("question_id", F.col("child").alias("node"), (F.col("score") + F.col("gain")).alias("score"), "depth")

    roots = spark.createDataFrame([(1, "r", 0.0, 0), (2, "s", 0.0, 0)], "question_id int, node string, score double, depth int")
    got = A.beam_search(roots, expand, F.length("node") == 3, width=2, depth=4).collect()
    assert sorted((r.question_id, r.place, r.node) for r in got) == [(1, 1, "rba"), (1, 2, "rca"), (2, 1, "s")]
    start = spark.createDataFrame([("a", 1, "go", 0.0), ("b", 1, "go", 1.0)], "state_id string, question_id int, next string, score double")
    step = lambda s: s.withColumn("score", F.col("score") + 3).withColumn("next", F.lit("end"))
    assert [r.state_id for r in best_first(start, {"go": step}, "end").collect()] == ["a"]


def test_dispatch_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(1, "Z"), (2, "M"), (3, "Unknown"), (4, "odd")], "k int, action string")
    got = A.dispatched(df, "action", {"Z": lambda d: d.withColumn("r", F.lit("z")), "M": lambda d: d.withColumn("r", F.lit("m"))})
    assert {r.k: r.r for r in got.collect()} == {1: "z", 2: "m"}
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert A.cached(spark, str(tmp_path), A.config_key("nq", "M", 8000, "tot"), make).count() == 4
    assert made == [1]


def test_retries():
    calls, slept = [], []

    def call(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError("limit" if len(calls) == 1 else "other")
        return x

    assert retrying(call, 5, 1.0, lambda e: "limit" in str(e), slept.append)(7) == 7 and slept == [5.0, 2.0]
    calls.clear()
    with pytest.raises(ValueError):
        retrying(call, 2, 0, sleep=lambda s: None)(7)


def test_ratios_and_fuzzy_duplicates(spark):
    assert partial_ratio("abcd", "xxabcdyy") == 100 and partial_ratio("abcd", "xxbcdyy") == 75 and partial_ratio("", "") == 100
    assert ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    df = spark.createDataFrame([(1, "x", "title", "a long text here"), (2, "x", "title", "a long text her"), (3, "x", "other", "a long text here"), (4, "y", "title", "a long text here")], "k int, g string, t string, p string")
    assert [(r.a, r.b) for r in fuzzy_duplicates(df, "k", "t", "p", ["g"]).collect()] == [(1, 2)]
    got = df.select(A.sequence_ratio(F.lit("abcd"), F.lit("bcde")).alias("r")).first().r
    assert got == 0.75


def test_pids(spark):
    df = spark.createDataFrame([("T", "Title: T\ntext"), ("T ", " Wikipedia Title: T \n text"), ("T", "text")], "t string, p string")
    assert [r.x for r in df.select(A.pid(F.col("t"), F.col("p")).alias("x")).collect()] == ["T text"] * 3


def test_knn_in_blocks_and_passages(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one, many = (sorted((r.query_id, r.vec_id, round(r.score, 6)) for r in R.knn(e, q, k=3, block=b).collect()) for b in (1000, 2))
    assert one == many and len(one) == 3 * q.count()
    docs = spark.createDataFrame([(1, "xx one two three four five six sevens and"), (2, "one two three four five six"), (3, "short one")], "doc_id long, text string")
    p = spark.createDataFrame([(7, "x one two three four five six seven"), (8, "short"), (9, "one two three four five six seven eight")], "query_id long, passage string")
    assert sorted((r.query_id, r.doc_id) for r in R.containing(docs, p).collect()) == [(7, 1), (8, 3)]


def test_an_approximate_index_recalls(spark, sf_dir, tmp_path):
    from ravelin.operators.vectors import VectorIndex

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    index = VectorIndex(spark, str(tmp_path / "v")).create(e, cells=16)
    assert index.exists() and spark.read.parquet(index.path + "/vectors").count() == e.count()
    exact = {(r.query_id, r.vec_id) for r in R.knn(e, q.withColumnRenamed("embedding", "q"), 5).collect()}
    recall = lambda probes=None: len({(r.query_id, r.vec_id) for r in index.search(q, 5, probes).collect()} & exact) / len(exact)
    assert recall(16) == 1.0 and recall() >= 0.9
