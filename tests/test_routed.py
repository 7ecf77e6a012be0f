"""Programs of different questions in one table, against answers by hand."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.operators import routed as R
from test_execution import FACTS


@pytest.fixture(scope="module")
def models(spark):
    facts = spark.createDataFrame(FACTS, "predicate string, subject string, object string")
    return {"kb": R.kb_model(facts), "math": R.math_model(), "read": R.text_model(lambda q: F.when(~q.contains("PARA_2"), F.upper(F.regexp_extract(q, r"(\w+)$", 1))))}


PROGRAMS = {
    "flat": (["(select) [kb] kin(dan, ?)", "(project_values_flat_unique) [kb] likes(#1, ?)", "(select) [math] count(#2)"], "ok", 3, "2"),
    "pairs": (["(select) [kb] kin(eve, ?)", "(project) [kb] likes(#1, ?)"], "ok", 2, [["cid", ["oat"]], ["flo", []]]),
    "values": (["(select) [kb] kin(dan, ?)", "(project) [kb] likes(#1, ?)", "(projectValues) [math] count(#2)", "(filterValues_keys) [math] is_greater(#3 | 1)"], "ok", 4, ["ann"]),
    "keys": (["(select) [kb] kin(dan, ?)", "(project) [kb] likes(#1, ?)", "(projectKeys_keys) [kb] kin(_, #2)"], "ok", 3, ["yes", "yes"]),
    "several": (["(select) [kb] kin(dan, ?)", "(select) [kb] likes(?, tea)", "(filter(#1)) [math] belongs_to(#1 | #2)"], "ok", 3, ["ann", "bob"]),
    "paras": (["(project) [read] what does #C say"], "ok", 1, [["PARA_0", "SAY"], ["PARA_1", "SAY"]]),
    "null": (["(project) [read] #C"], "failed", 1, None),
    "context": (["(project_values) [read] the #C", "(filter) [kb] likes(ann, #1)"], "ok", 2, []),
    "none": (["(select) [kb] kin(nobody, ?)", "(project_keys) [kb] likes(#1, ?)", "(select) [math] count(#2)"], "ok", 3, "0"),
    "early": (["(select) [kb] likes(#2, ?)", "(select) [kb] likes(ann, ?)"], "failed", 1, None),
    "odd": (["(guess) [kb] likes(ann, ?)"], "failed", 1, None),
    "form": (["likes(ann, ?)"], "failed", 1, None),
    "model": (["(select) [who] likes(ann, ?)"], "failed", 1, None),
    "scalar": (["(select) [kb] likes(ann, tea)", "(project) [kb] likes(#1, ?)"], "failed", 2, None),
    "suffix": (["(select_odd) [kb] likes(ann, ?)"], "failed", 1, None),
    "unpaired": (["(select) [kb] likes(ann, ?)", "(projectValues) [math] count(#1)"], "failed", 2, None),
    "two": (["(select) [kb] likes(ann, ?)", "(select) [kb] likes(bob, ?)", "(project) [kb] f(#1, #2)"], "failed", 3, None),
    "max": (["(select) [kb] likes(ann, ?)", "(project) [math] max(#1)"], "failed", 2, None),
}


@pytest.fixture(scope="module")
def ran(spark, models):
    rows = [(q, k, text) for q, (steps, *_) in PROGRAMS.items() for k, text in enumerate(steps, 1)]
    rows += [("flat", 1, PROGRAMS["flat"][0][0]), (None, 1, "(select) [kb] kin(dan, ?)"), ("nothing", 1, None)]
    contexts = spark.createDataFrame([("paras", 2), ("context", 1), ("null", 3), ("odd", 1), (None, 1)], "qid string, paras int")
    return R.run_programs(spark.createDataFrame(rows, "qid string, step int, text string"), models, contexts)


def test_every_program(ran):
    got = {r.qid: (r.status, r.steps_done, None if r.answer is None else json.loads(r.answer)) for r in ran.results.collect()}
    assert got == {q: tuple(want) for q, (_, *want) in PROGRAMS.items()} | {"nothing": ("failed", 1, None)}


def test_tasks_come_off_a_stack(ran):
    rows = ran.tasks.filter("qid = 'pairs'").collect()
    order = sorted(rows, key=lambda r: (r.step, r.task is None, r.task))
    assert [(r.question, r.model, r.answer) for r in order] == [
        ("kin(eve, ?)", "kb", '["cid","flo"]'), ("(select)", None, None), ("likes(cid, ?)", "kb", '["oat"]'), ("likes(flo, ?)", "kb", "[]"), ("(project)", None, None),
    ]


def test_an_empty_table_and_no_contexts(spark, models):
    none = spark.createDataFrame([], "qid string, step int, text string")
    assert R.run_programs(none, models).results.collect() == []
    one = R.run_programs(spark.createDataFrame([("q", 1, "(project) [read] #C")], "qid string, step int, text string"), models).results.first()
    assert (one.status, one.answer) == ("ok", "[]")


def test_plans_do_not_grow_with_the_program(spark, models):
    def joins(n):
        steps = ["(select) [kb] kin(dan, ?)", *["(project_values_flat_unique) [kb] kin(#1, ?)"] * n]
        ran = R.run_programs(spark.createDataFrame([("q", k, x) for k, x in enumerate(steps, 1)], "qid string, step int, text string"), models)
        return ran.results._jdf.queryExecution().optimizedPlan().toString().count("Join")

    assert joins(1) == joins(3)


def test_text_and_elements(spark):
    row = spark.createDataFrame([('"a \\"b\\""', '["k", [1, "x"]]')], "t string, p string")
    got = row.select(R.as_text(F.col("t")), R.as_text(F.col("p")), R.element(F.col("p"), 0), R.element(F.col("p"), 1), R.element(F.col("p"), 2), R._quoted(F.lit('a"b\\')), R._is_pair(F.col("p"))).first()
    assert tuple(got) == ('a "b"', '["k", [1, "x"]]', '"k"', '[1,"x"]', None, '"a\\"b\\\\"', True)


def test_equal_programs_run_once(spark, models):
    asked = []

    def kb(asks):
        asked.extend(r.qid for r in asks.select("qid").collect())
        return models["kb"](asks)

    steps = ["(select) [kb] kin(dan, ?)", "(project) [read] #C"]
    rows = [(q, k, text) for q in "abcd" for k, text in enumerate(steps, 1)] + [("x", 1, steps[0]), ("y", 1, steps[0])]
    contexts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("x", 1), ("y", 2)], "qid string, paras int")
    ran = R.run_programs(spark.createDataFrame(rows, "qid string, step int, text string"), {"kb": kb, "read": models["read"]}, contexts)
    assert sorted(asked) == ["a", "c", "d", "x"]
    got = {r.qid: (r.status, r.steps_done, r.answer) for r in ran.results.collect()}
    assert len(got) == 6 and got["a"] == got["b"] != got["c"] and got["x"] == got["y"]
    assert sorted((r.question, r.answer) for r in ran.tasks.filter("qid = 'b'").collect()) == sorted((r.question, r.answer) for r in ran.tasks.filter("qid = 'a'").collect())
