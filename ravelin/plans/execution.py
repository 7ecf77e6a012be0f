"""Queries over the executor of decomposed questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.operators import execution as X
from ravelin.operators import facts as K
from ravelin.operators import routed as R
from ravelin.plans.algebra import FACTS
from ravelin.plans.base import query, t

_NATIONS = X.Step("select", "in_region(?, $1)")


def _models(spark, d):
    facts = K.fact_base(spark, d)
    return {"kb": X.kb_model(facts), "math": X.math_model()}


def _regions(spark, d):
    return t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("qid")).withColumn("v1", F.col("qid"))


def _pairs(done):
    """Answers that are pairs, a row each."""
    pair = F.from_json("p", "key string, value array<string>")
    return done.filter("status = 'ok'").select("qid", F.explode("answer").alias("p")).select("qid", pair.alias("p")).select("qid", "p.key", F.array_join("p.value", ",").alias("value"))


@query(f"""WITH {FACTS} SELECT r.object AS qid, count(DISTINCT l.subject)::VARCHAR AS n FROM facts r LEFT JOIN facts l ON l.predicate = 'lives_in' AND l.object = r.subject
WHERE r.predicate = 'in_region' GROUP BY r.object""")
def algebra_program(spark, d):
    """How many customers live in a region: select, project and its suffixes, and a function of the list."""
    steps = [_NATIONS, X.Step("project_values_flat_unique", "lives_in(?, #1)"), X.Step("select", "count(#2)", "math")]
    done = X.run_steps(_regions(spark, d), steps, _models(spark, d))
    return done.filter("status = 'ok'").select("qid", F.get("answer", F.lit(0)).alias("n"))


_COUNTS = "SELECT r.object AS qid, r.subject AS key, count(l.subject) AS n FROM facts r LEFT JOIN facts l ON l.predicate = 'lives_in' AND l.object = r.subject WHERE r.predicate = 'in_region' GROUP BY 1, 2"
_COUNTED = [_NATIONS, X.Step("project", "lives_in(?, #1)"), X.Step("projectValues", "count(#2)", "math")]


@query(f"WITH {FACTS} SELECT qid, key, n::VARCHAR AS value FROM ({_COUNTS})")
def algebra_project_values(spark, d):
    """Pairs of a nation and the number of its customers: the value is asked about, the key stays."""
    return _pairs(X.run_steps(_regions(spark, d), _COUNTED, _models(spark, d)))


@query(f"WITH {FACTS} SELECT qid, string_agg(key, ',' ORDER BY key) AS nations FROM ({_COUNTS}) WHERE n > 6 GROUP BY qid")
def algebra_filter_values(spark, d):
    """Nations with over six customers."""
    done = X.run_steps(_regions(spark, d), [*_COUNTED, X.Step("filterValues_keys", "is_greater(#3 | 6)", "math")], _models(spark, d))
    return done.filter("status = 'ok'").select("qid", F.array_join("answer", ",").alias("nations"))


@query(f"""WITH {FACTS} SELECT s.subject AS qid, s.object AS key, string_agg(l.subject, ',' ORDER BY l.subject) AS value FROM facts s JOIN facts g ON g.predicate = 'in_region' AND g.subject = s.object AND g.object = 'r1'
JOIN facts l ON l.predicate = 'lives_in' AND l.object = s.object WHERE s.predicate = 'supplies_from' GROUP BY 1, 2""")
def algebra_filter_keys(spark, d):
    """Customers by a supplier's nation, where that is in region r1: the key is asked about, the pair stays."""
    q = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("qid")).withColumn("v1", F.col("qid"))
    steps = [X.Step("select", "supplies_from($1, ?)"), X.Step("project", "lives_in(?, #1)"), X.Step("filterKeys", "in_region(#2, r1)")]
    shared = X.run_shared(q, steps, _models(spark, d))
    return shared.spread(_pairs(shared.done).filter("value <> ''"))


@query(f"""WITH {FACTS} SELECT s.subject AS qid, '["' || g.object || '"]' AS key, string_agg(l.subject, ',' ORDER BY l.subject) AS value FROM facts s JOIN facts g ON g.predicate = 'in_region' AND g.subject = s.object
JOIN facts l ON l.predicate = 'lives_in' AND l.object = s.object WHERE s.predicate = 'supplies_from' GROUP BY 1, 2""")
def algebra_project_keys(spark, d):
    """The same with the key's answer in place of the key."""
    q = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("qid")).withColumn("v1", F.col("qid"))
    steps = [X.Step("select", "supplies_from($1, ?)"), X.Step("project", "lives_in(?, #1)"), X.Step("projectKeys", "in_region(#2, ?)")]
    shared = X.run_shared(q, steps, _models(spark, d))
    return shared.spread(_pairs(shared.done).filter("value <> ''"))


@query(f"""WITH {FACTS}, q AS (SELECT 's' || s_suppkey AS qid, 'r' || (s_suppkey % 5) AS v1 FROM supplier)
SELECT qid, max(CASE WHEN g.object = v1 THEN 'ok' ELSE 'empty' END) AS status, max(CASE WHEN g.object = v1 THEN g.subject END) AS nation FROM q JOIN facts s ON s.predicate = 'supplies_from' AND s.subject = qid
JOIN facts g ON g.predicate = 'in_region' AND g.subject = s.object GROUP BY qid""")
def algebra_filter_multi(spark, d):
    """The nations of a region that are a supplier's: a filter over one answer whose question holds another as well."""
    q = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("qid"), F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("v1"))
    steps = [_NATIONS, X.Step("select", "supplies_from($2, ?)"), X.Step("filter(#1)", "belongs_to(#1 | #2)", "math")]
    done = X.run_steps(q.withColumn("v2", F.col("qid")), steps, _models(spark, d))
    return done.select("qid", "status", F.get("answer", F.lit(0)).alias("nation"))


_VIEWS = [
    X.Rule("home_region($1, ?)", (X.Step("select", "moved_to($1, ?)"), X.Step("project_values_flat", "in_region(#1, ?)"))),  # nobody has moved: runs empty
    X.Rule("customer_region($1, ?)", (X.Step("select", "lives_in($1, ?)"), X.Step("project_values_flat_unique", "in_region(#1, ?)"))),
]


@query(f"WITH {FACTS} SELECT l.subject AS qid, g.object AS region, 'empty' AS moved FROM facts l JOIN facts g ON g.predicate = 'in_region' AND g.subject = l.object WHERE l.predicate = 'lives_in'")
def algebra_views(spark, d):
    """Predicates that stand for steps over other predicates."""
    q = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("qid")).withColumn("v1", F.col("qid"))
    models = _models(spark, d)
    models = {"view": X.rules_model(_VIEWS, models)}
    one = X.run_steps(q, [X.Step("select", "customer_region($1, ?)", "view")], models)
    two = X.run_steps(q, [X.Step("select", "home_region($1, ?)", "view")], models).select(F.col("qid").alias("q"), F.col("status").alias("moved"))
    return one.join(two, F.col("qid") == F.col("q")).select("qid", F.get("answer", F.lit(0)).alias("region"), "moved")


_TEMPLATES = [("Where does $1 dwell?", "dwells_in($1, ?)"), ("Where does $1 live?", "lives_in($1, ?)"), ("Where does $1 live", "moved_to($1, ?)"), ("In which region is $1?", "in_region($1, ?)")]


@query(f"""WITH {FACTS} SELECT subject AS qid, object AS answer FROM facts WHERE predicate IN ('lives_in', 'in_region')""")
def question_templates(spark, d):
    """Questions in words to predicates, by templates in order."""
    of = lambda name, key, c, text: t(spark, d, name).select(F.concat(F.lit(c), F.col(key).cast("string")).alias("qid")).withColumn("q", F.format_string(text, "qid"))
    asks = of("customer", "c_custkey", "c", "Where does %s live?").unionByName(of("nation", "n_nationkey", "n", "In which region is %s?"))
    facts = K.fact_base(spark, d)
    got = X.worded_model(_TEMPLATES, X.kb_model(facts))(asks, "words")
    return got.select("qid", F.get("answer", F.lit(0)).alias("answer"))


_MATH_Q = """CASE o_orderkey % 9 WHEN 0 THEN 'is_greater(' || o_custkey || ' | 70)' WHEN 1 THEN 'is_smaller(["' || o_custkey || '"] | 70)' WHEN 2 THEN 'diff(' || o_custkey || ' | 70.5)'
WHEN 3 THEN 'belongs_to(' || o_orderpriority || ' | ["1-URGENT","2-HIGH"])' WHEN 4 THEN 'max(["' || o_custkey || '","70"])' WHEN 5 THEN 'min([' || o_custkey || ',70])' WHEN 6 THEN 'count(["a","' || o_custkey || '"])'
WHEN 7 THEN 'max(["a","' || o_custkey || '"])' ELSE 'sum([' || o_custkey || '])' END"""


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN CASE WHEN o_custkey > 70 THEN 'yes' ELSE 'no' END WHEN 1 THEN CASE WHEN o_custkey < 70 THEN 'yes' ELSE 'no' END WHEN 2 THEN abs(o_custkey - 70.5)::DOUBLE::VARCHAR
WHEN 3 THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'yes' ELSE 'no' END WHEN 4 THEN greatest(o_custkey, 70)::DOUBLE::VARCHAR WHEN 5 THEN least(o_custkey, 70)::DOUBLE::VARCHAR WHEN 6 THEN '2' END AS answer FROM orders""")
def math_dispatch(spark, d):
    """Functions by the form of the question; no form and no number give no answer."""
    return t(spark, d, "orders").select("o_orderkey", X.math_answer(F.expr(_MATH_Q)).alias("answer"))


_MODELS = [("lives_in($1, ?)", "people"), ("lives_in(?, $1)", "places"), ("lives_in($1, $2)", "checks"), ("in_region($1, ?)", "places"), ("placed_by($1, ?)", "people"), ("placed_by($1, ?)", "orders")]
_ASKED = "CASE length(subject) % 3 WHEN 0 THEN predicate || '(' || subject || ', ?)' WHEN 1 THEN predicate || '(?, ' || object || ')' ELSE predicate || '(' || subject || ', ' || object || ')' END"


@query(f"""WITH {FACTS} SELECT predicate || subject AS qid, {_ASKED} AS question, CASE WHEN predicate = 'lives_in' THEN CASE length(subject) % 3 WHEN 0 THEN 'people' WHEN 1 THEN 'places' ELSE 'checks' END
WHEN predicate = 'in_region' AND length(subject) % 3 = 0 THEN 'places' END AS model FROM facts""")
def model_resolution(spark, d):
    """A question for each fact, and the one model that answers its form; two models share the orders' form, none has the
    suppliers'."""
    questions = K.fact_base(spark, d).select(F.concat("predicate", "subject").alias("qid"), F.expr(_ASKED).alias("question"))
    return X.resolved_models(questions, spark.createDataFrame(_MODELS, "predicate string, model string"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS n, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE '[' || o_orderpriority END AS first FROM orders""")
def json_or_text(spark, d):
    """Lists in JSON as their items, other texts as they are."""
    text = F.expr("""CASE o_orderkey % 3 WHEN 0 THEN '["' || o_orderstatus || '", "x"]' WHEN 1 THEN o_orderpriority ELSE '[' || o_orderpriority END""")
    got = X.json_or_text(text)
    return t(spark, d, "orders").select("o_orderkey", F.size(got).cast("long").alias("n"), F.get(got, F.lit(0)).alias("first"))


_SLICES = {"people": ["lives_in", "placed_by"], "places": ["in_region", "lives_in"]}


@query(f"""WITH {FACTS}, m(model, predicate) AS (VALUES {', '.join(f"('{m}', '{p}')" for m, ps in _SLICES.items() for p in ps)})
SELECT model, predicate, subject || ' ' || predicate || ' ' || object || '.' AS sentence, 'list(' || predicate || ')' AS of_list FROM facts JOIN m USING (predicate)""")
def submodel_slices(spark, d):
    """The facts that each model may know, as sentences, for data sets of its own."""
    m = spark.createDataFrame([(k, p) for k, ps in _SLICES.items() for p in ps], "model string, predicate string")
    x = K.fact_base(spark, d).join(F.broadcast(m), "predicate")  # as many rows as the models have predicates
    return x.select("model", "predicate", F.concat("subject", F.lit(" "), "predicate", F.lit(" "), "object", F.lit(".")).alias("sentence"), F.concat(F.lit("list("), "predicate", F.lit(")")).alias("of_list"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderkey % 2 = 0 OR o_orderkey % 4 = 2 END AS truth FROM orders")
def truth_test(spark, d):
    """yes, 1 and true in any case; what says neither is told as null here (an error where the test is strict)."""
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' ELSE o_orderpriority END")
    return t(spark, d, "orders").select("o_orderkey", X.truth(text, strict=False).alias("truth"))


_REGION = "'r' || (s_suppkey % 5)"


def _programs(spark, d):
    """A program for each supplier, of five kinds."""
    s = t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("s"), F.expr(_REGION).alias("r"), (F.col("s_suppkey") % 6).alias("kind"))
    own, nations = F.concat(F.lit("(select) [kb] supplies_from("), "s", F.lit(", ?)")), F.concat(F.lit("(select) [kb] in_region(?, "), "r", F.lit(")"))
    steps = [
        [own, F.lit("(project_values_flat) [kb] in_region(#1, ?)")],
        [nations, F.lit("(project) [kb] lives_in(?, #1)"), F.lit("(projectValues) [math] count(#2)"), F.lit("(filterValues_keys) [math] is_greater(#3 | 6)"), F.lit("(select) [math] count(#4)")],
        [own, nations, F.lit("(filter(#1)) [math] belongs_to(#1 | #2)")],
        [F.lit("(project_values_unique) [title] what is #C about")],
        [own, F.lit("(projectKeys) [kb] in_region(#1, ?)")],
        [own, F.lit("(guess) [kb] in_region(#1, ?)")],
    ]
    kind = F.array(*[F.array(*x) for x in steps])
    programs = s.select(F.col("s").alias("qid"), F.posexplode(F.get(kind, F.col("kind").cast("int"))).alias("p", "text")).select("qid", (F.col("p") + 1).alias("step"), "text")
    return programs, s.select(F.col("s").alias("qid"), (F.col("s_suppkey") % 4).cast("int").alias("paras"))


@query(f"""WITH {FACTS}, s AS (SELECT 's' || s_suppkey AS qid, {_REGION} AS r, s_suppkey % 6 AS kind, (s_suppkey % 4)::INT AS paras, 'n' || s_nationkey AS n FROM supplier), g AS (SELECT subject AS n, object AS region FROM facts WHERE predicate = 'in_region'),
c AS (SELECT object AS n, count(*) AS k FROM facts WHERE predicate = 'lives_in' GROUP BY object), b AS (SELECT g.region, count(*) FILTER (WHERE k > 6) AS large FROM g LEFT JOIN c USING (n) GROUP BY g.region)
SELECT qid, CASE WHEN kind > 3 THEN 'failed' ELSE 'ok' END AS status, CASE kind WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS steps_done,
CASE kind WHEN 0 THEN '["' || g.region || '"]' WHEN 1 THEN '"' || b.large || '"' WHEN 2 THEN CASE WHEN g.region = s.r THEN '["' || n || '"]' ELSE '[]' END WHEN 3 THEN CASE paras WHEN 0 THEN '[]' WHEN 1 THEN '["even"]' ELSE '["even", "odd"]' END END AS answer
FROM s JOIN g USING (n) JOIN b ON b.region = s.r""")
def routed_programs(spark, d):
    """Programs as data, a different one for each supplier; those of two kinds fail at their second step."""
    programs, contexts = _programs(spark, d)
    facts = K.fact_base(spark, d)
    title = R.text_model(lambda q: F.when(q.rlike(r"PARA_\d*[02468] "), "even").otherwise("odd"))
    return R.run_programs(programs, {"kb": R.kb_model(facts), "math": R.math_model(), "title": title}, contexts).results


@query(f"""WITH {FACTS}, s AS (SELECT 's' || s_suppkey AS qid, s_suppkey % 6 AS kind, 'n' || s_nationkey AS n FROM supplier), g AS (SELECT subject AS n, object AS region FROM facts WHERE predicate = 'in_region')
SELECT qid, 1 AS step, 0 AS place, 'supplies_from(' || qid || ', ?)' AS question, '["' || n || '"]' AS answer FROM s WHERE kind IN (0, 2, 4, 5) UNION ALL
SELECT qid, 2, 0, 'in_region(' || n || ', ?)', '["' || region || '"]' FROM s JOIN g USING (n) WHERE kind = 0""")
def routed_tasks(spark, d):
    """What the first two steps of some kinds of programs ask the facts, in the order of a stack of tasks."""
    programs, contexts = _programs(spark, d)
    kept = programs.filter("step < 3 AND text LIKE '% [kb] %' AND NOT text LIKE '%in_region(?,%' AND NOT text LIKE '%lives_in%'")
    ran = R.run_programs(kept, {"kb": R.kb_model(K.fact_base(spark, d))}, contexts)
    return ran.tasks.filter("task IS NOT NULL").select("qid", "step", F.get("task", F.lit(0)).alias("place"), "question", "answer")
