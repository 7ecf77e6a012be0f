"""Queries over the scoring functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import scoring as S
from ravelin.functions.text import answer_tokens
from ravelin.operators.align import aligned_f1 as aligned
from ravelin.plans.base import ANSWERS, MANY, answers, query, sql_answer_tokens, sql_norm, sql_words, t, word_slice

_G, _P = sql_answer_tokens("gold"), sql_answer_tokens("prediction")


def sql_overlap(g: str, p: str) -> str:
    """Common elements of two lists with repeats."""
    return f"coalesce(list_sum(list_transform(list_distinct({g}), lambda x: least(len(list_filter({g}, lambda y: y = x)), len(list_filter({p}, lambda z: z = x))))), 0)"


def sql_f1(g: str = _G, p: str = _P) -> str:
    return f"CASE WHEN len({g}) = 0 OR len({p}) = 0 THEN CAST(len({g}) = len({p}) AS DOUBLE) ELSE 2.0 * {sql_overlap(g, p)} / (len({g}) + len({p})) END"


SQL_EM = f"CAST({sql_norm('gold')} = {sql_norm('prediction')} AS INT)"
SQL_IN = f"(contains({sql_norm('prediction')}, {sql_norm('gold')}) OR (length({sql_norm('prediction')}) > 3 AND contains({sql_norm('gold')}, {sql_norm('prediction')})) OR len(list_filter({_G}, lambda x: NOT list_contains({_P}, x))) = 0)"
SQL_RECALL = f"CASE WHEN {SQL_IN} OR len({_G}) = 0 THEN 1.0 ELSE {sql_overlap(_G, _P)}::DOUBLE / len({_G}) END"


@query(f"WITH {ANSWERS} SELECT question_id, {SQL_EM} AS em FROM qa")
def exact_match(spark, d):
    return answers(spark, d).select("question_id", S.exact_match(F.col("gold"), F.col("prediction")).alias("em"))


@query(f"WITH {ANSWERS} SELECT question_id, round({sql_f1()}, 6) AS f1 FROM qa")
def token_f1(spark, d):
    return answers(spark, d).select("question_id", F.round(S.token_f1(F.col("gold"), F.col("prediction")), 6).alias("f1"))


@query(f"WITH {ANSWERS} SELECT question_id, CAST({SQL_IN} AS INT) AS acc FROM qa")
def answer_accuracy(spark, d):
    return answers(spark, d).select("question_id", S.accuracy(F.col("gold"), F.col("prediction")).alias("acc"))


@query(f"WITH {ANSWERS} SELECT question_id, round({SQL_RECALL}, 6) AS recall FROM qa")
def answer_recall(spark, d):
    return answers(spark, d).select("question_id", F.round(S.recall(F.col("gold"), F.col("prediction")), 6).alias("recall"))


@query(f"""
WITH {ANSWERS}, g AS (SELECT question_id, prediction, unnest([gold, reply, {sql_words('question', 2, MANY)}]) AS gold FROM qa)
SELECT question_id, max({SQL_EM}) AS em, round(max({sql_f1()}), 6) AS f1 FROM g GROUP BY question_id
""")
def max_over_gold(spark, d):
    a = answers(spark, d)
    golds = a.select("question_id", "prediction", F.explode(F.array("gold", "reply", word_slice(F.col("question"), 2, MANY))).alias("gold"))
    return golds.groupBy("question_id").agg(F.max(S.exact_match(F.col("gold"), F.col("prediction"))).alias("em"), F.round(F.max(S.token_f1(F.col("gold"), F.col("prediction"))), 6).alias("f1"))


def _sql_bag(g, p):
    hit, ng, np_ = f"len(list_intersect(list_distinct({g}), list_distinct({p})))::DOUBLE", f"len(list_distinct({g}))", f"len(list_distinct({p}))"
    pr, rc = f"CASE WHEN {np_} = 0 THEN 1.0 ELSE {hit} / nullif({np_}, 0) END", f"CASE WHEN {ng} = 0 THEN 1.0 ELSE {hit} / nullif({ng}, 0) END"
    return f"CASE WHEN ({pr}) + ({rc}) = 0 THEN 0.0 ELSE 2 * ({pr}) * ({rc}) / (({pr}) + ({rc})) END"


@query(f"WITH {ANSWERS} SELECT question_id, round({_sql_bag(_G, _P)}, 6) AS f1 FROM qa")
def bag_f1(spark, d):
    return answers(spark, d).select("question_id", F.round(S.bag_f1(answer_tokens(F.col("gold")), answer_tokens(F.col("prediction"))), 6).alias("f1"))


def _sql_pair(a, b):
    return _sql_bag(sql_answer_tokens(a), sql_answer_tokens(b))


@query(f"""
WITH {ANSWERS}, s AS (SELECT question_id, reply AS g1, question AS g2, {sql_words('question', 3, MANY)} AS p1, {sql_words('reply', 5, MANY)} AS p2 FROM qa)
SELECT question_id, round(greatest(({_sql_pair('g1', 'p1')}) + ({_sql_pair('g2', 'p2')}), ({_sql_pair('g1', 'p2')}) + ({_sql_pair('g2', 'p1')})) / 2, 6) AS f1 FROM s
""")
def aligned_f1(spark, d):
    a = answers(spark, d).select("question_id", F.array("reply", "question").alias("g"), F.array(word_slice(F.col("question"), 3, MANY), word_slice(F.col("reply"), 5, MANY)).alias("p"))
    spans = lambda c: F.transform(c, answer_tokens)
    return a.select("question_id", F.round(aligned(spans(F.col("g")), spans(F.col("p"))), 6).alias("f1"))


_GOLD_T, _PRED_T = "list_transform(range(0, 3), lambda i: 'src' || ((doc_id + i) % 20))", "list_transform(range(0, 1 + doc_id % 4), lambda i: 'src' || ((doc_id * 2 + i) % 20))"


@query(f"""
WITH s AS (SELECT doc_id, {_GOLD_T} AS g, {_PRED_T} AS p FROM documents), h AS (SELECT *, len(list_intersect(g, p))::DOUBLE AS hit FROM s)
SELECT doc_id, round(hit / len(p), 6) AS "precision", round(hit / len(g), 6) AS recall,
       round(CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / len(p)) * (hit / len(g)) / (hit / len(p) + hit / len(g)) END, 6) AS f1, CAST(hit = len(g) AND hit = len(p) AS INT) AS em FROM h
""")
def support_f1(spark, d):
    g = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("src"), ((F.col("doc_id") + i) % 20).cast("string")))
    p = F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4), lambda i: F.concat(F.lit("src"), ((F.col("doc_id") * 2 + i) % 20).cast("string")))
    s = S.set_scores(g, p)
    return t(spark, d, "documents").select("doc_id", *[F.round(s[k], 6).alias(k) if k != "em" else s[k].alias(k) for k in s])


@query("""
SELECT o_orderkey, CASE WHEN span IS NOT NULL THEN span WHEN num IS NOT NULL THEN num ELSE day END AS oracle_gold,
       CASE WHEN num IS NOT NULL THEN num WHEN span IS NOT NULL THEN span ELSE day END AS scored_gold
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS span, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS num,
             day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate) AS day FROM orders)
""")
def gold_answers(spark, d):
    span, num = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string"))
    day = F.concat_ws("-", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(span, num, day).alias("oracle_gold"), F.coalesce(num, span, day).alias("scored_gold"))


@query(f"""
WITH {ANSWERS}, z AS (SELECT question_id, CAST({sql_norm('gold')} = {sql_norm('prediction')} AS BOOL) AS zero, {SQL_IN} AS single FROM qa)
SELECT question_id, CASE WHEN zero THEN 'Z' WHEN single THEN 'S' ELSE 'M' END AS label FROM z
""")
def outcome_label(spark, d):
    zero, single = S.exact_match(F.col("gold"), F.col("prediction")) == 1, S.contained(F.col("gold"), F.col("prediction"))
    return answers(spark, d).select("question_id", F.when(zero, "Z").when(single, "S").otherwise("M").alias("label"))


@query(f"WITH {ANSWERS} SELECT question_id, list_contains([lower(trim(gold)), lower(trim(question))], lower(trim(prediction))) AS correct FROM qa")
def answer_in_gold(spark, d):
    low = lambda c: F.lower(F.trim(F.col(c)))
    return answers(spark, d).select("question_id", F.array_contains(F.array(low("gold"), low("question")), low("prediction")).alias("correct"))


@query(f"WITH {ANSWERS} SELECT question_id, CASE WHEN length(reply) > 500 THEN left(reply, 500) || '...' ELSE reply END AS preview FROM qa")
def context_preview(spark, d):
    return answers(spark, d).select("question_id", F.when(F.length("reply") > 500, F.concat(F.left("reply", F.lit(500)), F.lit("..."))).otherwise(F.col("reply")).alias("preview"))
