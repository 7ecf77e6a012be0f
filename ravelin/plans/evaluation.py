"""Queries over scored answers, routing logs and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import scoring as S
from ravelin.functions.text import plain_words, tokens
from ravelin.operators import reports as R
from ravelin.operators import retrieval as O
from ravelin.operators.agents import sequence_ratio
from ravelin.operators.align import bags_f1  # noqa: F401
from ravelin.plans.base import ANSWERS, answers, query, sql_norm, sql_tokens, t
from ravelin.plans.retrieval import BM25, hits
from ravelin.plans.scores import SQL_EM, SQL_IN, SQL_RECALL, sql_f1


def scored(spark, d):
    g, p = F.col("gold"), F.col("prediction")
    return answers(spark, d).select("*", S.exact_match(g, p).alias("em"), S.token_f1(g, p).alias("f1"), S.accuracy(g, p).alias("acc"), S.recall(g, p).alias("recall"))


SCORED = f"{ANSWERS}, scored AS (SELECT *, {SQL_EM} AS em, {sql_f1()} AS f1, CAST({SQL_IN} AS INT) AS acc, {SQL_RECALL} AS recall FROM qa)"
_METRICS = ("em", "f1", "acc", "recall")
_AVG = ", ".join(f"round(avg({m}), 3) AS {m}" for m in _METRICS)


def routing(spark, d):
    """The routing log: action by event type, confidence, cascade below 0.6 unless the action is multi-hop."""
    e = t(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "S-Sparse").when(F.col("event_type") == "error", "M").when(F.col("event_type") == "purchase", "S-Dense").when(F.col("event_type") == "signup", "S-Hybrid").otherwise("Z")
    conf = F.col("value") / (F.col("value") + 50)
    out = e.select("event_id", F.concat(F.lit("ds"), (F.col("user_id") % 6).cast("string")).alias("dataset"), action.alias("initial_action"), conf.alias("confidence"))
    cascaded = (F.col("confidence") < 0.6) & ~F.col("initial_action").startswith("M")
    return out.select("*", cascaded.alias("cascaded"), F.when(cascaded, "M").otherwise(F.col("initial_action")).alias("final_action"))


ROUTING = """ro0 AS (SELECT event_id, 'ds' || (user_id % 6) AS dataset, CASE event_type WHEN 'click' THEN 'S-Sparse' WHEN 'error' THEN 'M' WHEN 'purchase' THEN 'S-Dense' WHEN 'signup' THEN 'S-Hybrid' ELSE 'Z' END AS initial_action, value / (value + 50) AS confidence FROM events),
ro AS (SELECT *, confidence < 0.6 AND initial_action <> 'M' AS cascaded, CASE WHEN confidence < 0.6 AND initial_action <> 'M' THEN 'M' ELSE initial_action END AS final_action FROM ro0)"""


def labelled(spark, d):
    """Routing labels by quality and toxicity against a rule on length."""
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars", "source", "lang"), "doc_id")
    gold = F.when(F.col("toxic") == 1, "M").when(F.col("quality") == 1, "S-Dense").otherwise("Z")
    pred = F.when(F.col("n_chars") > 3000, "M").when(F.col("n_chars") > 800, "S-Dense").when(F.col("n_chars") > 400, "S-Sparse").otherwise("Z")
    return x.select("doc_id", "source", "lang", gold.alias("gold"), pred.alias("pred"))


LABELLED = """lb AS (SELECT doc_id, source, lang, CASE WHEN toxic = 1 THEN 'M' WHEN quality = 1 THEN 'S-Dense' ELSE 'Z' END AS gold,
  CASE WHEN n_chars > 3000 THEN 'M' WHEN n_chars > 800 THEN 'S-Dense' WHEN n_chars > 400 THEN 'S-Sparse' ELSE 'Z' END AS pred FROM labels JOIN documents USING (doc_id))"""


@query(f"WITH {SCORED} SELECT question_id, em, round(f1, 6) AS f1, acc, round(recall, 6) AS recall FROM scored")
def score_predictions(spark, d):
    return scored(spark, d).select("question_id", "em", F.round("f1", 6).alias("f1"), "acc", F.round("recall", 6).alias("recall"))


@query(f"WITH {SCORED} SELECT dataset, coalesce(action, 'all') AS action, count(*) AS count, {_AVG} FROM scored GROUP BY GROUPING SETS ((dataset), (dataset, action))")
def metrics_by_action(spark, d):
    return R.by_groupings(scored(spark, d), [["dataset"], ["dataset", "action"]], _METRICS)


@query(f"WITH {SCORED}, g AS (SELECT dataset, count(*) AS count, {_AVG} FROM scored GROUP BY dataset) SELECT sum(count)::BIGINT AS count, {', '.join(f'round(sum({m} * count) / sum(count), 4) AS {m}' for m in _METRICS)} FROM g")
def micro_average(spark, d):
    return R.micro_average(R.by_groupings(scored(spark, d), [["dataset"]], _METRICS), _METRICS)


@query(f"WITH {ROUTING} SELECT initial_action, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM ro GROUP BY 1")
def action_distribution(spark, d):
    return R.shares(routing(spark, d), "initial_action")


@query(f"WITH {LABELLED} SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS total, round(100 * avg(CAST(gold = 'Z' AS INT)), 4) AS pct_z, round(100 * avg(CAST(gold = 'M' AS INT)), 4) AS pct_m FROM lb GROUP BY ROLLUP (lang, source)")
def label_rollup(spark, d):
    out = labelled(spark, d).rollup("lang", "source").agg(F.count(F.lit(1)).alias("total"), *[F.round(100 * F.avg((F.col("gold") == a).cast("int")), 4).alias(n) for a, n in (("Z", "pct_z"), ("M", "pct_m"))])
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "total", "pct_z", "pct_m")


def _report_sql(gold, pred):
    return f"""WITH {LABELLED}, x AS (SELECT {gold} AS g, {pred} AS p FROM lb), l AS (SELECT g AS label FROM x UNION SELECT p FROM x),
c AS (SELECT label, (SELECT count(*) FROM x WHERE g = label AND p = label) AS hit, (SELECT count(*) FROM x WHERE g = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS predicted FROM l),
m AS (SELECT *, coalesce(hit / nullif(predicted, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS rc FROM c)
SELECT label, round(pr, 4) AS "precision", round(rc, 4) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 4) AS f1, support FROM m"""


@query(_report_sql("gold", "pred"))
def classification_report(spark, d):
    return R.classification_report(labelled(spark, d), "gold", "pred")


_COARSE = "CASE WHEN {0} LIKE 'S-%' THEN 'S' ELSE {0} END"


@query(_report_sql(_COARSE.format("gold"), _COARSE.format("pred")))
def coarse_report(spark, d):
    from ravelin.functions.text import coarse

    return R.classification_report(labelled(spark, d).select(coarse(F.col("gold")).alias("gold"), coarse(F.col("pred")).alias("pred")), "gold", "pred")


@query(f"""WITH {LABELLED} SELECT gold, count(*) FILTER (WHERE pred = 'Z') AS "Z", count(*) FILTER (WHERE pred = 'S-Sparse') AS "S-Sparse", count(*) FILTER (WHERE pred = 'S-Dense') AS "S-Dense", count(*) FILTER (WHERE pred = 'M') AS "M" FROM lb GROUP BY gold""")
def confusion_matrix(spark, d):
    return labelled(spark, d).groupBy("gold").pivot("pred", ["Z", "S-Sparse", "S-Dense", "M"]).count().na.fill(0)


@query(f"WITH {LABELLED} SELECT gold, pred, n FROM (SELECT gold, pred, count(*) AS n FROM lb WHERE gold <> pred GROUP BY 1, 2) ORDER BY n DESC, gold, pred LIMIT 3")
def label_transitions(spark, d):
    return labelled(spark, d).filter("gold <> pred").groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(3)


@query("SELECT o_custkey, o_orderpriority AS answer, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1")
def majority_answer(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("f"))
    return R.first_rows(n, 1, ["o_custkey"], F.desc("n"), F.asc("f")).select("o_custkey", "answer", "n")


@query(f"WITH {ROUTING} SELECT count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, round(min(confidence), 6) AS low, round(max(confidence), 6) AS high, round(avg(CAST(confidence < 0.6 AS INT)), 6) AS below FROM ro")
def confidence_stats(spark, d):
    c = F.col("confidence")
    return routing(spark, d).agg(F.count(F.lit(1)).alias("n"), *[F.round(f, 6).alias(n) for f, n in ((F.avg(c), "mean"), (F.stddev_pop(c), "std"), (F.min(c), "low"), (F.max(c), "high"), (F.avg((c < 0.6).cast("int")), "below"))])


@query(f"WITH {ROUTING} SELECT initial_action, final_action, count(*) AS n, round(avg(confidence), 6) AS mean, round(coalesce(stddev_samp(confidence), 0), 6) AS std FROM ro GROUP BY 1, 2")
def confidence_stats_by_route(spark, d):
    c = F.col("confidence")
    return routing(spark, d).groupBy("initial_action", "final_action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias("std"))


@query(f"WITH {ROUTING}, h AS (SELECT least(floor(confidence * 10), 9)::INT AS b, count(*) AS c FROM ro GROUP BY 1) SELECT k::INT AS bin, coalesce(c, 0) AS n FROM range(10) r(k) LEFT JOIN h ON b = k")
def confidence_histogram(spark, d):
    return R.histogram(routing(spark, d), "confidence")


@query(f"WITH {ROUTING} SELECT coalesce(initial_action, 'all') AS initial_action, count(*) AS n, round(avg(CAST(cascaded AS INT)), 4) AS cascade_rate FROM ro GROUP BY ROLLUP (initial_action)")
def cascade_rates(spark, d):
    out = routing(spark, d).rollup("initial_action").agg(F.count(F.lit(1)).alias("n"), R.rate(F.col("cascaded")).alias("cascade_rate"))
    return out.select(F.coalesce("initial_action", F.lit("all")).alias("initial_action"), "n", "cascade_rate")


@query(f"WITH {ROUTING}, g AS (SELECT dataset, cascaded, count(*) AS n, avg(CAST(event_id % 3 = 0 AS INT)) AS em FROM ro GROUP BY 1, 2) SELECT cascaded, sum(n)::BIGINT AS n, round(sum(em * n) / sum(n), 4) AS em FROM g GROUP BY cascaded")
def cascade_weighted(spark, d):
    g = routing(spark, d).groupBy("dataset", "cascaded").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_id") % 3 == 0).cast("int")).alias("em"))
    return g.groupBy("cascaded").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("em") * F.col("n")) / F.sum(F.col("n")), 4).alias("em"))


def _none():
    return F.array().cast("array<string>")


def _titles(spark, d):
    """Titles retrieved for each benchmark item."""
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("title"))
    got = hits(spark, d).join(docs, "doc_id").groupBy("query_id").agg(F.collect_set("title").alias("ret"))
    every = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return every.join(got, "query_id", "left").select("query_id", F.coalesce("ret", _none()).alias("ret"))


def _retrieved(spark, d):
    """Titles retrieved for each benchmark item, and gold titles: sources of the documents that hold its text."""
    docs = t(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"))
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    gold = O.containing(docs, b).join(docs.select("doc_id", "title"), "doc_id").groupBy("query_id").agg(F.collect_set("title").alias("gold"))
    return _titles(spark, d).join(gold, "query_id", "left").select("query_id", "ret", F.coalesce("gold", _none()).alias("gold"))


RETRIEVED = f"""{BM25}, rt AS (SELECT query_id, list(DISTINCT source) AS ret FROM hits JOIN documents USING (doc_id) GROUP BY query_id),
gd AS (SELECT item_id AS query_id, list(DISTINCT d.source) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id),
rg AS (SELECT b.item_id AS query_id, coalesce(ret, []) AS ret, coalesce(gold, []) AS gold, len(list_intersect(coalesce(ret, []), coalesce(gold, [])))::DOUBLE AS hit FROM benchmark b LEFT JOIN rt ON rt.query_id = b.item_id LEFT JOIN gd ON gd.query_id = b.item_id)"""


@query(f"""WITH {RETRIEVED} SELECT count(*) AS n, round(avg(hit / len(ret)), 4) AS "precision", round(avg(hit / len(gold)), 4) AS recall, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (len(ret) + len(gold)) END), 4) AS f1,
round(avg(CAST(hit > 0 AS INT)), 4) AS hit_rate, round(avg(CAST(hit = len(gold) AS INT)), 4) AS perfect_rate, round(avg(CAST(hit = 0 AS INT)), 4) AS no_hit_rate FROM rg WHERE len(gold) > 0""")
def retrieval_quality(spark, d):
    r = _retrieved(spark, d).filter(F.size("gold") > 0)
    s = S.set_scores(F.col("gold"), F.col("ret"))
    hit = F.size(F.array_intersect("gold", "ret"))
    mean = [F.round(F.avg(s[k]), 4).alias(k) for k in ("precision", "recall", "f1")]
    return r.agg(F.count(F.lit(1)).alias("n"), *mean, R.rate(hit > 0).alias("hit_rate"), R.rate(hit == F.size("gold")).alias("perfect_rate"), R.rate(hit == 0).alias("no_hit_rate"))


@query(f"WITH {RETRIEVED} SELECT round(avg(len(ret)), 4) AS mean, min(len(ret)) AS low, max(len(ret)) AS high, count(*) FILTER (WHERE len(ret) = 0) AS empty, round(100.0 * avg(CAST(len(ret) = 0 AS INT)), 4) AS empty_pct FROM rg")
def retrieval_volume(spark, d):
    n = F.size("ret").cast("long")
    return _titles(spark, d).agg(F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("low"), F.max(n).alias("high"), F.count_if(n == 0).alias("empty"), F.round(100.0 * F.avg((n == 0).cast("int")), 4).alias("empty_pct"))


@query(f"WITH {RETRIEVED} SELECT CASE WHEN len(gold) = 0 OR hit = 0 THEN 'none' WHEN hit = len(gold) THEN 'perfect' ELSE 'partial' END AS overlap, count(*) AS n, round(avg(CASE WHEN len(gold) = 0 THEN 0 ELSE hit / len(gold) END), 4) AS ratio FROM rg GROUP BY 1")
def context_overlap(spark, d):
    hit, n = F.size(F.array_intersect("gold", "ret")), F.size("gold")
    kind = F.when((n == 0) | (hit == 0), "none").when(hit == n, "perfect").otherwise("partial")
    ratio = F.when(n == 0, 0.0).otherwise(hit / F.greatest(n, F.lit(1)))
    return _retrieved(spark, d).groupBy(kind.alias("overlap")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ratio), 4).alias("ratio"))


def _first_found(spark, d):
    """The rank of the first hit that holds a benchmark item; null if none does."""
    gold = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("a"))
    h = hits(spark, d).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").join(O.bounded(gold), "query_id")
    found = h.filter(F.contains(F.lower("text"), F.lower("a"))).groupBy("query_id").agg(F.min("rank").alias("found"))
    return gold.select("query_id").join(found, "query_id", "left")


FOUND = f"""{BM25}, ff AS (SELECT b.item_id AS query_id, min(rank) AS found FROM benchmark b LEFT JOIN (SELECT h.* FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b2 ON b2.item_id = h.query_id
  WHERE contains(lower(d.text), lower(b2.text))) x ON x.query_id = b.item_id GROUP BY b.item_id)"""
_AT = "coalesce(found <= {0}, false)"


@query(f"WITH {FOUND} SELECT query_id, {', '.join(f'{_AT.format(k)} AS found_at_{k}' for k in (1, 5, 20))} FROM ff")
def recall_at_k(spark, d):
    return _first_found(spark, d).select("query_id", *[F.coalesce(F.col("found") <= k, F.lit(False)).alias(f"found_at_{k}") for k in (1, 5, 20)])


@query(f"WITH {FOUND}, b AS (SELECT CASE WHEN found <= 1 THEN 1 WHEN found <= 5 THEN 5 WHEN found <= 20 THEN 20 END AS k FROM ff) SELECT k AS first_found_at, count(*) AS n, CASE k WHEN 5 THEN '1->5' WHEN 20 THEN '5->20' END AS lost_in FROM b WHERE k IS NOT NULL GROUP BY k")
def recall_degradation(spark, d):
    f = F.col("found")
    k = F.when(f <= 1, 1).when(f <= 5, 5).when(f <= 20, 20)
    n = _first_found(spark, d).groupBy(k.alias("first_found_at")).agg(F.count(F.lit(1)).alias("n")).filter("first_found_at IS NOT NULL")
    return n.withColumn("lost_in", F.when(F.col("first_found_at") == 5, "1->5").when(F.col("first_found_at") == 20, "5->20"))


@query(f"""WITH {FOUND}, r AS (SELECT 'ds' || (query_id % 6) AS dataset, avg(CAST({_AT.format(5)} AS INT)) AS r5, avg(CAST({_AT.format(20)} AS INT)) AS r100 FROM ff GROUP BY 1)
SELECT dataset, round(r5, 4) AS recall_5, round(r100, 4) AS recall_100, CASE WHEN r100 < 0.5 THEN 'poor recall' WHEN r100 >= 0.8 AND r5 < 0.4 THEN 'poor ranking' WHEN r100 >= 0.8 AND r5 >= 0.6 THEN 'good' ELSE 'moderate' END AS diagnosis FROM r""")
def recall_diagnosis(spark, d):
    at = lambda k: F.avg(F.coalesce(F.col("found") <= k, F.lit(False)).cast("int"))
    r = _first_found(spark, d).groupBy(F.concat(F.lit("ds"), (F.col("query_id") % 6).cast("string")).alias("dataset")).agg(at(5).alias("r5"), at(20).alias("r100"))
    return r.select("dataset", F.round("r5", 4).alias("recall_5"), F.round("r100", 4).alias("recall_100"), R.diagnosis(F.col("r5"), F.col("r100")).alias("diagnosis"))


@query(f"WITH {FOUND} SELECT 'ds' || (query_id % 6) AS dataset, count(*) AS failures FROM ff WHERE NOT {_AT.format(5)} GROUP BY 1")
def recall_failures(spark, d):
    f = _first_found(spark, d).filter(~F.coalesce(F.col("found") <= 5, F.lit(False)))
    return f.groupBy(F.concat(F.lit("ds"), (F.col("query_id") % 6).cast("string")).alias("dataset")).agg(F.count(F.lit(1)).alias("failures"))


@query(f"""WITH {SCORED}, g AS (SELECT dataset, avg(acc) AS reader, avg(em) AS base, avg(recall) AS r5, CASE WHEN min(conv_id) % 2 = 0 THEN avg(f1) ELSE 0 END AS strong FROM scored GROUP BY dataset),
l AS (SELECT dataset, reader - base AS total, reader * (1 - r5) AS ret, CASE WHEN strong > 0 THEN strong - base ELSE reader - base - reader * (1 - r5) END AS rea FROM g)
SELECT dataset, round(total, 4) AS total, round(ret, 4) AS retrieval, round(rea, 4) AS reasoning, round(total - ret - rea, 4) + 0.0 AS other,
CASE WHEN total <= 0 THEN 'none' WHEN ret / total > 0.6 THEN 'retrieval' WHEN rea / total > 0.6 THEN 'reasoning' ELSE 'mixed' END AS cause FROM l""")
def loss_breakdown(spark, d):
    g = scored(spark, d).groupBy("dataset").agg(F.avg("acc").alias("reader"), F.avg("em").alias("base"), F.avg("recall").alias("r5"), F.when(F.min("conv_id") % 2 == 0, F.avg("f1")).otherwise(0.0).alias("strong"))
    x = R.losses(F.col("reader"), F.col("base"), F.col("r5"), F.col("strong"))
    out = g.select("dataset", *[v.alias(k) for k, v in x.items()])
    cause = R.dominant(F.col("total"), F.col("retrieval"), F.col("reasoning"))
    return out.select("dataset", *[(F.round(k, 4) + 0.0).alias(k) for k in x], cause.alias("cause"))


_PRED = "CASE question_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'Error: timeout' WHEN 2 THEN 'I cannot say' ELSE prediction END"


def _wrong(spark, d):
    """Wrong predictions; a question has its gold answer and that answer's last words as another."""
    a = answers(spark, d).withColumn("p", F.expr(_PRED)).filter(S.exact_match(F.col("gold"), F.col("p")) == 0)
    return a.select("question_id", "p", "gold", F.array("gold", F.expr(_OTHER)).alias("golds"))


def _errors(spark, d):
    """Wrong predictions and their kind, by the ratio of matching blocks of the plain texts."""
    a = _wrong(spark, d).withColumn("g", F.explode("golds"))
    ratio = sequence_ratio(plain_words(F.col("p")), plain_words(F.col("g")))
    best = a.withColumn("ratio", ratio).groupBy("question_id", "p", "gold", "golds").agg(F.max("ratio").alias("ratio"))
    kind = R.error_kind(F.col("p"), F.col("golds"), F.col("ratio"))
    return best.select("question_id", "p", "gold", kind.alias("kind"), F.length("p").alias("len_p"), F.length("gold").alias("len_g"))


_OTHER = "coalesce(nullif(substring(gold, 200), ''), gold)"
_PLAIN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_COUNT = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_SET = "list_distinct(string_split({}, ' '))"


@query(f"""WITH {ANSWERS}, e AS (SELECT question_id, {_PRED} AS p, gold, [gold, {_OTHER}] AS golds FROM qa WHERE {sql_norm('gold')} <> {sql_norm(f'({_PRED})')}), n AS (SELECT *, {_PLAIN.format('p')} AS pp, list_transform(golds, lambda g: {_PLAIN.format('g')}) AS pg, {_COUNT.format('p')} AS np,
list_sum(list_transform(golds, lambda g: {_COUNT.format('g')}))::DOUBLE / 2 AS ng FROM e), s AS (SELECT *, len(list_intersect({_SET.format('pp')}, {_SET.format('pg[1]')}))::DOUBLE / greatest(1, len({_SET.format('pp')})) AS sim FROM n)
SELECT question_id, CASE WHEN trim(p) = '' THEN 'empty_prediction' WHEN p LIKE 'Error%' THEN 'llm_error' WHEN contains(lower(p), 'don''t know') OR contains(lower(p), 'cannot') THEN 'refusal' WHEN contains(pp, pg[1]) OR contains(pp, pg[2]) THEN 'answer_embedded'
WHEN sim > 0.7 THEN 'high_similarity' WHEN sim > 0.4 THEN 'moderate_similarity' WHEN np > ng * 2 THEN 'too_verbose' WHEN np < ng * 0.5 AND np > 0 THEN 'too_short' ELSE 'completely_wrong' END AS kind FROM s""")
def error_kinds(spark, d):
    """The kind of each wrong prediction, with the share of its words in the gold answer for a similarity."""
    words = lambda c: F.array_distinct(F.split(plain_words(c), " "))
    share = F.size(F.array_intersect(words(F.col("p")), words(F.col("gold")))) / F.greatest(F.lit(1), F.size(words(F.col("p"))))
    return _wrong(spark, d).select("question_id", R.error_kind(F.col("p"), F.col("golds"), share).alias("kind"))


@query()
def error_taxonomy(spark, d):
    return _errors(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("len_p"), 4).alias("mean_length"), F.round(F.avg(F.col("len_p") / F.greatest("len_g", F.lit(1))), 4).alias("length_ratio"))


@query()
def error_examples(spark, d):
    return R.first_rows(_errors(spark, d), 3, ["kind"], F.asc("question_id")).select("kind", "place", "question_id", "p", "gold")


_PATTERN = "CASE WHEN trim(p) = '' THEN 'empty' WHEN p LIKE 'Error%' THEN 'error' WHEN length(p) > 60 THEN 'too_long' ELSE left(p, 30) END"


@query(f"WITH {ANSWERS}, x AS (SELECT {_PRED} AS p FROM qa) SELECT {_PATTERN} AS pattern, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, pattern LIMIT 20")
def answer_patterns(spark, d):
    x = answers(spark, d).select(F.expr(_PRED).alias("p"))
    return x.groupBy(F.expr(_PATTERN).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(20)


_ACTIONS = ["Z", "S-Sparse", "S-Dense", "S-Hybrid", "M"]


@query(f"""WITH {SCORED} SELECT dataset, {', '.join(f'''round(avg(em) FILTER (WHERE action = '{a}'), 4) AS "{a}_em", round(avg(f1) FILTER (WHERE action = '{a}'), 4) AS "{a}_f1"''' for a in _ACTIONS)} FROM scored GROUP BY dataset""")
def ablation_pivot(spark, d):
    return scored(spark, d).groupBy("dataset").pivot("action", _ACTIONS).agg(F.round(F.avg("em"), 4).alias("em"), F.round(F.avg("f1"), 4).alias("f1"))


@query(f"WITH {SCORED}, g AS (SELECT dataset, action, round(avg(f1), 6) AS f1 FROM scored GROUP BY 1, 2) SELECT dataset, action AS best, f1 FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, action) = 1")
def best_strategy(spark, d):
    g = scored(spark, d).groupBy("dataset", "action").agg(F.round(F.avg("f1"), 6).alias("f1"))
    return R.first_rows(g, 1, ["dataset"], F.desc("f1"), F.asc("action")).select("dataset", F.col("action").alias("best"), "f1")


@query(f"""WITH {SCORED}, s AS (SELECT dataset, question_id, round(f1, 6) AS f1 FROM scored) SELECT 'best' AS side, * FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, question_id) <= 2
UNION ALL SELECT 'worst', * FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY f1, question_id) <= 2""")
def best_worst_samples(spark, d):
    s = scored(spark, d).select("dataset", "question_id", F.round("f1", 6).alias("f1"))
    side = lambda name, o: R.first_rows(s, 2, ["dataset"], o, F.asc("question_id")).select(F.lit(name).alias("side"), "dataset", "question_id", "f1")
    return side("best", F.desc("f1")).unionByName(side("worst", F.asc("f1")))


@query(f"WITH {SCORED} SELECT question_id, em = 1 AS row_correct, round(avg(em) OVER (PARTITION BY dataset ORDER BY question_id ROWS UNBOUNDED PRECEDING), 3) > 0 AS running_correct FROM scored")
def running_em(spark, d):
    s = scored(spark, d)
    return s.select("question_id", (F.col("em") == 1).alias("row_correct"), (F.round(R.running(s, "em", ["dataset"], F.asc("question_id")), 3) > 0).alias("running_correct"))


@query(f"""WITH {SCORED}, g AS (SELECT conv_id, count(*) AS chains, sum(acc) AS correct FROM scored GROUP BY conv_id), a AS (SELECT c.conv_id, coalesce(chains, 0) AS chains, coalesce(correct, 0) AS correct FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id))
SELECT count(*) AS questions, count(*) FILTER (WHERE chains = 0) AS without, count(*) FILTER (WHERE correct > 0) AS any_correct, round(avg(chains), 4) AS mean_chains, round(avg(correct), 4) AS mean_correct FROM a""")
def chain_yield(spark, d):
    g = scored(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("chains"), F.sum("acc").alias("correct"))
    a = t(spark, d, "conversations").select("conv_id").distinct().join(g, "conv_id", "left").na.fill(0)
    return a.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("chains") == 0).alias("without"), F.count_if(F.col("correct") > 0).alias("any_correct"), F.round(F.avg("chains"), 4).alias("mean_chains"), F.round(F.avg("correct"), 4).alias("mean_correct"))


@query(f"""WITH {SCORED}, g AS (SELECT action, avg(em) AS em, avg(f1) AS f1 FROM scored GROUP BY action) SELECT g.action, round(g.em - b.em, 4) + 0.0 AS delta_em, round(g.f1 - b.f1, 4) + 0.0 AS delta_f1 FROM g, (SELECT * FROM g WHERE action = 'Z') b""")
def ablation_delta(spark, d):
    g = scored(spark, d).groupBy("action").agg(F.avg("em").alias("em"), F.avg("f1").alias("f1"))
    b = F.broadcast(g.filter("action = 'Z'").select(F.col("em").alias("b_em"), F.col("f1").alias("b_f1")))  # one row
    return g.crossJoin(b).select("action", (F.round(F.col("em") - F.col("b_em"), 4) + 0.0).alias("delta_em"), (F.round(F.col("f1") - F.col("b_f1"), 4) + 0.0).alias("delta_f1"))


@query(f"WITH {ROUTING} SELECT event_id, final_action, confidence >= 0.6 OR initial_action = 'M' AS direct FROM ro")
def cascade_decision(spark, d):
    return routing(spark, d).select("event_id", "final_action", (~F.col("cascaded")).alias("direct"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({sql_tokens('text')}) AS ts, text FROM benchmark) SELECT d.doc_id, round(CASE WHEN length(d.text) < 2 THEN 0.0 WHEN d.doc_id % 7 = 0 THEN 0.8
ELSE 1 / (1 + exp(-(len(list_intersect({sql_tokens('d.text')}, b.ts))::DOUBLE / 10 - 1))) END, 6) AS confidence FROM documents d JOIN b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id""")
def confidence_score(spark, d):
    """A logistic of a lexical logit; 0.8 without contexts (every seventh document here), 0 for an answer under two characters."""
    b = t(spark, d, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("ts"))
    x = t(spark, d, "documents").join(O.bounded(b), F.col("doc_id") % b.count() == F.col("item_id"))
    logit = F.size(F.array_intersect(tokens(F.col("text")), "ts")) / 10 - 1
    c = F.when(F.length("text") < 2, 0.0).when(F.col("doc_id") % 7 == 0, 0.8).otherwise(1 / (1 + F.exp(-logit)))
    return x.select("doc_id", F.round(c, 6).alias("confidence"))
