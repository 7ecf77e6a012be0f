"""Queries over lookups, selections, scores and reports that complete the engine's operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import scoring as S
from ravelin.functions import text as T
from ravelin.operators import agents as A
from ravelin.operators import facts as K
from ravelin.operators import retrieval as R
from ravelin.operators import sampling as M
from ravelin.operators import search as H
from ravelin.operators.execution import Step, kb_model, math_model
from ravelin.operators.models import merged
from ravelin.plans.algebra import FACTS
from ravelin.plans.base import ANSWERS, answers, query, sql_answer_tokens, sql_norm, t
from ravelin.plans.retrieval import BM25, hits

_HASH = "md5('42|' || {})"
_FRACTION = "('0x' || substr(md5('{}|' || {}), 1, 8))::BIGINT / 4294967296.0"


@query("""
WITH p AS (SELECT page_id, string_split(regexp_replace(html, '</p>|</h1>', chr(10), 'g'), chr(10)) AS ls FROM pages),
y AS (SELECT page_id, trim(regexp_replace(ls[1], '<[^>]*>', '', 'g')) AS para FROM p)
SELECT page_id, sha256(para) AS para_hash FROM y WHERE len(list_filter(regexp_split_to_array(para, '\\s+'), lambda w: w <> '')) > 10
""")
def abstract_filter(spark, d):
    """Only abstracts: the first paragraph of each page, where it is long enough to be held."""
    from ravelin.sources.corpus import html_paragraphs as paragraphs

    return paragraphs(t(spark, d, "pages"), key="page_id", html="html").filter("is_abstract").select("page_id", F.sha2("paragraph_text", 256).alias("para_hash"))


@query(f"WITH {BM25} SELECT query_id, h.doc_id, round(score + 0.5 * CAST(coalesce(d.source IN ('src1', 'src2'), false) AS INT), 6) AS score FROM hits h JOIN documents d USING (doc_id)")
def paragraph_type_should(spark, d):
    """Several paragraph types add to the score of what has one, and exclude nothing."""
    h = hits(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return h.select("query_id", "doc_id", F.round(F.col("score") + 0.5 * F.coalesce(F.col("source").isin("src1", "src2"), F.lit(False)).cast("int"), 6).alias("score"))


@query(f"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'SPANS' WHEN 1 THEN 'SPAN' WHEN 2 THEN 'NUMBER' WHEN 3 THEN 'DATE' END AS answer_type FROM orders)
SELECT * FROM x WHERE answer_type IN ('SPAN', 'DATE') AND {_FRACTION.format('types', 'o_orderkey')} < 0.7 ORDER BY {_HASH.format('o_orderkey')} LIMIT 300""")
def answer_type_filter(spark, d):
    """Questions whose answer is one span or a date, seven of ten of them, 300 at most."""
    o = F.col("o_orderkey")
    spans = F.when(o % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(o % 5 == 1, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    number, day = F.when(o % 5 == 2, "12").otherwise(""), F.when(o % 5 == 3, "17").otherwise("")
    x = t(spark, d, "orders").select("o_orderkey", S.answer_type(spans, number, day).alias("answer_type"))
    kept = x.filter(F.col("answer_type").isin("SPAN", "DATE") & (M.fraction(o, "types") < 0.7))
    return kept.orderBy(M.order_hash(o)).limit(300)


@query("""WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer), k AS (SELECT c_custkey FROM p WHERE (place % 4 IN (1, 2) OR c_custkey IN (SELECT s_suppkey FROM supplier)) AND c_custkey NOT IN (SELECT n_nationkey FROM nation))
SELECT o_orderkey, c_custkey FROM k JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 5 IN (1, 3)""")
def passage_subselect(spark, d):
    """Questions (orders) whose answer is one span or a date, of every first and second passage (customer) in four, with
    listed ones in any case and others in none."""
    of = lambda name, key: t(spark, d, name).select(F.col(key).alias("c_custkey"))
    kept = M.subselected(of("customer", "c_custkey"), "c_custkey", 4, [1, 2], of("supplier", "s_suppkey"), of("nation", "n_nationkey"))
    return t(spark, d, "orders").filter("o_orderkey % 5 IN (1, 3)").join(kept, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


@query(f"WITH {ANSWERS} SELECT question_id, coalesce(e.event_type, 'unclassified') AS classified FROM qa LEFT JOIN events e ON e.event_id = question_id AND e.event_id % 3 <> 0")
def left_lookup(spark, d):
    """Every prediction with its classification, where it has one."""
    c = t(spark, d, "events").filter("event_id % 3 <> 0").select("event_id", "event_type")
    return answers(spark, d).join(c, F.col("question_id") == F.col("event_id"), "left").select("question_id", F.coalesce("event_type", F.lit("unclassified")).alias("classified"))


@query(f"WITH {ANSWERS} SELECT p.question_id, e.event_type AS decision, p.prediction, g.gold FROM (SELECT question_id, prediction FROM qa WHERE conv_id % 4 <> 1) p JOIN (SELECT question_id, gold FROM qa WHERE turn < 6) g USING (question_id) JOIN events e ON e.event_id = p.question_id")
def three_way_join(spark, d):
    """Decisions, predictions and gold answers of the questions that all three have."""
    a = answers(spark, d)
    p, g = a.filter("conv_id % 4 <> 1").select("question_id", "prediction"), a.filter("turn < 6").select("question_id", "gold")
    e = t(spark, d, "events").select(F.col("event_id").alias("question_id"), F.col("event_type").alias("decision"))
    return e.join(p, "question_id").join(g, "question_id").select("question_id", "decision", "prediction", "gold")


_SETS = """s AS (SELECT doc_id, list_transform(range(0, 3), lambda i: 'Src ' || ((doc_id + i) % 20)) AS g, list_transform(range(0, doc_id % 4 + 1), lambda i: 'src' || ((doc_id * 2 + i) % 20) || ' ') AS p FROM documents),
n AS (SELECT list_distinct(list_transform(g, lambda x: replace(lower(x), ' ', ''))) AS g, list_distinct(list_transform(p, lambda x: replace(lower(x), ' ', ''))) AS p FROM s),
h AS (SELECT *, len(list_intersect(g, p))::DOUBLE AS hit FROM n)"""


@query(f"""WITH {_SETS} SELECT count(*) AS count, round(avg(hit / len(p)), 3) AS "precision", round(avg(hit / len(g)), 3) AS recall, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * hit / (len(p) + len(g)) END), 3) AS f1,
round(avg(CAST(hit = len(g) AND hit = len(p) AS INT)), 3) AS em, round(avg(len(p)), 6) AS avg_predicted, max(len(p)) AS max_predicted, min(len(p)) AS min_predicted FROM h""")
def support_averages(spark, d):
    """Means of support scores over normalised titles, and how many were predicted."""
    g = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("Src "), ((F.col("doc_id") + i) % 20).cast("string")))
    p = F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 4), lambda i: F.concat(F.lit("src"), ((F.col("doc_id") * 2 + i) % 20).cast("string"), F.lit(" ")))
    plain = lambda c: F.array_distinct(F.transform(c, T.support_normal))
    x = t(spark, d, "documents").select(plain(g).alias("g"), plain(p).alias("p"))
    s, n = S.set_scores(F.col("g"), F.col("p")), F.size("p").cast("long")
    return x.agg(F.count(F.lit(1)).alias("count"), *[F.round(F.avg(s[k]), 3).alias(k) for k in ("precision", "recall", "f1", "em")], F.round(F.avg(n), 6).alias("avg_predicted"), F.max(n).alias("max_predicted"), F.min(n).alias("min_predicted"))


@query(f"""WITH {BM25}, x AS (SELECT query_id, h.doc_id, score FROM hits h JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(d.text)) ORDER BY score, h.doc_id DESC) = 1)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def buffer_dedupe_topk(spark, d):
    """A buffer of twenty hits, deduplicated, then the ten best."""
    h = hits(spark, d).drop("rank").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.ranked(R.deduped_hits(h), 10).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {ANSWERS} SELECT question_id, action, 'old' AS part FROM qa WHERE conv_id % 2 = 0 UNION ALL SELECT question_id, 'Z', 'new' FROM qa WHERE conv_id % 3 = 0")
def union_training_rows(spark, d):
    """Existing and new training rows, all of both."""
    a = answers(spark, d)
    old = a.filter("conv_id % 2 = 0").select("question_id", "action", F.lit("old").alias("part"))
    return old.unionByName(a.filter("conv_id % 3 = 0").select("question_id", F.lit("Z").alias("action"), F.lit("new").alias("part")))


@query("""WITH c AS (SELECT source, lower(trim(lang)) AS title FROM documents UNION SELECT source, lower(trim('Fact ' || (doc_id % 3))) FROM documents WHERE doc_id % 2 = 0)
SELECT source, string_agg(title, ',' ORDER BY title) AS titles FROM c WHERE title <> '' GROUP BY source""")
def gold_title_union(spark, d):
    """Gold titles of a question from its contexts and its supporting facts."""
    x = t(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("contexts"), F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" FACT "), (F.col("doc_id") % 3).cast("string")))).alias("facts"))
    return x.select("source", F.array_join(F.array_sort(S.gold_titles(F.col("contexts"), F.col("facts"))), ",").alias("titles"))


@query(f"""WITH x AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {_HASH.format('p_partkey')}) AS n, count(*) OVER (PARTITION BY p_brand) AS c FROM part)
SELECT p_brand, p_partkey, n <= 3 AS of_count, n <= ceil(c * 0.25) AS of_fraction FROM x WHERE n <= 3 OR n <= ceil(c * 0.25)""")
def entity_subsample(spark, d):
    """Entities of each type: three of it, or a quarter."""
    x = t(spark, d, "part").select("p_brand", "p_partkey")
    three, quarter = M.subsampled(x, "p_brand", "p_partkey", 3), M.subsampled(x, "p_brand", "p_partkey", 0.25)
    both = three.withColumn("of_count", F.lit(True)).join(quarter.withColumn("of_fraction", F.lit(True)), ["p_brand", "p_partkey"], "full")
    return both.select("p_brand", "p_partkey", F.coalesce("of_count", F.lit(False)).alias("of_count"), F.coalesce("of_fraction", F.lit(False)).alias("of_fraction"))


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH.format('doc_id')} LIMIT 25")
def validation_sample(spark, d):
    """A random sample of a given size, to look at."""
    return t(spark, d, "documents").select("doc_id").orderBy(M.order_hash(F.col("doc_id")), "doc_id").limit(25)


@query(f"WITH {FACTS} SELECT l.subject AS question_id, g.object AS answer, 2.0::DOUBLE AS score FROM facts l JOIN facts g ON g.predicate = 'in_region' AND g.subject = l.object WHERE l.predicate = 'lives_in'")
def best_first_search(spark, d):
    """Where a customer's home region lies: states go from participant to participant until all have ended."""
    facts = K.fact_base(spark, d)

    def follow(predicate, then):
        def step(states):
            got = K.answer_each(states, facts, predicate, item="at")
            return got.select("state_id", "question_id", F.lit(then).alias("next"), (F.col("score") + 1).alias("score"), F.col("answer").alias("at"))

        return step

    start = t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("question_id"))
    start = start.select(F.col("question_id").alias("state_id"), "question_id", F.lit("nation").alias("next"), F.lit(0.0).alias("score"), F.col("question_id").alias("at"))
    done = H.best_first(start, {"nation": follow("lives_in", "region"), "region": follow("in_region", "end")}, "end", steps=5)
    return done.select("question_id", F.col("at").alias("answer"), "score")


_GAIN = "round(('0x' || substr(md5('gain|' || {0}), 1, 8))::BIGINT / 4294967296.0, 6)"


def _level(k, last, predicate):
    return f"""c{k} AS (SELECT b.question_id, f.subject AS node, round(b.score + {_GAIN.format('f.subject')}, 6) AS score FROM {last} b JOIN facts f ON f.predicate = '{predicate}' AND f.object = b.node),
b{k} AS (SELECT * FROM c{k} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node) <= 3)"""


@query(f"""WITH {FACTS}, b0 AS (SELECT 'r' || r_regionkey AS question_id, 'r' || r_regionkey AS node, 0.0::DOUBLE AS score FROM region), {_level(1, 'b0', 'in_region')}, {_level(2, 'b1', 'lives_in')}, {_level(3, 'b2', 'placed_by')}
SELECT question_id, node, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, node) AS place FROM b3""")
def beam_tree_search(spark, d):
    """From a region over its nations and their customers to orders: three nodes of each depth go on."""
    facts = K.fact_base(spark, d).select(F.col("object").alias("of"), F.col("subject").alias("child"), "predicate")
    steps = facts.filter("predicate IN ('in_region', 'lives_in', 'placed_by')")

    def expand(nodes):
        got = nodes.join(steps, F.col("node") == F.col("of"))
        gain = F.round(M.fraction(F.col("child"), "gain"), 6)
        return got.select("question_id", F.col("child").alias("node"), F.round(F.col("score") + gain, 6).alias("score"), "depth")

    roots = t(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("question_id"))
    roots = roots.select("question_id", F.col("question_id").alias("node"), F.lit(0.0).alias("score"), F.lit(0).alias("depth"))
    return A.beam_search(roots, expand, F.col("node").startswith("o")).select("question_id", "node", "score", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, replace(lower(x), ' ', '') AS support, regexp_replace(lower(trim(x)), ' +', ' ', 'g') AS spaced FROM (SELECT c_custkey, '  ' || c_name || '   OF  ' || c_mktsegment || ' ' AS x FROM customer)")
def support_normalize(spark, d):
    x = F.concat(F.lit("  "), "c_name", F.lit("   OF  "), "c_mktsegment", F.lit(" "))
    return t(spark, d, "customer").select("c_custkey", T.support_normal(x).alias("support"), T.single_spaced(x).alias("spaced"))


_TITLED = "CASE doc_id % 4 WHEN 0 THEN 'Wikipedia Title: ' || source WHEN 1 THEN 'ipedia ' || lang WHEN 2 THEN 'The Great ' || source ELSE text END"


@query(f"SELECT doc_id, contains(lower(x), 'wikipedia title') OR contains(lower(x), 'the great') OR starts_with(lower(x), 'ipedia') OR starts_with(lower(x), 'ikipedia') AS titled FROM (SELECT doc_id, {_TITLED} AS x FROM documents)")
def title_looking(spark, d):
    return t(spark, d, "documents").select("doc_id", T.looks_like_title(F.expr(_TITLED)).alias("titled"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"""WITH w AS (SELECT doc_id, list_filter(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: w NOT IN ({_STOP})) AS ws FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(ws, lambda w: CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND NOT regexp_matches(w, '[ea]ies$') THEN left(w, length(w) - 3) || 'y'
WHEN w LIKE '%es' AND NOT regexp_matches(w, '[aeo]es$') THEN left(w, length(w) - 1) WHEN w LIKE '%s' AND NOT regexp_matches(w, '[us]s$') THEN left(w, length(w) - 1) ELSE w END), ' ')) AS stems FROM w""")
def analyzed_tokens(spark, d):
    """Tokens without stop words, with plural endings cut."""
    return t(spark, d, "documents").select("doc_id", F.md5(F.array_join(T.analyzed(F.col("text")), " ").cast("binary")).alias("stems"))


_SAID = "CASE conv_id % 3 WHEN 0 THEN 'Q: ' || question || '  so it is ' || gold || '<end>rest' WHEN 1 THEN 'Q: ' || left(question, (length(question) * 0.8)::INT) || '§ ' || gold ELSE gold END"
_SAID_SPARK = "CASE conv_id % 3 WHEN 0 THEN 'Q: ' || question || '  so it is ' || gold || '<end>rest' WHEN 1 THEN 'Q: ' || left(question, cast(round(length(question) * 0.8) as int)) || '§ ' || gold ELSE gold END"


@query(f"""WITH {ANSWERS}, s AS (SELECT question_id, conv_id, 'Q: ' || question AS p, {_SAID} AS x FROM qa),
c AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(x), length(p)) + 1), lambda i: substr(x, i, 1) <> substr(p, i, 1))) - 1, least(length(x), length(p))) AS n FROM s),
o AS (SELECT question_id, CASE WHEN starts_with(x, p) OR n > 0.5 * length(p) THEN regexp_replace(substr(x, n + 1), '^\\s+', '') ELSE x END AS y FROM c)
SELECT question_id, string_split(y, '<end>')[1] AS said FROM o""")
def prompt_removed(spark, d):
    """Generations that repeat their prompt, in whole or in most of it."""
    a = answers(spark, d)
    return a.select("question_id", T.without_prompt(F.expr(_SAID_SPARK), F.concat(F.lit("Q: "), "question"), "<end>").alias("said"))


@query("""SELECT doc_id, CASE label WHEN 'Z' THEN 'L0' WHEN 'S' THEN 'L1' ELSE 'L2' END AS complexity, CASE label WHEN 'Z' THEN 'None' ELSE 'BM25' END AS index_strategy, label AS action,
CASE label WHEN 'Z' THEN 'knowledge' WHEN 'S' THEN 'one retrieval' ELSE 'several steps' END AS reason
FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'M' WHEN quality = 1 THEN 'S' WHEN doc_id % 2 = 0 THEN 'Z' ELSE 'other' END AS label FROM labels)""")
def label_training_rows(spark, d):
    """Outcome labels as training rows: complexity, index strategy, action, and why."""
    label = F.when(F.col("toxic") == 1, "M").when(F.col("quality") == 1, "S").when(F.col("doc_id") % 2 == 0, "Z").otherwise("other")
    return t(spark, d, "labels").select("doc_id", *[c.alias(k) for k, c in S.training_label(label).items()])


_PLANS = "CASE p_partkey % 4 WHEN 0 THEN 'Let me convert a -> b' || chr(10) || ' ' || p_brand || ' -> ' || p_type WHEN 1 THEN 'Here''s the plan' || chr(10) || chr(10) || p_name WHEN 2 THEN ' step by step ' || p_size || chr(10) || 'i''ll do' ELSE p_name END"
_LINES = "list_transform(string_split(x, chr(10)), lambda l: trim(l))"


def _no(fillers):
    return " AND ".join("NOT contains(lower(l), '" + f.replace("'", "''") + "')" for f in fillers)


@query(f"""SELECT p_partkey, coalesce(list_filter({_LINES}, lambda l: contains(l, '->') AND {_no(T.PLAN_FILLERS)})[1], list_filter({_LINES}, lambda l: l <> '' AND {_no(T.LINE_FILLERS)})[1], {_LINES}[1]) AS line
FROM (SELECT p_partkey, {_PLANS} AS x FROM part)""")
def plan_line_fallbacks(spark, d):
    x = F.expr(_PLANS.replace("''", "\\'").replace("chr(10)", "char(10)"))
    return t(spark, d, "part").select("p_partkey", T.plan_line(x).alias("line"))


@query("SELECT doc_id, sha256(source || ' ' || trim(text)) AS pid FROM documents")
def paragraph_ids(spark, d):
    """Names of paragraphs: titles and texts, without a line of the title before the text."""
    x = t(spark, d, "documents")
    headed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Wikipedia Title: "), "source", F.lit("\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" Title: "), "source", F.lit(" \n"), "text")).otherwise(F.col("text"))
    return x.select("doc_id", F.sha2(A.pid(F.col("source"), headed), 256).alias("pid"))


_RECALL = "SELECT event_type AS dataset, avg(CAST(event_id % 7 < length(event_type) - 2 AS INT)) AS r100, avg(CAST(event_id % 7 < length(event_type) - 5 AS INT)) AS r5, avg(CAST(event_id % 3 = 0 AS INT)) AS overlap FROM events GROUP BY 1"


@query(f"""SELECT dataset, array_to_string(list_filter([CASE WHEN r100 < 0.5 THEN 'better recall: more candidates, rewritten queries, hybrid search' WHEN r100 >= 0.8 AND r5 < 0.4 THEN 'better ranking: another reranker, more documents for the reader'
WHEN r100 >= 0.8 AND r5 >= 0.6 THEN 'retrieval is good: improve the reader' END, CASE WHEN overlap < 0.5 THEN 'contexts miss the gold ones: check rewritten queries' END], lambda x: x IS NOT NULL), '; ') AS advice FROM ({_RECALL})""")
def recommendations(spark, d):
    """What to do next, by recall and overlap of each data set."""
    of = lambda c: F.avg(c.cast("int"))
    n = F.length("event_type")
    x = t(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(of(F.col("event_id") % 7 < n - 2).alias("r100"), of(F.col("event_id") % 7 < n - 5).alias("r5"), of(F.col("event_id") % 3 == 0).alias("overlap"))
    return x.select("dataset", F.array_join(S.retrieval_advice(F.col("r100"), F.col("r5"), F.col("overlap")), "; ").alias("advice"))


@query("""SELECT dataset, array_to_string(list_filter([CASE WHEN em >= 0.7 THEN 'the reader is good: improve retrieval' WHEN em >= 0.5 THEN 'improve prompts, then retrieval' WHEN em >= 0.3 THEN 'improve prompts or tune the model' ELSE 'take a stronger model' END,
CASE WHEN empties > 0.3 * errors THEN 'many empty answers: prompt for one' END, CASE WHEN extracted > 0.5 * errors THEN 'many wrong extractions: reason step by step' END], lambda x: x IS NOT NULL), '; ') AS advice
FROM (SELECT event_type AS dataset, avg(CAST(event_id % 10 < length(event_type) AS INT)) AS em, count(*) FILTER (WHERE event_id % 4 = 0) AS empties, count(*) FILTER (WHERE event_id % 5 < 2) AS extracted, count(*) FILTER (WHERE event_id % 2 = 0) AS errors FROM events GROUP BY 1)""")
def reader_recommendations(spark, d):
    e = F.col("event_id")
    x = t(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.avg((e % 10 < F.length("event_type")).cast("int")).alias("em"), F.count_if(e % 4 == 0).alias("empties"), F.count_if(e % 5 < 2).alias("extracted"), F.count_if(e % 2 == 0).alias("errors"))
    return x.select("dataset", F.array_join(S.reader_advice(F.col("em"), F.col("empties"), F.col("extracted"), F.col("errors")), "; ").alias("advice"))


_BASE = {"retrieval": {"hybrid": False, "k": 5}, "tree": {"on": False}, "cascade": {"on": False}}
_GRID = {"A": {}, "B": {"retrieval": {"hybrid": True}}, "C": {"retrieval": {"hybrid": True}, "cascade": {"on": True}}, "D": {"retrieval": {"hybrid": True}, "cascade": {"on": True}, "tree": {"on": True}}}


@query(f"""WITH {ANSWERS}, v(experiment, setting, value) AS (VALUES ('A', 'retrieval.hybrid', 'false'), ('A', 'retrieval.k', '5'), ('A', 'tree.on', 'false'), ('A', 'cascade.on', 'false'), ('B', 'retrieval.hybrid', 'true'), ('B', 'retrieval.k', '5'), ('B', 'tree.on', 'false'), ('B', 'cascade.on', 'false'),
('C', 'retrieval.hybrid', 'true'), ('C', 'retrieval.k', '5'), ('C', 'tree.on', 'false'), ('C', 'cascade.on', 'true'), ('D', 'retrieval.hybrid', 'true'), ('D', 'retrieval.k', '5'), ('D', 'tree.on', 'true'), ('D', 'cascade.on', 'true')),
k AS (SELECT question_id, dataset, chr((65 + question_id % 4)::INT) AS experiment FROM qa)
SELECT dataset, experiment, setting, value, count(*) AS questions FROM k JOIN v USING (experiment) GROUP BY ALL""")
def ablation_grid(spark, d):
    """Which settings each data set's questions run with: an experiment's own laid over the base."""
    rows = [(name, f"{part}.{k}", str(v).lower()) for name, over in _GRID.items() for part, held in merged(_BASE, over).items() for k, v in held.items()]
    grid = spark.createDataFrame(rows, "experiment string, setting string, value string")
    asked = answers(spark, d).groupBy("dataset", F.char(65 + F.col("question_id") % 4).alias("experiment")).agg(F.count(F.lit(1)).alias("questions"))
    return asked.join(F.broadcast(grid), "experiment").select("dataset", "experiment", "setting", "value", "questions")  # a fixed few rows


@query(f"WITH {ANSWERS}, n AS (SELECT action, count(*) AS c FROM qa GROUP BY action) SELECT action, c AS n, round((SELECT sum(c) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * c), 6) AS weight FROM n")
def class_weights(spark, d):
    """Weights of training rows that make classes count alike."""
    n = answers(spark, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")))  # one row
    return n.crossJoin(total).select("action", "n", F.round(F.col("rows") / (F.col("classes") * F.col("n")), 6).alias("weight"))


@query(f"WITH {ANSWERS} SELECT question_id, CASE conv_id % 3 WHEN 2 THEN '' ELSE prediction END AS prediction FROM qa")
def prediction_coercion(spark, d):
    """Predictions that are lists count by their first; an empty list is the empty answer."""
    p = F.when(F.col("conv_id") % 3 == 0, F.array("prediction")).when(F.col("conv_id") % 3 == 1, F.array("prediction", "gold")).otherwise(F.array().cast("array<string>"))
    return answers(spark, d).select("question_id", T.first_prediction(p).alias("prediction"))


_NORM_IN = f"contains(regexp_replace(lower(trim(reply)), ' +', ' ', 'g'), regexp_replace(lower(trim(g)), ' +', ' ', 'g')) OR contains({sql_norm('reply')}, {sql_norm('g')})"


@query(f"""WITH {ANSWERS}, x AS (SELECT question_id, reply, unnest([gold, question, 'The ' || prediction || '!']) AS g FROM qa)
SELECT count(DISTINCT question_id) AS questions, round(avg(r), 6) AS recall FROM (SELECT question_id, avg(CAST({_NORM_IN} AS INT)) AS r FROM x GROUP BY question_id)""")
def support_recall_both_ways(spark, d):
    """The share of several gold answers that a retrieved text holds, as it stands or normalised."""
    golds = F.array("gold", "question", F.concat(F.lit("The "), "prediction", F.lit("!")))
    r = F.size(F.filter(golds, lambda g: T.supported(F.col("reply"), g))) / F.size(golds)
    return answers(spark, d).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(r), 6).alias("recall"))


@query(f"""WITH {FACTS} SELECT s.subject AS state_id, '["' || g.object || '"]' AS answer FROM facts s JOIN facts g ON g.predicate = 'in_region' AND g.subject = s.object WHERE s.predicate = 'supplies_from'""")
def execution_participant(spark, d):
    """A participant of the inference graph that runs a question's steps."""
    q = t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("question")).withColumn("question_id", F.col("question"))
    facts = K.fact_base(spark, d)
    run = A.execute_steps([Step("select", "supplies_from($1, ?)"), Step("project_values_flat", "in_region(#1, ?)")], {"kb": kb_model(facts), "math": math_model()}, A.END)
    return run(A.started(q, "execute")).select("state_id", "answer")


@query(f"WITH {ANSWERS} SELECT question_id, 'by ' || action AS result FROM qa WHERE action IN ('Z', 'M')")
def router_dispatch(spark, d):
    """Questions by their action to its strategy; Unknown and actions without one have no result."""
    a = answers(spark, d).select("question_id", F.when(F.col("action") == "S-Dense", "Unknown").otherwise(F.col("action")).alias("action"))
    of = lambda name: lambda rows: rows.select("question_id", F.lit(f"by {name}").alias("result"))
    return A.dispatched(a, "action", {"Z": of("Z"), "M": of("M"), "Unknown": of("Unknown")})


@query(f"""WITH {ANSWERS}, b AS (SELECT action, list_distinct({sql_answer_tokens('gold')}) AS g, list_distinct({sql_answer_tokens('prediction')}) AS p FROM qa)
SELECT action, round(avg(CASE WHEN len(g) + len(p) = 0 THEN 1 WHEN len(list_intersect(g, p)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(g, p)) / (len(g) + len(p)) END), 6) AS f1 FROM b GROUP BY action""")
def drop_f1_by_type(spark, d):
    """Mean F1 of token bags by type of question."""
    a = answers(spark, d).select("action", S.bag_f1(T.answer_tokens(F.col("gold")), T.answer_tokens(F.col("prediction"))).alias("f1"))
    return a.groupBy("action").agg(F.round(F.avg("f1"), 6).alias("f1"))


@query("SELECT user_id, count(*) AS n, round(sum(value) / count(*), 4) AS mean, max(value) AS top FROM events GROUP BY user_id")
def accumulated_metric(spark, d):
    """A metric with a state of its own, updated by batches and merged: mean and largest value of each user's events."""
    from ravelin.operators.reports import MeanAndTop, accumulated

    out = accumulated(t(spark, d, "events"), ["user_id"], ["value"], MeanAndTop())
    return out.select("user_id", F.col("n").cast("long").alias("n"), F.round("mean", 4).alias("mean"), "top")
