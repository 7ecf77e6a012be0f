"""Queries over variants of operators: further metrics, encodings, selections and report helpers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.scoring import bag_f1
from ravelin.functions.text import answer_tokens, normalize_answer, plain_words
from ravelin.functions.text import first_sentence as first_sentence_of
from ravelin.operators import retrieval as R
from ravelin.operators import sampling as M
from ravelin.operators.models import generated
from ravelin.operators.order import placed
from ravelin.plans.base import ANSWERS, answers, query, sql_answer_tokens, sql_norm, t
from ravelin.plans.retrieval import BM25, hits
from ravelin.plans.scores import _sql_bag

_GB, _PB = sql_answer_tokens("gold || ' ' || (conv_id % 4)"), sql_answer_tokens("prediction || ' ' || (conv_id % 3)")
_NUM = "list_filter({}, lambda x: try_cast(x AS DOUBLE) IS NOT NULL)"


@query(f"""WITH {ANSWERS}, b AS (SELECT question_id, list_distinct({_GB}) AS g, list_distinct({_PB}) AS p FROM qa)
SELECT question_id, CAST(list_sort(g) = list_sort(p) AS INT) AS em, round(CASE WHEN len({_NUM.format('g')}) > 0 AND len(list_intersect({_NUM.format('g')}, {_NUM.format('p')})) = 0 THEN 0.0 ELSE {_sql_bag('g', 'p')} END, 6) AS f1 FROM b""")
def drop_em_f1(spark, d):
    """Exact match of bags, and their F1 where the numbers of the gold bag, if it has any, are met by one."""
    with_number = lambda c, k: F.array_distinct(answer_tokens(F.concat(c, F.lit(" "), (F.col("conv_id") % k).cast("string"))))
    b = answers(spark, d).select("question_id", with_number(F.col("gold"), 4).alias("g"), with_number(F.col("prediction"), 3).alias("p"))
    numbers = lambda c: F.filter(c, lambda x: x.try_cast("double").isNotNull())
    unmet = (F.size(numbers("g")) > 0) & ~F.arrays_overlap(numbers("g"), numbers("p"))
    return b.select("question_id", (F.array_sort("g") == F.array_sort("p")).cast("int").alias("em"), F.round(F.when(unmet, 0.0).otherwise(bag_f1(F.col("g"), F.col("p"))), 6).alias("f1"))


@query(f"WITH {ANSWERS} SELECT action AS type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, round(avg(CAST({sql_norm('gold')} = {sql_norm('prediction')} AS INT)), 6) AS em FROM qa GROUP BY action")
def drop_by_type(spark, d):
    x = answers(spark, d).groupBy(F.col("action").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((normalize_answer(F.col("gold")) == normalize_answer(F.col("prediction"))).cast("int")), 6).alias("em"))
    total = F.broadcast(x.agg(F.sum("n").alias("total")))  # one row
    return x.crossJoin(total).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("share"), "em")


@query(f"WITH {BM25} SELECT h.query_id, h.doc_id, round(score + 0.75 * CAST(d.source = 'src' || (h.query_id % 20) AS INT), 6) AS score FROM hits h JOIN documents d USING (doc_id)")
def bm25_title_should(spark, d):
    """A title that matches adds to the score and excludes nothing."""
    h = hits(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    same = (F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).cast("int")
    return h.select("query_id", "doc_id", F.round(F.col("score") + 0.75 * same, 6).alias("score"))


@query(f"WITH {BM25} SELECT h.query_id, h.doc_id, h.rank FROM hits h JOIN documents d USING (doc_id) WHERE d.source = 'src' || (h.query_id % 20)")
def title_must_filter(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return h.filter(F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).select("query_id", "doc_id", "rank")


_PLAN = "lower(left(p_type, 8)) || ' -> ' || lower(p_name) || ' -> ' || lower(p_brand) || ' -> x'"


@query(f"""WITH c AS (SELECT p_partkey, 1 AS kind, pos, trim(part) AS q FROM (SELECT p_partkey, unnest(string_split({_PLAN}, '->')) AS part, generate_subscripts(string_split({_PLAN}, '->'), 1) AS pos FROM part) WHERE length(trim(part)) >= 2
UNION ALL SELECT p_partkey, 2, pos, lower(p_brand || ' ' || w) FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part) WHERE length(w) > 3 AND pos <= 3),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey, q ORDER BY kind, pos) = 1)
SELECT p_partkey, q, row_number() OVER (PARTITION BY p_partkey ORDER BY kind, pos) AS place FROM o QUALIFY place <= 4""")
def candidate_queries(spark, d):
    """Queries for the next hop: the plan's parts, then entity and keyword pairs; distinct, the first four."""
    p = t(spark, d, "part")
    parts = p.select("p_partkey", F.posexplode(F.split(F.expr(_PLAN), "->")).alias("pos", "part")).select("p_partkey", F.lit(1).alias("kind"), "pos", F.trim("part").alias("q")).filter(F.length("q") >= 2)
    combos = p.select("p_partkey", "p_brand", F.posexplode(F.split("p_name", " ")).alias("pos", "w")).filter((F.length("w") > 3) & (F.col("pos") < 3)).select("p_partkey", F.lit(2).alias("kind"), "pos", F.lower(F.concat("p_brand", F.lit(" "), "w")).alias("q"))
    first = W.partitionBy("p_partkey", "q").orderBy("kind", "pos")
    one = parts.unionByName(combos).withColumn("n", F.row_number().over(first)).filter("n = 1")
    place = W.partitionBy("p_partkey").orderBy("kind", "pos")
    return one.withColumn("place", F.row_number().over(place)).filter("place <= 4").select("p_partkey", "q", F.col("place").cast("long").alias("place"))


@query("SELECT event_id, 'reply to ' || event_type AS reply FROM events")
def memoised_generation(spark, d):
    """A stand-in generator, called once for each distinct prompt."""
    e = t(spark, d, "events").select("event_id", "event_type")
    return generated(e, "event_type", "reply", lambda prompts: [f"reply to {p}" for p in prompts]).select("event_id", "reply")


@query("""WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY source), m AS (SELECT min(c) AS k FROM n)
SELECT source, doc_id FROM documents, m QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id)) <= k""")
def equalised_subsample(spark, d):
    """As many rows of each group as the smallest has."""
    x = t(spark, d, "documents").select("source", "doc_id")
    least = x.groupBy("source").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c")).first()[0] or 0
    return M.subsampled(x, "source", "doc_id", max(2, least)).select("source", "doc_id")


@query("SELECT o_orderkey, CASE WHEN u < 0.5 THEN 'simple' WHEN u < 0.8 THEN 'chain' ELSE 'tree' END AS config FROM (SELECT o_orderkey, ('0x' || substr(md5('cfg|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 AS u FROM orders)")
def weighted_choice(spark, d):
    u = M.fraction(F.col("o_orderkey"), "cfg")
    return t(spark, d, "orders").select("o_orderkey", F.when(u < 0.5, "simple").when(u < 0.8, "chain").otherwise("tree").alias("config"))


@query("SELECT DISTINCT doc_id, source AS title FROM documents")
def support_pid_titles(spark, d):
    """Titles out of pids "pid___title___para"."""
    pid = F.concat_ws("___", F.col("doc_id").cast("string"), "source", "text")
    return t(spark, d, "documents").select("doc_id", F.get(F.split(pid, "___"), F.lit(1)).alias("title")).distinct()


@query(f"""SELECT s.source, coalesce(title, '') AS title, coalesce(para, '') AS para FROM (SELECT source, unnest(list_zip(titles, paras[1:2])) AS z, z[1] AS title, z[2] AS para FROM
(SELECT source, list(lang ORDER BY doc_id) AS titles, list(text ORDER BY doc_id) AS paras FROM documents GROUP BY source)) s""")
def context_encodings(spark, d):
    """Parallel lists of titles and paragraphs of unequal length as rows: a source has a title for each document and a
    paragraph for its first two; what is missing is empty."""
    x = t(spark, d, "documents").select("doc_id", "source", "lang", "text")
    first = x.select("source", F.col("doc_id").alias("p_id"), F.col("text").alias("p")).withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("p_id"))).filter("n <= 2")  # the rank limit holds before the shuffle
    both = x.join(first.select("p_id", "p"), F.col("doc_id") == F.col("p_id"), "left")
    return both.select("source", F.coalesce("lang", F.lit("")).alias("title"), F.coalesce("p", F.lit("")).alias("para"))


@query("SELECT item_id, pos FROM benchmark JOIN (VALUES (7, 0), (3, 1), (11, 2), (900, 3)) v(k, pos) ON item_id = k")
def prompt_key_order(spark, d):
    """Prompt examples of a list of keys, by their place in it."""
    keys = spark.createDataFrame([(k, i) for i, k in enumerate((7, 3, 11, 900))], "k long, pos int")
    return t(spark, d, "benchmark").join(F.broadcast(keys), F.col("item_id") == F.col("k")).select("item_id", "pos")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS success, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS skipped FROM orders")
def status_tally(spark, d):
    s = F.col("o_orderstatus")
    return t(spark, d, "orders").agg(F.count_if(s == "F").alias("success"), F.count_if(s == "O").alias("failed"), F.count_if(~s.isin("F", "O")).alias("skipped"))


_A = "b.text"


@query(f"""WITH {BM25} SELECT h.query_id, h.rank, contains(lower(d.text), lower({_A})) OR contains({sql_norm('d.text')}, {sql_norm(_A)}) OR (len({sql_answer_tokens(_A)}) > 1 AND len(list_filter({sql_answer_tokens(_A)}, lambda x: NOT list_contains({sql_answer_tokens('d.text')}, x))) = 0) AS found
FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id WHERE rank <= 5""")
def answer_in_context(spark, d):
    """An answer as it stands, without punctuation, or by all of its words."""
    gold = R.bounded(t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("a")))
    h = hits(spark, d, 5).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").join(gold, "query_id")
    words = answer_tokens(F.col("a"))
    every = (F.size(words) > 1) & (F.size(F.array_except(words, answer_tokens(F.col("text")))) == 0)
    return h.select("query_id", "rank", (F.contains(F.lower("text"), F.lower("a")) | F.contains(normalize_answer(F.col("text")), normalize_answer(F.col("a"))) | every).alias("found"))


@query("SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?])\\s', 1), ''), text) AS sentence FROM documents")
def first_sentence(spark, d):
    return t(spark, d, "documents").select("doc_id", first_sentence_of(F.col("text")).alias("sentence"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS plain FROM documents")
def diagnosis_normalize(spark, d):
    """Whole texts in lower case with letters, digits and underscores of any script, single spaces between."""
    return t(spark, d, "documents").select("doc_id", F.md5(plain_words(F.coalesce("text", F.lit(""))).cast("binary")).alias("plain"))


@query("SELECT p_partkey, line FROM (SELECT p_partkey, list_filter(['plan: first', 'let us think -> so', p_type || ' -> ' || p_brand, 'a -> b'], lambda x: contains(x, '->') AND NOT contains(lower(x), 'let us'))[1] AS line FROM part)")
def plan_line(spark, d):
    """The first line of a plan that has an arrow and no filler."""
    lines = F.array(F.lit("plan: first"), F.lit("let us think -> so"), F.concat("p_type", F.lit(" -> "), "p_brand"), F.lit("a -> b"))
    return t(spark, d, "part").select("p_partkey", F.get(F.filter(lines, lambda x: F.contains(x, F.lit("->")) & ~F.contains(F.lower(x), F.lit("let us"))), F.lit(0)).alias("line"))


@query("SELECT l_orderkey, list_sort(list(l_partkey)) = list_sort(list(CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END)) AS valid FROM lineitem GROUP BY l_orderkey")
def chain_valid(spark, d):
    """Predicted and gold answers are the same in any order."""
    p = F.when(F.col("l_linenumber") == 7, -1).otherwise(F.col("l_partkey"))
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg((F.array_sort(F.collect_list("l_partkey")) == F.array_sort(F.collect_list(p))).alias("valid"))


@query("(SELECT source AS title, 'both' AS side FROM documents WHERE lang = 'en' INTERSECT SELECT source, 'both' FROM documents WHERE lang = 'de') UNION ALL (SELECT source, 'first' FROM documents WHERE lang = 'fr' EXCEPT SELECT source, 'first' FROM documents WHERE lang = 'es' AND length(text) < 500)")
def title_set_ops(spark, d):
    x = t(spark, d, "documents")
    of = lambda c: x.filter(c).select(F.col("source").alias("title"))
    return of("lang = 'en'").intersect(of("lang = 'de'")).withColumn("side", F.lit("both")).unionByName(of("lang = 'fr'").subtract(of("lang = 'es' AND length(text) < 500")).withColumn("side", F.lit("first")))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'L2' WHEN quality = 1 THEN 'L1' ELSE 'L0' END AS complexity, CASE WHEN toxic = 1 THEN 'None' WHEN quality = 1 THEN 'Hybrid' ELSE 'None' END AS index_strategy FROM labels")
def label_mapping(spark, d):
    level = F.when(F.col("toxic") == 1, "L2").when(F.col("quality") == 1, "L1").otherwise("L0")
    return t(spark, d, "labels").select("doc_id", level.alias("complexity"), F.when(level == "L1", "Hybrid").otherwise("None").alias("index_strategy"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM (SELECT DISTINCT doc_id FROM documents)")
def sequential_numbers(spark, d):
    """Numbers in order of the id, from ranges that are numbered side by side."""
    x = placed(t(spark, d, "documents").select("doc_id").distinct(), ["doc_id"])
    return x.select("doc_id", (F.col("place") - 1).alias("number"))


@query("SELECT 'A' AS id, count(*) AS n FROM documents UNION ALL SELECT 'B', count(*) FROM pages")
def source_row_counts(spark, d):
    n = lambda name, i: t(spark, d, name).agg(F.lit(i).alias("id"), F.count(F.lit(1)).alias("n"))
    return n("documents", "A").unionByName(n("pages", "B"))


@query("SELECT item_id, coalesce(nullif(regexp_extract(p, 'Search: *([^\\n]*)', 1), ''), p) AS q, contains(p, 'Search:') AS asked FROM (SELECT item_id, CASE item_id % 2 WHEN 0 THEN 'Search: ' || text ELSE text END AS p FROM benchmark)")
def search_line(spark, d):
    p = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Search: "), "text")).otherwise(F.col("text"))
    got = F.regexp_extract(p, r"Search: *([^\n]*)", 1)
    return t(spark, d, "benchmark").select("item_id", F.when(got == "", p).otherwise(got).alias("q"), F.contains(p, F.lit("Search:")).alias("asked"))
