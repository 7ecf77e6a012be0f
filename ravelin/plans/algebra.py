"""Queries over query analysis, the fact base and its algebra."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.operators import facts as K
from ravelin.plans.base import query, t

FACTS = """facts AS (
  SELECT 'placed_by' AS predicate, 'o' || o_orderkey AS subject, 'c' || o_custkey AS object FROM orders UNION ALL SELECT 'lives_in', 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'in_region', 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'supplies_from', 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""

_Q = "CASE item_id % 6 WHEN 0 THEN 'How does ' WHEN 1 THEN 'Who is ' WHEN 2 THEN 'what is the name of the place of ' WHEN 3 THEN 'Explain the effect of \"' WHEN 4 THEN 'Compare 1998 and ' ELSE 'So ' END"
Q_SPARK = Q_SQL = f"{_Q} || text"
_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


def asked(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.expr(Q_SPARK).alias("q"))


ASKED = f"""aq AS (SELECT item_id, {Q_SQL} AS q FROM benchmark),
raw_e AS (SELECT item_id, q, list_concat(list_concat(regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all(q, '([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1)), regexp_extract_all(q, '([12][0-9]{{3}})', 1)) AS es FROM aq),
en AS (SELECT item_id, q, list_filter(es, lambda x, i: list_position(es, x) = i) AS es FROM raw_e)"""


@query(f"WITH {ASKED} SELECT item_id, array_to_string(es, '|') AS entities, len(es) AS n FROM en")
def query_entities(spark, d):
    e = T.entities(F.col("q"))
    return asked(spark, d).select("item_id", F.array_join(e, "|").alias("entities"), F.size(e).cast("long").alias("n"))


_TOTAL = f"coalesce(list_sum(list_transform(es, lambda e: len({_WORDS.format('e')}))), 0)"
_LEX = f"least(0.7 * least({_TOTAL}::DOUBLE / greatest(len({_WORDS.format('q')}), 1), 1) + 0.3 * least(CASE WHEN len(es) = 0 THEN 0 ELSE {_TOTAL}::DOUBLE / len(es) END / 3, 1), 1)"


@query(f"WITH {ASKED} SELECT item_id, round(CASE WHEN len({_WORDS.format('q')}) = 0 THEN 0.5 ELSE {_LEX} END, 6) AS lexical FROM en")
def lexical_specificity(spark, d):
    return asked(spark, d).select("item_id", F.round(T.lexical_specificity(F.col("q")), 6).alias("lexical"))


def _count(keys):
    return f"len(list_intersect({_WORDS.format('lower(q)')}, [{', '.join(repr(k) for k in keys)}]))"


def _holds(phrases):
    return "(" + " OR ".join(f"contains(lower(q), '{p}')" for p in phrases) + ")"


_A, _C = _count(T.ABSTRACT), _count(T.CONCRETE)
_SEM = f"""CASE WHEN {_A} + {_C} > 0 THEN CASE WHEN {_holds(T.BOOSTED_PHRASES)} THEN least({_A}::DOUBLE / ({_A} + {_C}) + 0.2, 1) ELSE {_A}::DOUBLE / ({_A} + {_C}) END
  WHEN {_holds(T.ABSTRACT_PHRASES)} THEN 0.8 WHEN {_holds(T.CONCRETE_PHRASES)} THEN 0.2 ELSE 0.5 END"""


@query(f"WITH {ASKED} SELECT item_id, round({_SEM}, 6) AS semantic FROM en")
def semantic_abstractness(spark, d):
    return asked(spark, d).select("item_id", F.round(T.semantic_abstractness(F.col("q")), 6).alias("semantic"))


@query(f"""
WITH {ASKED}, ls AS (SELECT item_id, {_LEX} AS l, {_SEM} AS s FROM en), ex AS (SELECT item_id, exp(2 * l) AS b, exp(l + s) AS p, exp(2 * s) AS h FROM ls)
SELECT item_id, round(b / (b + p + h), 6) AS bm25, round(p / (b + p + h), 6) AS splade, round(h / (b + p + h), 6) AS hnsw,
       CASE WHEN round(b, 9) >= round(p, 9) AND round(b, 9) >= round(h, 9) THEN 'bm25' WHEN round(p, 9) >= round(h, 9) THEN 'splade' ELSE 'hnsw' END AS strategy FROM ex
""")
def dynamic_weights(spark, d):
    w = asked(spark, d).select("item_id", *[v.alias(k) for k, v in T.fusion_weights(T.lexical_specificity(F.col("q")), T.semantic_abstractness(F.col("q"))).items()])
    b, p, h = (F.round(k, 9) for k in ("bm25", "splade", "hnsw"))
    name = F.when((b >= p) & (b >= h), "bm25").when(p >= h, "splade").otherwise("hnsw")
    return w.select("item_id", *[F.round(k, 6).alias(k) for k in ("bm25", "splade", "hnsw")], name.alias("strategy"))


@query(f"""WITH {FACTS} SELECT 'lives_in(?, n3)' AS question, subject AS answer FROM facts WHERE predicate = 'lives_in' AND object = 'n3'
UNION ALL SELECT 'in_region(n3, r9)', CASE WHEN count(*) > 0 THEN 'yes' ELSE 'no' END FROM facts WHERE predicate = 'in_region' AND subject = 'n3' AND object = 'r9'""")
def kb_lookup(spark, d):
    f = K.fact_base(spark, d)
    a = K.lookup(f, "lives_in", "?", "n3").select(F.lit("lives_in(?, n3)").alias("question"), "answer")
    return a.unionByName(K.lookup(f, "in_region", "n3", "r9").select(F.lit("in_region(n3, r9)").alias("question"), "answer"))


@query(f"WITH {FACTS} SELECT a.subject, a.object AS middle, b.object FROM facts a JOIN facts b ON a.object = b.subject WHERE a.predicate = 'placed_by' AND b.predicate = 'lives_in'")
def kb_two_hop(spark, d):
    return K.two_hop(K.fact_base(spark, d), "placed_by", "lives_in")


@query("SELECT a.r_name AS x, b.r_name AS y, c.r_name AS z FROM region a, region b, region c WHERE a.r_name <> b.r_name AND a.r_name <> c.r_name AND b.r_name <> c.r_name")
def distinct_assignments(spark, d):
    """All assignments of three different regions: regions are a fixed handful."""
    r = t(spark, d, "region").select("r_name")
    x, y, z = (F.broadcast(r.withColumnRenamed("r_name", k)) for k in "xyz")
    return x.join(y, F.col("x") != F.col("y")).join(z, (F.col("z") != F.col("x")) & (F.col("z") != F.col("y")))


_BY = "SELECT c_nationkey, list(['c' || c_custkey, c_mktsegment] ORDER BY c_custkey) AS xs FROM customer GROUP BY c_nationkey"


def _pairs(spark, d):
    x = F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment")))
    return t(spark, d, "customer").groupBy("c_nationkey").agg(x.alias("x"))


@query(f"SELECT c_nationkey, array_to_string(flatten(xs), ',') AS flat FROM ({_BY})")
def algebra_flat(spark, d):
    xs = F.transform("x", lambda p: F.array(F.concat(F.lit("c"), p.c_custkey.cast("string")), p.c_mktsegment))
    return _pairs(spark, d).select("c_nationkey", F.array_join(K.apply_suffixes(xs, "project_flat"), ",").alias("flat"))


@query("""SELECT c_nationkey, array_to_string(list(c_mktsegment ORDER BY k), ',') AS "unique" FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY 1, 2) GROUP BY 1""")
def algebra_unique(spark, d):
    return _pairs(spark, d).select("c_nationkey", F.array_join(K.apply_suffixes(F.transform("x", lambda p: p.c_mktsegment), "project_unique"), ",").alias("unique"))


@query("""SELECT c_nationkey, array_to_string(list('c' || c_custkey ORDER BY c_custkey), ',') AS keys, array_to_string(list(c_mktsegment ORDER BY c_custkey), ',') AS "values" FROM customer GROUP BY 1""")
def algebra_keys_values(spark, d):
    kv = F.transform("x", lambda p: F.struct(F.concat(F.lit("c"), p.c_custkey.cast("string")).alias("key"), p.c_mktsegment.alias("value")))
    return _pairs(spark, d).select("c_nationkey", F.array_join(K.apply_suffixes(kv, "project_keys"), ",").alias("keys"), F.array_join(K.apply_suffixes(kv, "project_values"), ",").alias("values"))


@query("""WITH a AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > -900 THEN c_mktsegment END AS ans FROM customer)
SELECT c_nationkey, c_custkey, ans AS answer FROM a WHERE c_nationkey NOT IN (SELECT c_nationkey FROM a WHERE ans IS NULL)""")
def algebra_null_abort(spark, d):
    a = t(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > -900, F.col("c_mktsegment")).alias("answer"))
    return K.aborting(a, "c_nationkey", "answer")


@query(f"""WITH {FACTS} SELECT o_custkey AS qid, 'o' || o_orderkey AS item, f.object AS answer FROM orders LEFT JOIN facts f ON f.predicate = 'placed_by' AND f.subject = 'o' || o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def algebra_project(spark, d):
    items = t(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("qid"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("item"))
    return K.answer_each(items, K.fact_base(spark, d), "placed_by")


@query("SELECT c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def algebra_filter(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.withColumn("a", F.when(F.col("n_regionkey") == 1, "Yes").otherwise("no")).filter(K.is_true(F.col("a"))).select(F.col("c_custkey").alias("item"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_totalprice > 200000 THEN 'yes' ELSE 'no' END AS is_greater, CASE WHEN o_totalprice < 100000 THEN 'yes' ELSE 'no' END AS is_smaller FROM orders")
def math_compare(spark, d):
    a = F.when(F.col("o_orderkey") % 7 == 0, "many").otherwise(F.col("o_totalprice").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", K.compare(a, F.lit("200000")).alias("is_greater"), K.compare(F.col("o_totalprice").cast("string"), F.lit("100000"), False).alias("is_smaller"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - l_quantity), 3) AS diff FROM lineitem")
def math_diff(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", K.difference(F.col("l_extendedprice"), F.col("l_quantity")).alias("diff"))


@query("SELECT l_orderkey, count(*) AS n, max(l_quantity) AS top, min(l_quantity) AS low, max(CASE WHEN l_quantity = 10 THEN 'yes' ELSE 'no' END) AS has_ten FROM lineitem GROUP BY l_orderkey")
def math_list_agg(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return x.select("l_orderkey", F.size("q").cast("long").alias("n"), F.array_max("q").alias("top"), F.array_min("q").alias("low"), F.when(F.array_contains("q", 10.0), "yes").otherwise("no").alias("has_ten"))


_DATES = "date_diff('day', b, a) AS days, (year(a) - year(b)) * 12 + month(a) - month(b) AS months, year(a) - year(b) AS years"


@query(f"SELECT o_orderkey, {_DATES} FROM (SELECT o_orderkey, o_orderdate::DATE AS a, DATE '1995-06-17' AS b FROM orders)")
def date_difference(spark, d):
    a = F.col("o_orderdate").cast("date").cast("string")
    return t(spark, d, "orders").select("o_orderkey", *[K.date_difference(a, F.lit("June 17, 1995"), u).cast("long").alias(u) for u in ("days", "months", "years")])


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate::DATE AS o FROM orders),
y AS (SELECT o_orderkey, k, CASE WHEN k = 0 THEN o WHEN k = 1 THEN date_trunc('month', o)::DATE WHEN k = 2 THEN make_date(1995, month(o), least(day(o), 28)) WHEN k = 3 THEN make_date(year(o), 1, 1) END AS a, month(o) AS m FROM x)
SELECT o_orderkey, CASE WHEN k = 2 AND m = 1 THEN NULL ELSE date_diff('day', DATE '1995-06-17', a) END AS days, CASE WHEN k = 2 AND m = 1 THEN NULL ELSE (year(a) - 1995) * 12 + month(a) - 6 END AS months,
CASE WHEN k = 2 AND m = 1 THEN NULL ELSE year(a) - 1995 END AS years FROM y""")
def partial_date_difference(spark, d):
    """Dates in full, without a day, without a year, as a year alone, and no date: a missing year is borrowed, January
    without a year can't be used."""
    o, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 5
    short = F.concat(F.date_format(o, "MMMM "), F.least(F.dayofmonth(o), F.lit(28)).cast("string"))
    a = F.when(k == 0, F.date_format(o, "d MMM yyyy")).when(k == 1, F.date_format(o, "MMMM yyyy")).when(k == 2, short).when(k == 3, F.date_format(o, "yyyy")).otherwise("sometime")
    return t(spark, d, "orders").select("o_orderkey", *[K.date_difference(a, F.lit("1995-06-17"), u).cast("long").alias(u) for u in ("days", "months", "years")])


@query("""WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate::DATE AS o FROM orders), y AS (SELECT o_orderkey, CASE k WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN year(o) % 4 = 0 THEN make_date(year(o), 2, 29) END ELSE o END AS a,
CASE WHEN k = 1 AND day(o) < 13 THEN make_date(year(o), day(o), month(o)) ELSE a END AS b FROM x, LATERAL (SELECT CASE k WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN year(o) % 4 = 0 THEN make_date(year(o), 2, 29) END ELSE o END AS a) z)
SELECT o_orderkey, date_diff('day', DATE '1995-06-17', b) AS days, (year(b) - 1995) * 12 + month(b) - 6 AS months, year(b) - 1995 AS years FROM y""")
def date_forms(spark, d):
    """Dates in numbers, month first, day first (told only by a day over 12) and year first, and days that the calendar
    doesn't have: June 31, and February 29 but for leap years."""
    o, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    a = F.when(k == 0, F.date_format(o, "MM/dd/yyyy")).when(k == 1, F.date_format(o, "dd/MM/yyyy")).when(k == 2, F.date_format(o, "yyyy/MM/dd")).when(k == 3, F.date_format(o, "'June 31', yyyy")).when(k == 4, F.date_format(o, "'February 29', yyyy"))
    a = a.otherwise(F.date_format(o, "M-d-yy"))
    return t(spark, d, "orders").select("o_orderkey", *[K.date_difference(a, F.lit("June 17, 1995"), u).cast("long").alias(u) for u in ("days", "months", "years")])


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_size")
def sorted_distinct_values(spark, d):
    return K.sorted_distinct(t(spark, d, "part").select("p_brand", "p_size", "p_partkey"), "p_partkey", "p_size", ["p_brand"])


@query(f"WITH {FACTS} SELECT subject || ' is home to ' || object || '.' AS sentence FROM facts WHERE predicate = 'lives_in'")
def kb_verbalize(spark, d):
    f = K.fact_base(spark, d).filter("predicate = 'lives_in'")
    return f.select(K.verbalize("$1 is home to $2.", F.col("subject"), F.col("object")).alias("sentence"))


@query("SELECT 'next' AS predicate, n_name AS subject, lead(n_name) OVER (ORDER BY n_nationkey) AS object FROM nation QUALIFY object IS NOT NULL")
def kb_chain(spark, d):
    return K.chain_facts(t(spark, d, "nation"), "next", "n_nationkey", "n_name")


@query("""WITH RECURSIVE tr AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, tr.depth + 1 FROM nation n JOIN tr ON (n.n_nationkey - 1) // 2 = tr.k AND n.n_nationkey > 0)
SELECT k AS n_nationkey, depth FROM tr""")
def kb_tree_depth(spark, d):
    t(spark, d, "nation").createOrReplaceTempView("ravelin_nation")
    return spark.sql("""WITH RECURSIVE tr AS (SELECT n_nationkey AS k, 0 AS depth FROM ravelin_nation WHERE n_nationkey = 0
        UNION ALL SELECT n.n_nationkey, tr.depth + 1 FROM ravelin_nation n JOIN tr ON floor((n.n_nationkey - 1) / 2) = tr.k AND n.n_nationkey > 0) SELECT k AS n_nationkey, depth FROM tr""")


@query(f"""WITH {FACTS}, two AS (SELECT a.subject AS r, list(DISTINCT b.subject ORDER BY b.subject) AS xs FROM (SELECT object AS subject, subject AS n FROM facts WHERE predicate = 'in_region') a
  JOIN facts b ON b.object = a.n AND b.predicate = 'supplies_from' GROUP BY a.subject, a.n)
SELECT r AS region, len(xs) AS n, array_to_string(xs, ',') AS answers FROM two WHERE len(xs) BETWEEN 1 AND 5""")
def theory_questions(spark, d):
    """Which suppliers come from a nation of the region? Questions with one to five answers are kept."""
    f = K.fact_base(spark, d)
    a = f.filter("predicate = 'in_region'").select(F.col("object").alias("region"), F.col("subject").alias("n"))
    b = f.filter("predicate = 'supplies_from'").select(F.col("subject").alias("s"), F.col("object").alias("m"))
    got = a.join(b, F.col("n") == F.col("m")).groupBy("region", "n").agg(F.array_sort(F.collect_set("s")).alias("xs"))
    return got.filter(F.size("xs").between(1, 5)).select("region", F.size("xs").cast("long").alias("n"), F.array_join("xs", ",").alias("answers"))


@query("SELECT o_orderkey, try_cast(replace(replace(trim(string_split(x, '####')[2]), '$', ''), ',', '') AS DOUBLE) AS answer FROM (SELECT o_orderkey, 'work #### $' || (o_custkey // 1000) || ',' || lpad((o_custkey % 1000)::VARCHAR, 3, '0') || '.5' AS x FROM orders)")
def final_answer_number(spark, d):
    x = F.expr("'work #### $' || (o_custkey div 1000) || ',' || lpad(cast(o_custkey % 1000 as string), 3, '0') || '.5'")
    got = F.regexp_replace(F.trim(F.substring_index(x, "####", -1)), "[$,]", "")
    return t(spark, d, "orders").select("o_orderkey", got.try_cast("double").alias("answer"))


@query("SELECT p_partkey, 'made' AS name, p_brand AS first_arg, CASE WHEN p_partkey % 2 = 0 THEN p_type || ', x' ELSE p_type END AS second_arg FROM part")
def predicate_parse(spark, d):
    x = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("made("), "p_brand", F.lit(" | "), "p_type", F.lit(", x)"))).otherwise(F.concat(F.lit("made("), "p_brand", F.lit(", "), "p_type", F.lit(")")))
    got = K.parse_predicate(x)
    return t(spark, d, "part").select("p_partkey", got["name"].alias("name"), F.get(got["args"], F.lit(0)).alias("first_arg"), F.get(got["args"], F.lit(1)).alias("second_arg"))


@query("SELECT c_custkey, 'c' || c_custkey AS subject, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer")
def kb_relation_pairing(spark, d):
    w = W.partitionBy("c_nationkey").orderBy("c_custkey")
    return t(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subject"), F.row_number().over(w).cast("long").alias("place"))
