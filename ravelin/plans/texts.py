"""Queries over the string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans.base import _P, query, sql_norm, sql_words, t

_ARTICLES = "('a', 'an', 'the')"


@query(f"SELECT doc_id, {sql_norm('text')} AS normalized FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normalized"))


@query(f"""
SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(x), '[ -]'),
       lambda w: coalesce(CASE WHEN try_cast(w AS DOUBLE) IS NOT NULL THEN CAST(try_cast(w AS DOUBLE) AS VARCHAR) END,
                          CASE WHEN translate(w, '{_P}', '') IN {_ARTICLES} THEN '' ELSE translate(w, '{_P}', '') END)),
       lambda w: w <> ''), ' ') AS normalized
FROM (SELECT p_partkey, 'The ' || p_name || ', ' || p_size || ' pcs-' || p_brand || ' a ' || (p_size % 10) || '.50' AS x FROM part)
""")
def drop_normalize(spark, d):
    x = F.concat(F.lit("The "), "p_name", F.lit(", "), F.col("p_size").cast("string"), F.lit(" pcs-"), "p_brand", F.lit(" a "), (F.col("p_size") % 10).cast("string"), F.lit(".50"))
    return t(spark, d, "part").select("p_partkey", T.number_normalize(x).alias("normalized"))


@query(f"""
SELECT item_id, array_to_string(list_filter(string_split('Which ' || text || ' is where', ' '),
       lambda w: lower(w) NOT IN ('who','what','when','where','why','which','how','does','is')), ' ') AS query FROM benchmark
""")
def remove_wh_words(spark, d):
    x = F.concat(F.lit("Which "), "text", F.lit(" is where"))
    return t(spark, d, "benchmark").select("item_id", T.without_wh_words(x).alias("query"))


_SENTENCE = "CASE doc_id % 4 WHEN 0 THEN 'Therefore, ' WHEN 1 THEN '12 + 3 = 15 ' WHEN 2 THEN 'so ' ELSE '' END || text"


@query(f"""
SELECT doc_id, s AS sentence FROM (SELECT doc_id, {_SENTENCE} AS s FROM documents)
WHERE NOT (regexp_matches(lower(s), '^(thus[ ,]|so[ ,]|that is,|therefore|hence)') OR regexp_matches(s, '(\\d[\\d,]*\\.?\\d+|\\d+) [+-] (\\d[\\d,]*\\.?\\d+|\\d+) = (\\d[\\d,]*\\.?\\d+|\\d+)'))
""")
def reasoning_sentence_filter(spark, d):
    s = t(spark, d, "documents").select("doc_id", F.expr(_SENTENCE).alias("sentence"))
    return s.filter(~T.is_reasoning(F.col("sentence")))


def _sql_clean(x):
    out = f"lower(trim(trim({x}), '\"''[]'))"
    for p in T.QUERY_FILLERS:
        out = f"replace({out}, '{p}', ' ')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_RAW = "CASE item_id % 3 WHEN 0 THEN '\"I need to find ' WHEN 1 THEN '[tell me who is ' ELSE 'what is ' END || CASE WHEN item_id % 3 = 2 THEN '' ELSE text END"


@query(f"SELECT item_id, CASE WHEN length(c) < 2 THEN lower(trim(q)) ELSE c END AS query FROM (SELECT item_id, q, {_sql_clean('q')} AS c FROM (SELECT item_id, {_RAW} AS q FROM benchmark))")
def clean_query(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.clean_query(F.expr(_RAW)).alias("query"))


_AGENT = "'Thought: ' || replace(text, chr(10), ' ') || chr(10) || 'Action: ' || CASE conv_id % 7 WHEN 0 THEN 'Z' WHEN 1 THEN 'S-Sparse' WHEN 2 THEN 's-dense now' WHEN 3 THEN 'use S-Hybrid' WHEN 4 THEN 'M' WHEN 5 THEN 'none' ELSE 'go' END || chr(10) || 'Search: ' || replace(substr(text, 5), chr(10), ' ') || chr(10) || CASE WHEN conv_id % 7 = 6 THEN 'then S-Dense' ELSE 'Answer: ' || text END"
_RAW_AGENT = f"SELECT conv_id, turn, {_AGENT} AS s FROM conversations"


def _agent(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.expr(_AGENT).alias("s"))


@query(f"SELECT conv_id, turn, CASE WHEN contains(s, 'Action:') THEN regexp_extract(s, '(?s)^(.*?Action:[^\\n]*)', 1) ELSE s END AS kept FROM ({_RAW_AGENT})")
def truncate_at_action(spark, d):
    return _agent(spark, d).select("conv_id", "turn", T.until_action(F.col("s")).alias("kept"))


_EVIDENCE = "CASE turn % 4 WHEN 0 THEN 'No information here' WHEN 1 THEN 'No mention of it, but ' || text WHEN 2 THEN text ELSE 'It is unknown' END"


@query(f"""
SELECT conv_id, turn, (conv_id % 5) > 0 AND NOT (({' OR '.join(f"contains(s, '{p.replace(chr(39), chr(39) * 2)}')" for p in T.REFUSALS)})
       AND NOT (contains(s, 'but') OR contains(s, 'however'))) AS supported
FROM (SELECT conv_id, turn, lower({_EVIDENCE}) AS s FROM conversations)
""")
def evidence_check(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.evidence_supports(F.expr(_EVIDENCE), F.col("conv_id") % 5).alias("supported"))


@query(f"""
SELECT conv_id, turn, regexp_extract(s, 'Thought: *([^\\n]*)', 1) AS thought, regexp_extract(s, 'Action: *([^\\n]*)', 1) AS action_text,
       regexp_extract(s, 'Search: *([^\\n]*)', 1) AS search, regexp_extract(s, 'Answer: *([^\\n]*)', 1) AS answer FROM ({_RAW_AGENT})
""")
def parse_agent_output(spark, d):
    got = [F.regexp_extract("s", rf"{k}: *([^\n]*)", 1).alias(n) for k, n in (("Thought", "thought"), ("Action", "action_text"), ("Search", "search"), ("Answer", "answer"))]
    return _agent(spark, d).select("conv_id", "turn", *got)


def _sql_named(x):
    return "coalesce(" + ", ".join(f"CASE WHEN contains({x}, '{a}') THEN '{a}' END" for a in T.ACTIONS) + ")"


_NAMED = "regexp_extract(s, 'Action:\\s*([A-Za-z0-9\\-]+)', 1)"
_PARSED = f"coalesce(CASE WHEN {_NAMED} IN ('Z', 'S-Sparse', 'S-Dense', 'S-Hybrid', 'M') THEN {_NAMED} END, {_sql_named("regexp_extract(trim(s), '([^' || chr(10) || ']*)$', 1)")}, {_sql_named('s')}, 'Unknown')"


@query(f"SELECT conv_id, turn, {_PARSED} AS action FROM ({_RAW_AGENT})")
def parse_action(spark, d):
    return _agent(spark, d).select("conv_id", "turn", T.parse_action(F.col("s")).alias("action"))


@query(f"SELECT conv_id, turn, CASE WHEN a LIKE 'S-%' THEN 'S' WHEN a = 'Unknown' THEN 'S' ELSE a END AS action FROM (SELECT conv_id, turn, {_PARSED} AS a FROM ({_RAW_AGENT}))")
def parse_action_coarse(spark, d):
    a = T.parse_action(F.col("s"))
    return _agent(spark, d).select("conv_id", "turn", F.when(a == "Unknown", "S").otherwise(T.coarse(a)).alias("action"))


@query("""
SELECT event_id, CASE WHEN c = 'L0' THEN 'Z' WHEN c = 'L2' THEN 'M' WHEN i = 'Lexical' THEN 'S-Sparse' WHEN i = 'Semantic' THEN 'S-Dense' ELSE 'S-Hybrid' END AS action
FROM (SELECT event_id, 'L' || (event_id % 3) AS c, CASE user_id % 3 WHEN 0 THEN 'Lexical' WHEN 1 THEN 'Semantic' END AS i FROM events)
""")
def hybrid_rule(spark, d):
    c = F.concat(F.lit("L"), (F.col("event_id") % 3).cast("string"))
    i = F.when(F.col("user_id") % 3 == 0, "Lexical").when(F.col("user_id") % 3 == 1, "Semantic")
    return t(spark, d, "events").select("event_id", T.hybrid_rule(c, i, F.lit("Unknown")).alias("action"))


@query("""
SELECT event_id, coalesce(j->>'$.text', j->>'$.generated_texts[0]', j->>'$.choices[0].text', j->>'$.choices[0].message.content', '') AS reply
FROM (SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN '{"text":"' || event_type || '"}' WHEN 1 THEN '{"generated_texts":["' || event_type || '","x"]}'
  WHEN 2 THEN '{"choices":[{"text":"' || event_type || '"}]}' WHEN 3 THEN '{"choices":[{"message":{"content":"' || event_type || '"}}]}' ELSE props END AS JSON) AS j FROM events)
""")
def llm_json_text(spark, d):
    j = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"text":"' || event_type || '"}' WHEN 1 THEN '{"generated_texts":["' || event_type || '","x"]}'
        WHEN 2 THEN '{"choices":[{"text":"' || event_type || '"}]}' WHEN 3 THEN '{"choices":[{"message":{"content":"' || event_type || '"}}]}' ELSE props END""")
    return t(spark, d, "events").select("event_id", T.json_text(j).alias("reply"))


_SAID = "CASE item_id % 3 WHEN 0 THEN 'So the answer is: ' || p || '.' WHEN 1 THEN p || '.' ELSE 'The Answer is ' || p END"


@query(f"""
SELECT item_id, CASE WHEN regexp_matches(s, '(?i)^.*answer is:? ?(.+?)\\.?$') THEN regexp_extract(s, '(?i).*answer is:? ?(.*?)\\.?$', 1) ELSE regexp_replace(s, '\\.$', '') END AS answer
FROM (SELECT item_id, {_SAID} AS s FROM (SELECT item_id, replace(replace(text, chr(10), ' '), '.', '') AS p FROM benchmark))
""")
def extract_answer(spark, d):
    p = t(spark, d, "benchmark").select("item_id", F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("."), F.lit("")).alias("p"))
    return p.select("item_id", T.extract_answer(F.expr(_SAID)).alias("answer"))


@query(f"SELECT doc_id, source || ': ' || {sql_words('text', 1, 50)} AS para FROM documents")
def para_to_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.concat("source", F.lit(": "), T.first_words(F.col("text"), 50)).alias("para"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents WHERE len(string_split(text, ' ')) <= 600")
def long_para_filter(spark, d):
    n = F.size(F.split("text", " ")).cast("long")
    return t(spark, d, "documents").select("doc_id", n.alias("n_words")).filter("n_words <= 600")


@query(f"""
SELECT d.doc_id, len(list_intersect(string_split(lower(d.text), ' '), string_split(lower(b.text), ' '))) AS shared
FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
""")
def title_question_overlap(spark, d):
    b = t(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("q"))
    x = t(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    return x.join(b, F.col("doc_id") % b.count() == F.col("item_id")).select("doc_id", F.size(F.array_intersect("w", "q")).cast("long").alias("shared"))


_LIST = "'1. ' || p_name || chr(10) || '2. ' || p_type || chr(10) || chr(10) || '3.  ' || p_name || chr(10) || p_brand"


@query(f"""
SELECT p_partkey, array_to_string(list_filter([x[1], x[2], x[3], CASE WHEN x[4] = x[1] THEN '' ELSE x[4] END, x[5]], lambda w: w <> ''), '|') AS items
FROM (SELECT p_partkey, list_transform(string_split({_LIST}, chr(10)), lambda w: trim(regexp_replace(w, '^ *\\d+\\. *', ''))) AS x FROM part)
""")
def numbered_list_parse(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(T.numbered_list(F.expr(_LIST)), "|").alias("items"))


_QUESTION = "CASE item_id % 9 WHEN 0 THEN 'What ' WHEN 1 THEN 'who ' WHEN 2 THEN 'When ' WHEN 3 THEN 'where ' WHEN 4 THEN 'Why ' WHEN 5 THEN 'how ' WHEN 6 THEN 'Which ' ELSE 'The ' END || text"


@query(f"""
SELECT type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM (
  SELECT coalesce(nullif(regexp_extract(lower(q), '^(what|who|when|where|why|how|which)', 1), ''), 'other') AS type FROM (SELECT {_QUESTION} AS q FROM benchmark)
) GROUP BY type
""")
def question_types(spark, d):
    n = t(spark, d, "benchmark").groupBy(T.question_type(F.expr(_QUESTION)).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(F.broadcast(total)).select("type", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


@query("""
SELECT c_custkey, array_to_string(list_transform(string_split(w, ' '), lambda x: substr(x, 2, 1)), '') AS letters
FROM (SELECT c_custkey, c_name || ' ' || c_mktsegment AS w FROM customer)
""")
def letter_concat(spark, d):
    w = F.split(F.concat("c_name", F.lit(" "), "c_mktsegment"), " ")
    return t(spark, d, "customer").select("c_custkey", F.array_join(F.transform(w, lambda x: F.substring(x, 2, 1)), "").alias("letters"))


@query("SELECT item_id, array_to_string(list_reverse(string_split(text, ' ')), ' ') AS reversed FROM benchmark")
def reverse_sequence(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(F.reverse(F.split("text", " ")), " ").alias("reversed"))
