"""Queries over the participants of an inference graph; generators are deterministic stand-ins."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ravelin.operators import agents as A
from ravelin.operators import retrieval as R
from ravelin.plans.base import query, sql_tokens, sql_words, t
from ravelin.plans.retrieval import BM25, index
from ravelin.storage import written


def _states(spark, d, first="go"):
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.regexp_replace("text", r"\s+", " ").alias("question"))
    return A.started(b, first)


def _asked(prompt):
    """The words of the question that a prompt ends with."""
    return re.search(r"Q: (.*)\nA:[^\n]*$", prompt, re.DOTALL)[1].split(" ")


_Q = "SELECT item_id::VARCHAR AS state_id, regexp_replace(text, '\\s+', ' ', 'g') AS q, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM benchmark"


@query(f"SELECT state_id, 'go' AS next, trim(q) AS answer FROM ({_Q})")
def participant_copy(spark, d):
    """The question as the next one."""
    return A.copy_question("go")(_states(spark, d)).select("state_id", "next", "answer")


@query(f"SELECT state_id, 'map' AS next, CASE WHEN w[1] = w[2] THEN '[\"' || w[1] || '\"]' ELSE '[\"' || w[1] || '\",\"' || w[2] || '\"]' END AS answer FROM ({_Q})")
def participant_titles(spark, d):
    """Titles that a generator names; this one names the question's first two words, one of them twice."""
    name = lambda prompts: [json.dumps([w[0], w[1], w[0]], ensure_ascii=False) for w in map(_asked, prompts)]
    return A.generate_titles(name, "map")(_states(spark, d)).select("state_id", "next", "answer")


_ENDS = "len(w) % 2 = 0"
_BARE = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _bare(word):
    return re.sub(r"\W", "", word)


@query(f"SELECT state_id, CASE WHEN {_ENDS} THEN '[EOQ]' ELSE 'go' END AS next, CASE WHEN {_ENDS} THEN {_BARE.format('w[1]')} ELSE {_BARE.format('w[2]')} || ' comes next.' END AS answer FROM ({_Q})")
def participant_step(spark, d):
    """A sentence of reasoning; half of the questions end with an answer."""
    say = lambda prompts: [f"So the answer is: {_bare(w[0])}. Done." if len(w) % 2 == 0 else f"{_bare(w[1])} comes next. And more." for w in map(_asked, prompts)]
    return A.step_by_step(say, "go", pattern=r"answer is: (.*)\.$")(_states(spark, d)).select("state_id", "next", "answer")


@query(f"SELECT state_id, CASE WHEN w[1] = w[3] THEN '[\"' || w[1] || '\"]' ELSE '[\"' || w[1] || '\",\"' || w[3] || '\"]' END AS answer FROM ({_Q})")
def participant_answer(spark, d):
    """A numbered list of answers as its distinct items."""
    say = lambda prompts: [f"1. {w[0]}\n2. {w[2]}\n3. {w[0]}" for w in map(_asked, prompts)]
    return A.answer_question(say, A.END, listed=True)(_states(spark, d)).select("state_id", "answer")


def _retrieve(spark, d, k=10):
    held, docs = index(spark, d), t(spark, d, "documents").select("doc_id", F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("paragraph_text"))

    def of(asks):
        # the hits are few, so texts aren't shuffled to meet them
        best = R.bounded(written(R.lexical(held, R.query_terms(asks, F.col("q")), k), "hits"))
        return best.join(docs, "doc_id").select("query_id", "title", "paragraph_text", "score")

    return of


@query()
def participant_retrieve(spark, d):
    """What a state holds after retrieval with its question: the best that are no duplicates of each other."""
    got = A.retrieve_and_reset(_retrieve(spark, d), "read", most=5)(_states(spark, d))
    return got.select("state_id", "next", "titles", F.size("paras").alias("held"))


_SECOND = sql_words("text", 1, 6)


_TERMS = "unnest(list_distinct({})) AS term FROM benchmark"


@query(f"""WITH {BM25.replace(_TERMS.format(sql_tokens('text')), _TERMS.format(sql_tokens(_SECOND)))},
h AS (SELECT query_id, score, d.source || ' ' || d.doc_id AS title FROM hits JOIN documents d USING (doc_id) WHERE rank <= 10 AND len(string_split(d.text, ' ')) <= 600)
SELECT query_id::VARCHAR AS state_id, '[' || string_agg('"' || title || '"', ',' ORDER BY score DESC, title) AS a, count(*) AS n FROM h GROUP BY 1""")
def participant_map(spark, d):
    """Titles of the corpus that a named title leads to; the name here is the question's first six words."""
    named = t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    states = A.started(named.withColumnRenamed("text", "question"), "map").withColumn("answer", F.to_json(F.array(F.array_join(F.slice(F.split("question", " "), 1, 6), " "))))
    got = A.map_titles(_retrieve(spark, d), "read")(states)
    return got.filter(F.size("titles") > 0).select("state_id", F.regexp_replace("answer", r"\]$", "").alias("a"), F.size("titles").cast("long").alias("n"))
