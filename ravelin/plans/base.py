"""Registration of queries, and what their definitions share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import PUNCTUATION
from ravelin.shipping import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(shipped(spark), sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL text that several oracles share.
_P = PUNCTUATION.replace("'", "''")


_EDGE = "[^\\p{L}\\p{N}_]"


def sql_bare(x: str) -> str:
    """Without punctuation and whole articles. Neighbours share their edge, so the replacement is done twice."""
    out = f"translate(lower({x}), '{_P}', '')"
    for _ in range(2):
        out = f"regexp_replace({out}, '(^|{_EDGE})(a|an|the)({_EDGE}|$)', '\\1 \\3', 'g')"
    return out


def sql_answer_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_bare(x)}, '\\s+'), lambda w: w <> '')"


def sql_norm(x: str) -> str:
    return f"array_to_string({sql_answer_tokens(x)}, ' ')"


def sql_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


#: Beyond the words of any text: a slice to the end.
MANY = 1 << 30


def sql_words(x: str, i: int, j: int) -> str:
    return f"array_to_string(list_slice(string_split({x}, ' '), {i}, {j}), ' ')"


def word_slice(c, i: int, j: int):
    return F.array_join(F.slice(F.split(c, " "), i, j - i + 1), " ")


ACTIONS = ("Z", "S-Sparse", "S-Dense", "S-Hybrid", "M")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question, prediction and gold answer of every user turn with a reply; the routing action and the data set."""
    c = t(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select(F.col("conv_id").alias("qc"), F.col("turn").alias("qt"), F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").join(q, (F.col("conv_id") == F.col("qc")) & (F.col("turn") == F.col("qt") + 1))
    action = F.element_at(F.array(*[F.lit(x) for x in ACTIONS]), (F.col("conv_id") % 5 + 1).cast("int"))
    gold = F.when(F.col("conv_id") % 3 == 0, F.col("text")).when(F.col("conv_id") % 3 == 1, word_slice(F.col("text"), 4, MANY)).otherwise(F.col("question"))
    return a.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat(F.lit("ds"), (F.col("conv_id") % 6).cast("string")).alias("dataset"), action.alias("action"),
        "conv_id", "turn", "question", F.col("text").alias("prediction"), gold.alias("gold"), F.col("text").alias("reply"),
    )


ANSWERS = f"""qa AS (
  SELECT a.conv_id * 100 + a.turn AS question_id, 'ds' || (a.conv_id % 6) AS dataset,
         (['Z', 'S-Sparse', 'S-Dense', 'S-Hybrid', 'M'])[(a.conv_id % 5 + 1)::INT] AS action, a.conv_id, a.turn, q.text AS question,
         a.text AS prediction,
         CASE a.conv_id % 3 WHEN 0 THEN a.text WHEN 1 THEN {sql_words('a.text', 4, MANY)} ELSE q.text END AS gold,
         a.text AS reply
  FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' AND q.role = 'user'
)"""
