"""Iterative retrieval: a loop over states of all questions, one set of joins a hop."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.storage import written


class Participant(Protocol):
    """A step of an inference graph: states in, successor states out. States have state_id, question_id, next, score."""

    def __call__(self, states: DataFrame) -> DataFrame: ...


def best_first(start: DataFrame, participants: Mapping[str, Participant], end: str, beam: int = 1, steps: int = 20, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Expand each question's best open states until all reach ``end`` or the steps are used.

    In each step a question's ``beam`` states of least score are expanded, all questions at once; others wait. Lineage is
    cut each step by ``cut`` (a table in the shared folder).
    """
    states = start
    for _ in range(steps):
        w = W.partitionBy("question_id").orderBy("score", "state_id")
        placed = cut(states.withColumn("__n", F.row_number().over(w)))
        active = placed.filter((F.col("__n") <= beam) & (F.col("next") != end)).drop("__n")
        if active.isEmpty():
            break
        states = placed.filter((F.col("__n") > beam) | (F.col("next") == end)).drop("__n")
        for name, step in participants.items():
            states = states.unionByName(step(active.filter(F.col("next") == name)))
    w = W.partitionBy("question_id").orderBy("score", "state_id")
    return states.filter(F.col("next") == end).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def hops(start: DataFrame, retrieve: Callable[[DataFrame], DataFrame], follow: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """start (query_id, q): n rounds of retrieval; each round's best hit gives the next round's query.

    Returns the hits of all rounds, distinct by query and document, with the hop that found them first. Each round's hits
    are written, so that no round runs the one before again.
    """
    found, queries = None, start
    for hop in range(1, n + 1):
        got = written(retrieve(queries).withColumn("hop", F.lit(hop)), "hop")
        found = got if found is None else found.unionByName(got)
        queries = follow(got.filter("rank = 1"))
    w = W.partitionBy("query_id", "doc_id").orderBy("hop", "rank")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def gain(relevance: Column, is_new_title: Column, max_jaccard: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    """Relevance and novelty of a document for a node: novelty 1 without contexts, else of title and content."""
    novelty = F.when(max_jaccard.isNull(), 1.0).otherwise(0.4 * F.when(is_new_title, 1.0).otherwise(0.3) + 0.6 * (1 - max_jaccard))
    return alpha * relevance + beta * novelty


def covered(plan: Column, context: Column) -> Column:
    """Parts of a plan ("a -> b") that have half of their words, one at least, in the context's words."""
    parts = F.transform(F.split(F.lower(plan), "->"), lambda p: F.array_distinct(F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != "")))
    known = F.array_distinct(F.split(F.lower(context), r"\s+"))
    return F.size(F.filter(parts, lambda ws: (F.size(ws) > 0) & (F.size(F.array_intersect(ws, known)) >= F.greatest(F.lit(1), F.floor(F.size(ws) / 2)))))


def exits(last: Column, step: Column, most: int, pattern: str = r"(?i)answer is") -> Column:
    """Whether generation ends: nothing was said, the steps are used, or the pattern is met."""
    return (F.trim(F.coalesce(last, F.lit(""))) == "") | (step >= most) | last.rlike(pattern)
