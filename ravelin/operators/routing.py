"""Resuming, merging and cascading of routed questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.operators.order import placed


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def completeness(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: missing from got, or extra in it."""
    a, b = expected.select(key).distinct(), got.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("extra")))


def last_write(rows: DataFrame, key: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """Each key's last row in order."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(key, "__r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of both by key; where both have a key, the new one's values count."""
    n = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(True).alias("__new"))
    return old.join(n, key, "full").select(key, *[F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def cascade(direct: DataFrame, hard: DataFrame, key: str, answer: str, cascaded: Column) -> DataFrame:
    """The hard strategy's answer where a question cascades and has one, else the direct one."""
    h = hard.select(key, F.col(answer).alias("__h"))
    return direct.join(h, key, "left").select(key, F.when(cascaded & F.col("__h").isNotNull(), F.col("__h")).otherwise(F.col(answer)).alias(answer), cascaded.alias("cascaded"))


def rolling_eviction(existing: DataFrame, new: DataFrame, by: str, k: int, base: float = 0.6) -> DataFrame:
    """The k best documents of a question: those held count ``base``, new ones their score; of equal texts the held one
    stays; ties go to the held one, then the place. Both need (by, pos, text, score)."""
    both = existing.withColumn("score", F.lit(base)).withColumn("held", F.lit(1)).unionByName(new.withColumn("held", F.lit(0)))
    first = W.partitionBy(by, F.lower(F.trim("text"))).orderBy(F.desc("held"), F.asc("pos"))
    one = both.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    best = W.partitionBy(by).orderBy(F.desc("score"), F.desc("held"), F.asc("pos"))
    return one.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def head_tail(rows: DataFrame, by: str, order: str, ends: int, limit: int) -> DataFrame:
    """All rows of a group up to ``limit``; of larger ones the first and the last ``ends``."""
    n = rows.groupBy(F.col(by).alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    each = placed(rows, [order], [by]).join(n, F.col(by) == F.col("__b"))
    return each.filter((F.col("__n") <= limit) | (F.col("place") <= ends) | (F.col("place") > F.col("__n") - ends)).drop("__b", "__n")


def pinned(paras: Column, pin: Column, position: str) -> Column:
    """A pinned paragraph put in front if it is absent, and moved to the top or the bottom if asked."""
    if position not in ("no_op", "top", "bottom"):
        raise ValueError(f"unknown position {position}")
    held = F.when(F.array_contains(paras, pin), paras).otherwise(F.concat(F.array(pin), paras))
    rest = F.filter(held, lambda p: p != pin)
    return held if position == "no_op" else F.concat(F.array(pin), rest) if position == "top" else F.concat(rest, F.array(pin))
