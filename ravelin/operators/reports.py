"""Aggregations of scored answers: groupings, reports, distributions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pandas.core.groupby import DataFrameGroupBy
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.text import plain_words

from ravelin.shipping import shipped


def rate(c: Column, digits: int = 4) -> Column:
    return F.round(F.avg(c.cast("int")), digits)


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key, with each count's percentage of all; the total is one row."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(*keys, "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def by_groupings(df: DataFrame, sets: Sequence[Sequence[str]], metrics: Sequence[str], digits: int = 3) -> DataFrame:
    """Means over several groupings in one pass; columns outside a grouping are "all"."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    cols = [[F.col(k) for k in s] for s in sets]
    out = df.groupingSets(cols, *[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])
    return out.select(*[F.coalesce(k, F.lit("all")).alias(k) for k in keys], "count", *metrics)


def micro_average(per_group: DataFrame, metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """Means of groups' metrics, weighted by their count."""
    return per_group.agg(F.sum("count").alias("count"), *[F.round(F.sum(F.col(m) * F.col("count")) / F.sum("count"), digits).alias(m) for m in metrics])


def classification_report(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each label, from one pass over the pairs' counts."""
    n = df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))
    right = F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)
    g = n.groupBy(F.col(gold).alias("label")).agg(F.sum(right).alias("hit"), F.sum("n").alias("support"))
    p = n.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    both = g.join(p, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hit", "support", "predicted")])
    precision, recall = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return both.select("label", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"), "support")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in equal bins of [0, 1], the last one closed; empty bins count 0."""
    got = df.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def first_rows(df: DataFrame, n: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first n rows of each group."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def running(df: DataFrame, value: str, by: Sequence[str], *order: Column) -> Column:
    """The mean of all rows of the group so far."""
    return F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def diagnosis(r5: Column, r100: Column) -> Column:
    return F.when(r100 < 0.5, "poor recall").when((r100 >= 0.8) & (r5 < 0.4), "poor ranking").when((r100 >= 0.8) & (r5 >= 0.6), "good").otherwise("moderate")


def losses(reader: Column, baseline: Column, recall5: Column, strong: Column) -> dict[str, Column]:
    """Total loss, and what retrieval, reasoning and the rest have of it."""
    total, retrieval = reader - baseline, reader * (1 - recall5)
    reasoning = F.when(strong > 0, strong - baseline).otherwise(total - retrieval)
    return {"total": total, "retrieval": retrieval, "reasoning": reasoning, "other": total - retrieval - reasoning}


def dominant(total: Column, retrieval: Column, reasoning: Column) -> Column:
    return F.when(total <= 0, "none").when(retrieval / total > 0.6, "retrieval").when(reasoning / total > 0.6, "reasoning").otherwise("mixed")


#: Rows whose groups are updated at a time.
UPDATED = 1 << 16


class Metric(Protocol):
    """A metric with a state of its own: a flat row of numbers for each group, updated by batches of rows, merged, and read,
    for all groups of a batch at once."""

    state: Sequence[str]
    result: Sequence[str]

    def update(self, groups: DataFrameGroupBy) -> pd.DataFrame: ...

    def merge(self, groups: DataFrameGroupBy) -> pd.DataFrame: ...

    def read(self, states: pd.DataFrame) -> pd.DataFrame: ...


class MeanAndTop:
    """Rows, the mean and the largest value."""

    state, result = ("n", "total", "top"), ("n", "mean", "top")

    def update(self, groups):
        v = groups[groups.obj.columns[0]]
        return pd.DataFrame({"n": v.count(), "total": v.sum(), "top": v.max().astype(float).fillna(float("-inf"))})

    def merge(self, groups):
        return groups.agg({"n": "sum", "total": "sum", "top": "max"})

    def read(self, states):
        return pd.DataFrame({"n": states["n"], "mean": states["total"] / states["n"].clip(lower=1), "top": states["top"]})


def accumulated(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], metric: Metric) -> DataFrame:
    """A metric of each group: batches are updated where they lie, and only their states are shuffled and merged. States are
    merged in the order of their keys, a batch of groups at a time; the last group's is held back for the next batch."""
    shipped(rows.sparkSession)
    keys, columns = list(keys), list(columns)
    base = rows.select(*keys, *columns)
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields[: len(keys)]]
    numbers = lambda names: [f"{n} double" for n in names]

    def grouped(frame: pd.DataFrame, names: list[str]) -> DataFrameGroupBy:
        return frame[names].groupby([frame[k] for k in keys], dropna=False, sort=False)

    def update(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= UPDATED:
                yield metric.update(grouped(pd.concat(held), columns)).reset_index()
                held = []
        if any(map(len, held)):
            yield metric.update(grouped(pd.concat(held), columns)).reset_index()

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda states: pd.concat([states[keys], metric.read(states)], axis=1)
        last = None
        for frame in frames:
            if len(frame):
                frame = frame if last is None else pd.concat([last, frame], ignore_index=True)
                states = metric.merge(grouped(frame, list(metric.state))).reset_index()
                last = states.iloc[-1:]
                yield read(states.iloc[:-1])
        if last is not None:
            yield read(last)

    states = base.mapInPandas(update, ", ".join([*key_types, *numbers(metric.state)]))
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(merge, ", ".join([*key_types, *numbers(metric.result)]))


def error_kind(prediction: Column, golds: Column, similarity: Column) -> Column:
    """What is wrong with a wrong prediction, by the first rule that fits. golds is an array of texts; similarity (0 to 1) is
    the best ratio of the plain prediction to a plain gold answer, by whatever measure. Null predictions are empty."""
    said = F.coalesce(prediction, F.lit(""))
    plain, low = plain_words(said), F.lower(said)
    count = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    n = count(said)
    usual = F.aggregate(golds, F.lit(0.0), lambda a, g: a + count(g)) / F.size(golds)
    return (
        F.when(F.trim(said) == "", "empty_prediction").when(said.startswith("Error"), "llm_error")
        .when(F.contains(low, F.lit("don't know")) | F.contains(low, F.lit("cannot")), "refusal")
        .when(F.exists(golds, lambda g: F.contains(plain, plain_words(g))), "answer_embedded")
        .when(similarity > 0.7, "high_similarity").when(similarity > 0.4, "moderate_similarity")
        .when(n > usual * 2, "too_verbose").when((n < usual * 0.5) & (n > 0), "too_short").otherwise("completely_wrong")
    )
