"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import table, written

#: Exponents that temper each dimension's share of tokens into its target share.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds of fitting at most, the relative gap to every target at which it ends, the share of tokens to keep, the seed
#: of the draw.
ROUNDS, TOLERANCE, BUDGET, SEED = 12, 1e-10, 0.5, "mix"
#: Up to so many combinations of the dimensions' values are fitted on the driver and broadcast; more are fitted as a table.
MAX_CELLS = 200_000
#: The gap beyond which targets count as missed.
MISSED = 0.01
NONE = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """The form of a text, told by its words and marks."""
    words = F.regexp_count(text, F.lit(WORDS))
    return (
        F.when(text.isNull() | (words == 0), "empty").when(F.lower(text).contains("license") | F.lower(text).contains("licensed under"), "legal")
        .when(text.contains(" | "), "tabular").when(words < 80, "note").when(words < 600, "article").otherwise("essay")
    )


def rake(weights: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Scale cells' weights so that each dimension's sums approach its targets, one dimension after the other, until all
    are within the tolerance. Returns the weights and the largest relative gap left; targets of zero empty their cells."""
    x, gap = weights.astype(float).copy(), np.inf
    for _ in range(rounds):
        for code, target in zip(codes, targets):
            sums = np.bincount(code, x, minlength=len(target))
            x *= np.divide(target, sums, out=np.zeros(len(target)), where=sums > 0)[code]
        gap = max(float(np.max(np.abs(np.bincount(c, x, minlength=len(t)) - t) / np.where(t > 0, t, 1))) for c, t in zip(codes, targets))
        if gap <= tolerance:
            break
    return x, gap


def wanted_shares(natural: Mapping[str, float], temper: float, given: Mapping[str, float] | None) -> dict[str, float]:
    """A dimension's target shares: the given ones, and what they leave to the other values by their natural shares; of
    none given, all natural shares to the power of temper, normalised."""
    if given is None:
        power = {k: v**temper for k, v in natural.items()}
        total = sum(power.values())
        return {k: v / total for k, v in power.items()}
    named = {k: float(given[k]) for k in natural if k in given}
    others = {k: v for k, v in natural.items() if k not in given}
    rest = max(0.0, 1 - sum(named.values())) if others else 0.0
    out = named | {k: rest * v / sum(others.values()) for k, v in others.items()}
    total = sum(out.values())
    if total <= 0:
        raise ValueError("no value that occurs has a target weight")
    return {k: v / total for k, v in out.items()}


def calibrated(weights: np.ndarray, wanted: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities in proportion to wanted / weights, at most 1, whose expected weight is budget times all weight."""
    ratio = wanted / weights
    order = np.argsort(-ratio, kind="stable")
    w, r = weights[order], ratio[order]
    full = np.concatenate(([0.0], np.cumsum(w)[:-1]))  # weight of the cells before, were they all kept
    rest = np.cumsum((w * r)[::-1])[::-1]
    scale = (budget * w.sum() - full) / np.maximum(rest, np.finfo(float).tiny)
    first = int(np.argmax(scale * r <= 1)) if (scale * r <= 1).any() else len(r) - 1
    return np.clip(scale[first] * ratio, 0, 1)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on doc_id only."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _missed(gap: float) -> None:
    if gap > MISSED:
        logging.getLogger(__name__).warning("the weights miss a target by %.3g of it: the targets contradict each other or the combinations that occur", gap)


def chances(cells: list, dims: Sequence[str], temper: Mapping[str, float], targets: Mapping[str, Mapping[str, float]], rounds: int, budget: float) -> list[tuple]:
    """Rows (dims, probability) of collected cells (dims, w)."""
    w = np.array([c["w"] for c in cells], float)
    codes, goals = [], []
    for d in dims:
        names = sorted({c[d] for c in cells})
        at = {name: k for k, name in enumerate(names)}
        code = np.array([at[c[d]] for c in cells])
        shares = wanted_shares(dict(zip(names, np.bincount(code, w) / w.sum())), temper[d], targets.get(d))
        codes.append(code)
        goals.append(np.array([shares[name] for name in names]) * w.sum())
    x, gap = rake(w, codes, goals, rounds)
    _missed(gap)
    return [(*[c[d] for d in dims], float(p)) for c, p in zip(cells, calibrated(w, x, budget))]


def chances_table(cells: DataFrame, dims: Sequence[str], temper: Mapping[str, float], targets: Mapping[str, Mapping[str, float]], rounds: int, budget: float, tolerance: float = TOLERANCE) -> DataFrame:
    """(dims, probability) of any number of cells (dims, w), fitted and calibrated by aggregations and joins."""
    spark = cells.sparkSession
    cells = written(cells, "mix-cells")
    total = cells.agg(F.sum("w")).first()[0]
    goals = {}
    for d in dims:
        natural = cells.groupBy(d).agg((F.sum("w") / F.lit(total)).alias("share"))
        given = targets.get(d)
        if given is None:
            raw = natural.withColumn("raw", F.pow("share", F.lit(temper[d])))
        else:
            named = spark.createDataFrame([(str(k), float(v)) for k, v in given.items()] or [("", 0.0)], "__v string, g double")
            natural = natural.join(F.broadcast(named), F.col(d) == F.col("__v"), "left")  # as many rows as the caller gave
            sums = natural.agg(F.sum("g").alias("named"), F.sum(F.when(F.col("g").isNull(), F.col("share"))).alias("others")).first()
            rest = max(0.0, 1 - (sums.named or 0.0)) if sums.others else 0.0
            raw = natural.withColumn("raw", F.coalesce("g", F.lit(rest) * F.col("share") / F.lit(sums.others or 1.0)))
        raw = written(raw.select(F.col(d).alias("__k"), "raw"), f"mix-goal-{d}")
        whole = raw.agg(F.sum("raw")).first()[0]
        if not whole:
            raise ValueError("no value that occurs has a target weight")
        goals[d] = raw.select("__k", (F.col("raw") * F.lit(total / whole)).alias("goal"))
    x = cells.withColumn("x", F.col("w").cast("double"))
    gap = float("inf")
    for _ in range(rounds):
        for d in dims:
            sums = x.groupBy(F.col(d).alias("__s")).agg(F.sum("x").alias("sum")).join(goals[d], F.col("__s") == F.col("__k"))
            factor = sums.select("__s", F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
            x = x.join(factor, F.col(d) == F.col("__s")).select(*dims, "w", (F.col("x") * F.col("factor")).alias("x"))
        x = written(x, "mix-weights")
        gaps = []
        for d in dims:
            sums = x.groupBy(F.col(d).alias("__s")).agg(F.sum("x").alias("sum")).join(goals[d], F.col("__s") == F.col("__k"))
            gaps.append(sums.agg(F.max(F.abs(F.col("sum") - F.col("goal")) / F.when(F.col("goal") > 0, F.col("goal")).otherwise(1.0))).first()[0])
        gap = max(gaps)
        if gap <= tolerance:
            break
    _missed(gap)
    # The scale that meets the budget: cells at certainty are found from below, so their number only grows.
    ratio = F.col("x") / F.col("w")
    scale, full, before = 0.0, 0.0, -1
    while True:
        sure = F.lit(scale) * ratio >= 1 if before >= 0 else F.lit(False)
        got = x.agg(F.sum(F.when(sure, F.col("w")).otherwise(0)).alias("full"), F.sum(F.when(sure, 0.0).otherwise(F.col("x"))).alias("rest"), F.sum(sure.cast("long")).alias("n")).first()
        if got.n == before or not got.rest:
            break
        before, full = got.n, got.full
        scale = (budget * total - full) / got.rest
    return x.select(*dims, F.least(F.lit(1.0), F.lit(scale) * ratio).alias("probability"))


def mix(docs: DataFrame, temper: Mapping[str, float] = TEMPER, topic=topic_of, rounds: int = ROUNDS, budget: float = BUDGET, seed: str = SEED,
        max_cells: int = MAX_CELLS, carry: Sequence[str] = (), targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Sampling probability and decision for every row: doc_id, source, lang, topic, n_tokens, probability, kept.

    Tokens (words) are summed by source, language and topic over all rows. ``targets`` names shares of tokens by
    dimension and value, {"lang": {"en": 0.5}}; values that it doesn't name share what is left by their own tokens. A
    dimension without targets aims at its natural shares to the power in ``temper``, normalised. Weights are raked until
    every margin is met or the rounds are used; a gap that stays is logged. They become probabilities whose expected
    tokens are ``budget`` of all. A row is kept if a hash of its doc_id lies below its probability. ``topic`` gives a
    text's topic; the default is its form.

    * null source or lang: a value of its own, "(none)". Null, empty or blank text: topic "empty", one token.
    * rows of one doc_id and cell share a decision; null doc_id draws as one id. Empty table: no rows.
    * more than ``max_cells`` combinations are fitted as a table, with the same result.
    * extra columns are ignored unless named in ``carry``.
    """
    dims = ["source", "lang", "topic"]
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").alias("d"), F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        topic(text).alias("topic"), F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)), F.lit(1)).cast("long").alias("n_tokens"),
        *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)],
    )
    table_ = rows.groupBy(*dims).agg(F.sum("n_tokens").alias("w"))
    cells = table_.limit(max_cells + 1).collect()
    targets = targets or {}
    if len(cells) <= max_cells:
        cells = sorted(cells, key=lambda c: tuple(c[d] for d in dims))
        found = chances(cells, dims, temper, targets, rounds, budget) if cells else []
        told = F.broadcast(docs.sparkSession.createDataFrame(found, "source string, lang string, topic string, probability double"))  # at most max_cells rows
    else:
        told = written(chances_table(table_, dims, temper, targets, rounds, budget), "mix-chances")
    out = rows.join(told, dims, "left")
    return out.select(F.col("d").alias("doc_id"), *dims, "n_tokens", "probability", (uniform(F.col("d"), seed) < F.col("probability")).alias("kept"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def _oracle() -> str:
    steps, last = [], "cells"
    for k in range(ROUNDS):
        for d in TEMPER:
            name = f"x{k}_{d}"
            steps.append(f"{name} AS (SELECT source, lang, topic, w, t_source, t_lang, t_topic, x * t_{d} / sum(x) OVER (PARTITION BY {d}) AS x FROM {last})")
            last = name
    shares = "".join(f", s_{d} AS (SELECT {d}, pow(sum(w) / (SELECT sum(w) FROM c0), {e}) AS s FROM c0 GROUP BY {d})" for d, e in TEMPER.items())
    target = "".join(f", s_{d}.s / (SELECT sum(s) FROM s_{d}) * (SELECT sum(w) FROM c0) AS t_{d}" for d in TEMPER)
    joins = "".join(f" JOIN s_{d} USING ({d})" for d in TEMPER)
    return f"""
WITH r AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n
  FROM documents
), rows_ AS (
  SELECT doc_id, source, lang, greatest(n, 1) AS n_tokens,
         CASE WHEN n = 0 THEN 'empty' WHEN contains(lower(text), 'license') OR contains(lower(text), 'licensed under') THEN 'legal'
              WHEN contains(text, ' | ') THEN 'tabular' WHEN n < 80 THEN 'note' WHEN n < 600 THEN 'article' ELSE 'essay' END AS topic
  FROM r
), c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM rows_ GROUP BY ALL){shares}
, cells AS (SELECT source, lang, topic, w{target}, w AS x FROM c0{joins})
, {', '.join(steps)}
, q AS (
  SELECT source, lang, topic, w, x / w AS ratio,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(x) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS k
  FROM {last} WINDOW o AS (ORDER BY x / w DESC, source, lang, topic)
), s AS (SELECT *, ({BUDGET} * (SELECT sum(w) FROM c0) - full_) / rest AS scale FROM q)
, f AS (SELECT scale FROM s WHERE scale * ratio <= 1 OR k = (SELECT max(k) FROM s) ORDER BY k LIMIT 1)
SELECT d.doc_id, source, lang, topic, d.n_tokens, round(greatest(0, least(1, f.scale * s.ratio)), 6) AS probability,
       ('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 8))::BIGINT / 4294967296.0 < greatest(0, least(1, f.scale * s.ratio)) AS kept
FROM rows_ d JOIN s USING (source, lang, topic), f
"""


ORACLE = _oracle()
