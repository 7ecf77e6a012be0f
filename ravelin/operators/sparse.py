"""Learned sparse vectors: token weights pooled from a model's logits, and their storage as whole impacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens kept for a document and for a query, and steps that a weight is stored in.
DOC_TOKENS, QUERY_TOKENS, STEPS = 200, 100, 255


def pooled(logits: DataFrame, key: str = "doc_id", most: int = DOC_TOKENS) -> DataFrame:
    """logits (key, position, token, logit) -> (key, token, weight): the largest ln(1 + max(logit, 0)) of a token over all
    positions. The ``most`` heaviest tokens stay, equal ones by token; of them special tokens ("[..", "<..") and those with a
    full stop go, other tokens keep letters, digits, "_" and "-" only. Tokens that become equal count by the heavier.

    Weights are summed up within tasks first, and a key's rank limit holds within tasks too. Null tokens or logits say
    nothing; a key without weight has no rows.
    """
    weight = F.log1p(F.greatest(F.col("logit").cast("double"), F.lit(0.0)))
    w = logits.filter("token IS NOT NULL AND logit IS NOT NULL").groupBy(key, "token").agg(F.max(weight).alias("weight")).filter("weight > 0")
    top = w.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("weight"), "token"))).filter(F.col("__n") <= most)
    plain = top.filter(~F.col("token").rlike(r"^[\[<]|\."))
    bare = plain.withColumn("token", F.regexp_replace("token", r"[^\p{L}\p{N}_-]", "")).filter("token <> ''")
    return bare.groupBy(key, "token").agg(F.max("weight").alias("weight"))


def impacts(weights: DataFrame, steps: int = STEPS) -> DataFrame:
    """weights (.., token, weight) with ``impact`` in place of weight: whole steps of the heaviest weight of the table,
    rounded up, so that no token is lost. The scale is one number for the table."""
    scale = weights.agg(F.max("weight")).first()[0] or 1.0
    return weights.withColumn("impact", F.ceil(F.col("weight") * steps / F.lit(scale) - 1e-9).cast("int")).drop("weight")


def stored(weights: DataFrame, path: str, key: str = "doc_id", parts: int = 64) -> None:
    """Impacts as Parquet in folders by a hash of the token; within a file by token, the largest impact first. A token's
    postings go to several files."""
    out = impacts(weights).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int"))
    dealt = out.repartition(F.col("part"), F.pmod(F.xxhash64(key), F.lit(4)))
    dealt.sortWithinPartitions("part", "token", F.desc("impact"), key).write.partitionBy("part").parquet(path)


def impact_scores(impacts_: DataFrame, query: DataFrame, key: str = "doc_id") -> DataFrame:
    """query (query_id, token, impact) against impacts (key, token, impact): the sum of their products, whole numbers."""
    q = query.select("query_id", F.col("token").alias("q_token"), F.col("impact").cast("long").alias("q_impact"))
    return impacts_.join(q, F.col("token") == F.col("q_token")).groupBy("query_id", key).agg(F.sum(F.col("impact") * F.col("q_impact")).alias("score"))
