"""Exact deduplication by skew-safe combining, full content compared at every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import ascii_lower, table, written

#: Salts of the middle stage. A salt is a map task's number modulo this, so a text of many copies reaches
#: each salted group as at most (map tasks / SALTS) rows.
SALTS = 32


def _digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def exact_groups(docs: DataFrame, salts: int = SALTS, digest=_digest) -> DataFrame:
    """Groups of rows whose texts are equal after lower-casing A-Z.

    Three combining stages, each keyed by the digest and the full text: within the map task (partial aggregation),
    within a salted digest group, and over the salts' winners. A digest that stands for several texts is found
    there and its rows are then matched by full text, so any digest function gives right results.

    Returns doc_id, keep_id (the largest doc_id of the group), group_size, kept, text_sha256: one row for each row.

    * null text counts as empty.
    * null doc_id: smaller than any other; keep_id is null only if every doc_id of the group is.
    * repeated rows (same doc_id and text) count in group_size and carry the same verdict.
    * empty table: no rows. Extra columns are ignored.
    """
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col("doc_id").alias("id"), norm.alias("norm"))
    keyed = rows.select("id", "norm", digest(F.col("norm")).alias("digest"))
    winners = (
        keyed.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "norm").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "norm").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    )
    # Without texts from here: one row for each digest, and whether it stands for one text only.
    classes = written(winners.groupBy("digest").agg(F.max("top").alias("keep_id"), F.max("n").alias("group_size"), F.count(F.lit(1)).alias("texts")), "exact-classes")
    clashing = classes.filter("texts > 1").select("digest")
    member = keyed.drop("norm").join(classes.filter("texts = 1").drop("texts"), "digest")
    if not clashing.isEmpty():
        apart = keyed.join(clashing, "digest", "left_semi")
        whole = apart.groupBy("norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        member = member.unionByName(apart.join(whole, "norm").select("digest", "id", "keep_id", "group_size"))
    return member.select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
