"""Line deduplication over whole texts (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import WHITE, ascii_lower, detached, table

#: A line's key is dropped when at least this many documents hold it and it has at least so many code points.
MIN_CHARS, MIN_DOCS = 20, 3


def drop_frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: Sequence[str] = ()) -> DataFrame:
    """Drop lines that recur across documents; the largest doc_id that holds a line keeps its lines.

    docs needs doc_id and text; other columns are ignored unless named in ``carry``.
    Returns doc_id, n_lines, n_dropped, text (kept lines joined by a newline) and the carried columns,
    one row for each input row.

    * null or empty text: one empty line, which is too short to be dropped.
    * null doc_id: one further document, smaller than all others.
    * repeated doc_id: its rows are one document when documents are counted; each row is filtered by itself,
      and a line within one document, however often repeated, never reaches the threshold alone.
    * empty table: no rows.
    """
    lines = F.split(F.coalesce(F.col("__t"), F.lit("")), "\n", -1)
    base = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__t"), *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)])
    row_key = F.xxhash64(F.coalesce(F.col("__t"), F.lit("")))

    key = ascii_lower(F.btrim(F.col("line"), F.lit(WHITE)))
    held = (
        base.select("__id", row_key.alias("__row"), F.posexplode(lines).alias("pos", "line"))
        .select("__id", "__row", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        # 128 bits of two independently seeded hashes stand for the key
        .select("__id", "__row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    )
    frequent = (
        held.groupBy("h1", "h2", "__id").agg(F.lit(1).alias("one"))  # partial aggregation: a document counts once
        .groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("__id").alias("keep"))
        .filter(F.col("n") >= min_docs)
        .select(detached(F.col("h1")).alias("f1"), detached(F.col("h2")).alias("f2"), "keep")
    )
    dropped = (
        held.join(frequent, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
        .filter(~F.col("__id").eqNullSafe(F.col("keep")))
        .groupBy(F.col("__id").alias("d_id"), F.col("__row").alias("d_row"))
        .agg(F.collect_list("pos").alias("gone"))  # at most one document's lines
    )
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone"))
    return (
        base.withColumn("__row", row_key)
        .join(dropped, F.col("__id").eqNullSafe(F.col("d_id")) & (F.col("__row") == F.col("d_row")), "left")
        .withColumn("lines", lines)
        .withColumn("left", F.when(F.col("gone").isNotNull(), left))
        .select(
            F.col("__id").alias("doc_id"),
            n.cast("long").alias("n_lines"),
            F.coalesce(n - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("left").isNull(), F.coalesce("__t", F.lit(""))).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")).alias("text"),
            *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)],
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM documents d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS pos) u
), f AS (
  SELECT key, max(doc_id) AS keep FROM l WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.*, (f.key IS NOT NULL AND l.doc_id <> f.keep) AS gone FROM l LEFT JOIN f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
