"""The corpus pipeline: STAGES in order, each over the documents that its predecessor kept.

Every stage but the last returns the columns of documents. Each works on all rows of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, langid, lines, mixing, simhash
from ravelin.llm._common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least mean confidence of a text's windows that keeps it: texts in two languages are sure window by window and stay,
#: texts in none of the learned languages and junk mostly aren't. Texts under a window have less to go on.
MIN_CONFIDENCE, MIN_CONFIDENCE_SHORT = 0.7, 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with that language as their lang; texts that are null, empty or without letters
    and those of an unsure prediction go. Null columns and repeated rows are as they come; an empty table stays one."""
    told = langid.identify(docs, langid.fit(docs), carry=["text", "source", "n_chars"])
    least = F.when(F.octet_length("text") < langid.WINDOW, MIN_CONFIDENCE_SHORT).otherwise(MIN_CONFIDENCE)
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("confidence") >= least))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines leave the texts; n_chars counts what is left. A null text becomes the empty one."""
    out = lines.drop_frequent_lines(docs, carry=["lang", "source"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id: groups of texts whose
    fingerprints op8 links, or whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Null and empty
    texts are one group, null doc_ids come last."""
    return simhash.drop_near(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked weights of sources, languages and topics. Nulls are values of their own."""
    rows = docs.select(F.struct(*COLUMNS).alias("row"), "doc_id", "text", "lang", "source")
    return mixing.mix(rows, carry=["row"]).filter("kept").select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text; a null text has no tokens."""
    return bpe.digests(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]
#: Training a network and coding by a vocabulary are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it keep is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
