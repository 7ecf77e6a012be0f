"""Readers and writers of paragraph corpora. All schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARAGRAPH = "id string, title string, paragraph_index int, paragraph_text string, url string, is_abstract boolean"
#: Splits of files whose offsets are broadcast, at most.
NEAR_SPLITS = 100_000
QUESTION = (
    "dataset string, question_id string, question_text string, "
    "answers_objects array<struct<number:string,date:struct<day:string,month:string,year:string>,spans:array<string>>>, "
    "contexts array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
)


def _id(*columns: str):
    return F.substring(F.sha2(F.concat_ws(" ", *columns), 256), 1, 32)


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Line-delimited JSON; tolerant reading drops malformed lines, else they fail the read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON object of keys to values as rows (key, value)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """Compressed JSON lines of pages whose text is a list of sentences; one paragraph a page."""
    raw = read_jsonl(spark, path, "title string, text array<string>, url string")
    text = F.array_join(F.transform("text", lambda s: F.trim(s)), " ")
    return raw.select(_id("title", "url").alias("id"), "title", F.lit(0).alias("paragraph_index"), text.alias("paragraph_text"), "url", F.lit(True).alias("is_abstract"))


def html_paragraphs(pages: DataFrame, key: str, html: str, min_words: int = 10) -> DataFrame:
    """Paragraphs of over ``min_words`` words, tags stripped, numbered by their place in the page; the first is the abstract."""
    lines = F.split(F.regexp_replace(html, "</p>|</h1>", "\n"), "\n", -1)
    para = F.trim(F.regexp_replace("raw", "<[^>]*>", ""))
    out = pages.select(key, F.posexplode(lines).alias("paragraph_index", "raw")).select(key, "paragraph_index", para.alias("paragraph_text"), (F.col("paragraph_index") == 0).alias("is_abstract"))
    return out.filter(F.size(F.filter(F.split("paragraph_text", r"\s+"), lambda w: w != "")) > min_words)


def nested_contexts(raw: DataFrame, column: str, text: str) -> DataFrame:
    """Questions' contexts (structs with a title and a text, or a list of sentences) as distinct paragraphs."""
    c = raw.select(F.explode(column).alias("c"))
    body = F.array_join(f"c.{text}", " ") if dict(c.select(f"c.{text}").dtypes)[text].startswith("array") else F.col(f"c.{text}")
    rows = c.select(F.col("c.title").alias("title"), body.alias("paragraph_text")).withColumn("id", _id("title", "paragraph_text"))
    return rows.dropDuplicates(["id"]).select("id", "title", F.lit(0).alias("paragraph_index"), "paragraph_text", F.lit("").alias("url"), F.lit(True).alias("is_abstract"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 within each file, without bringing a file to one task.

    Lines are numbered within the splits in which Spark reads a file, and the splits' counts give the offsets.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    counts = raw.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row a split
    w = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    offsets = counts.select(F.col("file").alias("f"), F.col("start").alias("s"), "first", (F.sum("n").over(w) - F.col("n")).alias("before"))
    near = F.broadcast(offsets) if raw.rdd.getNumPartitions() <= NEAR_SPLITS else offsets  # a row for each split
    out = raw.join(near, (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
    return out.select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def passages_tsv(spark: SparkSession, path: str, done: DataFrame | None = None, start_line: int = 0, batch: int | None = None) -> DataFrame:
    """Tab-separated id, text, title with a header, from ``start_line`` on (0: the first after the header); ids in
    ``done`` were written before and are left out. ``batch`` adds a batch number for encoders."""
    if start_line or batch:
        lines = numbered_lines(spark, path).filter(F.col("line") > start_line)
        part = F.from_csv("value", "id string, text string, title string", {"sep": "\t"})
        rows = lines.select((F.col("line") - 1).alias("line"), part.alias("p")).select("line", "p.*")
    else:
        rows = spark.read.schema("id string, text string, title string").option("sep", "\t").option("header", True).csv(path)
    rows = rows.join(done.select("id"), "id", "left_anti") if done is not None else rows
    extra = [F.floor(F.col("line") / batch).alias("batch")] if batch else []
    return rows.select("id", "title", F.lit(0).alias("paragraph_index"), F.col("text").alias("paragraph_text"), F.lit("").alias("url"), F.lit(True).alias("is_abstract"), *extra)


def write_corpus(paragraphs: DataFrame, corpus: str, path: str, mode: str = "overwrite") -> None:
    """An index partition by corpus name, so that a query of one corpus reads no other."""
    paragraphs.withColumn("corpus_name", F.lit(corpus)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("corpus_name").parquet(path)


def chain_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Text blocks parted by blank lines: question_id from the first line, the rest as chain."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.split("value", r"\n\s*\n")).alias("b")).select(F.btrim("b", F.lit(" \n\r\t")).alias("b")).filter("b <> ''").select(
        F.regexp_extract("b", r"^(?:QID: *)?([^\n]*)", 1).alias("question_id"), F.regexp_extract("b", r"(?s)^[^\n]*\n?(.*)$", 1).alias("chain"))


def prompt_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples of a prompt file, each headed by a line "# METADATA: {json}"."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.filter(F.split("value", r"(?m)^# METADATA: "), lambda x: F.trim(x) != "")
    return whole.select(F.posexplode(parts).alias("pos", "p")).select("pos", F.get_json_object(F.regexp_extract("p", r"^([^\n]*)", 1), "$.qid").alias("qid"), F.btrim(F.regexp_replace("p", r"^[^\n]*\n", ""), F.lit(" \n\r\t")).alias("example"))


KINDS = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet"}


def write_results(rows: DataFrame, path: str, kind: str | None = None) -> None:
    """Rows as JSON lines, CSV with a header, or Parquet; the kind is told by the path's ending where it isn't given."""
    kind = kind or next((k for end, k in KINDS.items() if path.rstrip("/").endswith(end)), "json")
    w = rows.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path) if kind == "json" else w.parquet(path)


def reload_results(spark: SparkSession, path: str, schema: str, key: str = "question_id") -> DataFrame:
    """Results of earlier runs, by key; where a key was written more than once the last line counts."""
    rows = numbered_lines(spark, path).select(F.struct("file", "line").alias("at"), F.from_json("value", schema).alias("r")).filter(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


ROUTING_LOG = "question_id string, initial_action string, confidence double, final_action string, cascaded boolean, dataset string, question_text string"


def read_routing_log(spark: SparkSession, path: str) -> DataFrame:
    """A routing log: CSV with a header."""
    return spark.read.schema(ROUTING_LOG).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_routing_log(rows: DataFrame, path: str) -> None:
    """The log's columns in order, confidences with four digits."""
    names = [c.split(" ")[0] for c in ROUTING_LOG.split(", ")]
    rows.select(*[F.round("confidence", 4).alias("confidence") if n == "confidence" else n for n in names]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
