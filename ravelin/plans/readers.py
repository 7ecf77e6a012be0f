"""Queries over the readers and writers: tables go to files of a kind and are read back from there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.plans.base import query, t
from ravelin.sources import corpus as C
from ravelin.sources.index import LexicalIndex
from ravelin.storage import new_path


def _paragraphs(spark, d):
    x = t(spark, d, "documents")
    return x.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.lit(0).alias("paragraph_index"), F.col("text").alias("paragraph_text"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"),
        (F.col("doc_id") % 2 == 0).alias("is_abstract"),
    )


_PARAGRAPHS = "SELECT doc_id::VARCHAR AS id, source AS title, md5(text) AS digest, 'http://x/' || doc_id AS url, doc_id % 2 = 0 AS is_abstract FROM documents"


def _shown(rows):
    return rows.select("id", "title", F.md5(F.col("paragraph_text").cast("binary")).alias("digest"), "url", "is_abstract")


@query(_PARAGRAPHS)
def jsonl_scan(spark, d):
    path = new_path(spark, "jsonl")
    _paragraphs(spark, d).write.json(path)
    return _shown(C.read_jsonl(spark, path, C.PARAGRAPH))


@query(f"{_PARAGRAPHS} WHERE doc_id % 10 <> 3")
def jsonl_tolerant_scan(spark, d):
    """Lines that are no JSON, in place of every tenth document, are left out."""
    path = new_path(spark, "jsonl")
    rows = _paragraphs(spark, d)
    broken = F.col("id").cast("long") % 10 == 3
    rows.select(F.when(broken, F.concat(F.lit('{"id": "'), "id", F.lit('", "title": '))).otherwise(F.to_json(F.struct(*rows.columns))).alias("value")).write.text(path)
    return _shown(C.read_jsonl(spark, path, C.PARAGRAPH, tolerant=True))


@query("SELECT item_id, unnest([text, text || '!']) AS text, unnest([0, 1]) AS place FROM benchmark")
def json_scan(spark, d):
    """A file for each item, a JSON list over several lines."""
    path = new_path(spark, "json")
    b = t(spark, d, "benchmark")
    entry = lambda x, k: F.struct(F.col("item_id"), x.alias("text"), F.lit(k).alias("place"))
    whole = F.to_json(F.array(entry(F.col("text"), 0), entry(F.concat("text", F.lit("!")), 1)), {"pretty": "true"})
    b.select(F.col("item_id").alias("part"), whole.alias("value")).write.partitionBy("part").text(path)
    return C.read_json(spark, f"{path}/part=*", "item_id long, text string, place int")


@query("""SELECT left(sha256(title || ' ' || url), 32) AS id, title, url, md5(para) AS digest FROM (SELECT source || ' ' || doc_id AS title, 'u' || doc_id AS url,
array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), ' ') AS para FROM documents)""")
def compressed_pages(spark, d):
    """Compressed JSON lines of pages whose text is a list of lines, found by a pattern of names."""
    path = new_path(spark, "bz2")
    x = t(spark, d, "documents").select(F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("title"), F.split(F.coalesce("text", F.lit("")), "\n").alias("text"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    x.write.option("compression", "bzip2").json(path)
    return C.wiki_pages(spark, f"{path}/*.bz2").select("id", "title", "url", F.md5(F.col("paragraph_text").cast("binary")).alias("digest"))


@query("SELECT DISTINCT left(sha256(role || ' ' || text), 32) AS id, role AS title, md5(text) AS digest FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def nested_context_scan(spark, d):
    """Contexts nested in questions, in several files, as distinct paragraphs."""
    path = new_path(spark, "contexts")
    c = t(spark, d, "conversations").filter("text IS NOT NULL AND role IS NOT NULL").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("int").alias("idx"), F.col("role").alias("title"), F.col("text").alias("paragraph_text"))).alias("contexts"))
    c.select(F.col("conv_id").cast("string").alias("question_id"), "contexts").repartition(3).write.json(path)
    raw = C.read_jsonl(spark, path, C.QUESTION)
    return C.nested_contexts(raw, "contexts", "paragraph_text").select("id", "title", F.md5(F.col("paragraph_text").cast("binary")).alias("digest"))


_TSV = "regexp_replace(text, '[\\t\\n\"\\\\\\\\]', ' ', 'g')"


@query(f"SELECT id, 't' || id AS title, {_TSV} AS paragraph_text, (place - 1) // 8 AS batch FROM (SELECT item_id::VARCHAR AS id, item_id, text, row_number() OVER (ORDER BY item_id) AS place FROM benchmark) WHERE place > 5 AND item_id % 3 <> 0")
def tsv_scan(spark, d):
    """Tab-separated passages from the sixth on, in batches of eight; every third was written before."""
    path = new_path(spark, "tsv")
    b = t(spark, d, "benchmark")
    rows = b.select("item_id", F.col("item_id").cast("string").alias("id"), F.regexp_replace("text", r'[\t\n"\\]', " ").alias("text"), F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("title"))
    rows.coalesce(1).sortWithinPartitions("item_id").drop("item_id").write.option("sep", "\t").option("header", True).csv(path)  # one file, as it is a list in order
    done = b.filter("item_id % 3 = 0").select(F.col("item_id").cast("string").alias("id"))
    return C.passages_tsv(spark, path, done, start_line=5, batch=8).select("id", "title", "paragraph_text", F.col("batch").cast("long").alias("batch"))


@query("SELECT o_orderkey, o_orderpriority || ', \"' || o_orderstatus || '\"' AS note, round(o_totalprice, 2) AS price FROM orders")
def csv_scan(spark, d):
    """Results as CSV with a header, quotes and commas within fields, read back."""
    path = f"{new_path(spark, 'results')}.csv"
    o = t(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("note"), F.round("o_totalprice", 2).alias("price"))
    C.write_results(o, path)
    return spark.read.schema("o_orderkey long, note string, price double").option("header", True).csv(path)


@query("SELECT 'q' || item_id AS qid, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS example FROM benchmark UNION ALL SELECT 'r' || item_id, 'Q: ' || item_id || chr(10) || 'A: none' FROM benchmark")
def prompt_scan(spark, d):
    """Prompt files, one an item, with two examples each below a line of metadata."""
    path = new_path(spark, "prompts")
    k = F.col("item_id").cast("string")
    head = lambda c: F.concat(F.lit('# METADATA: {"qid": "'), F.lit(c), k, F.lit('", "n": 1}\n'))
    text = F.concat(head("q"), F.regexp_replace("text", r"\s+", " "), F.lit("\n\n\n"), head("r"), F.lit("Q: "), k, F.lit("\nA: none\n"))
    t(spark, d, "benchmark").select(F.col("item_id").alias("part"), text.alias("value")).write.partitionBy("part").text(path)
    return C.prompt_examples(spark, f"{path}/part=*").select("qid", "example")


@query("""WITH n AS (SELECT count(*) AS a, count(*) FILTER (WHERE doc_id % 2 = 0) AS h FROM documents)
SELECT unnest(['new', 'created', 'refused', 'forced', 'deleted']) AS step, unnest([false, true, true, true, false]) AS there, unnest([0, a, a, h, 0]) AS documents FROM n""")
def index_admin(spark, d):
    """Whether an index is there and how many documents it has: before and after its creation, a creation that is refused,
    one that is forced, and its deletion."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    held, rows = LexicalIndex(spark, new_path(spark, "admin-index")), []
    told = lambda step: rows.append((step, held.exists(), held.corpus().N if held.exists() else 0))
    told("new")
    held.create(docs, buckets=4)
    told("created")
    try:
        held.create(docs.limit(0))
    except FileExistsError:
        told("refused")
    held.create(docs.filter("doc_id % 2 = 0"), force=True, buckets=4)
    told("forced")
    held.delete()
    told("deleted")
    return spark.createDataFrame(rows, "step string, there boolean, documents long")
