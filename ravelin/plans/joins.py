"""Queries over text joins, tree search, stems, model boundaries and learned sparse weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions.stem import stemmed
from ravelin.functions.text import tokens
from ravelin.operators import models, sparse, tree
from ravelin.operators import retrieval as R
from ravelin.operators import sampling as M
from ravelin.operators import similarity as S
from ravelin.plans.base import MANY, query, sql_tokens, t
from ravelin.plans.dataflow import _BLOCKS
from ravelin.plans.retrieval import BM25, bench, hits, index
from ravelin.sources.blocks import blocks
from ravelin.storage import written

#: Least ratio of whole texts: at most three characters of a hundred differ.
CLOSE = 97.0


def _texts(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


@query()
def fuzzy_pairs(spark, d):
    """Pairs of different texts that are nearly the same, character by character; copies are represented by the first."""
    return S.similar_texts(_texts(spark, d), CLOSE)


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS representative, count(*) OVER (PARTITION BY coalesce(text, '')) AS members FROM documents")
def fuzzy_classes(spark, d):
    """Which document stands for each in the pairs."""
    return S.text_classes(_texts(spark, d))


def _quoted(spark, d):
    """Benchmark items as somebody quotes them: without their last word, two letters changed."""
    q = F.expr("array_join(slice(split(text, ' '), 1, greatest(size(split(text, ' ')) - 1, 1)), ' ')")
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace(F.regexp_replace(q, "^(.{10}).", "$1x"), "^(.{30}).", "$1y").alias("q"))


@query()
def passage_matches(spark, d):
    """The first lexical hit of each quotation, if it holds the quotation with a partial ratio of over 95."""
    q = _quoted(spark, d)
    first = R.bounded(written(R.lexical(index(spark, d), R.query_terms(q, F.col("q")), 1), "hits"))
    texts = t(spark, d, "documents").select("doc_id", "text")
    return S.matching_passages(first.select("query_id", "rank", "doc_id").join(R.bounded(q), "query_id").join(texts, "doc_id"))


@query()
def tree_retrieval(spark, d):
    """Tree search over the lexical index for each benchmark item; its halves and its number are the plan."""
    b = t(spark, d, "benchmark").select("item_id", "text", F.split("text", " ").alias("b"))
    half = F.floor(F.size("b") / 2).cast("int")
    plan = F.concat(F.array_join(F.slice("b", F.lit(1), half), " "), F.lit(" -> "), F.array_join(F.slice("b", half + 1, F.size("b")), " "), F.lit(" -> item "), F.col("item_id").cast("string"))
    questions = b.select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"), plan.alias("plan"))
    held = index(spark, d)
    retrieve = lambda asks, k: R.lexical(held, R.query_terms(asks, F.col("q")), k)
    docs = t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return tree.tree_search(questions, retrieve, docs, depth=3).select("question_id", "node", "q", "score", "depth", F.size("docs").alias("found"), "done", "place")


@query()
def stemmed_terms(spark, d):
    """How many documents hold each stem."""
    terms = t(spark, d, "documents").select("doc_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term"))
    return stemmed(terms).groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("n"))


def _scorer():
    return lambda pairs: [len({*a.lower().split()} & {*b.lower().split()}) / max(1, len({*a.lower().split()})) for a, b in pairs]


_SPLIT = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> ''))"


@query(f"""WITH {BM25}, x AS (SELECT h.query_id, h.doc_id, round(len(list_intersect({_SPLIT.format('b.text')}, {_SPLIT.format('d.text')}))::DOUBLE / greatest(1, len({_SPLIT.format('b.text')})), 6) AS score FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 5""")
def scored_rerank(spark, d):
    """Hits in the order of a scorer of (query, passage) pairs; the scorer here is the share of the query's words."""
    x = hits(spark, d).select("query_id", "doc_id").join(R.bounded(bench(spark, d)), "query_id").join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
    scored = models.pair_scored(x, "q", "text", "score", "share", _scorer)
    return R.ranked(scored.select("query_id", "doc_id", F.round("score", 6).alias("score")), 5)


def _encoder():
    return lambda texts: [[len(x), x.count(" "), x.count(".")] for x in texts]


@query("SELECT conv_id, turn, length(text)::FLOAT AS a, (length(text) - length(replace(text, ' ', '')))::FLOAT AS b, (length(text) - length(replace(text, '.', '')))::FLOAT AS c FROM conversations WHERE text IS NOT NULL")
def encoded_texts(spark, d):
    """Vectors of an encoder that is loaded once a worker; the encoder here counts characters, spaces and full stops."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "text").filter("text IS NOT NULL")
    v = models.encoded(c, "text", "v", "counts", _encoder)
    return v.select("conv_id", "turn", *[F.get("v", F.lit(k)).alias(x) for k, x in enumerate("abc")])


_LOGITS = f"""w AS (SELECT doc_id, unnest({sql_tokens('text')}) AS word, generate_subscripts({sql_tokens('text')}, 1) AS position FROM documents),
k AS (SELECT doc_id, position, left(word, 5) AS token FROM w UNION ALL SELECT doc_id, position, '##' || substr(word, 6) FROM w WHERE length(word) > 5 UNION ALL SELECT DISTINCT doc_id, 0, '[CLS]' FROM w),
lg AS (SELECT doc_id, token, round(('0x' || substr(md5('logit|' || token || (position % 50)), 1, 8))::BIGINT / 4294967296.0 * 6 - 3, 6) AS logit FROM k)"""


def _logits(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("p", "word")).select("doc_id", (F.col("p") + 1).alias("position"), "word")
    pieces = w.select("doc_id", "position", F.left("word", F.lit(5)).alias("token")).unionByName(w.filter(F.length("word") > 5).select("doc_id", "position", F.concat(F.lit("##"), F.substring("word", 6, MANY)).alias("token")))
    pieces = pieces.unionByName(w.select("doc_id").distinct().select("doc_id", F.lit(0).alias("position"), F.lit("[CLS]").alias("token")))
    return pieces.withColumn("logit", F.round(M.fraction(F.concat("token", (F.col("position") % 50).cast("string")), "logit") * 6 - 3, 6))


@query(f"""WITH {_LOGITS}, m AS (SELECT doc_id, token, ln(1 + greatest(max(logit), 0)) AS w FROM lg GROUP BY doc_id, token HAVING w > 0), o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) <= 200),
b AS (SELECT doc_id, replace(token, '#', '') AS token, w FROM o WHERE token NOT LIKE '[%') SELECT doc_id, token, round(max(w), 6) AS weight FROM b WHERE token <> '' GROUP BY doc_id, token""")
def sparse_encode(spark, d):
    """Token weights pooled over positions from logits of word pieces."""
    return sparse.pooled(_logits(spark, d)).select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query("""SELECT 'f' || item_id AS path, 0 AS block, 'q' || item_id AS head, trim(replace(text, chr(10), ' ')) AS body FROM benchmark UNION ALL SELECT 'f' || item_id, 1, 'r' || item_id, 'second' FROM benchmark""")
def line_blocks(spark, d):
    """Blocks of files' lines by a table function with state; the same blocks as ``chain_block_parse`` reads."""
    files = t(spark, d, "benchmark").select(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("path"), F.expr(_BLOCKS).alias("content"))
    lines = files.select("path", F.posexplode(F.split("content", "\\n")).alias("line_no", "line"))
    return blocks(lines, "QID")
