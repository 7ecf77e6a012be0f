"""Queries over ingestion, indexing and retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.scoring import cosine, jaccard
from ravelin.functions.text import tokens
from ravelin.operators import retrieval as R
from ravelin.operators.similarity import best_matches, indel_ratio, near_duplicates, set_classes, shingle_sets, similar_sets
from ravelin.operators.vectors import VectorIndex
from ravelin.plans.base import query, sql_tokens, t
from ravelin.sources.index import SORTED, LexicalIndex
from ravelin.storage import new_path, written

TOP = 20


def bench(spark, d):
    """Benchmark items as queries."""
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


_INDEXES: dict[tuple, LexicalIndex] = {}


def index(spark, d) -> LexicalIndex:
    """The documents' lexical index, built once in an application and anew where the documents' files have changed."""
    key, source = (spark.sparkContext.applicationId, d), f"{d}/documents.parquet"
    held = _INDEXES.get(key)
    if held is None or not held.fresh(source):
        if held is not None:
            held.delete()
        _INDEXES[key] = LexicalIndex(spark, new_path(spark, "lexical-index")).create(t(spark, d, "documents"), source=source)
    return _INDEXES[key]


def hits(spark, d, k=TOP):
    """The hits of benchmark items, written, so that what reads them twice doesn't search twice; they are broadcast to what
    they are joined with, if their number allows."""
    return R.bounded(written(R.lexical(index(spark, d), R.query_terms(bench(spark, d), F.col("q")), k), "hits"))


BM25 = f"""
bq AS (SELECT item_id AS query_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark),
tk AS (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents),
cs AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tk),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM po JOIN bq USING (term) JOIN dfs USING (term), cs GROUP BY query_id, doc_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= {TOP})"""


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM hits")
def bm25_topk(spark, d):
    return hits(spark, d)


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM hits")
def bounded_topk(spark, d):
    """The same hits from the blocks of documents that can hold them."""
    terms = R.query_terms(bench(spark, d), F.col("q"))
    return R.ranked(index(spark, d).top(terms, TOP, R.near_terms(terms)).withColumn("score", F.round("score", 6)), TOP)


@query(f"""WITH {BM25.replace('FROM documents', "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN source || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 2)")} SELECT query_id, doc_id, score, rank FROM hits""")
def maintained_topk(spark, d):
    """Hits of an index to which batches were added, some documents again with another text, and from which some were
    removed."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source")
    held = LexicalIndex(spark, new_path(spark, "maintained-index")).create(docs.filter("doc_id % 2 = 0"), buckets=8)
    held.add(docs.filter("doc_id % 2 = 1 AND doc_id % 5 <> 1"))
    held.remove(docs.filter("doc_id % 7 = 2"))
    held.add(docs.filter("doc_id % 5 = 1 AND doc_id % 7 <> 2").withColumn("text", F.concat("source", F.lit(" "), "text")))
    return R.lexical(held, R.query_terms(bench(spark, d), F.col("q")), TOP)


@query(f"""WITH {BM25}, m AS (SELECT h.query_id, bool_or(contains(lower(d.text), lower(g.a))) AS found
  FROM hits h JOIN documents d USING (doc_id) JOIN (SELECT item_id, text AS a FROM benchmark) g ON g.item_id = h.query_id WHERE rank <= 5 GROUP BY h.query_id)
SELECT count(*) AS questions, round(avg(CAST(coalesce(found, false) AS INT)), 6) AS recall FROM benchmark LEFT JOIN m ON item_id = query_id""")
def answer_support_recall(spark, d):
    gold = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("a"))
    top = hits(spark, d, 5).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").join(R.bounded(gold), "query_id")
    found = top.groupBy("query_id").agg(F.max(F.contains(F.lower("text"), F.lower("a"))).alias("found"))
    return gold.join(found, "query_id", "left").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce("found", F.lit(False)).cast("int")), 6).alias("recall"))


_ID = "substr(sha256(source || ' ' || text), 1, 32)"


@query(f"SELECT doc_id, {_ID} AS id FROM documents")
def doc_hash_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws(" ", "source", "text"), 256), 1, 32).alias("id"))


@query("SELECT sha256(text) AS doc_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def corpus_dedupe(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("doc_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""
WITH p AS (SELECT page_id, string_split(regexp_replace(html, '</p>|</h1>', chr(10), 'g'), chr(10)) AS ls FROM pages),
x AS (SELECT page_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS paragraph_index FROM p), y AS (SELECT page_id, paragraph_index, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS para FROM x)
SELECT page_id, paragraph_index, sha256(para) AS para_hash, paragraph_index = 0 AS is_abstract FROM y WHERE len(list_filter(regexp_split_to_array(para, '\\s+'), lambda w: w <> '')) > 10
""")
def html_paragraphs(spark, d):
    from ravelin.sources.corpus import html_paragraphs as paragraphs

    out = paragraphs(t(spark, d, "pages"), key="page_id", html="html")
    return out.select("page_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), F.sha2("paragraph_text", 256).alias("para_hash"), "is_abstract")


#: Terms in a larger share of the documents than one of so many are joined by broadcast, if no more than MANY_TERMS are.
SHARE, MANY_TERMS = 1000, 400_000


def sparse(spark, d, n=20):
    """The n weightiest terms of each document: log(1 + tf) times smoothed idf. Tasks are as many as the corpus needs, and
    frequent terms' postings, which would all come to one task, aren't shuffled to meet their terms' numbers."""
    held = index(spark, d)
    c = held.corpus()
    tf = held.postings().select("doc_id", "term", "tf")
    tasks = max(1, -(-c.N // SORTED))
    df = written(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    often = df.filter(F.col("df") * SHARE > c.N)
    weight = F.round(F.log1p("tf") * F.log(1 + F.lit(c.N) / F.col("df")), 6).alias("w")
    if often.limit(MANY_TERMS + 1).count() <= MANY_TERMS:
        told = tf.join(F.broadcast(often), "term", "left")
        few = told.filter("df IS NULL").drop("df").repartition(tasks, "term").join(df.filter(F.col("df") * SHARE <= c.N).repartition(tasks, "term"), "term")
        both = told.filter("df IS NOT NULL").select("doc_id", "term", weight).unionByName(few.select("doc_id", "term", weight))
    else:
        df = df.select(F.concat("term", F.lit("")).alias("__t"), "df")  # an exchange of its own, so that frequent terms' partitions can be split
        both = tf.join(df, F.col("term") == F.col("__t")).select("doc_id", "term", weight)
    return R.ranked(both.repartition(tasks, "doc_id"), n, key="doc_id", item="term", score="w").drop("rank")


SPARSE = f"""
stf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL),
sdf AS (SELECT term, count(*) AS df FROM stf GROUP BY term),
spw AS (SELECT doc_id, term, round(ln(1 + tf) * ln(1 + (SELECT count(*) FROM documents) / df), 6) AS w FROM stf JOIN sdf USING (term)),
sp AS (SELECT doc_id, term, w FROM spw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) <= 20)"""


@query(f"WITH {SPARSE} SELECT * FROM sp")
def sparse_encode_topn(spark, d):
    return sparse(spark, d)


def sparse_hits(spark, d):
    q = R.query_terms(bench(spark, d), F.col("q")).withColumn("qw", F.lit(1.0) + F.length("term") / 10)
    return R.ranked(R.sparse_dot(sparse(spark, d), q).withColumn("score", F.round("score", 7)), TOP)


SPARSE_HITS = f"""
sq AS (SELECT item_id AS query_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark),
ss AS (SELECT query_id, doc_id, round(sum(w * (1.0 + length(term)::DOUBLE / 10)), 7) AS score FROM sp JOIN sq USING (term) GROUP BY ALL),
sh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ss) WHERE rank <= {TOP})"""


@query(f"WITH {SPARSE}, {SPARSE_HITS} SELECT query_id, doc_id, score, rank FROM sh")
def sparse_dot_topk(spark, d):
    return sparse_hits(spark, d)


def dense_hits(spark, d, k=10):
    """Vectors whose id is divisible by 100 as queries, scored (1 + cosine) / 2 as engines score them."""
    e = t(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    # scores are rounded to 0.00001 of (1 + cosine) / 2; a query is its own neighbour
    s = R.knn(e, q, k + 1, slack=5e-5).filter("query_id <> vec_id")
    return R.ranked(s.select("query_id", F.col("vec_id").alias("doc_id"), F.round((1 + F.col("score")) / 2, 5).alias("score")), k)


DENSE = """
dq AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
ds AS (SELECT query_id, vec_id AS doc_id, round((1 + list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])) / 2, 5) AS score FROM embeddings, dq WHERE query_id <> vec_id),
dh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds) WHERE rank <= 10)"""


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM dh")
def dense_knn(spark, d):
    return dense_hits(spark, d)


@query(f"""
WITH {BM25}, {SPARSE}, {SPARSE_HITS}, {DENSE}, al AS (
  SELECT query_id, doc_id, 0.5 * score AS score FROM hits UNION ALL SELECT query_id, doc_id, 1.0 * score FROM sh UNION ALL SELECT query_id, doc_id, 2.0 * score FROM dh
), fu AS (SELECT query_id, doc_id, round(sum(score), 7) AS score FROM al GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fu) WHERE rank <= 10
""")
def hybrid_fusion(spark, d):
    arms = {"bm25": hits(spark, d), "splade": sparse_hits(spark, d), "hnsw": dense_hits(spark, d)}
    return R.ranked(R.fused(arms, {"bm25": 0.5, "splade": 1.0, "hnsw": 2.0}).withColumn("score", F.round("score", 7)), 10)


def _overlap(q, text):
    """A stand-in for a cross-encoder: share of a query's terms in the passage."""
    return F.round(F.size(F.array_intersect(tokens(q), tokens(text))) / F.size(F.array_distinct(tokens(q))), 6)


_SQL_OVERLAP = f"round(len(list_intersect({sql_tokens('q.q')}, {sql_tokens('d.text')}))::DOUBLE / len(list_distinct({sql_tokens('q.q')})), 6)"


def _with_text(spark, d, h):
    docs = t(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"))
    return h.join(docs, "doc_id").join(R.bounded(bench(spark, d)), "query_id")


@query(f"""
WITH {BM25}, q AS (SELECT item_id AS query_id, text AS q FROM benchmark),
r AS (SELECT h.query_id, h.doc_id, h.score, h.rank, CASE WHEN h.rank <= 10 THEN {_SQL_OVERLAP} END AS rerank_score FROM hits h JOIN documents d USING (doc_id) JOIN q USING (query_id))
SELECT query_id, doc_id, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_score, score) DESC, doc_id) AS final_rank FROM r
""")
def rerank_topk(spark, d):
    out = R.reranked(_with_text(spark, d, hits(spark, d)), _overlap(F.col("q"), F.col("text")), 10)
    return out.select("query_id", "doc_id", "score", "rerank_score", "final_rank")


@query(f"""
WITH {BM25} SELECT query_id, doc_id, score FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id, lower(trim(d.text)) ORDER BY score, h.doc_id DESC) AS n FROM hits h JOIN documents d USING (doc_id)) WHERE n = 1
""")
def hit_dedupe(spark, d):
    return R.deduped_hits(_with_text(spark, d, hits(spark, d))).select("query_id", "doc_id", "score")


@query(f"""
WITH {BM25} SELECT query_id, d.source AS title, min(rank) AS position, max_by(h.doc_id, rank) AS doc_id FROM hits h JOIN documents d USING (doc_id) GROUP BY query_id, d.source
""")
def title_search(spark, d):
    h = _with_text(spark, d, hits(spark, d))
    return h.groupBy("query_id", "title").agg(F.min("rank").alias("position"), F.max_by("doc_id", "rank").alias("doc_id"))


@query(f"WITH {BM25} SELECT query_id, h.doc_id, score, rank FROM hits h JOIN documents d USING (doc_id) WHERE lower(trim(d.source)) IN ('src0', 'src1', 'src2', 'src3')")
def title_post_filter(spark, d):
    allowed = spark.createDataFrame([(" SRC0",), ("src1 ",), ("Src2",), ("src3",)], "title string")
    return R.title_filtered(_with_text(spark, d, hits(spark, d)), allowed).select("query_id", "doc_id", "score", "rank")


_MATCH = f"CAST(d.source = 'src' || (h.query_id % 20) AS INT) + {_SQL_OVERLAP}"


@query(f"""
WITH {BM25}, q AS (SELECT item_id AS query_id, text AS q FROM benchmark),
m AS (SELECT h.query_id, h.doc_id, round({_MATCH}, 6) AS s FROM hits h JOIN documents d USING (doc_id) JOIN q USING (query_id))
SELECT query_id, CASE WHEN s >= 1.5 THEN doc_id END AS doc_id, s AS match_score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) = 1
""")
def best_paragraph_match(spark, d):
    h = _with_text(spark, d, hits(spark, d))
    score = F.round((F.col("title") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).cast("int") + _overlap(F.col("q"), F.col("text")), 6)
    return best_matches(h, score, 1.5)


_SHINGLED = """s0 AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) END AS sh
           FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), ' ') AS w FROM documents))"""


@query(f"WITH {_SHINGLED} SELECT doc_id, min(doc_id) OVER (PARTITION BY sh) AS representative, count(*) OVER (PARTITION BY sh) AS members FROM s0")
def near_duplicate_classes(spark, d):
    """Which document stands for a document's equals in ``near_duplicate_pairs``."""
    out = set_classes(shingle_sets(t(spark, d, "documents")))
    return out.select(F.col("id").alias("doc_id"), "representative", "members")


@query(f"""
WITH {_SHINGLED}, s AS (SELECT min(doc_id) AS doc_id, sh FROM s0 GROUP BY sh),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(c::DOUBLE / (na + nb - c), 6) AS similarity FROM p WHERE c::DOUBLE / (na + nb - c) >= 0.8
""")
def near_duplicate_pairs(spark, d):
    return near_duplicates(t(spark, d, "documents"))


@query(f"""
WITH s AS (SELECT min(id) AS id, ts FROM (SELECT conv_id * 100 + turn AS id, list_sort(list_distinct({sql_tokens('text')})) AS ts FROM conversations) GROUP BY ts)
SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.ts, b.ts))::DOUBLE / len(list_distinct(list_concat(a.ts, b.ts))), 6) AS similarity
FROM s a JOIN s b ON a.id < b.id WHERE len(list_intersect(a.ts, b.ts))::DOUBLE / len(list_distinct(list_concat(a.ts, b.ts))) >= 0.25
""")
def jaccard_pairs(spark, d):
    """Turns that share a quarter of their words."""
    s = t(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.array_distinct(tokens(F.col("text"))).alias("ts"))
    return similar_sets(s, 0.25)


@query(f"""
WITH {BM25}, tt AS (SELECT h.query_id, h.doc_id, round(greatest(2.0 * CAST(list_contains(bt.ts, d.lang) AS INT), score), 6) AS score
  FROM hits h JOIN documents d USING (doc_id) JOIN (SELECT item_id, {sql_tokens('text')} AS ts FROM benchmark) bt ON bt.item_id = h.query_id)
SELECT query_id, doc_id, score FROM tt
""")
def best_fields_boost(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select("doc_id", F.col("lang").alias("title")), "doc_id").join(R.bounded(bench(spark, d)), "query_id")
    title = 2.0 * F.array_contains(tokens(F.col("q")), F.col("title")).cast("int")
    return h.select("query_id", "doc_id", F.round(F.greatest(title, "score"), 6).alias("score"))


@query(f"""
WITH {BM25} SELECT h.query_id, h.doc_id, round(0.3 * h.score + 0.7 * (1 + list_cosine_similarity(v.embedding::DOUBLE[], qv.embedding::DOUBLE[])), 5) AS score
FROM hits h JOIN embeddings v ON v.vec_id = h.doc_id JOIN embeddings qv ON qv.vec_id = h.query_id
""")
def bm25_gated_hybrid(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    h = hits(spark, d).join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(q, "query_id")
    return h.select("query_id", "doc_id", F.round(0.3 * F.col("score") + 0.7 * (1 + cosine(F.col("embedding"), F.col("q"))), 5).alias("score"))


@query("""
SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) + 1.0, 5) AS score
FROM embeddings, (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0)
""")
def exact_script_knn(spark, d):
    e = t(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.knn(e, q).select("query_id", F.col("vec_id").alias("doc_id"), F.round(F.col("score") + 1.0, 5).alias("score"))


@query("SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % 100 = 0")
def approximate_knn(spark, d):
    """Whether a search of the nearest cells finds nine of ten of the ten nearest vectors that a full search finds."""
    e = t(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = VectorIndex(spark, new_path(spark, "vector-index")).create(e).search(q, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = R.knn(e, q.withColumnRenamed("embedding", "q"), 10).select("query_id", "vec_id")
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("recalled"))


@query("SELECT doc_id, source AS paragraph_type FROM documents WHERE source IN ('src1', 'src2') OR source IS NULL OR source = ''")
def paragraph_type_filter(spark, d):
    c = F.col("source")
    return t(spark, d, "documents").filter(c.isin("src1", "src2") | c.isNull() | (c == "")).select("doc_id", c.alias("paragraph_type"))


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score + 0.5 * CAST(doc_id % 10 = 0 AS INT), 6) AS score FROM hits")
def paragraph_index_boost(spark, d):
    return hits(spark, d).select("query_id", "doc_id", F.round(F.col("score") + 0.5 * (F.col("doc_id") % 10 == 0).cast("int"), 6).alias("score"))


@query()
def string_ratios(spark, d):
    """Indel ratios, plain and with sorted tokens, of each benchmark item to its best hit."""
    top = hits(spark, d, 1).join(t(spark, d, "documents").select("doc_id", F.col("text").alias("x")), "doc_id")
    return top.join(R.bounded(bench(spark, d)), "query_id").select("query_id", indel_ratio(F.col("q"), F.col("x")).alias("ratio"), indel_ratio(F.array_join(F.array_sort(tokens(F.col("q"))), " "), F.array_join(F.array_sort(tokens(F.col("x"))), " ")).alias("token_sort_ratio"))
