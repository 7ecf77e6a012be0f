"""Queries over routing state, iterative retrieval and dataset construction."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions import scoring as S
from ravelin.functions.text import first_sentence, normalize_answer, tokens
from ravelin.operators import retrieval as R
from ravelin.operators import routing as O
from ravelin.operators import sampling as M
from ravelin.operators import search as H
from ravelin.plans.base import ANSWERS, MANY, answers, query, sql_norm, sql_tokens, sql_words, t
from ravelin.plans.evaluation import ROUTING, routing
from ravelin.plans.retrieval import BM25, TOP, bench, hits, index


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def resume_anti_join(spark, d):
    e = t(spark, d, "events")
    return O.unprocessed(e, e.filter("event_id % 3 = 0"), "event_id").select("event_id", "event_type")


@query("""WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT vec_id * 3 AS doc_id FROM embeddings) SELECT doc_id, 'missing' AS status FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)
UNION ALL SELECT doc_id, 'extra' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""")
def completeness_check(spark, d):
    return O.completeness(t(spark, d, "documents"), t(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("doc_id")), "doc_id")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    return O.last_write(t(spark, d, "events"), "user_id", F.col("event_id"), ["event_type", "value"])


@query("SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.o ELSE c.c_mktsegment END AS c_mktsegment FROM customer c FULL JOIN (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS o FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1) n ON c.c_custkey = n.c_custkey")
def upsert_merge(spark, d):
    new = t(spark, d, "orders").filter("o_custkey % 4 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return O.upsert(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), new, "c_custkey", ["c_mktsegment"])


@query(f"WITH {ROUTING} SELECT r.event_id, CASE WHEN cascaded AND e.event_id % 2 = 0 THEN 'hard ' || e.event_type ELSE e.event_type END AS answer, cascaded FROM ro r JOIN events e USING (event_id)")
def cascade_merge(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("event_type").alias("answer"))
    direct = routing(spark, d).select("event_id", "cascaded").join(e, "event_id")
    hard = e.filter("event_id % 2 = 0").select("event_id", F.concat(F.lit("hard "), "answer").alias("answer"))
    return O.cascade(direct, hard, "event_id", "answer", F.col("cascaded"))


@query(f"WITH {ROUTING} SELECT initial_action, final_action, event_id, round(confidence, 4) AS confidence FROM ro QUALIFY row_number() OVER (PARTITION BY initial_action, final_action ORDER BY event_id) <= 3")
def route_examples(spark, d):
    from ravelin.operators.reports import first_rows

    return first_rows(routing(spark, d), 3, ["initial_action", "final_action"], F.asc("event_id")).select("initial_action", "final_action", "event_id", F.round("confidence", 4).alias("confidence"))


_BLOCKS = "'QID: q' || item_id || chr(10) || replace(text, chr(10), ' ') || chr(10) || chr(10) || 'QID: r' || item_id || chr(10) || 'second'"


@query("""SELECT 'q' || item_id AS question_id, trim(replace(text, chr(10), ' ')) AS chain FROM benchmark UNION ALL SELECT 'r' || item_id, 'second' FROM benchmark""")
def chain_block_parse(spark, d):
    b = t(spark, d, "benchmark").select(F.explode(F.split(F.expr(_BLOCKS), r"\n\n")).alias("b"))
    return b.select(F.regexp_extract("b", r"^QID: *([^\n]*)", 1).alias("question_id"), F.trim(F.regexp_extract("b", r"(?s)^[^\n]*\n(.*)$", 1)).alias("chain"))


def _retrieve(spark, d, k):
    held = index(spark, d)
    return lambda q: R.lexical(held, R.query_terms(q, F.col("q")), k)


_SENTENCE = "coalesce(nullif(regexp_extract(d.text, '(?s)^(.*?[.!?])\\s', 1), ''), d.text)"
_HOP2 = BM25.replace("bq AS (SELECT item_id AS query_id, unnest(list_distinct(" + sql_tokens("text") + ")) AS term FROM benchmark)", "XX")


def _second(sql):
    """The lexical query's clauses under other names, over the queries of the second hop."""
    body = sql.replace("XX", f"bq2 AS (SELECT query_id, unnest(list_distinct({sql_tokens(_SENTENCE)})) AS term FROM hits h JOIN documents d USING (doc_id) WHERE rank = 1)")
    for name in ("hits", "po", "dfs", "sc", "tk", "cs"):
        for a, b in ((f"{name} AS", f"{name}2 AS"), (f"FROM {name} ", f"FROM {name}2 "), (f"FROM {name})", f"FROM {name}2)"), (f"JOIN {name} ", f"JOIN {name}2 "), (f", {name} GROUP", f", {name}2 GROUP")):
            if not (name == "hits" and a == "FROM hits "):
                body = body.replace(a, b)
    return body.replace("SELECT term FROM bq)", "SELECT term FROM bq2)").replace("JOIN bq USING", "JOIN bq2 USING")


@query(f"""WITH {BM25}, {_second(_HOP2)} SELECT query_id, doc_id, min(hop) AS hop FROM (SELECT query_id, doc_id, 1 AS hop FROM hits WHERE rank <= 8 UNION ALL SELECT query_id, doc_id, 2 FROM hits2 WHERE rank <= 8) GROUP BY 1, 2""")
def two_hop_retrieval(spark, d):
    docs = t(spark, d, "documents")
    follow = lambda top: top.join(docs.select("doc_id", "text"), "doc_id").select("query_id", first_sentence(F.col("text")).alias("q"))
    return H.hops(bench(spark, d), _retrieve(spark, d, 8), follow, 2).select("query_id", "doc_id", "hop")


@query(f"""WITH {BM25}, x AS (SELECT query_id, d.text, rank AS pos, 0.6 AS score, 1 AS held FROM hits JOIN documents d USING (doc_id) WHERE rank <= 8
UNION ALL SELECT query_id, d.text, rank, score / 20, 0 FROM hits JOIN documents d USING (doc_id) WHERE rank > 5),
o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(text)) ORDER BY held DESC, pos) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, held DESC, pos) AS rank FROM o)
SELECT query_id, pos, held, rank FROM r WHERE rank <= 10""")
def rolling_eviction(spark, d):
    h = hits(spark, d).join(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", F.col("rank").alias("pos"), "text", (F.col("score") / 20).alias("score"))
    return O.rolling_eviction(h.filter("pos <= 8"), h.filter("pos > 5"), "query_id", 10).select("query_id", "pos", "held", "rank")


@query("""SELECT conv_id, string_agg(repeat(' ', 4 * (turn % 3)::INT) || CASE role WHEN 'user' THEN 'Q: ' WHEN 'assistant' THEN 'A: ' ELSE 'O: ' END || text, chr(10) ORDER BY turn) AS trace FROM conversations GROUP BY conv_id""")
def trace_print(spark, d):
    mark = F.when(F.col("role") == "user", "Q: ").when(F.col("role") == "assistant", "A: ").otherwise("O: ")
    line = F.concat(F.repeat(F.lit(" "), (4 * (F.col("turn") % 3)).cast("int")), mark, "text")
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x.line), "\n").alias("trace"))


@query("SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS last_question, max_by(text, turn) FILTER (WHERE role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id")
def trace_last(spark, d):
    last = lambda r: F.max_by(F.when(F.col("role") == r, F.col("text")), F.when(F.col("role") == r, F.col("turn")))
    return t(spark, d, "conversations").groupBy("conv_id").agg(last("user").alias("last_question"), last("assistant").alias("last_answer"))


@query("SELECT source || ' ' || left(text, 20) AS key, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def context_key_dedupe(spark, d):
    return t(spark, d, "documents").groupBy(F.concat("source", F.lit(" "), F.left("text", F.lit(20))).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, place FROM p WHERE n <= 40 OR place <= 15 OR place > n - 15")
def head_tail_select(spark, d):
    return O.head_tail(t(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 15, 40).select("source", "doc_id", "place")


_WS = "list_distinct(string_split(lower({}), ' '))"


@query(f"""WITH {BM25}, h AS (SELECT query_id, rank, d.source, {_WS.format('d.text')} AS w FROM hits JOIN documents d USING (doc_id) WHERE rank <= 5), q AS (SELECT item_id AS query_id, {_WS.format('text')} AS qw FROM benchmark),
j AS (SELECT a.query_id, a.rank, max(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w)))) AS mj, bool_and(a.source <> b.source) AS fresh FROM h a JOIN h b ON a.query_id = b.query_id AND b.rank < a.rank GROUP BY 1, 2)
SELECT h.query_id, h.rank, round(0.7 * least(len(list_intersect(qw, w))::DOUBLE / len(qw), 1) + 0.3 * CASE WHEN mj IS NULL THEN 1 ELSE 0.4 * CASE WHEN fresh THEN 1 ELSE 0.3 END + 0.6 * (1 - mj) END, 6) AS gain FROM h JOIN q USING (query_id) LEFT JOIN j ON j.query_id = h.query_id AND j.rank = h.rank""")
def mi_gain(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    h = hits(spark, d, 5).join(docs, "doc_id").select("query_id", "rank", "source", "w")
    b = h.select(F.col("query_id").alias("bq"), F.col("rank").alias("br"), F.col("source").alias("bs"), F.col("w").alias("bw"))
    seen = h.join(b, (F.col("query_id") == F.col("bq")) & (F.col("br") < F.col("rank"))).groupBy("query_id", "rank").agg(F.max(S.jaccard(F.col("w"), F.col("bw"))).alias("mj"), F.bool_and(F.col("source") != F.col("bs")).alias("fresh"))
    q = R.bounded(bench(spark, d).select("query_id", F.array_distinct(F.split(F.lower("q"), " ")).alias("qw")))
    out = h.join(seen, ["query_id", "rank"], "left").join(q, "query_id")
    relevance = F.least(F.size(F.array_intersect("qw", "w")) / F.size("qw"), F.lit(1.0))
    return out.select("query_id", "rank", F.round(H.gain(relevance, F.col("fresh"), F.col("mj")), 6).alias("gain"))


_HALF = "len(string_split(b.text, ' ')) // 2"
_PLAN = f"{sql_words('b.text', 1, _HALF)} || ' -> ' || {sql_words('b.text', _HALF + ' + 1', MANY)} || ' -> ' || d.source"
_PARTS = f"list_transform(string_split(lower({_PLAN}), '->'), lambda p: list_distinct(list_filter(regexp_split_to_array(trim(p), '\\s+'), lambda w: w <> '')))"


@query(f"""SELECT doc_id, len(list_filter({_PARTS}, lambda ws: len(ws) > 0 AND len(list_intersect(ws, list_distinct(regexp_split_to_array(lower(d.text), '\\s+')))) >= greatest(1, len(ws) // 2))) AS covered FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id""")
def plan_coverage(spark, d):
    b = t(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("b"))
    x = t(spark, d, "documents").join(R.bounded(b), F.col("doc_id") % b.count() == F.col("item_id"))
    half = F.floor(F.size("b") / 2).cast("int")
    plan = F.concat(F.array_join(F.slice("b", F.lit(1), half), " "), F.lit(" -> "), F.array_join(F.slice("b", half + 1, F.size("b")), " "), F.lit(" -> "), F.col("source"))
    return x.select("doc_id", H.covered(plan, F.col("text")).cast("long").alias("covered"))


_LAST = "CASE turn % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'So the answer is ' || text ELSE text END"


@query(f"SELECT conv_id, turn, trim(s) = '' OR turn >= 5 OR regexp_matches(s, '(?i)answer is') AS exits FROM (SELECT conv_id, turn, {_LAST} AS s FROM conversations)")
def exit_controller(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", H.exits(F.expr(_LAST), F.col("turn"), 5).alias("exits"))


@query("""WITH s AS (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS xs FROM lineitem GROUP BY 1), h AS (SELECT l_orderkey, CASE WHEN list_contains(xs, 'RF') THEN xs ELSE list_prepend('RF', xs) END AS held, list_filter(xs, lambda x: x <> 'RF') AS rest FROM s)
SELECT l_orderkey, array_to_string(held, ',') AS no_op, array_to_string(list_prepend('RF', rest), ',') AS top, array_to_string(list_append(rest, 'RF'), ',') AS bottom FROM h""")
def pin_reorder(spark, d):
    """The lines of each order, a few, with one pinned."""
    xs = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("x"))))
    s = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(xs, lambda x: x.x).alias("xs"))
    return s.select("l_orderkey", *[F.array_join(O.pinned(F.col("xs"), F.lit("RF"), p), ",").alias(p) for p in ("no_op", "top", "bottom")])


@query(f"""WITH {BM25}, b AS (SELECT query_id, doc_id, rank, score, 1 AS depth FROM hits WHERE rank <= 3) SELECT query_id, doc_id, rank AS place FROM b""")
def beam_prune(spark, d):
    return hits(spark, d, 3).select("query_id", "doc_id", F.col("rank").alias("place"))


_HASH = "md5('42|' || {})"


@query(f"""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, d.source FROM documents d JOIN s ON s.source = d.source QUALIFY row_number() OVER (PARTITION BY d.source ORDER BY {_HASH.format('doc_id')}) <= 130 // k + CAST(i <= 130 % k AS INT)""")
def stratified_sample(spark, d):
    return M.stratified(t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 130)


@query("""WITH c AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, unnest(range(0, (greatest(300, n) - 1 - i) // n + 1))::INT AS copy FROM c""")
def oversample(spark, d):
    return M.oversampled(t(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 300)


@query(f"SELECT doc_id, CASE WHEN ('0x' || substr({_HASH.format('doc_id')}, 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents")
def hash_split(spark, d):
    return M.split(t(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT source, doc_id FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 5 IN (1, 3)")
def nth_of_k_sample(spark, d):
    return M.nth_of(t(spark, d, "documents").select("source", "doc_id"), "doc_id", 5, [1, 3], "source")


@query("""SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS contexts FROM (SELECT d.source, d.doc_id, coalesce(l.quality, 0) = 1 AS s, bool_or(coalesce(l.quality, 0) = 1) OVER (PARTITION BY d.source, d.lang) AS a, d.lang
FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE s OR NOT a GROUP BY source""")
def gold_context_or_all(spark, d):
    """Supporting contexts of each question (a source and language), all of them where none supports."""
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    q = x.groupBy("source", "lang").agg(F.collect_list(F.struct("doc_id", (F.coalesce("quality", F.lit(0)) == 1).alias("s"))).alias("c"))
    kept = F.filter("c", lambda x: x.s)
    q = q.select("source", F.explode(F.when(F.size(kept) == 0, F.col("c")).otherwise(kept)).alias("x")).groupBy("source").agg(F.array_sort(F.collect_list("x.doc_id")).alias("ids"))
    return q.select("source", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("contexts"))


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS used FROM conversations) WHERE used <= 1500")
def fit_budget(spark, d):
    return M.within_budget(t(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 1500).select("conv_id", "turn", "used")


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<q> ' ELSE '<a> ' END || text, ' ' ORDER BY turn) AS chain FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def reasoning_chain_text(spark, d):
    part = F.concat(F.when(F.col("role") == "user", "<q> ").otherwise("<a> "), "text")
    x = F.array_sort(F.collect_list(F.struct("turn", part.alias("p"))))
    return t(spark, d, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(F.array_join(F.transform(x, lambda y: y.p), " ").alias("chain"))


@query(f"WITH {ANSWERS} SELECT question_id, '### Question: ' || question || chr(10) || '### Action: ' || action AS text FROM qa")
def sft_text(spark, d):
    return answers(spark, d).select("question_id", F.concat(F.lit("### Question: "), "question", F.lit("\n### Action: "), "action").alias("text"))


@query("SELECT doc_id, array_to_string(list_sort(list_transform(range(0, 5), lambda i: md5('n|' || doc_id || '|' || i)))[1:3], ',') AS negatives FROM documents")
def sampled_negatives(spark, d):
    x = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.md5(F.concat(F.lit("n|"), F.col("doc_id").cast("string"), F.lit("|"), i.cast("string")).cast("binary")))
    return t(spark, d, "documents").select("doc_id", F.array_join(F.slice(F.array_sort(x), 1, 3), ",").alias("negatives"))


@query("SELECT question_id, action, predicted FROM (SELECT conv_id AS question_id, 'forced' AS action, 'S-Dense' AS predicted FROM conversations WHERE turn = 0)")
def forced_strategy(spark, d):
    return t(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("question_id"), F.lit("forced").alias("action"), F.lit("S-Dense").alias("predicted"))


@query("SELECT event_type, greatest(600.0, round(count(*) * CASE event_type WHEN 'error' THEN 300 ELSE 20 END / (12 * 0.7) * 1.5, 4)) AS seconds FROM events GROUP BY event_type")
def timeout_estimate(spark, d):
    each = F.when(F.col("event_type") == "error", 300).otherwise(20)
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.greatest(F.lit(600.0), F.round(F.col("n") * each / (12 * 0.7) * 1.5, 4)).alias("seconds"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    """Beyond the questions: tumbling windows of the event stream; streaming/events.py runs the same as a stream."""
    from ravelin.streaming.events import tumbling

    return tumbling(t(spark, d, "events"), "1 hour")
