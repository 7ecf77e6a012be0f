"""Tree search that retrieves: each node is a query and the documents that it found, a path is what a question knows so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.operators.retrieval import bounded
from ravelin.operators.search import gain
from ravelin.storage import written

#: asks (query_id, q), hits wanted -> (query_id, doc_id, rank).
Retrieve = Callable[[DataFrame, int], DataFrame]
#: Share of a plan's parts that ends a path.
COVERED = 0.7
NODE = ["question_id", "node", "q", "score", "depth", "docs"]


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def plan_parts(plan: Column) -> Column:
    return F.transform(F.split(F.lower(F.coalesce(plan, F.lit(""))), "->"), lambda p: F.trim(p))


def _known(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, title, words) of the documents that were found, one row each; no others are grouped or split into words."""
    some = docs.join(bounded(written(ids.distinct(), "ids")), "doc_id", "left_semi")
    one = some.groupBy("doc_id").agg(F.max(F.struct(F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("text", F.lit("")).alias("text"))).alias("d"))
    return one.select("doc_id", "d.title", words(F.col("d.text")).alias("words"))


def _with_docs(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each document of each node's path, with its place, title and words."""
    return nodes.select("question_id", "node", F.posexplode("docs").alias("pos", "doc_id")).join(held, "doc_id")


def answerable(nodes: DataFrame, questions: DataFrame, held: DataFrame, depth: int) -> DataFrame:
    """nodes with ``done``: below the root, with two documents, and at the depth before the last or with enough parts of
    the plan covered: half of a part's words, one at least, stand in the path's documents."""
    known = questions.select("question_id", plan_parts(F.col("plan")).alias("parts"))
    flat = known.select("question_id", F.array_distinct(F.flatten(F.transform("parts", words))).alias("plan_words"))
    met = _with_docs(nodes, held).join(flat, "question_id").groupBy("question_id", "node").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("plan_words", "words")))).alias("met"))
    told = nodes.join(known, "question_id").join(met, ["question_id", "node"], "left")
    met_ = F.coalesce("met", F.array().cast("array<string>"))
    enough = lambda ws: (F.size(ws) > 0) & (F.size(F.array_intersect(ws, met_)) >= F.greatest(F.lit(1), F.floor(F.size(ws) / 2)))
    covered = F.size(F.filter("parts", lambda p: enough(words(p)))) >= F.size("parts") * COVERED
    done = (F.col("depth") >= 1) & (F.size("docs") >= 2) & ((F.col("depth") >= depth - 1) | ((F.size("parts") > 1) & covered))
    return told.withColumn("done", done).select(*NODE, "done")


def candidate_queries(nodes: DataFrame, questions: DataFrame, held: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(question_id, node, place, cq): what an open node asks next, ``most`` queries that its question hasn't asked: parts
    of the plan, then titles of its first five documents with each of the question's first three words of over three
    letters."""
    own = nodes.select("question_id", "node").join(questions, "question_id")
    parts = own.select("question_id", "node", F.lit(0).alias("kind"), F.posexplode(plan_parts(F.col("plan"))).alias("a", "cq")).withColumn("b", F.lit(0))
    long = F.slice(F.filter(F.split(F.lower("question"), r"\s+"), lambda w: F.length(w) > 3), 1, 3)
    titles = _with_docs(nodes, held).filter("pos < 5 AND title <> ''").groupBy("question_id", "node", "title").agg(F.min("pos").alias("a"))
    combos = titles.join(own.select("question_id", "node", F.posexplode(long).alias("b", "w")), ["question_id", "node"])
    combos = combos.select("question_id", "node", F.lit(1).alias("kind"), "a", F.lower(F.concat("title", F.lit(" "), "w")).alias("cq"), "b")
    new = parts.unionByName(combos).filter(F.length("cq") >= 2).join(asked, ["question_id", "cq"], "left_anti")
    first = new.withColumn("__n", F.row_number().over(W.partitionBy("question_id", "node", "cq").orderBy("kind", "a", "b"))).filter("__n = 1")
    place = F.row_number().over(W.partitionBy("question_id", "node").orderBy("kind", "a", "b"))
    return first.withColumn("place", place).filter(F.col("place") <= most).select("question_id", "node", "place", "cq")


def tree_search(questions: DataFrame, retrieve: Retrieve, docs: DataFrame, width: int = 3, depth: int = 4, branches: int = 3, first: int = 8, hits: int = 5) -> DataFrame:
    """questions (question_id: string, question, plan: "a -> b") over docs (doc_id, title, text) -> the beams at the end:
    question_id, node, q, score, depth, docs, done, place (1 is best).

    The root retrieves with the question. In each round all questions' open nodes ask ``branches`` new queries each; a
    query that finds something is a child, whose score is its parent's and the mean gain of what it found: relevance to the
    question, and novelty against the documents of the path. Finished nodes compete with children for ``width`` places;
    ties go to the lesser node. A question without either keeps its beam, and all rounds end when no node is open. Paths
    hold document ids; what is compared is joined from docs, for the documents of a beam only.

    * null question or plan: empty. A question that finds nothing has a root without documents.
    * questions of one id are one, docs of one id are one; no questions, no rows.
    """
    questions = written(questions.groupBy("question_id").agg(*[F.coalesce(F.max(c), F.lit("")).alias(c) for c in ("question", "plan")]), "questions")
    def found(asks: DataFrame, k: int) -> DataFrame:
        got = retrieve(asks.select("query_id", "q"), k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("new"))
        return asks.join(got, "query_id", "left").withColumn("new", F.coalesce("new", F.array().cast("array<bigint>")))

    root = found(questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("q")), first)
    beam = root.select(F.col("query_id").alias("question_id"), F.lit("0").alias("node"), "q", F.lit(0.0).alias("score"), F.lit(0).alias("depth"), F.col("new").alias("docs"))
    asked = questions.select("question_id", F.lower("question").alias("cq"))
    beam = written(beam, "roots")
    held = written(_known(docs, beam.select(F.explode("docs").alias("doc_id"))), "tree-docs")
    beam = written(answerable(beam, questions, held, depth), "beam")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("node"))
    for level in range(1, depth + 1):
        open_ = beam.filter("NOT done")
        if open_.isEmpty():
            break
        queries = written(candidate_queries(open_, questions, held, asked, branches), "candidates")
        asked = written(asked.unionByName(queries.select("question_id", "cq")).distinct(), "asked")
        asks = queries.select("question_id", "node", F.concat("node", F.lit("."), "place").alias("child"), F.col("cq").alias("q")).withColumn("query_id", F.concat("question_id", F.lit("|"), "child"))
        children = written(found(asks, hits).filter(F.size("new") > 0), "children")
        fresh = children.select(F.explode("new").alias("doc_id")).join(held.select("doc_id"), "doc_id", "left_anti")
        held = written(held.unionByName(_known(docs, fresh)), "tree-docs")
        scored = _gains(children, open_, questions, held)
        grown = children.join(scored, "query_id").join(open_.select("question_id", "node", F.col("score").alias("before"), F.col("docs").alias("path")), ["question_id", "node"])
        grown = grown.select("question_id", F.col("child").alias("node"), "q", F.round(F.col("before") + F.col("gain"), 6).alias("score"), F.lit(level).alias("depth"), F.concat("path", "new").alias("docs"))
        both = beam.filter("done").select(*NODE).unionByName(grown)
        stuck = beam.select(*NODE).join(both.select("question_id").distinct(), "question_id", "left_anti")
        best = both.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= width).drop("__n")
        beam = written(answerable(written(best.unionByName(stuck), "pruned"), questions, held, depth), "beam")
    return beam.withColumn("place", F.row_number().over(order).cast("long"))


def _gains(children: DataFrame, parents: DataFrame, questions: DataFrame, held: DataFrame) -> DataFrame:
    """(query_id, gain): mean gain of the documents that each child found."""
    new = children.select("query_id", "question_id", "node", F.posexplode("new").alias("at", "doc_id")).join(held, "doc_id")
    path = _with_docs(parents, held).select("question_id", "node", F.col("title").alias("p_title"), F.col("words").alias("p_words"))
    both = F.size(F.array_intersect("words", "p_words"))
    union = F.size("words") + F.size("p_words") - both
    seen = new.join(path, ["question_id", "node"]).groupBy("query_id", "at").agg(
        F.max(F.when((union > 0) & (F.size("p_words") > 0), both / union).otherwise(0.0)).alias("closest"), F.bool_or(F.col("title") == F.col("p_title")).alias("known")
    )
    asked = questions.select("question_id", words(F.col("question")).alias("q_words"))
    told = new.join(seen, ["query_id", "at"], "left").join(asked, "question_id")
    relevance = F.when((F.size("q_words") > 0) & (F.size("words") > 0), F.size(F.array_intersect("q_words", "words")) / F.size("q_words")).otherwise(0.0)
    each = F.when((F.size("words") == 0) & F.col("closest").isNotNull(), 0.7 * relevance).otherwise(gain(relevance, ~F.col("known") & (F.col("title") != ""), F.col("closest")))
    return told.groupBy("query_id").agg(F.avg(each).alias("gain"))
