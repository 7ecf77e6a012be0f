"""A stored lexical index: postings by term in segments, removed documents, and the corpus' size.

Segments and lists of removed documents are tables that never change; a version of the index is a table that names them.
Batches are added and documents removed without touching what is there; ``merge`` makes one segment of all. Queries read
the postings of their terms only, and ``top`` only those of blocks of documents that can hold one of the best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.text import tokens
from ravelin.shipping import shipped
from ravelin.storage import exists, file_system, removed, written

#: Folders that postings are dealt to by a hash of their term; the files that a folder's postings are spread over are one for
#: so many documents, and SPREAD at least.
BUCKETS, SPREAD, SPREAD_DOCS = 64, 4, 50_000
#: Documents whose postings one task sorts, or so: there are as many tasks as the corpus needs, whatever the session's number.
SORTED = 2048
#: Neighbouring document ids of a block, and blocks of a query that are scored first.
BLOCK, LEAD = 64, 4
#: Documents whose scores one task adds up, or so: each may meet every query.
SCORED = 4096
#: Cells (queries times documents) and pairs of postings and queries that are scored at once, at most; one document is always.
CELLS, PAIRS = 1 << 21, 1 << 21
K1, B = 1.2, 0.75
POSTINGS, BOUNDS = "doc_id long, dl int, term string, tf long, block long, bucket int", "term string, block long, most_tf long, least_dl int, bucket int"


class Corpus(NamedTuple):
    N: int
    avgdl: float
    buckets: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Tells a folder's or file's content by its files' names, sizes and times."""
    fs, where = file_system(spark, path)
    found, it = [], fs.listFiles(where, True)
    while it.hasNext():
        f = it.next()
        found.append(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()


class LexicalIndex:
    """Postings (term, doc_id, tf, dl) below a path, in folders by a hash of the term, sorted by term and block."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: tuple[int, list] | None = None  # a version never changes

    # Versions.

    def _version(self) -> int | None:
        fs, where = file_system(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return None
        names = [int(s.getPath().getName()) for s in fs.listStatus(where)]
        return max((n for n in names if exists(self.spark, f"{self.path}/versions/{n}/_SUCCESS")), default=None)

    def _listed(self) -> list:
        """The tables of the newest version: seq, kind, N, total, buckets, source."""
        version = self._version()
        if version is None:
            return []
        if self._known is None or self._known[0] != version:
            rows = self.spark.read.parquet(f"{self.path}/versions/{version}").collect()  # a row for each batch
            self._known = (version, sorted(rows, key=lambda r: r.seq))
        return self._known[1]

    def _publish(self, rows: list) -> None:
        """A new version, complete or not there at all; of concurrent writers one fails, as the folder exists."""
        version = (self._version() or 0) + 1
        schema = "seq int, kind string, N long, total long, buckets int, source string"
        self.spark.createDataFrame([tuple(r) for r in rows], schema).coalesce(1).write.mode("error").parquet(f"{self.path}/versions/{version}")

    def exists(self) -> bool:
        """Whether the index is there and complete."""
        return self._version() is not None

    def delete(self) -> bool:
        """Remove the index; whether there was one."""
        found = self.exists()
        removed(self.spark, self.path)
        self._known = None
        return found

    def fresh(self, source: str) -> bool:
        """Whether the index was created from the files that are at ``source`` now."""
        rows = self._listed()
        return bool(rows) and rows[0].source == fingerprint(self.spark, source)

    # Writing.

    def create(self, docs: DataFrame, key: str = "doc_id", text: str = "text", analyze: Callable[[Column], Column] = tokens, force: bool = False, buckets: int = BUCKETS, stem: Callable[[DataFrame], DataFrame] | None = None, source: str | None = None) -> LexicalIndex:
        """Index docs. An index that is there is an error, unless ``force`` puts the new one in its place. The version is
        written last: until then the index doesn't exist. ``stem`` maps a table's column term to stems; ``source`` is the
        path that docs were read from, by which a stale index is known."""
        if self.exists() and not force:
            raise FileExistsError(self.path)
        mark = fingerprint(self.spark, source) if source else None
        removed(self.spark, self.path)
        self._known = None
        self._publish([self._segment(1, docs, key, text, analyze, stem, buckets, mark)])
        return self

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", analyze: Callable[[Column], Column] = tokens, stem: Callable[[DataFrame], DataFrame] | None = None) -> LexicalIndex:
        """A further batch as a segment of its own; a document that is there already is replaced."""
        rows = self._listed()
        seq = rows[-1].seq + 1
        gone = self._removal(seq, docs.select(F.col(key).cast("long").alias("doc_id")))
        self._publish([*rows, *gone, self._segment(seq + 1, docs, key, text, analyze, stem, rows[0].buckets, None)])
        return self

    def remove(self, ids: DataFrame) -> LexicalIndex:
        """Documents (doc_id) that no query finds any more."""
        rows = self._listed()
        self._publish([*rows, *self._removal(rows[-1].seq + 1, ids.select(F.col("doc_id").cast("long").alias("doc_id")))])
        return self

    def merge(self) -> LexicalIndex:
        """One segment of all that is left; older tables go."""
        rows = self._listed()
        seq = rows[-1].seq + 1
        path = f"{self.path}/tables/{seq}"
        self._written(path, self.postings(), self._docs(), rows[0].buckets)
        c = self.spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        self._publish([(seq, "segment", c.n, c.total, rows[0].buckets, rows[0].source)])
        for r in rows:
            removed(self.spark, f"{self.path}/tables/{r.seq}")
        return self

    def _segment(self, seq: int, docs: DataFrame, key: str, text: str, analyze, stem, buckets: int, source: str | None) -> tuple:
        path = f"{self.path}/tables/{seq}"
        base = docs.select(F.col(key).cast("long").alias("doc_id"), analyze(F.col(text)).alias("ts"))
        if base.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            counted = _counted(base)
        else:  # rows of one document are counted together
            each = base.select("doc_id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
            counted = each.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        if stem is not None:
            counted = stem(counted).groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))
        self._written(path, counted, base.select("doc_id", F.greatest(F.size("ts"), F.lit(0)).alias("dl")), buckets)
        c = self.spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        return (seq, "segment", c.n, c.total, buckets, source)

    def _written(self, path: str, postings: DataFrame, docs: DataFrame, buckets: int) -> None:
        block = F.floor(F.col("doc_id") / BLOCK).cast("long")
        # a frequent term's postings go to several files, blocks stay whole
        n = docs.count()
        files = max(SPREAD, -(-n // SPREAD_DOCS))
        spread = postings.select("doc_id", "dl", "term", "tf").repartition(max(SPREAD, -(-n // SORTED)), bucket_of(F.col("term"), buckets), F.pmod(F.xxhash64(block), F.lit(files)))
        dealt = spread.withColumn("block", block).withColumn("bucket", bucket_of(F.col("term"), buckets))
        dealt.sortWithinPartitions("bucket", "term", "block", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
        docs.write.parquet(f"{path}/docs")

    def _removal(self, seq: int, ids: DataFrame) -> list:
        path = f"{self.path}/tables/{seq}"
        self._docs().join(ids.distinct(), "doc_id", "left_semi").write.parquet(f"{path}/docs")
        c = self.spark.read.schema("doc_id long, dl int").parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        if c.n == 0:
            removed(self.spark, path)
            return []
        return [(seq, "removal", c.n, c.total, None, None)]

    # Reading.

    def corpus(self) -> Corpus:
        """Documents that are left, their mean length and the number of folders."""
        rows = self._listed()
        sign = {"segment": 1, "removal": -1}
        n, total = sum(sign[r.kind] * r.N for r in rows), sum(sign[r.kind] * r.total for r in rows)
        return Corpus(n, total / n if n else 0.0, rows[0].buckets)

    def _live(self, name: str, schema: str) -> DataFrame:
        """A table of all segments without the documents that were removed after their segment was written."""
        rows = self._listed()
        read = lambda r, what, schema_: self.spark.read.schema(schema_).parquet(f"{self.path}/tables/{r.seq}/{what}").withColumn("__seq", F.lit(r.seq))
        parts = reduce(DataFrame.unionByName, [read(r, name, schema) for r in rows if r.kind == "segment"])
        gone = [read(r, "docs", "doc_id long, dl int") for r in rows if r.kind == "removal"]
        if not gone:
            return parts.drop("__seq")
        last = reduce(DataFrame.unionByName, gone).groupBy(F.col("doc_id").alias("__id")).agg(F.max("__seq").alias("__gone"))
        return parts.join(last, F.col("doc_id") == F.col("__id"), "left").filter(F.col("__gone").isNull() | (F.col("__seq") > F.col("__gone"))).drop("__seq", "__id", "__gone")

    def _docs(self) -> DataFrame:
        return self._live("docs", "doc_id long, dl int")

    def postings(self) -> DataFrame:
        return self._live("postings", POSTINGS)

    def _bounds(self) -> DataFrame:
        """(term, block, most_tf, least_dl); of removed documents too, so they are bounds still."""
        parts = [self._bounds_of(f"{self.path}/tables/{r.seq}") for r in self._listed() if r.kind == "segment"]
        return reduce(DataFrame.unionByName, parts)

    def _bounds_of(self, path: str) -> DataFrame:
        """A segment's bounds, written when they are asked for first."""
        if not exists(self.spark, f"{path}/bounds/_SUCCESS"):
            held = self.spark.read.schema(POSTINGS).parquet(f"{path}/postings")
            bounds = held.groupBy("bucket", "term", "block").agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
            n = self.spark.read.parquet(f"{path}/docs").count()
            dealt = bounds.repartition(max(SPREAD, -(-n // SORTED)), "bucket", F.pmod(F.xxhash64("block"), F.lit(max(SPREAD, -(-n // SPREAD_DOCS)))))
            dealt.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bounds")
        return self.spark.read.schema(BOUNDS).parquet(f"{path}/bounds")

    def of_terms(self, terms: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The postings of terms (term); their folders alone are read."""
        wanted = terms.select("term").distinct().withColumn("bucket", bucket_of(F.col("term"), self.corpus().buckets))
        return self.postings().join(near(wanted), ["bucket", "term"]).select("term", "doc_id", "tf", "dl", "block")

    def _weighed(self, terms: DataFrame, held: DataFrame, c: Corpus) -> DataFrame:
        df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return terms.join(df, "term").withColumn("idf", F.log(1 + (F.lit(c.N) - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def bm25(self, terms: DataFrame, near: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
        """terms (query_id, term) -> (query_id, doc_id, score) of every document that shares a term with a query. near
        marks what derives from the terms for broadcast, if their number allows."""
        c = self.corpus()
        held = self.of_terms(terms, near)
        weighed = self._weighed(terms, held, c)
        if near is F.broadcast:
            held = self._together(held, "doc_id", c)
        return held.join(near(weighed), "term").groupBy("query_id", "doc_id").agg(F.sum(_part(F.col("idf"), F.col("tf"), F.col("dl"), c, k1, b)).alias("score"))

    def best(self, terms: DataFrame, k: int, near: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B, slack: float = 1e-6) -> DataFrame:
        """(query_id, doc_id, score) of documents among which are each query's k best, and all that are within ``slack`` of
        the k-th, for a caller that ranks by rounded scores. Each task adds up the scores of its documents in arrays and
        passes on its best; pairs of queries and documents make no rows."""
        if near is not F.broadcast:
            return self.bm25(terms, near, k1, b)
        c = self.corpus()
        asked = _Asked(self._weighed(terms, self.of_terms(terms, near), c), terms)
        return asked.best(self._together(self._numbered(asked), "doc_id", c), k, c, k1, b, slack)

    def _numbered(self, asked: _Asked) -> DataFrame:
        """(no, doc_id, tf, dl, block): the postings of the asked terms, which are numbered."""
        wanted = self.spark.createDataFrame(list(enumerate(asked.terms)), "no int, term string").withColumn("bucket", bucket_of(F.col("term"), self.corpus().buckets))
        return self.postings().join(F.broadcast(wanted), ["bucket", "term"]).select("no", "doc_id", F.col("tf").cast("int").alias("tf"), "dl", "block")

    def _together(self, rows: DataFrame, by: str, c: Corpus) -> DataFrame:
        """rows with those of a document or block in one task. What queries that are broadcast make of them, far more rows,
        is added up there and isn't shuffled again."""
        return rows.repartition(max(1, -(-c.N // SCORED)), by)

    def candidates(self, terms: DataFrame, k: int, near: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, term, doc_id, part): postings of the blocks that can hold one of a query's k best documents.

        A block's bound for a query adds up, over its terms, what the largest frequency in the shortest document would
        give. The LEAD blocks of the highest bounds are scored first; blocks whose bound is under the k-th best score of
        these can't matter.
        """
        return self._candidates(terms, k, near, k1, b).drop("block")

    def _candidates(self, terms: DataFrame, k: int, near: Callable[[DataFrame], DataFrame], k1: float, b: float) -> DataFrame:
        c = self.corpus()
        held = self.of_terms(terms, near)
        weighed = self._weighed(terms, held, c)
        told = near(weighed)
        # a row for each block, so that blocks meet where they are
        open_ = self._open(weighed, held, k, near, c, k1, b).groupBy("block").agg(F.collect_set("query_id").alias("open"))
        together = self._together(held, "block", c) if near is F.broadcast else held
        rest = together.join(open_, "block").join(told, "term").filter(F.array_contains("open", F.col("query_id")))
        return rest.select("query_id", "term", "doc_id", "block", _part(F.col("idf"), F.col("tf"), F.col("dl"), c, k1, b).alias("part"))

    def _open(self, weighed: DataFrame, held: DataFrame, k: int, near: Callable[[DataFrame], DataFrame], c: Corpus, k1: float, b: float) -> DataFrame:
        """(query_id, block): the blocks that can hold one of a query's k best."""
        weighed = weighed.withColumn("bucket", bucket_of(F.col("term"), c.buckets))
        together = (lambda df: self._together(df, "block", c)) if near is F.broadcast else (lambda df: df)
        bound = together(self._bounds().join(near(weighed.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi")).join(near(weighed), ["bucket", "term"])
        # three plans read the bounds of queries and blocks, so they are kept
        bound = written(bound.groupBy("query_id", "block").agg(F.sum(_part(F.col("idf"), F.col("most_tf"), F.col("least_dl"), c, k1, b)).alias("bound")), "bounds")
        lead = bound.withColumn("__n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "block"))).filter(F.col("__n") <= LEAD).select("query_id", "block")
        first = held.join(near(lead.select("block").distinct()), "block").join(near(weighed.drop("bucket")), "term").join(near(lead), ["query_id", "block"])
        scores = first.groupBy("query_id", "doc_id").agg(F.sum(_part(F.col("idf"), F.col("tf"), F.col("dl"), c, k1, b)).alias("score"))
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
        least = scores.withColumn("__n", place).filter(F.col("__n") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
        return bound.join(near(least), "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select("query_id", "block")

    def top(self, terms: DataFrame, k: int, near: Callable[[DataFrame], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc_id, score) of documents among which are each query's k best, with their whole scores."""
        if near is not F.broadcast:
            return self._candidates(terms, k, near, k1, b).groupBy("query_id", "block", "doc_id").agg(F.sum("part").alias("score")).drop("block")
        c = self.corpus()
        held = self.of_terms(terms, near)
        asked = _Asked(self._weighed(terms, held, c), terms)
        blocks = self._open(near(asked.table), held, k, near, c, k1, b).select("block").distinct()
        return asked.best(self._together(self._numbered(asked), "block", c).join(blocks, "block", "left_semi"), k, c, k1, b, 1e-6)


class _Asked:
    """The terms of queries that are few enough to be sent to every task, with their weights, as arrays."""

    def __init__(self, weighed: DataFrame, terms: DataFrame):
        rows = sorted((r.term, r.query_id, r.idf) for r in weighed.select("term", "query_id", "idf").collect())  # bounded by the caller
        self.kind = terms.schema["query_id"].dataType.simpleString()
        self.table = weighed.sparkSession.createDataFrame([(q, t, x) for t, q, x in rows], f"query_id {self.kind}, term string, idf double")
        self.terms = sorted({r[0] for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        self.queries = sorted({r[1] for r in rows})
        place = {q: i for i, q in enumerate(self.queries)}
        self.of = np.array([place[r[1]] for r in rows], dtype="int64")
        self.begins = np.searchsorted(np.array([number[r[0]] for r in rows], dtype="int64"), np.arange(len(self.terms) + 1))
        self.idf = np.array([rows[i][2] for i in self.begins[:-1]], dtype="float64")

    def best(self, rows: DataFrame, k: int, c: Corpus, k1: float, b: float, slack: float) -> DataFrame:
        """rows (no, doc_id, tf, dl), a document's in one task -> (query_id, doc_id, score): each task's k best of a query and
        what is within slack of the k-th. Documents are scored a few at a time, so a task's memory doesn't grow with them."""
        shipped(rows.sparkSession)
        of, begins, idf, queries = self.of, self.begins, self.idf, np.array(self.queries, dtype=object)

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            least = np.zeros(len(queries))
            for no, doc, tf, dl in _documents(frames, begins, len(queries)):
                many = begins[no + 1] - begins[no]
                part = _part(idf[no], tf, dl, c, k1, b)
                docs, at = np.unique(doc, return_inverse=True)
                # each posting counts for every query that has its term
                ends = np.cumsum(many)
                q = of[np.arange(ends[-1]) - np.repeat(ends - many - begins[no], many)]
                scores = np.bincount(q * len(docs) + np.repeat(at, many), np.repeat(part, many), len(queries) * len(docs)).reshape(len(queries), len(docs))
                if len(docs) >= k:
                    least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
                q, d = np.nonzero((scores > 0) & (scores >= least[:, None] - slack))
                yield pd.DataFrame({"query_id": queries[q], "doc_id": docs[d], "score": scores[q, d]})

        return rows.select("no", "doc_id", "tf", "dl").sortWithinPartitions("doc_id", "no").mapInPandas(score, f"query_id {self.kind}, doc_id long, score double")


def _documents(frames: Iterator[pd.DataFrame], begins: np.ndarray, queries: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Postings (no, doc_id, tf, dl) in order of documents, in parts of whole documents under the limits, one at least."""
    most, held, pairs = max(1, CELLS // max(1, queries)), [], 0
    for f in frames:
        held.append(tuple(f[x].to_numpy() for x in ("no", "doc_id", "tf", "dl")))
        no = held[-1][0]
        pairs += int((begins[no + 1] - begins[no]).sum())
        if pairs >= PAIRS:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            # the last document may go on in the next batch
            last = int(np.searchsorted(rows[1], rows[1][-1]))
            yield from _cut(tuple(x[:last] for x in rows), begins, most)
            held = [tuple(x[last:] for x in rows)]
            no = held[0][0]
            pairs = int((begins[no + 1] - begins[no]).sum())
    if held:
        yield from _cut(tuple(np.concatenate(x) for x in zip(*held, strict=True)), begins, most)


def _cut(rows: tuple[np.ndarray, ...], begins: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """rows in parts of up to ``most`` documents and PAIRS pairs, one document at least."""
    no, doc = rows[0], rows[1]
    starts = np.append(np.nonzero(np.diff(doc, prepend=doc[:1] - 1))[0], len(doc))  # where documents begin, and the end
    before = np.append(0, np.cumsum(begins[no + 1] - begins[no]))[starts]
    i = 0
    while i < len(starts) - 1:
        j = max(i + 1, min(i + most, int(np.searchsorted(before, before[i] + PAIRS, "right")) - 1, len(starts) - 1))
        yield tuple(x[starts[i] : starts[j]] for x in rows)
        i = j


def _counted(base: DataFrame) -> DataFrame:
    """base (doc_id, ts) -> (doc_id, dl, term, tf): the runs of each document's sorted terms, counted within its row."""
    rows = base.select("doc_id", F.size("ts").alias("dl"), F.sort_array("ts").alias("s")).filter("dl > 0")
    begins = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    rows = rows.withColumn("at", begins)
    # a run ends where the next one begins
    runs = F.transform("at", lambda a, k: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("dl")) - a).cast("long").alias("tf")))
    return rows.select("doc_id", "dl", F.explode(runs).alias("r")).select("doc_id", "dl", "r.term", "r.tf")


def _part(idf, tf, dl, c: Corpus, k1: float, b: float):
    """What a posting adds to a score, of columns or arrays; it grows with tf and falls with dl."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / c.avgdl))
