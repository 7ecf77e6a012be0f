"""Top-k retrieval for whole query sets: lexical, dense, sparse, hybrid, reranking, filters."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.text import tokens
from ravelin.shipping import shipped
from ravelin.sources.index import K1, B, LexicalIndex
from ravelin.storage import written

#: Rows of a query side that is broadcast, at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(scored: DataFrame, k: int, key: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best rows of each query, ties by item, numbered from 1. The rank limit is applied before the shuffle."""
    w = W.partitionBy(key).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    """(query_id, term): distinct terms of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(text))).alias("term"))


def near_terms(terms: DataFrame):
    """What marks tables that derive from the query terms for broadcast: their number bounds them."""
    return F.broadcast if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else (lambda df: df)


def bm25(index: LexicalIndex, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of every document of a stored index that shares a term with a query."""
    return index.bm25(terms, near_terms(terms), k1, b)


def lexical(index: LexicalIndex, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's k best documents of a stored index by scores of six digits."""
    return ranked(index.best(terms, k, near_terms(terms)).withColumn("score", F.round("score", 6)), k)


#: Vectors of a block on either side, and blocks of queries that are broadcast, at most.
QUERY_BLOCK, VECTOR_BLOCK, NEAR_BLOCKS = 256, 2048, 64


def _packed(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of unit length, one row each: ids, and the vectors end to end."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held = [], []
        for f in frames:
            for i, v in zip(f[key], f[vector], strict=True):
                ids.append(i)
                held.append(v)
                if len(ids) == size:
                    yield block(ids, held)
                    ids, held = [], []
        if ids:
            yield block(ids, held)

    def block(ids: list, held: list) -> pd.DataFrame:
        x = np.stack(held).astype("float64")
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return pd.DataFrame({f"{name}_ids": [ids], f"{name}_data": [unit.tobytes()]})

    return rows.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(pack, f"{name}_ids array<long>, {name}_data binary")


def knn(vectors: DataFrame, queries: DataFrame, k: int | None = None, block: int = QUERY_BLOCK, slack: float | None = None) -> DataFrame:
    """(query_id, vec_id, score): cosine of a stated set of queries to every vector, or to the k best of each query. With
    ``slack``, what is within it of the k-th best of a block stays as well, for a caller that ranks by rounded scores.

    Both sides are packed into blocks; a plan of one join pairs every block of vectors with every block of queries, and a
    pair is one product of matrices, of which a query's k best go on. Few blocks of queries are broadcast, many are
    written and read by each task. A vector of length 0 has no score; null vectors are left out.
    """
    shipped(vectors.sparkSession)
    asked = written(_packed(queries, "query_id", "q", block, "q"), "query-blocks")
    few = asked.limit(NEAR_BLOCKS + 1).count() <= NEAR_BLOCKS
    pairs = _packed(vectors, "vec_id", "embedding", VECTOR_BLOCK, "v").crossJoin(F.broadcast(asked) if few else asked)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for v_ids, v, q_ids, q in zip(f["v_ids"], f["v_data"], f["q_ids"], f["q_data"], strict=True):
                scores = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(v).reshape(len(v_ids), -1).T
                v_ids = np.asarray(v_ids)
                if k is not None and len(v_ids) > k:
                    # ties at the k-th score all go on: the final rank decides between them by id
                    least = -np.partition(-np.nan_to_num(scores, nan=-2.0), k - 1, axis=1)[:, k - 1 : k]
                    at = np.nonzero(scores >= least - (slack or 0.0))
                else:
                    at = np.nonzero(~np.isnan(scores))
                yield pd.DataFrame({"query_id": np.asarray(q_ids)[at[0]], "vec_id": v_ids[at[1]], "score": scores[at]})

    out = pairs.mapInPandas(score, "query_id long, vec_id long, score double")
    if k is None or slack is not None:
        return out
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return out.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= k).drop("__k")


def containing(docs: DataFrame, passages: DataFrame, words: int = 5) -> DataFrame:
    """docs (doc_id, text), passages (query_id, passage) -> (query_id, doc_id): the documents that hold a passage.

    A passage's first and last word may stand within longer ones, but words in between stand whole: documents that hold
    its second to sixth word in a row, or all words in between if these are fewer, are found by equality, and then by the
    whole passage. Passages of one or two words have none in between; they are looked for in every document, in blocks.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    own = passages.withColumn("__w", split(F.col("passage"))).withColumn("__n", F.least(F.lit(words), F.size("__w") - 2))
    keyed = own.filter("__n >= 1").select("query_id", "passage", "__n", F.xxhash64(F.slice("__w", F.lit(2), F.col("__n"))).alias("g"))
    sizes = sorted(r[0] for r in keyed.select("__n").distinct().collect())  # as many as ``words``
    w = docs.select("doc_id", split(F.col("text")).alias("w"))
    found = docs.select("doc_id").limit(0).select(F.lit(None).cast(passages.schema["query_id"].dataType).alias("query_id"), "doc_id")
    parts = []
    for n in sizes:
        each = _word_grams(w, n)
        parts.append(each.join(bounded(keyed.filter(F.col("__n") == n).drop("__n")), "g").select("doc_id", "query_id", "passage"))
    if parts:
        # pairs that are few are broadcast, so that texts aren't shuffled to meet them
        pairs = bounded(written(reduce(DataFrame.unionByName, parts).distinct(), "passage-pairs"))
        found = docs.select("doc_id", "text").join(pairs, "doc_id").filter(F.contains("text", "passage")).select("query_id", "doc_id")
    short = own.filter("__n < 1").select("query_id", "passage")
    if short.isEmpty():
        return found.distinct()
    number = F.floor(F.monotonically_increasing_id() / QUERY_BLOCK)
    blocks = written(short.withColumn("__b", number).groupBy("__b").agg(F.collect_list(F.struct("query_id", "passage")).alias("held")).drop("__b"), "passages")  # a block's
    near = F.broadcast(blocks) if blocks.limit(NEAR_BLOCKS + 1).count() <= NEAR_BLOCKS else blocks
    met = docs.select("doc_id", "text").crossJoin(near).select("doc_id", F.explode(F.filter("held", lambda x: F.contains(F.col("text"), x["passage"]))).alias("p"))
    return found.unionByName(met.select("p.query_id", "doc_id")).distinct()


def _word_grams(w: DataFrame, n: int) -> DataFrame:
    """(doc_id, g): hashes of all runs of n words of w (doc_id, w)."""
    beside = F.arrays_zip(*[F.slice("w", F.lit(k + 1), F.size("w") - n + 1).alias(f"w{k}") for k in range(n)])
    grams = F.transform(beside, lambda x: F.xxhash64(F.array(*[x[f"w{k}"] for k in range(n)])))
    return w.filter(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(grams)).alias("g"))


def sparse_dot(weights: DataFrame, queries: DataFrame) -> DataFrame:
    """weights (doc_id, term, w) and queries (query_id, term, qw): inner products over shared terms."""
    return weights.join(bounded(queries), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))


def fused(arms: Mapping[str, DataFrame], weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of arms' raw scores by query and document; a document that an arm lacks gets nothing from it."""
    parts = [arm.select("query_id", "doc_id", (F.col("score") * weights.get(name, 1.0)).alias("score")) for name, arm in arms.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def deduped_hits(hits: DataFrame, keep: str = "worst") -> DataFrame:
    """One hit of each normalised text in a query: that of the lowest score (the default), or of the highest."""
    order = [F.asc("score"), F.desc("doc_id")] if keep == "worst" else [F.desc("score"), F.asc("doc_id")]
    w = W.partitionBy("query_id", F.lower(F.trim("text"))).orderBy(*order)
    return hits.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def reranked(hits: DataFrame, score: Column, top: int) -> DataFrame:
    """Hits with rerank_score for each query's first ``top``; all are ranked by it, or else by their raw score."""
    scored = hits.withColumn("rerank_score", F.when(F.col("rank") <= top, score))
    w = W.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", "score")), F.asc("doc_id"))
    return scored.withColumn("final_rank", F.row_number().over(w).cast("long"))


def title_filtered(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits whose trimmed title, without case, is allowed (column title); applied after top-k, so fewer may be left."""
    names = allowed.select(F.lower(F.trim("title")).alias("__t")).distinct()
    return hits.join(bounded(names), F.lower(F.trim("title")) == F.col("__t"), "left_semi")
