"""Quality rules: a document's hashed n-grams are weighed by how much likelier they are in trusted texts than in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import WHITE, in_slices, table, trimmed

#: Buckets of words and of pairs of neighbouring words, one after the other. A weight is in millionths.
BUCKETS, UNIT = 1 << 17, 1_000_000
#: Share of the corpus in the trusted multinomial.
CORPUS_SHARE = 0.03
#: Trusted documents used, at most; those of the smallest hashes. Every HELD_OUT-th of them sets the threshold.
TRUSTED, HELD_OUT = 20_000, 4
#: A document must reach what all but one in so many of the held-out trusted documents reach, less this margin.
ONE_IN, MARGIN = 200, 0.3
#: Base rules: least words, most per cent of words in repeated windows of so many words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Words whose hash a task remembers.
MEMORY = 400_000
MULTIPLIER = 1_000_003


class _Hashes(dict):
    """32 bits of each word's MD5."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return h


def buckets(words: list[bytes], hashes: dict) -> np.ndarray:
    """The buckets of a text's words and of its pairs of neighbouring words."""
    h = np.fromiter(map(hashes.__getitem__, words), "int64", len(words))
    return np.concatenate([h % BUCKETS, BUCKETS + (h[:-1] * MULTIPLIER + h[1:]) % BUCKETS])


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words whose sequence the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = pd.factorize(np.array(words, dtype=object))[0].astype("int64")
    pairs = np.unique(ids[:-1] * len(words) + ids[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * len(words) + pairs[2:], return_inverse=True)[1]
    _, place, times = np.unique(fours[:n] * len(words) + ids[WINDOW - 1 :], return_inverse=True, return_counts=True)
    again = np.concatenate([[0], np.cumsum(times[place] > 1)])
    at = np.arange(len(words))
    return int(np.count_nonzero(again[np.minimum(at + 1, n)] > again[np.maximum(at - WINDOW + 1, 0)]))


def rules(text: str | None, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without [\\x20\\x09-\\x0D], as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, n): the n-grams of all texts by bucket. Each task sums its own texts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = _Hashes(), np.zeros(2 * BUCKETS, "int64")
        for batch in batches:
            held = [buckets(words, hashes) for words in map(words_of, batch["text"]) if words]
            if held:
                total += np.bincount(np.concatenate(held), minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype("int32"), "n": total[at]})

    return in_slices(docs.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame) -> np.ndarray:
    got = counts.toPandas()  # 2 * BUCKETS rows at most
    out = np.zeros(2 * BUCKETS, "int64")
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def log_ratios(corpus: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """For each bucket, the logarithm of its share among trusted n-grams over its share in the corpus, in millionths.

    Words and pairs are two multinomials. The trusted one is mixed with a share of the corpus, which bounds a weight from
    below alike at every size. Nothing trusted means a ratio of 1 throughout; an empty bucket weighs nothing.
    """
    out = np.zeros(2 * BUCKETS, "int64")
    for half in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        c, t = corpus[half].astype("float64"), trusted[half].astype("float64")
        if c.sum() and t.sum():
            share = c / c.sum()
            mixed = (1 - CORPUS_SHARE) * t / t.sum() + CORPUS_SHARE * share
            with np.errstate(divide="ignore", invalid="ignore"):
                out[half] = np.rint(np.where(c > 0, np.log(mixed / share), 0) * UNIT)
    return out


class Model:
    """Weights of buckets and the least mean weight of a document that is kept; whole numbers, so that no order of
    adding changes a verdict."""

    def __init__(self, weights: np.ndarray, least: int):
        self.weights, self.least = weights, least

    def score(self, words: list[bytes], hashes: dict) -> int:
        """Mean weight of the n-grams, rounded down; 0 for no words."""
        if not words:
            return 0
        at = buckets(words, hashes)
        return int(self.weights[at].sum()) // len(at)


def trusted_ids(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """(id, held_out): documents of quality 1 that aren't toxic by any label row, ``most`` at most: those whose id has the
    smallest hash. It is a bounded side for a broadcast."""
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 AND (t = 0 OR t IS NULL)")
    rank = F.md5(F.col("doc_id").cast("string"))
    first = good.select(F.col("doc_id").alias("id"), rank.alias("rank")).orderBy("rank", "id").limit(most)
    return first.select("id", (F.conv(F.substr("rank", F.lit(1), F.lit(4)), 16, 10).cast("int") % HELD_OUT == 0).alias("held_out"))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRUSTED) -> Model:
    """The corpus counted over all documents, the trusted multinomial over a bounded sample of labelled ones, and the
    threshold from the part of the sample held out from it.

    Without trusted documents all weights are 0, without held-out ones the threshold is minus the margin.
    """
    ids = trusted_ids(docs, labels, most)
    corpus = _dense(gram_counts(docs))
    mine = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    weights = log_ratios(corpus, _dense(gram_counts(mine.filter("NOT held_out"))))
    told = scored(mine.filter("held_out").select("doc_id", "text"), Model(weights, 0))
    scores = np.sort(told.filter("NOT base_failed").select("score").toPandas()["score"].to_numpy())  # a part of the sample
    least = int(scores[len(scores) // ONE_IN]) if len(scores) else 0
    trimmed()
    return Model(weights, least - int(MARGIN * UNIT))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score (millionths): one row
    for each row of docs.

    * null or empty text, or white space only: no words, base_failed.
    * null doc_id stays null; repeated rows get the same verdict each; empty table: no rows; extra columns are ignored.
    * a very long text is judged as a whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.least))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, m = _Hashes(), Model(*sent.value)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                words = words_of(text)
                told = rules(text, words)
                failed, score = base_failed(len(words), told[-1]), m.score(words, hashes)
                rows.append((len(words), *told, failed, not failed and score >= m.least, score))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_slices(docs.select("doc_id", "text"), judge, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score long")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM d
), h AS (
  SELECT doc_id, pos, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h, lead(word) OVER o AS after FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), g AS (
  SELECT doc_id, 0 AS half, h % {BUCKETS} AS bucket FROM h
  UNION ALL
  SELECT doc_id, 1, (h * {MULTIPLIER} + ('0x' || substr(md5(after), 1, 8))::BIGINT) % {BUCKETS} FROM h WHERE after IS NOT NULL
), k AS (
  SELECT doc_id, md5(doc_id::VARCHAR) AS rank FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND (max(toxic) = 0 OR max(toxic) IS NULL)
  ORDER BY rank, doc_id LIMIT {TRUSTED}
), i AS (
  SELECT doc_id, ('0x' || substr(rank, 1, 4))::INT % {HELD_OUT} = 0 AS held_out FROM k
), c AS (
  SELECT half, bucket, count(*) AS c, count(*) FILTER (WHERE NOT i.held_out) AS t FROM g LEFT JOIN i USING (doc_id) GROUP BY half, bucket
), r AS (
  SELECT half, bucket, c / sum(c) OVER o::DOUBLE AS share, t, sum(t) OVER o::DOUBLE AS ts FROM c WINDOW o AS (PARTITION BY half)
), v AS (
  SELECT half, bucket, CASE WHEN ts = 0 THEN 0 ELSE round_even(ln(({1 - CORPUS_SHARE} * t / ts + {CORPUS_SHARE} * share) / share) * {UNIT}, 0)::BIGINT END AS v FROM r
), s AS (
  SELECT doc_id, sum(v)::BIGINT AS total, count(*) AS n FROM g JOIN v USING (half, bucket) GROUP BY doc_id
), e AS (
  SELECT doc_id, (total - ((total % n) + n) % n) // n AS score FROM s
), x AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, five) AS times
  FROM (SELECT doc_id, p AS pos, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS five FROM d, range(1, len(w) - {WINDOW - 2}) r(p))
), m AS (
  SELECT doc_id, count(DISTINCT pos + o) AS n_repeat_words FROM x, range({WINDOW}) r(o) WHERE times > 1 GROUP BY doc_id
), q AS (
  SELECT doc_id, sum(times - 1) AS n_dup_lines
  FROM (SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(score, 0) AS score
  FROM d LEFT JOIN q USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN e USING (doc_id)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b
), z AS (
  SELECT coalesce(list_sort(list(score))[len(list(score)) // {ONE_IN} + 1], 0) - {int(MARGIN * UNIT)} AS least
  FROM f JOIN i USING (doc_id) WHERE held_out AND NOT base_failed
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND score >= least AS kept, score FROM f, z
"""
