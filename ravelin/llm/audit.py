"""How filters interact: joint failures of all their intersections, and what every order of applying them removes."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm._common import WHITE, table

#: The filters. A text fails A with few words, B with few different ones, C with many capitals, D with a symbol,
#: and E if a smaller doc_id has the identical text.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_failures(text: Column) -> dict[str, Column]:
    """For each filter that looks at one text only: whether that text (not null) fails it."""
    bare = F.btrim(text, F.lit(WHITE))
    words = F.split(bare, r"[ \t-\r]+", -1)
    empty = bare == ""
    n, distinct = F.when(empty, 0).otherwise(F.size(words)), F.when(empty, 0).otherwise(F.size(F.array_distinct(words)))
    return {
        "A": n < MIN_WORDS,
        "B": distinct * 100 < n * MIN_DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITALS_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def _mask(letters: str) -> int:
    return sum(1 << FILTERS.index(x) for x in letters)


def joint_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: empty string) with three arrays of 32 longs, ``n``, ``good`` and ``toxic``.

    Place m of an array counts the part's documents that fail every filter whose bit is set in m (bit 0: A); place 0
    counts all of them. ``good`` and ``toxic`` count documents that ``labels`` calls quality 1 and toxic 1.

    * null text counts as empty. A null doc_id is no smaller than any other, has no smaller one and no labels.
    * repeated rows count each; rows of one doc_id and text are not copies of each other.
    * several label rows of a document: it is good, or toxic, if one of them says so. Null labels say nothing.
    * empty table: no rows. Extra columns are ignored.

    A document that fails E is one of a text's rows other than those of its smallest doc_id. Rows of a text are therefore
    combined by part first, whatever their number; the smallest doc_id is then looked for among a text's parts only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_failures(text)
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"),
        sum((F.when(c, 1 << FILTERS.index(x)).otherwise(0) for x, c in fails.items()), F.lit(0)).alias("mask"),
    )
    told = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    once = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = once.join(told, F.col("id") == F.col("l_id"), "left").select(
        "id", "part", "digest", "mask", "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    )
    counts = ["n", "good", "toxic"]
    combined = marked.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", *counts))).alias("first"),
        *[F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"null_{c}") for c in counts],
    )
    is_first = F.col("first.id").eqNullSafe(F.min("first.id").over(Window.partitionBy("digest")))
    copies = combined.withColumn("holds", is_first).select(
        "part", "mask", *counts,
        *[(F.col(c) - F.col(f"null_{c}") - F.when(F.col("holds"), F.coalesce(F.col(f"first.{c}"), F.lit(0))).otherwise(0)).alias(f"e_{c}") for c in counts],
    )
    flags = copies.select("part", *counts, *[f"e_{c}" for c in counts], *[F.getbit("mask", F.lit(k)).cast("long").alias(f"f{k}") for k in range(len(FILTERS) - 1)])

    def product(m: int, count: str) -> Column:
        out = F.col(f"e_{count}" if m >> 4 & 1 else count)
        for k in range(len(FILTERS) - 1):
            if m >> k & 1:
                out = out * F.col(f"f{k}")
        return out

    sums = flags.groupBy("part").agg(*[F.sum(product(m, c)).alias(f"{c}_{m}") for c in counts for m in range(ALL + 1)])
    return sums.select("part", *[F.array(*[F.col(f"{c}_{m}") for m in range(ALL + 1)]).alias(c) for c in counts])


def _survivors(joint: Column) -> Column:
    """From joint failures: place m is how many fail none of the filters in m (inclusion and exclusion)."""
    return F.array(*[sum((joint[t] * (-1) ** t.bit_count() for t in range(1, m + 1) if t & ~m == 0), joint[0]) for m in range(ALL + 1)])


def _shapley(joint: Column) -> Column:
    """From joint failures: for each filter, what it removes, summed over all orders. The dividend of a set of filters is
    its joint failures, with the sign of inclusion and exclusion; its members share it evenly."""
    orders = len(ORDERS)
    return F.array(*[sum((joint[t] * (orders // t.bit_count() * (-1) ** (t.bit_count() + 1)) for t in range(1, ALL + 1) if t >> k & 1), F.lit(0).cast("long")) for k in range(len(FILTERS))])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order: see ``joint_failures`` for nulls, repeats and empty tables.

    Returns one row for each part, filter_order (all 120) and step (1 to 5): kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.
    """
    joint = joint_failures(docs, labels)
    by_part = joint.select(
        "part", "n", _shapley(F.col("n")).alias("values"), *[_survivors(F.col(c)).alias(f"left_{c}") for c in ("n", "good", "toxic")],
        F.explode(F.array(*[F.lit(o) for o in ORDERS])).alias("filter_order"),
    )
    steps = by_part.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = F.ascii(F.substr("filter_order", "step", F.lit(1))) - ord(FILTERS[0])
    before = sum((F.when(F.instr(F.substr("filter_order", F.lit(1), F.col("step") - 1), x) > 0, 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    at = steps.withColumn("k", place).withColumn("before", before).withColumn("bit", F.expr("shiftleft(1, k)"))
    removed = lambda c: F.get(f"left_{c}", "before") - F.get(f"left_{c}", F.col("before") + F.col("bit"))
    return at.select(
        "part", "filter_order", "step",
        F.get("left_n", F.col("before") + F.col("bit")).alias("kept"), removed("n").alias("removed"), (F.get("n", "bit") - removed("n")).alias("redundant"),
        (F.get("left_n", F.lit(ALL) - F.col("bit")) - F.get("left_n", F.lit(ALL))).alias("unique_fails"),
        removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("values", "k").alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Plays all orders through, document pattern by document pattern.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), f AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)
), p AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, mask
), x AS (
  SELECT chr(65 + i::INT) AS c, (1 << i::INT)::INT AS b FROM range(5) r(i)
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM o, range(1, 6) r(step)
), c AS (
  SELECT p.part, s.filter_order, s.step, s.bit,
         sum(CASE WHEN p.mask & (s.earlier | s.bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN p.mask & s.earlier = 0 AND p.mask & s.bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN p.mask & s.earlier <> 0 AND p.mask & s.bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN p.mask = s.bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN p.mask & s.earlier = 0 AND p.mask & s.bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN p.mask & s.earlier = 0 AND p.mask & s.bit <> 0 THEN bad ELSE 0 END) AS toxic_lost
  FROM p, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM c
"""
