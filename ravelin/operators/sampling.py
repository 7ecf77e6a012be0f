"""Samples and splits by hashes of ids, so that they don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.operators.order import placed


def order_hash(key: Column, seed: str = "42") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def fraction(key: Column, seed: str = "42") -> Column:
    """A number in [0, 1) from the key's hash."""
    return F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _lowest(rows: DataFrame, by: str, key: str, wanted: DataFrame, seed: str) -> DataFrame:
    """The ``want`` rows of each group (wanted: by, want, size) whose hashes are least.

    A hash below a limit that hardly a sample misses cuts large groups down before they are ordered, so no task orders a
    whole group; a group that the limit left short is taken whole.
    """
    u = fraction(F.col(key), seed)
    w = wanted.select(F.col(by).alias("__b"), "want", "size")
    limit = (F.col("want") + 6 * F.sqrt(F.col("want")) + 20) / F.col("size")
    near = rows.join(w, F.col(by).eqNullSafe(F.col("__b"))).filter(u < limit).drop("__b")
    order = W.partitionBy(by).orderBy(order_hash(F.col(key), seed), key)
    placed = near.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= F.col("want")).drop("__n")
    short = placed.groupBy(F.col(by).alias("__b")).agg(F.count(F.lit(1)).alias("__c"), F.first("want").alias("__w"), F.first("size").alias("__s")).filter("__c < __w AND __c < __s")
    placed = placed.drop("want", "size")
    if short.isEmpty():
        return placed
    rest = rows.join(short.select("__b", "__w"), F.col(by).eqNullSafe(F.col("__b"))).withColumn("__n", F.row_number().over(order)).filter("__n <= __w").drop("__n", "__b", "__w")
    return placed.join(short.select("__b"), F.col(by).eqNullSafe(F.col("__b")), "left_anti").unionByName(rest)


def stratified(rows: DataFrame, by: str, key: str, total: int, seed: str = "42") -> DataFrame:
    """total rows spread evenly over strata; the first strata in order get what is left over."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    k = n.count()
    each, over = divmod(total, max(1, k))
    first = n.orderBy(by).limit(over).select(F.col(by).alias("__f"), F.lit(1).alias("more"))
    wanted = n.join(first, F.col(by).eqNullSafe(F.col("__f")), "left").select(by, (F.lit(each) + F.coalesce("more", F.lit(0))).alias("want"), "size")
    return _lowest(rows, by, key, wanted, seed)


def subsampled(rows: DataFrame, by: str, key: str, amount: float, seed: str = "42") -> DataFrame:
    """Of each group a fraction, rounded up, where amount is at most 1, else so many rows."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    want = F.ceil(F.col("size") * amount) if amount <= 1 else F.lit(int(amount))
    return _lowest(rows, by, key, n.select(by, want.cast("long").alias("want"), "size"), seed)


def split(rows: DataFrame, key: str, test: float = 0.2, seed: str = "42") -> DataFrame:
    return rows.withColumn("split", F.when(fraction(F.col(key), seed) < test, "test").otherwise("train"))


def oversampled(rows: DataFrame, by: str, key: str, target: int) -> DataFrame:
    """Each class repeated, row by row in turn, until it has ``target`` rows; larger classes stay. Column copy counts from 0."""
    n = rows.groupBy(F.col(by).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    each = placed(rows, [key], [by]).withColumnRenamed("place", "__i").join(n, F.col(by) == F.col("__b"))
    copies = F.floor((F.greatest(F.lit(target), F.col("__c")) - F.col("__i")) / F.col("__c"))
    return each.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int")))).drop("__i", "__b", "__c")


def nth_of(rows: DataFrame, order: str, k: int, nth: list[int], by: str) -> DataFrame:
    """Rows whose place within their group, modulo k, is one of nth."""
    return placed(rows, [order], [by]).filter(((F.col("place") - 1) % k).isin(*nth)).drop("place")


def within_budget(rows: DataFrame, by: str, order: str, cost: Column, budget: int) -> DataFrame:
    """The longest run of rows, in order, whose summed cost stays within the budget."""
    return placed(rows, [order], [by], cost).filter(F.col("used") <= budget).drop("place")


def subselected(passages: DataFrame, key: str, k: int, nth: list[int], include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Passages whose place in the order of the key, from 1, modulo k is one of nth, and those that ``include`` (key) lists,
    without those that ``exclude`` (key) lists. Listed keys count once; null keys match none."""
    each = placed(passages, [key]).withColumn("__in", (F.col("place") % k).isin(*nth)).drop("place")
    if include is not None:
        listed = include.select(F.col(key).alias("__k")).distinct().withColumn("__listed", F.lit(True))
        each = each.join(listed, F.col(key) == F.col("__k"), "left").withColumn("__in", F.col("__in") | F.coalesce("__listed", F.lit(False))).drop("__k", "__listed")
    each = each.filter("__in").drop("__in")
    return each if exclude is None else each.join(exclude.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
