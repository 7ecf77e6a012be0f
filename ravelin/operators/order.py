"""Places and running sums within groups of any size: ranges of the order are numbered side by side, then shifted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.storage import written


def placed(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), cost: Column | None = None) -> DataFrame:
    """rows with ``place``, from 1, in the order of the columns within each group of ``by``, and ``used``, the sum of
    ``cost`` up to the row where one is given. Rows must differ in by and order for a defined result.

    Rows are dealt by ranges of (by, order), numbered within their range, and shifted by what the group has in earlier
    ranges: a row for each range and group, however large these are. A null group is a group of its own.
    """
    keys = [*by, *order]
    dealt = rows.withColumn("__cost", F.lit(0) if cost is None else cost).repartitionByRange(*[F.col(c) for c in keys]) if keys else rows
    held = written(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    within = W.partitionBy("__part", *by).orderBy(*order)
    own = held.withColumn("__place", F.row_number().over(within)).withColumn("__used", F.sum("__cost").over(within.rowsBetween(W.unboundedPreceding, 0)))
    sizes = held.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"), F.sum("__cost").alias("__sum"))
    earlier = W.partitionBy(*[F.col(f"__g{i}") for i in range(len(by))]).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    named = sizes.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "__n", "__sum")
    shifts = named.select("__p", *[f"__g{i}" for i in range(len(by))], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__spent"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], F.col("__part") == F.col("__p"))
    out = own.join(shifts, same).withColumn("place", (F.col("__place") + F.col("__before")).cast("long"))
    if cost is not None:
        out = out.withColumn("used", F.col("__used") + F.col("__spent"))
    return out.select(*rows.columns, "place", *["used"] * (cost is not None))
