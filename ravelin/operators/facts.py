"""A fact base and a small algebra of questions over it: select, project, filter and their suffix operations.

Facts are rows (predicate, subject, object). Bindings of a question are rows (qid, pos, item); an answer to an item is
joined to it, so every step is one relational operation over all questions at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.operators.order import placed

TRUE = ("yes", "1", "true")


def fact_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """placed_by(order, customer), lives_in(customer, nation), in_region(nation, region), supplies_from(supplier, nation)."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")

    def facts(df: DataFrame, predicate: str, subject: str, s: str, object_: str, o: str) -> DataFrame:
        return df.select(F.lit(predicate).alias("predicate"), F.concat(F.lit(s), F.col(subject).cast("string")).alias("subject"), F.concat(F.lit(o), F.col(object_).cast("string")).alias("object"))

    parts = [
        facts(read("orders"), "placed_by", "o_orderkey", "o", "o_custkey", "c"), facts(read("customer"), "lives_in", "c_custkey", "c", "c_nationkey", "n"),
        facts(read("nation"), "in_region", "n_nationkey", "n", "n_regionkey", "r"), facts(read("supplier"), "supplies_from", "s_suppkey", "s", "s_nationkey", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lookup(facts: DataFrame, predicate: str, subject: str = "_", object_: str = "_") -> DataFrame:
    """Facts that match a pattern: "_" and "?" match anything, "?" marks what is returned (column answer), constants must
    be equal. Without "?" the answer is yes or no."""
    found = facts.filter(F.col("predicate") == predicate)
    for name, want in (("subject", subject), ("object", object_)):
        if want not in ("_", "?"):
            found = found.filter(F.col(name) == want)
    asked = [n for n, w in (("subject", subject), ("object", object_)) if w == "?"]
    if not asked:
        return found.agg(F.when(F.count(F.lit(1)) > 0, "yes").otherwise("no").alias("answer"))
    return found.select(F.col(asked[0]).alias("answer") if len(asked) == 1 else F.concat_ws(", ", *asked).alias("answer"))


def answer_each(items: DataFrame, facts: DataFrame, predicate: str, item: str = "item", inverse: bool = False) -> DataFrame:
    """items with a further column answer, one row for each answer: what project asks of each item. Items without an
    answer get null."""
    given, wanted = ("object", "subject") if inverse else ("subject", "object")
    f = facts.filter(F.col("predicate") == predicate).select(F.col(given).alias("__k"), F.col(wanted).alias("answer"))
    return items.join(f, F.col(item) == F.col("__k"), "left").drop("__k")


def two_hop(facts: DataFrame, first: str, second: str) -> DataFrame:
    """(subject, middle, object) of facts chained from the first predicate to the second."""
    a = facts.filter(F.col("predicate") == first).select("subject", F.col("object").alias("middle"))
    b = facts.filter(F.col("predicate") == second).select(F.col("subject").alias("__m"), "object")
    return a.join(b, F.col("middle") == F.col("__m")).select("subject", "middle", "object")


def is_true(c: Column) -> Column:
    return F.lower(c).isin(*TRUE)


def aborting(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """Only the groups in which no answer is missing: one invalid sub-answer voids an operation."""
    sound = rows.groupBy(key).agg(F.bool_and(F.col(answer).isNotNull()).alias("__ok")).filter("__ok").select(F.col(key).alias("__k"))
    return rows.join(sound, F.col(key) == F.col("__k"), "left_semi")


#: Suffix operations over arrays; those on pairs take structs of key and value.
SUFFIX = {
    "flat": lambda c: F.flatten(c),
    "unique": lambda c: F.array_distinct(c),
    "keys": lambda c: F.transform(c, lambda x: x.key),
    "values": lambda c: F.transform(c, lambda x: x.value),
}
OPERATIONS = ("projectValues", "projectKeys", "filterValues", "filterKeys", "project", "filter", "select")


def apply_suffixes(c: Column, operation: str) -> Column:
    """project_values_flat_unique and the like: the suffixes after an operation's name, from left to right."""
    head, *rest = operation.split("_")
    if head not in OPERATIONS:
        raise ValueError(f"unknown operation {head}")
    for name in rest:
        if name not in SUFFIX:
            raise ValueError(f"unknown suffix {name}")
        c = SUFFIX[name](c)
    return c


def compare(a: Column, b: Column, greater: bool = True) -> Column:
    """yes or no of two values read as numbers; null if one isn't a number."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNull() | y.isNull(), None).when((x > y) if greater else (x < y), "yes").otherwise("no")


def difference(a: Column, b: Column) -> Column:
    return F.round(F.abs(a.try_cast("double") - b.try_cast("double")), 3)


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


#: Days of each month in a leap year.
DAYS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def partial_date(text: Column) -> Column:
    """year, month and day that a text names, as a struct; null for what it doesn't: 1995-06-17, 1995/06/17, 17 June 1995,
    June 17, 1995, June 1995, June 17, 06/17/1995, 17.06.1995. Months may be cut to three letters. Of two numbers before a
    year the first is the month, unless only the second can be. Two digits of a year are 1969 to 2068.

    ``sound`` is false where a day or month can't be, as in June 31."""
    low = F.lower(F.trim(text))
    iso = r"^(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?(?!\d)"
    numeric = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)"
    forms = {
        "first": (numeric, 1), "second": (numeric, 2), "last": (numeric, 3), "iso_year": (iso, 1), "iso_month": (iso, 2), "iso_day": (iso, 3),
        "year": (r"\b(\d{4})\b", 1), "day": (r"(?<![-/.\d])\b(\d{1,2})(?:st|nd|rd|th)?\b(?![-/.]\d)", 1),
    }
    name = F.regexp_extract(low, r"\b(" + "|".join(m[:3] for m in MONTHS) + r")[a-z]*\b", 1)
    parts = F.struct(*[F.nullif(F.regexp_extract(low, form, k), F.lit("")).cast("int").alias(n) for n, (form, k) in forms.items()], F.nullif(F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("int"), F.lit(0)).alias("month"))

    def read(x: Column) -> Column:
        swapped = (x["first"] > 12) & (x["second"] <= 12)
        full = F.when(x["last"] >= 100, x["last"]).when(x["last"] < 69, x["last"] + 2000).otherwise(x["last"] + 1900)
        numbers = x["first"].isNotNull()
        return F.struct(
            F.when(numbers, full).otherwise(F.coalesce(x["iso_year"], x["year"])).alias("year"),
            F.when(numbers, F.when(swapped, x["second"]).otherwise(x["first"])).otherwise(F.coalesce(x["iso_month"], x["month"])).alias("month"),
            F.when(numbers, F.when(swapped, x["first"]).otherwise(x["second"])).otherwise(F.coalesce(x["iso_day"], x["day"])).alias("day"),
        )

    def judged(x: Column) -> Column:
        longest = F.try_element_at(F.array(*[F.lit(n) for n in DAYS]), F.when(x["month"].between(1, 12), x["month"]))
        fits = F.coalesce(x["month"].between(1, 12), F.lit(True)) & F.coalesce(x["day"].between(1, F.coalesce(longest, F.lit(31))), F.lit(True))
        return F.struct(x["year"].alias("year"), x["month"].alias("month"), x["day"].alias("day"), fits.alias("sound"))

    return _once(_once(parts, read), judged)


def _once(value: Column, of) -> Column:
    """of(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def date_difference(a: Column, b: Column, unit: str) -> Column:
    """The first date less the second in days, months or years, for texts of dates or partial ones.

    A date without a year takes the other's; one with neither year nor month, or with January alone, can't be used. What
    else is missing counts as 1. Null for a day that the calendar doesn't have, February 29 in the other's year included.
    """
    if unit not in ("days", "months", "years"):
        raise ValueError(f"unknown unit {unit}")
    far = F.lit(3000)  # where neither has a year, both are in one

    def told(z: Column) -> Column:
        x, y = z["x"], z["y"]
        usable = lambda p: p["sound"] & (p["year"].isNotNull() | (F.coalesce(p["month"], F.lit(1)) != 1))
        year = lambda p, q: F.coalesce(p["year"], q["year"], far)
        month = lambda p: F.coalesce(p["month"], F.lit(1))
        day = lambda p, q: F.try_make_timestamp(year(p, q), month(p), F.coalesce(p["day"], F.lit(1)), F.lit(0), F.lit(0), F.lit(0)).cast("date")
        days = F.datediff(day(x, y), day(y, x))  # null if the calendar lacks one of them
        out = {"years": year(x, y) - year(y, x), "months": (year(x, y) - year(y, x)) * 12 + month(x) - month(y), "days": days}[unit]
        return F.when(usable(x) & usable(y) & days.isNotNull(), out)

    return _once(F.struct(partial_date(a).alias("x"), partial_date(b).alias("y")), told)


def sorted_distinct(pairs: DataFrame, key: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """Pairs in order of their value; of equal values the least key stays."""
    w = W.partitionBy(*within, value).orderBy(key)
    return pairs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def verbalize(template: str, subject: Column, object_: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("$1"), subject), F.lit("$2"), object_)


def chain_facts(entities: DataFrame, predicate: str, order: str, name: str) -> DataFrame:
    """Each entity related to the next in order, without one task for all: neighbours by their places."""
    own = placed(entities.select(F.col(order).alias("__o"), F.col(name).alias("subject")), ["__o", "subject"])
    after = own.select((F.col("place") - 1).alias("__p"), F.col("subject").alias("object"))
    return own.join(after, F.col("place") == F.col("__p")).select(F.lit(predicate).alias("predicate"), "subject", "object")


def parse_predicate(text: Column) -> dict[str, Column]:
    """Name and arguments of "name(a, b)" or "name(a | b)"."""
    inside = F.regexp_extract(text, r"^[^(]*\((.*)\)$", 1)
    args = F.when(F.contains(inside, F.lit(" | ")), F.split(inside, r" \| ")).otherwise(F.split(inside, ", "))
    return {"name": F.regexp_extract(text, r"^([^(]*)\(", 1), "args": args}
