"""SimHash near-duplicates found by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._common import detached, in_slices, met, table, trimmed, written
from ravelin.llm.components import components

#: Words in a shingle, the hash's seed, and the largest number of differing bits of a link.
WORDS, SEED, BITS = 3, 42, 2
#: Buckets up to this size compare their members; larger ones are split by further wildcards, without pairs.
SMALL = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if over half the shingles' hashes have it; 0 without words. Signed, as Spark's long."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    whole = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    k = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - k + 1].tolist()
    stops = (ends[k - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([h(whole[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinted(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs (t, further columns) with __fp in place of t."""
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "t"], T.StructField("__fp", T.LongType())])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="t").assign(__fp=pd.Series([fingerprint(t, words, seed) for t in batch["t"]], index=batch.index, dtype="int64"))

    return in_slices(docs, of, schema)


def _masked(value: str, bit: str) -> str:
    return f"({value} & ~shiftleft(1L, {bit}))"


def links(prints: DataFrame, small: int = SMALL) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most two bits.

    A fingerprint is cut into two segments of 32 bits: of two that differ in at most two bits, one segment differs in
    at most one. Each segment is indexed under its 32 one-wildcard variants; equality of a variant makes a candidate.
    Buckets of up to ``small`` members compare them all and verify the distance. Larger ones are not paired: their
    members get a second wildcard in the other segment (and two where the first segment is equal), which proves the
    distance, and each such group is linked to its smallest member. No link is lost in its transitive closure.
    """
    # A fingerprint becomes 64 rows: the few bytes of all fingerprints are dealt over all tasks first.
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    variant = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).selectExpr(
        "fp", "v", "CASE WHEN v < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END AS seg"
    ).selectExpr("fp", "v", f"{_masked('seg', 'v % 32')} AS rest")
    shared = variant.groupBy("v", "rest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = shared.select(F.col("v").alias("w"), detached(F.col("rest")).alias("r"), "n")
    found = written(variant.join(met(shared), (F.col("v") == F.col("w")) & (F.col("rest") == F.col("r"))).select("fp", "v", "rest", "n"), "variants")

    few = found.filter(F.col("n") <= small).select("v", "rest", "fp")
    pairs = few.join(met(few.withColumnRenamed("fp", "gp")), ["v", "rest"]).filter("fp < gp AND bit_count(fp ^ gp) <= 2").select(F.col("fp").alias("a"), F.col("gp").alias("b"))

    many = found.filter(F.col("n") > small).selectExpr("fp", "v", "rest", "CASE WHEN v < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END AS other",
                                                         "CASE WHEN v < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END AS own")
    one = many.select("fp", "v", "rest", "other", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j")).selectExpr("fp", "v", "rest AS own", "j", "-1 AS k", f"{_masked('other', 'j')} AS other")
    two = (
        many.filter("v % 32 = 0").select("fp", "v", "own", "other", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("j"))
        .select("*", F.explode(F.expr("sequence(j + 1, 31)")).alias("k"))
        .selectExpr("fp", "v + 64 AS v", "own", "j", "k", f"{_masked(_masked('other', 'j'), 'k')} AS other")
    )
    grouped = one.unionByName(two)
    keys = ["v", "own", "j", "k", "other"]
    low = grouped.groupBy(*keys).agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(detached(F.col("own")).alias("own"), *[c for c in keys if c != "own"], "low")
    stars = grouped.join(met(low), keys).filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _rooted(classes: DataFrame, small: int) -> DataFrame:
    """classes (fp and other columns, a row for each fingerprint) with ``root``, the smallest fingerprint that links reach."""
    roots = components(links(classes.select("fp"), small))
    return classes.join(met(roots.select(F.col("node"), "root")), F.col("fp") == F.col("node"), "left").select(*classes.columns, F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, words: int = WORDS, seed: int = SEED, small: int = SMALL, carry: Sequence[str] = ()) -> DataFrame:
    """Fingerprint and component of every row: doc_id, fp (signed long), component_id and the carried columns.

    component_id is the smallest doc_id that links of at most two bits reach, the row's own included.

    * null or empty text, or white space only: fingerprint zero, linked like any other.
    * repeated rows and repeated doc_ids: each row gets the fingerprint of its text.
    * null doc_id: never the smallest; a component of such rows only has a null id.
    * empty table: no rows. Other columns are ignored unless named in ``carry``.
    """
    base = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("t"), *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)])
    base = written(fingerprinted(base, words, seed), "fingerprints")
    rooted = _rooted(base.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("low")), small)
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(met(least), "root").select(F.col("fp").alias("key"), "component_id"), "named")
    return base.join(met(named), F.col("__fp") == F.col("key"), "left").select(
        F.col("__id").alias("doc_id"), F.col("__fp").alias("fp"), "component_id", *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)]
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that stay: of each component of ``near_groups`` the one with the smallest doc_id."""
    marked = _marked(docs)
    grouped = near_groups(marked, words, seed, carry=["__row"])
    return _one_each(marked, grouped.select("doc_id", "__row", F.coalesce(F.col("component_id"), F.col("fp")).alias("group"), F.col("component_id").isNull().alias("unnamed")))


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__row", F.xxhash64(F.coalesce("text", F.lit(""))))


def _one_each(marked: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each group (doc_id, __row, group, unnamed) the row with the smallest doc_id, null the last; ties: any one of
    equal rows. All columns of the rows are kept."""
    top = grouped.groupBy("group", "unnamed").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")).alias("top"))
    stays = written(top.select(F.col("top.doc_id").alias("__d"), F.col("top.__row").alias("__r")), "stays")
    kept = marked.join(stays, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__row") == F.col("__r")), "left_semi")
    repeated = grouped.groupBy("doc_id", "__row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "__row"])
    return kept.drop("__row")


# Similar texts: shingles in common make candidates, their exact sets decide.

#: Words in a shingle and the least Jaccard similarity of a link.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: 64-bit parts of a wide fingerprint, and of the wider one of large groups' members. Sets of FEW hashes or more may miss
#: the estimated distance by SLACK of all bits, smaller ones, whose majorities are coarse, by SLACK_FEW: over 5 deviations.
PARTS, WIDER, FEW = 8, 32, 64
SLACK, SLACK_FEW = {PARTS: 50, WIDER: 92}, {PARTS: 67, WIDER: 268}
#: Buckets up to this size compare their members pair by pair; members of larger ones meet so many rounds of centres, and
#: each other in blocks of this size.
SIMILAR_SMALL, ROUNDS, BLOCK_MEMBERS = 128, 2, 512
#: Hashes that so many texts have among their first are common: they come last in the order. At most COMMON_MOST, the
#: most frequent ones, are told apart: any choice gives the same links, it only sizes the buckets.
COMMON, COMMON_MOST = 16, 250_000
#: Longs that are broadcast at most.
BROADCAST = 2_000_000
_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(WIDER)], np.uint64)
_NONE = np.zeros(0, np.uint64)


def shingle_hashes(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The set of a text's word shingles (A-Z lower-cased; fewer words: all of them are one) as 64-bit hashes in order."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return _NONE
    whole = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    k = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(whole[a:b]) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64))


def wide_fingerprint(hashes: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """parts * 64 bits over a set of hashes, as signed longs; zeros of an empty set."""
    counts = np.zeros(parts * 64, np.int64)
    for at in range(0, len(hashes), 255):  # up to 255 fit a byte's sum
        x = hashes[at : at + 255, None] ^ _MIX[:parts]
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")


def prefix_size(n: int, similarity: float) -> int:
    """How many first hashes of a set of n are indexed: of two sets that similar, each holds at least similarity * n of
    its hashes in common with the other, so the first hash in common stands among these in both."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def ordered(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A sorted set in the one order of all hashes, in which ``common`` (sorted) ones come last."""
    if len(common) and len(hashes):
        at = np.minimum(common.searchsorted(hashes), len(common) - 1)
        last = common[at] == hashes
        hashes = np.concatenate((hashes[~last], hashes[last]))
    return hashes


def first_hashes(hashes: np.ndarray, similarity: float, common: np.ndarray = _NONE) -> np.ndarray:
    """The indexed hashes of a set: the first in that order."""
    return ordered(hashes, common)[: prefix_size(len(hashes), similarity)]


def largest_distance(similarity: float, bits: int = PARTS * 64) -> int:
    """Differing bits up to which two texts are estimated to be that similar: sets of Jaccard similarity J have a cosine
    of 2 J / (1 + J), and a bit differs with the angle's share of a half turn."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _distance(a: str, b: str, parts: int = PARTS) -> str:
    return " + ".join(f"bit_count({a}{k} ^ {b}{k})" for k in range(parts))


def common_hashes(texts: DataFrame, words: int, similarity: float, least: int = COMMON, most: int = COMMON_MOST) -> np.ndarray:
    """Of texts (t): the hashes that ``least`` texts or more have among their first, sorted; the most frequent ones if
    these are over ``most``."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [first_hashes(shingle_hashes(t, words), similarity) for t in batch["t"]]
            yield pd.DataFrame({"key": np.concatenate([_NONE, *found]).view(np.int64)})

    counts = in_slices(texts.select("t"), first, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    counts = written(counts.select("key", F.floor(F.log2("n") * 8).cast("int").alias("level")), "similar-common")
    bound, total = None, 0
    for level, n in sorted(map(tuple, counts.groupBy("level").agg(F.count(F.lit(1))).collect()), reverse=True):  # at most 512 levels
        total += n
        if total > most:
            break
        bound = level
    if bound is None:
        return _NONE
    keys = np.sort(counts.filter(F.col("level") >= bound).select("key").toArrow()["key"].to_numpy().view(np.uint64))
    trimmed()
    return keys


def same_shingles(base: DataFrame) -> DataFrame:
    """base (nid, head: a set's first hashes; one row for each nid) -> (key, nid, n): the sets under each hash that
    several have; n rows."""
    variant = base.select("nid", F.explode("head").alias("key"))
    shared = variant.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(detached(F.col("key")).alias("k"), "n")
    return written(variant.join(shared, F.col("key") == F.col("k")).select("key", "nid", "n"), "similar-buckets")


def _sides(prints: DataFrame, parts: int = PARTS) -> tuple[DataFrame, DataFrame]:
    """prints (nid, size, f0, f1, ...) as (a, xn, x0, ...) and (b, yn, y0, ...)."""
    return tuple(prints.select(F.col("nid").alias(name), F.col("size").alias(f"{c}n"), *[F.col(f"f{k}").alias(f"{c}{k}") for k in range(parts)]) for name, c in (("a", "x"), ("b", "y")))


def _fits(similarity: float, distance: str = "d", parts: int = PARTS) -> str:
    """Sets that similar are of like sizes, and their fingerprints aren't further apart than this."""
    most = largest_distance(similarity, parts * 64)
    return f"least(xn, yn) >= {similarity} * greatest(xn, yn) - 1e-9 AND {distance} <= CASE WHEN least(xn, yn) < {FEW} THEN {most + SLACK_FEW[parts]} ELSE {most + SLACK[parts]} END"


def near_pairs(found: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d): pairs a < b of sets that share a bucket of found (key, nid) and can be that similar."""
    left, right = _sides(classes)
    pairs = found.select("key", F.col("nid").alias("a")).join(found.select("key", F.col("nid").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    near = pairs.join(left, "a").join(right, "b").withColumn("d", F.expr(_distance("x", "y"))).filter(_fits(similarity))
    return written(near.select("a", "b", "d"), "similar-near")


def centred(members: DataFrame, classes: DataFrame, sample: int = 64) -> DataFrame:
    """members (key, nid, n) -> (key, nid, z): with the bucket's centre, which need not be in the bucket.

    Each member picks its largest bucket. Of those that picked one, the nearest to the bitwise majority of ``sample`` of
    them is their centre: the original, where copies were edited apart from each other. A bucket's centre is that of
    most of its members, so the buckets of one group of copies mostly agree in it.
    """
    parts = [f"f{k}" for k in range(PARTS)]
    one = written(members.groupBy("nid").agg(F.max(F.struct("n", "key")).alias("m")).select("nid", F.col("m.key").alias("key")), "similar-chosen")
    order = W.partitionBy("key").orderBy(F.xxhash64("nid"), "nid")
    some = one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample).join(classes, "nid")  # at most ``sample`` of a bucket

    def majority(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.unpackbits(np.ascontiguousarray(group[parts].to_numpy("<i8")).view(np.uint8), axis=1, bitorder="little")
        middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(group), bitorder="little").view("<i8")
        return pd.DataFrame([[group["key"].iloc[0], *middle.tolist()]], columns=["c", *[f"y{k}" for k in range(PARTS)]])

    middles = some.select("key", *parts).groupBy("key").applyInPandas(majority, "c long, " + ", ".join(f"y{k} long" for k in range(PARTS)))
    middles = middles.select(detached(F.col("c")).alias("c"), *[f"y{k}" for k in range(PARTS)])
    around = one.join(_sides(classes)[0], F.col("nid") == F.col("a")).join(middles, F.col("key") == F.col("c"))
    nearest = around.groupBy("key").agg(F.min(F.struct(F.expr(_distance("x", "y")).alias("d"), "nid")).alias("m")).select(detached(F.col("key")).alias("c"), F.col("m.nid").alias("z"))
    told = one.join(nearest, F.col("key") == F.col("c")).select(F.col("nid").alias("m"), "z")
    votes = members.join(told, F.col("nid") == F.col("m")).groupBy("key", "z").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("key").agg(F.max(F.struct("votes", "z")).alias("m")).select(detached(F.col("key")).alias("k"), F.col("m.z").alias("z"))
    return written(members.join(best, F.col("key") == F.col("k")).select("key", "nid", "n", "z"), "similar-centred")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (nid, h) are that similar, exactly."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("i", F.size(F.array_intersect("x", "y")))
    return written(both.filter(F.col("i") / (F.size("x") + F.size("y") - F.col("i")) >= similarity).select("a", "b"), "similar-links")


def star_links(many: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """many (key, nid, n: the members of large buckets) -> the links of members to their buckets' centres, those without
    one to a next centre; and the groups (z, nid) of the first centres, which hold each bucket's members together."""
    links, groups, left = [], None, many
    for k in range(rounds):
        members = centred(left, classes)
        if groups is None:
            groups = written(members.select("z", "nid").distinct(), "similar-groups")
        pairs = members.filter("nid <> z").select(F.col("z").alias("a"), F.col("nid").alias("b")).distinct()
        linked = verified(pairs, sets, similarity)
        links.append(linked)
        if k + 1 < rounds:
            told = linked.select(F.col("a").alias("c"), F.col("b").alias("m"))
            left = written(members.filter("nid <> z").join(told, (F.col("z") == F.col("c")) & (F.col("nid") == F.col("m")), "left_anti").select("key", "nid", "n"), "similar-left")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out, groups


def wider_prints(sets: DataFrame) -> DataFrame:
    """sets (nid, h) -> (nid, size, f0, f1, ...): fingerprints of WIDER parts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.asarray(h, np.int64).view(np.uint64) for h in batch["h"]]
            prints = np.array([wide_fingerprint(h, WIDER) for h in found], np.int64).reshape(-1, WIDER)
            yield pd.DataFrame({"nid": batch["nid"], "size": [len(h) for h in found], **{f"f{k}": prints[:, k] for k in range(WIDER)}})

    return written(in_slices(sets.select("nid", "h"), of, "nid long, size long, " + ", ".join(f"f{k} long" for k in range(WIDER))), "similar-wider")


def beyond_stars(groups: DataFrame, prints: DataFrame, rooted: Callable, similarity: float, block: int = BLOCK_MEMBERS) -> DataFrame:
    """Pairs (a, b) of a group's members (z, nid) in different components that can be that similar by their sizes and
    wider fingerprints (prints). A large group is dealt in blocks, so no task compares it alone; what doesn't fit is
    never made a row."""
    told = rooted("nid", groups, "u")
    split = told.groupBy("z").agg(F.min("u").alias("low"), F.max("u").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    split = split.select(detached(F.col("z")).alias("g"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    left, right = _sides(prints, WIDER)
    open_ = written(told.join(split, F.col("z") == F.col("g")).select("z", "nid", "u", "blocks"), "similar-open")
    here = open_.join(left, F.col("nid") == F.col("a")).select("z", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int").alias("block"), "a", "u", "xn", *[f"x{k}" for k in range(WIDER)])
    there = open_.join(right, F.col("nid") == F.col("b")).select(F.col("z").alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "b", F.col("u").alias("v"), "yn", *[f"y{k}" for k in range(WIDER)])
    fits = _fits(similarity, f"({_distance('x', 'y', WIDER)})", WIDER)
    return here.join(there, (F.col("z") == F.col("y")) & (F.col("block") == F.col("other")) & F.expr(f"a < b AND u <> v AND {fits}")).select("a", "b")


def similar_roots(found: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, small: int) -> DataFrame:
    """found (key, nid, n: the members of each bucket and their number), classes (nid, size, f0 ... f7: fingerprints),
    sets_of (nid -> nid, h: whole sets) -> (node, root): the components of all pairs that share a bucket and are that
    similar.

    Buckets of up to ``small`` members compare them all, each member its nearest first, and the others only if that
    leaves them in different components. Larger ones, which are mostly large groups of copies, compare members with
    centres, and then those of different components by wider fingerprints. Exact sets decide every link.
    """
    near = near_pairs(found.filter(F.col("n") <= small), classes, similarity)
    many = found.filter(F.col("n") > small)
    large = not many.isEmpty()
    wanted = near.select(F.col("a").alias("nid")).unionByName(near.select(F.col("b").alias("nid")))
    sets = sets_of((wanted.unionByName(many.select("nid")) if large else wanted).distinct())
    tree = near.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    linked = verified(tree, sets, similarity)
    groups = None
    if large:
        stars, groups = star_links(many, classes, sets, similarity)
        linked = linked.unionByName(stars)
    roots = components(linked)
    told = roots.select(detached(F.col("node")).alias("node"), "root")

    def rooted(name: str, table: DataFrame, out: str) -> DataFrame:
        return table.join(told, F.col(name) == F.col("node"), "left").withColumn(out, F.coalesce("root", name)).drop("node", "root")

    apart = rooted("b", rooted("a", near.select("a", "b"), "u"), "v").filter("u <> v").select("a", "b")
    if large:
        members = sets.join(many.select(F.col("nid").alias("m")).distinct(), F.col("nid") == F.col("m"), "left_semi")
        apart = apart.unionByName(beyond_stars(groups, wider_prints(members), rooted, similarity))
    more = verified(written(apart.distinct(), "similar-apart"), sets, similarity)
    return components(linked.unionByName(more)) if not more.isEmpty() else roots


def similar_groups(marked: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, small: int = SIMILAR_SMALL) -> DataFrame:
    """Rows of ``_marked`` documents -> (doc_id, __row, group): the components of similar texts, for each row."""
    parts = [f"f{k}" for k in range(PARTS)]
    rows = marked.select(F.col("doc_id").alias("d"), F.col("__row").alias("r"), F.col("text").alias("t"))
    shared = marked.sparkSession.sparkContext.broadcast(common_hashes(rows, words, similarity))
    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "t"], *map(long, ["nid", "size", *parts]), T.StructField("head", T.ArrayType(T.LongType()))])

    def numbers(sets: list[np.ndarray]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch["t"]]
            prints = np.array([wide_fingerprint(h) for h in sets], np.int64).reshape(-1, PARTS)
            head = pd.Series([first_hashes(h, similarity, shared.value).view(np.int64) for h in sets], index=batch.index, dtype=object)
            yield batch.drop(columns="t").assign(nid=numbers(sets), size=np.array([len(h) for h in sets], np.int64), **{f: prints[:, k] for k, f in enumerate(parts)}, head=head)

    # Equal sets have one number, a hash of the set; one text stands for its equals.
    base = written(in_slices(rows, of, schema), "similar-base")
    first = base.groupBy("nid").agg(F.min("r").alias("s")).select(detached(F.col("nid")).alias("n"), "s")
    classes = base.drop("d").join(first, (F.col("nid") == F.col("n")) & (F.col("r") == F.col("s"))).select("nid", "r", "size", *parts, "head")
    classes = written(classes.dropDuplicates(["nid"]), "similar-classes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = written(classes.select("nid", "r").join(wanted, "nid", "left_semi").select(F.col("r").alias("w")), "similar-wanted")
        asked = rows.join(F.broadcast(texts) if texts.count() <= BROADCAST else texts, F.col("r") == F.col("w"), "left_semi").select("t")

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [shingle_hashes(t, words) for t in batch["t"]]
                yield pd.DataFrame({"nid": numbers(found), "h": pd.Series([h.view(np.int64) for h in found], dtype=object)})

        return written(in_slices(asked, sets, "nid long, h array<long>").dropDuplicates(["nid"]), "similar-sets")

    roots = similar_roots(same_shingles(classes), classes.drop("r", "head"), sets_of, similarity, small)
    roots = roots.select(detached(F.col("node")).alias("node"), "root")
    grouped = base.select("d", "r", "nid").join(roots, F.col("nid") == F.col("node"), "left")
    grouped = grouped.select(F.col("d").alias("doc_id"), F.col("r").alias("__row"), F.coalesce("root", "nid").alias("group"))
    return written(grouped, "similar-grouped")


def drop_similar(docs: DataFrame, words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, small: int = SIMILAR_SMALL) -> DataFrame:
    """The rows of docs that stay when of each group of similar texts the one with the smallest doc_id stays.

    Texts are similar if their sets of word shingles (A-Z lower-cased) have a Jaccard similarity of at least
    ``similarity``; groups are the components of such links. Sets that similar share one of their first hashes, in an
    order in which hashes of many texts come last; those pairs are compared exactly, unless their fingerprints are
    further apart than such sets can be. All columns are kept.

    * null or empty text, or white space only: one group. Fewer words than a shingle: all of them are one shingle.
    * null doc_ids come after all others; of equal rows any one stays. Empty table: no rows.
    """
    marked = _marked(docs)
    grouped = similar_groups(marked, words, similarity, small)
    return _one_each(marked, grouped.withColumn("unnamed", F.lit(False)))


def drop_near(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """The rows of docs that stay when of each group of near duplicates the one with the smallest doc_id stays.

    Groups are the components of the links of ``near_groups`` (fingerprints that differ in at most two bits) and of
    ``drop_similar`` (sets of shingles that are similar), so edited copies that fingerprints tell apart go as well. All
    columns are kept; odd rows are as in ``drop_similar``.
    """
    marked = _marked(docs)
    prints = written(fingerprinted(marked.select(F.col("__row").alias("r"), F.col("text").alias("t"))), "near-prints")
    rooted = _rooted(prints.select(F.col("__fp").alias("fp")).distinct(), small)
    told = written(prints.distinct().join(met(rooted), F.col("__fp") == F.col("fp")).select("r", F.col("root").alias("print")), "near-rooted")
    grouped = similar_groups(marked)
    pairs = written(grouped.select("__row", "group").distinct().join(met(told), F.col("__row") == F.col("r")).select("group", "print").distinct(), "near-pairs")
    low = pairs.groupBy("print").agg(F.min("group").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(detached(F.col("print")).alias("p"), "low")
    joined = components(pairs.join(met(low), F.col("print") == F.col("p")).select(F.col("low").alias("a"), F.col("group").alias("b")))
    joined = joined.select(detached(F.col("node")).alias("node"), "root")
    whole = grouped.join(met(joined), F.col("group") == F.col("node"), "left").select("doc_id", "__row", F.coalesce("root", "group").alias("group"), F.lit(False).alias("unnamed"))
    return _one_each(marked, written(whole, "near-grouped"))
