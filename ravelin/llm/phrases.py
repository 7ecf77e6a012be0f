"""Phrase collocations: candidates that their parts leave possible get slots of a minimal perfect hash, and are counted there.

Words of enough occurrences get ids. From then on a phrase of k words is a key of two ids, those of its first and of its
last k-1 words, so that only phrases whose parts are frequent have one at all. Of each length

1. a sketch of hashed keys is counted, which tells the keys that can't be frequent;
2. the other distinct keys are the candidates; a minimal perfect hash gives each a slot, beside its key;
3. each task counts the slots of its keys as an array, keys that aren't stored at their slot left out; arrays are summed
   over nodes of several tasks, then over nodes;
4. positions of frequent phrases get their slot's id, the rest ends a run.

Candidates beyond SLOTS are counted in blocks of that many, one pass each.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm._common import UPPER, discarded, in_slices, table, trimmed, written

#: Occurrences and words of a candidate, phrases returned for a language, and the factor of a score.
LEAST, LONGEST, TOP, FACTOR = 100, 5, 2000, 1000
#: Candidates that have slots at a time, and words of one file of the lexicon: what the driver and a task hold.
SLOTS, SHARD_WORDS = 1 << 21, 1 << 19
#: Binary logarithms of the fewest and most counters of a sketch; it has about one for every eight words of the corpus.
SKETCH = (12, 28)
#: Counters that travel together, those that a task holds, and chunks that one task adds up.
CHUNK, COUNTERS, ADDED = 1 << 14, 1 << 21, 128
#: Ids that are kept together, and distinct words that a task holds.
BLOB, HELD = 1 << 14, 200_000
UNKNOWN, BREAK = "und", b"\xff"
ODD = np.uint64(0x9E3779B97F4A7C15)

_TOKENS = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r", UPPER.lower().encode() + BREAK * 10)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with BREAK (no byte of UTF-8) wherever a piece ends."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TOKENS).replace(BREAK, b" \xff ").split()


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = (keys ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * ODD
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 to n-1 for n different 64-bit keys. At each level, keys that are alone at their place are done and the
    others go on to the next, which has two places for each of them."""

    def __init__(self, places: np.ndarray, sizes: list[int]):
        self.places, self.sizes = places, sizes  # the slot at each place of each level, or -1

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest, done = [], keys, 0
        while len(rest):
            size = 2 * len(rest) + 1
            at = (_mix(rest, len(levels)) % np.uint64(size)).astype("int64")
            alone = np.bincount(at, minlength=size) == 1
            level = np.full(size, -1, "int32")
            level[alone] = done + np.arange(np.count_nonzero(alone), dtype="int32")
            done += int(np.count_nonzero(alone))
            levels.append(level)
            rest = rest[~alone[at]]
        return cls(np.concatenate([*levels, np.empty(0, "int32")]), [len(x) for x in levels])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot. A key that isn't one of the n gets any slot or -1: the caller compares what is stored there."""
        out = np.full(len(keys), -1, "int32")
        open_, offset = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            got = self.places[offset + (_mix(keys[open_], level) % np.uint64(size)).astype("int64")]
            out[open_] = got
            open_, offset = open_[got < 0], offset + size
        return out


class StoredKeys:
    """A perfect hash with its keys at their slots."""

    def __init__(self, keys: np.ndarray):
        self.hash = PerfectHash.of(keys)
        self.keys = np.zeros(len(keys), "uint64")
        self.keys[self.hash.slots(keys)] = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys that are stored, -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1, "int32")
        slots = self.hash.slots(keys)
        return np.where((slots >= 0) & (self.keys[slots] == keys), slots, np.int32(-1))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))


class Lexicon:
    """Ids of frequent words in files that tasks map into memory; a word's hash tells its file. ``words`` of a file are
    compared whole."""

    def __init__(self, names: list[str], bases: list[int]):
        self.bases = bases
        self.shards = [tuple(np.asarray(np.load(SparkFiles.get(f"{name}-{part}.npy"), mmap_mode="r")) for part in ("places", "sizes", "ends", "text")) for name in names]

    def find(self, words: list[bytes]) -> list[int]:
        hashes = _word_hashes(words)
        shard, out = hashes % np.uint64(len(self.shards)), [-1] * len(words)
        for s, (places, sizes, ends, text) in enumerate(self.shards):
            at = np.flatnonzero(shard == s)
            slots = PerfectHash(places, sizes.tolist()).slots(hashes[at])
            at, slots = at[slots >= 0], slots[slots >= 0]
            for i, slot, begin, end in zip(at.tolist(), slots.tolist(), ends[slots].tolist(), ends[slots + 1].tolist(), strict=True):
                if len(words[i]) == end - begin and text[begin:end].tobytes() == words[i]:
                    out[i] = self.bases[s] + slot
        return out


def _named(lang: str, word: bytes) -> bytes:
    return lang.encode() + b"\0" + word


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts; a null word has the count of all words of the language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}
        total: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = [(lang, w.decode("utf-8", "surrogatepass"), n) for lang, c in held.items() for w, n in c.items() if w != BREAK]
            return pd.DataFrame([*rows, *((lang, None, n) for lang, n in total.items())], columns=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = tokens(text)
                held.setdefault(lang, Counter()).update(words)
                total[lang] += len(words) - words.count(BREAK)
                if sum(map(len, held.values())) > HELD:
                    yield out()
                    held.clear()
                    total.clear()
        yield out()

    return in_slices(docs.select("lang", "text"), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def build_lexicon(words: DataFrame) -> tuple[list[str], list[int], DataFrame]:
    """words (lang, word, n) -> names of the files, the first id of each, and (id, lang, word, n). The driver sees the words
    of one file at a time."""
    spark = words.sparkSession
    shards = max(1, -(-words.count() // SHARD_WORDS))

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(shard=(_word_hashes([_named(x, w.encode("utf-8", "surrogatepass")) for x, w in zip(b["lang"], b["word"], strict=True)]) % np.uint64(shards)).astype("int64"))

    dealt = written(in_slices(words, shard, "lang string, word string, n long, shard long"), "words")
    folder, names, bases, base, parts = Path(tempfile.mkdtemp(prefix="ravelin-")), [], [], 0, []
    for s in range(shards):
        own = dealt.filter(F.col("shard") == s).drop("shard").toArrow()
        keys = [_named(x, w.encode("utf-8", "surrogatepass")) for x, w in zip(own["lang"].to_pylist(), own["word"].to_pylist(), strict=True)]
        hashes = _word_hashes(keys)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two frequent words have the same 64-bit hash")
        perfect = PerfectHash.of(hashes)
        slots = perfect.slots(hashes)
        order = np.argsort(slots)
        text = b"".join(keys[i] for i in order)
        ends = np.concatenate([[0], np.cumsum([len(keys[i]) for i in order])]).astype("int64")
        name = f"phrases-{uuid.uuid4().hex}"
        for part, x in (("places", perfect.places), ("sizes", np.array(perfect.sizes, "int64")), ("ends", ends), ("text", np.frombuffer(text, "uint8"))):
            np.save(folder / f"{name}-{part}.npy", x)
            spark.sparkContext.addFile(str(folder / f"{name}-{part}.npy"))
        names.append(name)
        bases.append(base)
        if len(keys):
            parts.append(written(spark.createDataFrame(own.append_column("id", pa.array(slots.astype("int64") + base))).select("id", "lang", "word", "n"), "words"))
        base += len(keys)
    out = parts[0] if parts else spark.createDataFrame([], "id long, lang string, word string, n long")
    for p in parts[1:]:
        out = out.unionByName(p)
    return names, bases, out


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Runs of two or more ids, each followed by one -1."""
    valid = np.concatenate([[False], ids >= 0, [False]])
    run = valid[1:-1] & (valid[:-2] | valid[2:])
    ends = ~valid[1:-1] & np.concatenate([[False], run[:-1]]) if len(run) else run
    return ids[run | ends]


def _blobs(arrays: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Arrays joined, each ended by a -1, until they are BLOB long: what a row of the table of ids holds."""
    held: list[np.ndarray] = []
    stop = np.array([-1], "int32")
    n = 0
    for x in arrays:
        if len(x):
            held += [x, stop]
            n += len(x) + 1
        if n >= BLOB:
            yield pd.DataFrame({"ids": [np.concatenate(held).astype("<i4").tobytes()]})
            held, n = [], 0
    if held:
        yield pd.DataFrame({"ids": [np.concatenate(held).astype("<i4").tobytes()]})


def encoded(docs: DataFrame, names: list[str], bases: list[int]) -> DataFrame:
    """Rows of ids: runs of frequent words."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(names, bases)

        def arrays() -> Iterator[np.ndarray]:
            for batch in batches:
                for lang, group in batch.groupby("lang")["text"]:
                    texts = [tokens(text) for text in group]
                    words = list(set().union(*texts) - {BREAK})
                    ids = dict(zip(words, lexicon.find([_named(lang, w) for w in words]), strict=True)) | {BREAK: -1}
                    for x in texts:
                        yield squeezed(np.fromiter(map(ids.__getitem__, x), "int32", len(x)))

        yield from _blobs(arrays())

    return in_slices(docs.select("lang", "text"), code, "ids binary")


def _keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a row of ids where a longer phrase is possible, and its keys."""
    ids = np.frombuffer(blob, "<i4")
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, ids[at].astype("uint64") << np.uint64(32) | ids[at + 1].astype("uint64")


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of several parts as one: places in order, each once."""
    at, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
    return at[begin], np.add.reduceat(n, begin) if len(at) else n


def _counted(blobs: Iterator[bytes], places, most: int = COUNTERS) -> Iterator[pd.DataFrame]:
    """Counters that rows of ids add to, by chunks: their places in the chunk and counts. About ``most`` are held at a
    time, however many counters there are."""

    def out(at: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        own, begin = np.unique(at // CHUNK, return_index=True)
        counts = [x.astype(np.min_scalar_type(int(x.max()))) for x in np.split(n, begin[1:])]
        return pd.DataFrame({"chunk": own, "width": [x.itemsize for x in counts], "places": [x.astype("<u2").tobytes() for x in np.split(at % CHUNK, begin[1:])], "counts": [x.tobytes() for x in counts]})

    held, n = [], 0
    for blob in blobs:
        at, counts = np.unique(places(blob), return_counts=True)
        held.append((at.astype("int64"), counts.astype("int64")))
        n += len(at)
        if n > most:
            held = [_added(held)]
            n = len(held[0][0])
            if n > most // 2:
                yield out(*held[0])
                held, n = [], 0
    if n:
        yield out(*_added(held))


def _sums(rows: DataFrame, size: int, places, least: int | None = None) -> np.ndarray:
    """Sums over tasks of ``size`` counters: places(row) gives the counters that a row of ids adds one to. With ``least``,
    only whether a sum reaches it, as packed bits. Tasks send the counters that they have, and each of those that add them
    up has at most ADDED chunks or so."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _counted((blob for batch in batches for blob in batch["ids"]), places)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, width, at, counts in zip(batch["chunk"], batch["width"], batch["places"], batch["counts"], strict=True):
                if chunk not in held:
                    held[chunk] = np.zeros(CHUNK, "int64")
                held[chunk][np.frombuffer(at, "<u2")] += np.frombuffer(counts, f"<u{width}")
        for chunk, x in held.items():
            yield pd.DataFrame({"chunk": [chunk], "counts": [(np.packbits(x >= least) if least is not None else x).tobytes()]})

    chunks = -(-size // CHUNK)
    adders = min(chunks, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks // ADDED)))
    parts = in_slices(rows, count, "chunk int, width int, places binary, counts binary").repartition(adders, "chunk")
    got = in_slices(parts, add, "chunk int, counts binary").toArrow()
    kind, each = ("<i8", CHUNK) if least is None else ("uint8", CHUNK // 8)
    out = np.zeros(chunks * each, kind)
    for chunk, counts in zip(got["chunk"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[chunk * each : (chunk + 1) * each] = np.frombuffer(counts, kind)
    return out[:size] if least is None else out


def _on(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether bits of a packed array are set."""
    return packed[at >> 3] >> (7 - (at & 7)).astype("uint8") & 1 == 1


def candidates(rows: DataFrame, words: int, least: int) -> DataFrame:
    """(key): distinct keys in rows of ids whose counter of the sketch reaches ``least``, as longs. Tasks send their own
    distinct keys packed by hash."""
    bits = int(np.clip(max(words // 8, 1).bit_length(), *SKETCH))
    shift = np.uint64(64 - bits)
    alive = _sums(rows, 1 << bits, lambda blob: (_mix(_keys(blob)[1], 99) >> shift).astype("int64"), least)
    sent = rows.sparkSession.sparkContext.broadcast(alive)
    del alive
    trimmed()

    parts = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(held: list[np.ndarray]) -> pd.DataFrame:
        x = np.unique(np.concatenate(held))
        part = (_mix(x, 5) % np.uint64(parts)).astype("int32")
        order = np.argsort(part, kind="stable")
        own, begin = np.unique(part[order], return_index=True)
        return pd.DataFrame({"part": own, "keys": [k.tobytes() for k in np.split(x[order], begin[1:])] if len(own) else []})

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alive = sent.value
        held, n = [], 0
        for batch in batches:
            for blob in batch["ids"]:
                x = _keys(blob)[1]
                held.append(np.unique(x[_on(alive, (_mix(x, 99) >> shift).astype("int64"))]))
                n += len(held[-1])
                if n > 4 * HELD:
                    held = [np.unique(np.concatenate(held))]
                    n = len(held[0])
                if n > 3 * HELD:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    def united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The different keys of a partition, which has all packs of its parts."""
        held = np.empty(0, "uint64")
        for batch in batches:
            held = np.unique(np.concatenate([held, *(np.frombuffer(x, "<u8") for x in batch["keys"])]))
        yield pd.DataFrame({"key": held.view("int64")})

    return in_slices(in_slices(rows, keys, "part int, keys binary").repartition("part"), united, "key long")


def lengthened(rows: DataFrame, words: int, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ids of phrases -> (id, head, tail, n) of the frequent phrases of one word more, whose first and last words
    are the phrases head and tail; and the rows with their ids as ``next``, or None if there are none. The rows given go."""
    spark = rows.sparkSession
    found = written(candidates(rows, words, least), "candidates")
    blocks = max(1, -(-found.count() // SLOTS))
    kind = "id long, head long, tail long, n long"
    rows = rows.withColumn("next", F.lit(None).cast("binary"))
    parts, base = [], 0
    for b in range(blocks):
        stored = StoredKeys(found.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()["key"].to_numpy().view("uint64"))
        sent = spark.sparkContext.broadcast(stored)
        counts = _sums(rows, max(1, len(stored.keys)), lambda blob, sent=sent: (x := sent.value.find(_keys(blob)[1]))[x >= 0])[: len(stored.keys)]
        often = np.flatnonzero(counts >= least)
        ids = np.full(len(counts), -1, "int32")
        ids[often] = base + np.arange(len(often))
        base += len(often)
        if len(often):
            keys = stored.keys[often]
            found_ = {"id": ids[often].astype("int64"), "head": (keys >> np.uint64(32)).astype("int64"), "tail": (keys & np.uint64((1 << 32) - 1)).astype("int64"), "n": counts[often]}
            parts.append(written(spark.createDataFrame(pa.table(found_)), "phrases"))
            before, rows = rows, written(_with_ids(rows, sent, spark.sparkContext.broadcast(ids)), "ids")
            discarded(before)
    discarded(found)
    out = parts[0] if parts else spark.createDataFrame([], kind)
    for p in parts[1:]:
        out = out.unionByName(p)
    trimmed()
    return out, rows if parts else None


def _with_ids(rows: DataFrame, stored, ids) -> DataFrame:
    """``next``: at each place the id of the phrase that starts there, if it is a frequent one of this block."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for blob, before in zip(batch["ids"], batch["next"], strict=True):
                at, keys = _keys(blob)
                slot = stored.value.find(keys)
                place, slot = at[slot >= 0], slot[slot >= 0]
                new = np.frombuffer(before, "<i4").copy() if before is not None else np.full(len(blob) // 4, -1, "<i4")
                new[place] = np.maximum(new[place], ids.value[slot])
                out.append(new.tobytes())
            yield pd.DataFrame({"ids": batch["ids"], "next": pd.Series(out, index=batch.index, dtype=object)})

    return in_slices(rows, fill, "ids binary, next binary")


def _next(rows: DataFrame) -> DataFrame:
    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _blobs(squeezed(np.frombuffer(x, "<i4")) for batch in batches for x in batch["next"] if x is not None)

    return in_slices(rows.select("next"), take, "ids binary")


def _whole(c: Column) -> Column:
    return c.cast("decimal(16,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """All candidates: lang, phrase, words, a, l, r, n, score, inside (whether a longer candidate as frequent holds it).

    Phrases lie within pieces of a text and are counted by language. A cut after the first k words gives the counts l and r
    of both parts; the lowest score of a phrase's cuts counts, the smallest k of equal ones. Counts are longs; scores are
    divided in 38 decimal digits.

    * null text counts as empty, null lang as ``und``; repeated rows count each; doc_id isn't read.
    * empty table, or no frequent phrase: no rows. Extra columns are ignored; very long texts are read whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    counts = written(word_counts(docs).filter((F.col("n") >= least) | F.col("word").isNull()), "word-counts")
    totals = counts.filter("word IS NULL").select(F.col("lang").alias("t_lang"), F.col("n").alias("total"))
    words = int(totals.agg(F.sum("total")).first()[0] or 0)
    names, bases, known = build_lexicon(counts.filter("word IS NOT NULL"))
    rows: DataFrame | None = written(encoded(docs, names, bases), "ids")
    level = known.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("lefts"), F.array("n").alias("rights"))
    out = []
    for k in range(2, longest + 1):
        longer, rows = lengthened(rows, words, least)
        if rows is None:
            break
        rows = _next(before := rows)
        rows = written(rows, "ids")
        discarded(before)
        head = level.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("h_phrase"), F.col("n").alias("h_n"), F.col("lefts").alias("h_lefts"))
        tail = level.select(F.col("id").alias("tail"), F.col("last").alias("t_last"), F.col("n").alias("t_n"), F.col("rights").alias("t_rights"))
        joined = longer.join(head, "head").join(tail, "tail")
        now = written(
            joined.select(
                "id", "lang", F.concat_ws(" ", "h_phrase", "t_last").alias("phrase"), F.col("t_last").alias("last"), "n", F.concat("h_lefts", F.array("n")).alias("lefts"),
                F.concat("t_rights", F.array("n")).alias("rights"), "head", "tail", (F.col("h_n") == F.col("n")).alias("as_head"), (F.col("t_n") == F.col("n")).alias("as_tail"),
            ),
            "level",
        )
        if k > 2:
            holds = now.filter("as_head").select(F.col("head").alias("in_id")).union(now.filter("as_tail").select(F.col("tail").alias("in_id"))).distinct()
            out[-1] = out[-1].join(holds, F.col("id") == F.col("in_id"), "left").withColumn("inside", F.col("in_id").isNotNull()).drop("in_id")
        cut = lambda j, k=k: (F.get("lefts", F.lit(j - 1)), F.get("rights", F.lit(k - j - 1)))
        cuts = [F.struct(F.lit(j).alias("k"), cut(j)[0].alias("l"), cut(j)[1].alias("r")) for j in range(1, k)]
        out.append(now.select("id", "lang", "phrase", F.lit(k).alias("words"), F.col("n").alias("a"), F.array(*cuts).alias("cuts")).withColumn("inside", F.lit(False)))
        level = now.select("id", "lang", "phrase", "last", "n", "lefts", "rights")
    if not out:
        return spark.createDataFrame([], "lang string, phrase string, words int, a long, l long, r long, n long, score long, inside boolean")
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    both = both.join(totals, F.col("lang") == F.col("t_lang"))
    scored = F.transform("cuts", lambda c: F.struct(_scores(F.col("a"), F.col("total"), c.l, c.r).alias("score"), c.k.alias("k"), c.l.alias("l"), c.r.alias("r")))
    return both.withColumn("best", F.array_min(scored)).select("lang", "phrase", "words", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score", "inside")


def _scores(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(FACTOR * a * n / (left * right)), exactly."""
    return F.call_function("div", _whole(a) * F.lit(FACTOR).cast("decimal(4,0)") * _whole(n), _whole(left) * _whole(right))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents")).filter("NOT inside")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= TOP).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH p AS (
  SELECT lang, unnest(list_transform(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), lambda x: list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> ''))) AS w
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
), c AS (
  SELECT lang, k, phrase, count(*) AS a FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM p, range(1, {LONGEST + 1}) x(k), range(1, len(w) - k + 2) y(i)
  ) GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), d AS (
  SELECT c.*, n.n, string_split(phrase, ' ') AS w FROM c JOIN n USING (lang) WHERE k > 1
), s AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, a FROM d, range(2, k) x(j), range(1, k - j + 2) y(i)
), f AS (
  SELECT lang || chr(1) || phrase AS part, a FROM c
), t AS (
  SELECT e.lang, e.phrase, e.a, e.n, l.a AS l, r.a AS r, (({FACTOR}::HUGEINT * e.a * e.n) // (l.a::HUGEINT * r.a))::BIGINT AS score, e.i
  FROM (SELECT d.*, y.i, lang || chr(1) || array_to_string(w[1:y.i], ' ') AS lp, lang || chr(1) || array_to_string(w[y.i + 1:], ' ') AS rp FROM d, range(1, d.k) y(i)) e
  JOIN f l ON l.part = e.lp JOIN f r ON r.part = e.rp
), b AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), o AS (
  SELECT b.lang, b.phrase, b.a, b.l, b.r, b.n, b.score, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM s GROUP BY lang, phrase) m USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= {TOP}
"""
