"""Substring deduplication over a log-structured fingerprint index.

Every window of 50 words has an anchor: the word 8-gram of least hash in it. Neighbouring windows with one anchor form
a cell. The index holds sorted immutable runs, one for each batch of documents, with an entry for each distinct cell:
the anchor's hash, a digest of the cell's words, and the smallest document that holds it, and where. Runs are bucketed
and sorted by anchor and digest, so that a new batch is merge-joined with them without moving or sorting them anew;
runs of like size are compacted into one by merge joins. Equal windows have equal anchors, so a window can recur only
under its own anchor: in an equal cell, which the join shows, or in a different cell of the same anchor, whose windows
are then compared one by one by 128-bit digests of their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._common import detached, exists, file_system, in_slices, new_path, removed, table, written

#: Words in a window and in an anchor.
WINDOW, ANCHOR = 50, 8
#: Batches in which a table enters the index, and runs that are compacted into one.
BATCHES, FANOUT = 2, 2
#: Anchors that are broadcast at most.
BROADCAST = 1_000_000
#: Windows that are handled at a time.
SEGMENT = 1 << 17
LOWEST = -(1 << 63)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _POWERS[int(base)] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """A text's words [^\\x20\\x09-\\x0D]+, joined by single spaces, and where each begins and ends."""

    def __init__(self, text: str | None):
        self.whole = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
        raw = np.frombuffer(self.whole, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.n = len(gaps) + 1 if len(raw) else 0
        self.starts = np.concatenate(([0], gaps + 1))[: self.n]
        self.ends = np.concatenate((gaps, [len(raw)]))[: self.n]

    def hashes(self, a: int, b: int) -> np.ndarray:
        """Hashes of the words a to b, from sums of their bytes times powers of a constant."""
        low, high = int(self.starts[a]), int(self.ends[b - 1])
        raw = np.frombuffer(self.whole, np.uint8)[low:high].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * _powers(_BASE, len(raw)), dtype=np.uint64, out=sums[1:])
        s, e = self.starts[a:b] - low, self.ends[a:b] - low
        return _mixed((sums[e] - sums[s]) * _powers(_INVERSE, len(raw) + 1)[s] + (e - s).astype(np.uint64))

    def digest(self, first: int, last: int, size: int) -> bytes:
        """Of the words that the windows first to last cover."""
        return blake2b(memoryview(self.whole)[int(self.starts[first]) : int(self.ends[last + WINDOW - 1])], digest_size=size).digest()

    def sha(self, span: int) -> bytes:
        """Of the words that the windows of a span cover."""
        first = span >> 8
        return sha256(memoryview(self.whole)[int(self.starts[first]) : int(self.ends[first + (span & 255) + WINDOW - 1])]).digest()

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor hashes, first windows, last windows) by segments of the text."""
        for a in range(0, self.n - WINDOW + 1, SEGMENT):
            b = min(self.n, a + SEGMENT + WINDOW - 1)
            h = self.hashes(a, b)
            width, factor = 1, _STEP
            while width < ANCHOR:
                h = h[:-width] * factor + h[width:]
                width, factor = width * 2, np.uint64(int(factor) ** 2 & (1 << 64) - 1)
            h = _mixed(h)
            least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
            width, span = 1, WINDOW - ANCHOR + 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            last = np.concatenate((first[1:], [len(at)])) - 1
            yield h[at[first]], first + a, last + a


def _keyed(docs: DataFrame) -> DataFrame:
    """order (doc_id, null as the least), row (32 bits of a hash of the text, to tell rows of one doc_id apart) and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("o"), F.hash(text).alias("r"), text.alias("text"))


def cells(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(fp, cell, o, r, span): the cells of all texts; cell has ``bits`` bits of a digest of all words, span holds the first
    window and how many more."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, waiting = [], 0

            def out() -> pd.DataFrame:
                fp, cell, o, r, span = (np.concatenate(x) for x in zip(*parts))
                return pd.DataFrame({"fp": fp.view(np.int64), "cell": cell, "o": o, "r": r, "span": span})

            for o, r, text in zip(batch["o"], batch["r"], batch["text"]):
                words = Words(text)
                for fp, first, last in words.cells():
                    digests = b"".join([words.digest(f, z, 8) for f, z in zip(first.tolist(), last.tolist())])
                    parts.append((fp, np.frombuffer(digests, "<i8") >> (64 - bits), np.full(len(fp), o, np.int64), np.full(len(fp), r, np.int32), (first << 8) | (last - first)))
                    waiting += len(fp)
                if waiting > 100_000:
                    yield out()
                    parts, waiting = [], 0
            if parts:
                yield out()

    return in_slices(_keyed(docs), cut, "fp long, cell long, o long, r int, span long")


class SubstringIndex:
    """The runs of an index below ``path`` in the shared folder: tables (fp, cell, low, r, span), bucketed and sorted by
    (fp, cell), which never change. low is the smallest document that holds the cell in the run or in an older one, r and
    span say where in that document; fresh says that no older run holds the cell.

    A run's name tells which batches it covers and its buckets. A compacted run covers those that it replaces; they are
    removed only when it is complete, so a run that another covers, or that isn't complete, doesn't count. An index is
    opened again by its path.
    """

    SCHEMA = "fp long, cell long, low long, r int, span long, fresh boolean"
    NAME = re.compile(r"run-(\d{8})-(\d{8})-(\d{6})")

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = (path or new_path(spark, "substring-index")).rstrip("/")

    def runs(self) -> list[str]:
        """Names of the live runs, oldest first."""
        if not exists(self.spark, self.path):
            return []
        fs, where = file_system(self.spark, self.path)
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        matched = {n: self.NAME.fullmatch(n) for n in names}
        found = {n: (int(m[1]), int(m[2])) for n, m in matched.items() if m and exists(self.spark, f"{self.path}/{n}/_SUCCESS")}
        return sorted(n for n, (a, b) in found.items() if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found.values()))

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed table; it is registered where this session doesn't know it."""
        name = self._name(run)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (fp, cell) SORTED BY (fp, cell) INTO {int(run[-6:])} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(name)

    def _name(self, run: str) -> str:
        return "ravelin_" + blake2b(f"{self.path}/{run}".encode(), digest_size=12).hexdigest()

    def _write(self, entries: DataFrame, first: int, last: int) -> str:
        runs = self.runs()
        buckets = int(runs[0][-6:]) if runs else int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        run = f"run-{first:08d}-{last:08d}-{buckets:06d}"
        entries.write.format("parquet").bucketBy(buckets, "fp", "cell").sortBy("fp", "cell").option("path", f"{self.path}/{run}").saveAsTable(self._name(run))
        return run

    def add(self, cells: DataFrame) -> str:
        """A batch's cells (fp, cell, o, r, span) as a new run, merge-joined with all older ones. Returns the run."""
        runs = self.runs()
        new = cells.groupBy("fp", "cell").agg(F.min(F.struct(F.col("o").alias("low"), "r", "span")).alias("own"))
        for k, run in enumerate(runs):
            old = self.table(run).select("fp", "cell", F.struct("low", "r", "span").alias(f"old{k}"))
            new = new.join(old.hint("merge"), ["fp", "cell"], "left")
        olds = [F.col(f"old{k}") for k in range(len(runs))]
        first = F.least("own", *olds) if olds else F.col("own")
        fresh = reduce(lambda a, b: a & b, [c.isNull() for c in olds], F.lit(True))
        last = int(self.NAME.fullmatch(runs[-1])[2]) if runs else 0
        return self._write(new.select("fp", "cell", first.alias("first"), fresh.alias("fresh")).select("fp", "cell", "first.*", "fresh"), last + 1, last + 1)

    def compact(self) -> None:
        """While the newest ``fanout`` runs cover equally many batches: one run in their place, by merge joins. Of a cell
        in several, the entry of the smallest document stays."""
        while True:
            runs = self.runs()
            some = runs[-self.fanout :]
            covers = [(int(m[1]), int(m[2])) for m in map(self.NAME.fullmatch, some)]
            if len(some) < self.fanout or len({b - a for a, b in covers}) > 1:
                return
            merged = self.table(some[0])
            for run in some[1:]:
                newer = self.table(run).toDF("fp", "cell", "l", "rr", "s", "f")
                here, there = F.when(F.col("low").isNotNull(), F.struct("low", "r", "span")), F.when(F.col("l").isNotNull(), F.struct(F.col("l").alias("low"), F.col("rr").alias("r"), F.col("s").alias("span")))
                merged = merged.join(newer.hint("merge"), ["fp", "cell"], "full").select("fp", "cell", F.least(here, there).alias("first"), F.coalesce("fresh", "f").alias("fresh"))
                merged = merged.select("fp", "cell", "first.*", "fresh")
            self._write(merged, covers[0][0], covers[-1][1])
            self.remove(some)

    def remove(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            removed(self.spark, f"{self.path}/{run}")

    def entries(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA)
        for run in self.runs():
            out = out.unionByName(self.table(run))
        return out

    def open_anchors(self, among: DataFrame | None = None) -> DataFrame:
        """Anchors (fp) that stand in several cells, of different documents; ``among`` (fp) bounds where they are looked for."""
        held = self.entries().filter("fresh").select("fp", "low")
        if among is not None:
            held = held.join(among.select(F.col("fp").alias("k")), F.col("fp") == F.col("k"), "left_semi")
        shared = held.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("a"), F.max("low").alias("b"))
        return shared.filter("n > 1 AND a <> b").select("fp")


#: What is read of a text again: windows, cells that are held to recur, and the cells that they are held to equal.
WINDOWS, CLAIM, FIRST = 0, 1, 2


def _read(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (o, r, kind, span, fp, cell) -> (kind, o, r, at, a, b, words). Of WINDOWS a row for each window of the spans, a
    and b are 128 bits of a digest of its words and ``at`` is its place; of other kinds a row for each span, a and b are fp and
    cell, ``at`` is the span and words the SHA-256 of all words of the cell."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, waiting = [], 0

            def out() -> pd.DataFrame:
                names = ("kind", "o", "r", "at", "a", "b", "words")
                return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*parts)))))

            def put(kind: int, o: int, r: int, at: np.ndarray, a: np.ndarray, b: np.ndarray, words: np.ndarray) -> None:
                parts.append((np.full(len(at), kind, np.int32), np.full(len(at), o, np.int64), np.full(len(at), r, np.int32), at, a, b, words))

            for o, r, text, spans in zip(batch["o"], batch["r"], batch["text"], batch["spans"]):
                words = Words(text)
                windows = [np.arange(s["span"] >> 8, (s["span"] >> 8) + (s["span"] & 255) + 1) for s in spans if s["kind"] == WINDOWS]
                at = np.unique(np.concatenate(windows)) if windows else np.empty(0, np.int64)
                for k in range(0, len(at), SEGMENT):
                    some = at[k : k + SEGMENT]
                    w = np.frombuffer(b"".join([words.digest(x, x, 16) for x in some.tolist()]), np.dtype([("a", "<i8"), ("b", "<i8")]))
                    put(WINDOWS, o, r, some, w["a"], w["b"], np.full(len(some), None, object))
                    waiting += len(some)
                for kind in (CLAIM, FIRST):
                    own = [s for s in spans if s["kind"] == kind]
                    if own:
                        shas = np.empty(len(own), object)
                        shas[:] = [words.sha(s["span"]) for s in own]
                        put(kind, o, r, *(np.array([s[x] for s in own], np.int64) for x in ("span", "fp", "cell")), shas)
                        waiting += len(own)
                if waiting > 100_000:
                    yield out()
                    parts, waiting = [], 0
            if parts:
                yield out()

    spans = wanted.groupBy("o", "r").agg(F.collect_list(F.struct("kind", "span", "fp", "cell")).alias("spans"))  # one document's
    joined = docs.join(spans, ["o", "r"]).select("o", "r", "text", "spans")
    return in_slices(joined, read, "kind int, o long, r int, at long, a long, b long, words binary")


def _spans(df: DataFrame, kind: int) -> DataFrame:
    return df.select("o", "r", F.lit(kind).alias("kind"), "span", "fp", "cell")


def _repeated_windows(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(o, r, span): windows of seen (a, b, o, r, at) that start in a smaller document of known (a, b, o), too."""
    first = known.groupBy("a", "b").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low < high").select(detached(F.col("a")).alias("v1"), detached(F.col("b")).alias("v2"), "low")
    alone = seen.join(first, (F.col("a") == F.col("v1")) & (F.col("b") == F.col("v2"))).filter("o > low")
    return alone.select("o", "r", F.shiftleft("at", 8).alias("span"))


def _batches(docs: DataFrame, n: int) -> list[Column]:
    """Conditions that deal a table by ranges of doc_id, smallest first; null doc_ids come first."""
    cuts = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 1000).alias("q")).first().q if n > 1 else []
    cuts = sorted(set(cuts or []))
    o = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        c = F.lit(True)
        if low is not None:
            c = c & (o > low)
        if high is not None:
            c = c & (o <= high)
        out.append(c)
    return out


def remove_repeats(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, index: SubstringIndex | None = None, history: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """Drop every word covered by a window of 50 words that also starts in a document with a smaller doc_id.

    Cells that meet in the index by an anchor and ``bits`` bits of a digest are verified by the SHA-256 of all their words
    against the first document's; where that fails, all windows of the anchor are judged one by one. Fewer bits only cost
    time.

    Windows are judged on the input. Returns doc_id, n_words, n_removed, text (kept words joined by one space), a row
    for each input row.

    With an ``index``, docs is a further batch of it: what the index holds counts as well, and the batch is added.
    ``history`` gives the documents that the index was made of; of these only rows are read that hold a cell which recurs in
    the batch, or share an anchor with different cells of it. Without it, cells of older documents are taken by their digest.
    Earlier results are not revised: batches should come in order of doc_id.

    * null or empty text, or white space only: no words. Fewer than 50 words: nothing is removed.
    * null doc_id: a document before all others (as is the least long). Extra columns are ignored.
    * repeated doc_id: rows of one document; they never remove each other's words.
    * empty table: no rows.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or SubstringIndex(spark, fanout=fanout)
    before = index.runs()
    cuts, added = [], []
    for batch in _batches(docs, batches):
        cuts.append(written(cells(docs.filter(batch), bits), "cells"))
        added.append(index.add(cuts[-1]))
    rows = _keyed(docs)

    # Anchors in several cells: of the batch's, or of anything where the index is only this table's.
    among = None
    if before:
        among = cuts[0].select("fp")
        for cut in cuts[1:]:
            among = among.unionByName(cut.select("fp"))
        among = among.distinct()
    anchors = written(index.open_anchors(among), "anchors")
    near = F.broadcast if anchors.count() <= BROADCAST else (lambda df: df)
    anchors = anchors.select(detached(F.col("fp")).alias("k"))
    met = None
    for cut, run in zip(cuts, added):
        lows = index.table(run).select(detached(F.col("fp")).alias("f"), F.col("cell").alias("c"), "low", F.col("r").alias("low_r"), F.col("span").alias("low_span"))
        held = cut.join(lows, (F.col("fp") == F.col("f")) & (F.col("cell") == F.col("c"))).join(near(anchors), F.col("fp") == F.col("k"), "left")
        held = held.withColumn("gone", F.col("o") > F.col("low")).withColumn("open", F.col("k").isNotNull()).filter("gone OR open")
        held = held.select("o", "r", "span", "fp", "cell", "gone", *[F.when(F.col("gone"), F.col(c)).alias(c) for c in ("low", "low_r", "low_span")])
        met = held if met is None else met.unionByName(held)
    met = written(met, "met")

    # Texts are read once: windows where an anchor stands in different cells, cells that recur, and the first of each.
    # A cell's first document isn't cleared by the cell itself; its windows may still recur in a different cell.
    older = _keyed(history) if before and history is not None else None
    claims = met.filter("gone")
    firsts = claims.select(F.col("low").alias("o"), F.col("low_r").alias("r"), F.col("low_span").alias("span"), "fp", "cell").distinct()
    wanted = _spans(met.filter("NOT gone"), WINDOWS).unionByName(_spans(claims, CLAIM)).unionByName(_spans(firsts, FIRST))
    read = written(_read(rows, wanted), "read")
    known = read.filter(F.col("kind") != CLAIM)
    if older is not None:
        parts = [index.table(run).filter("fresh").join(near(anchors), F.col("fp") == F.col("k"), "left_semi").select(F.col("low").alias("o"), "r", "span", "fp", "cell") for run in before]
        known = known.unionByName(written(_read(older, _spans(reduce(DataFrame.unionByName, parts), WINDOWS).unionByName(_spans(firsts, FIRST))), "read"))
    windows, seen = known.filter(F.col("kind") == WINDOWS).select("a", "b", "o"), read.filter(F.col("kind") == WINDOWS)
    equal = known.filter(F.col("kind") == FIRST).select(detached(F.col("a")).alias("v1"), detached(F.col("b")).alias("v2"), F.col("words").alias("first_words"))
    told = read.filter(F.col("kind") == CLAIM).join(equal, (F.col("a") == F.col("v1")) & (F.col("b") == F.col("v2")), "left")
    told = told.withColumn("same", F.col("first_words").isNull() | (F.col("words") == F.col("first_words")))
    gone = told.filter("same").select("o", "r", F.col("at").alias("span")).unionByName(_repeated_windows(seen, windows))
    unlike = written(told.filter("NOT same").select(F.col("a").alias("x")).distinct(), "unlike")
    if not unlike.isEmpty():  # digests of different words are equal: every window of these anchors is looked at
        among_these = lambda df: df.join(unlike, F.col("fp") == F.col("x"), "left_semi").select("o", "r", "span", "fp", "cell")
        again = written(_read(rows, _spans(reduce(DataFrame.unionByName, map(among_these, cuts)), WINDOWS)), "read")
        both = again.select("a", "b", "o")
        if older is not None:
            parts = [among_these(index.table(run).filter("fresh").withColumnRenamed("low", "o")) for run in before]
            both = both.unionByName(_read(older, _spans(reduce(DataFrame.unionByName, parts), WINDOWS)).select("a", "b", "o"))
        gone = gone.unionByName(_repeated_windows(again, both))
    gone = written(gone.groupBy("o", "r").agg(F.collect_list("span").alias("gone")), "gone")  # one document's
    if own:
        index.remove(index.runs())
    else:
        index.compact()

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"], batch["gone"]):
                words = Words(text)
                if spans is None or not len(spans):
                    out.append((words.n, 0, words.whole.decode("utf-8", "surrogatepass")))
                    continue
                spans = np.asarray(spans, np.int64)
                depth = np.zeros(words.n + 1, np.int64)
                np.add.at(depth, spans >> 8, 1)
                np.add.at(depth, (spans >> 8) + (spans & 255) + WINDOW, -1)
                kept = np.flatnonzero(np.cumsum(depth)[: words.n] == 0)
                whole = words.whole
                out.append((words.n, words.n - len(kept), b" ".join([whole[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist())]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame({"o": batch["o"], **dict(zip(("n_words", "n_removed", "text"), zip(*out)))}) if out else pd.DataFrame({"o": [], "n_words": [], "n_removed": [], "text": []})

    done = in_slices(rows.join(gone, ["o", "r"], "left").select("o", "text", "gone"), strip, "o long, n_words long, n_removed long, text string")
    return done.select(F.when(F.col("o") != LOWEST, F.col("o")).alias("doc_id"), "n_words", "n_removed", "text")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
