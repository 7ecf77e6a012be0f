"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent words are counted over the whole corpus and compiled, with their ids, into a shared-suffix automaton that
executors memory-map. A word outside it is merged by the vocabulary's own ranks. Both ways give the same ids.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm._common import in_slices, table, trimmed, written

#: Words of the automaton, at most. It bounds what is brought to the driver and sent to executors.
LEXICON = 40_000
#: Distinct words that a task counts before it hands its counts on, and words that a task remembers.
HELD = 200_000
#: Bytes of a word up to which words merge side by side, and how many do at a time.
SHORT, WIDE = 48, 16_384
NEVER = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes for themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary whose words end in a suffix, read from a tokenizer's JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[int, int] = {}  # pair -> rank and the pair's id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[a] << 32 | self.ids[b]] = rank << 32 | self.ids[a + b]
        self._pairs = np.array(sorted(self.ranks), np.uint64)
        self._ranks = np.array([self.ranks[k] for k in sorted(self.ranks)], np.int64)
        self._letters = [np.array([self.ids[c + e] for c in _byte_letters()], np.int64) for e in ("", self.end)]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None

    def split(self, text: str) -> list[str]:
        """A text's words and special tokens in order; special tokens are told apart by ``special``."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
            if k % 2:
                out.append(part)
                continue
            # lower-casing is by single characters: no final sigma
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += self.words(part)
        return out

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the pair of lowest rank merges first, of equal ones the leftmost."""
        if word in self.special:
            return [self.special[word]]
        letters = [_byte_letters()[b] for b in word.encode("utf-8", "surrogatepass")]
        letters[-1] += self.end
        sym: list[int] = [self.ids[c] for c in letters]
        n = len(sym)
        rank = self.ranks.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank(sym[i] << 32 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = r & 0xFFFFFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(sym[x] << 32 | sym[y])) is not None:
                    heapq.heappush(heap, (r, x, sym[x], sym[y]))
        return [s for s in sym if s >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._ranks[at], NEVER)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Packed ids of many words: in each round every word merges its pair of lowest rank, all words at once."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in raw])
        out: list[bytes] = [b""] * len(words)
        low = 0
        for most in (8, 16, SHORT):
            some = np.flatnonzero((size > low) & (size <= most))
            low = most
            for at in range(0, len(some), WIDE):
                part = some[at : at + WIDE]
                for k, ids in zip(part.tolist(), self._merge_block([raw[k] for k in part.tolist()], size[part])):
                    out[k] = ids
        for k in np.flatnonzero(size > SHORT).tolist():
            out[k] = _packed(self.merge(words[k]))
        return out

    def _merge_block(self, raw: list[bytes], size: np.ndarray) -> Iterator[bytes]:
        n, width = len(raw), int(size.max())
        column = np.arange(width)
        inside = column < size[:, None]
        sym = np.full((n, width + 1), len(self.names), np.int64)  # the last column pairs with nothing
        body = np.zeros((n, width), np.uint8)
        body[inside] = np.frombuffer(b"".join(raw), np.uint8)
        sym[:, :width][inside] = self._letters[0][body[inside]]
        sym[np.arange(n), size - 1] = self._letters[1][body[np.arange(n), size - 1]]
        after = np.where(column + 1 < size[:, None], column + 1, width)
        before = np.tile(np.arange(-1, width), (n, 1))
        pairs = np.full((n, width), NEVER)
        pairs[:, : width - 1][inside[:, 1:]] = self._rank(sym[:, : width - 1][inside[:, 1:]], sym[:, 1:width][inside[:, 1:]])
        rows = np.arange(n)
        while len(rows):
            held = pairs[rows]
            at = held.argmin(axis=1)
            best = held[np.arange(len(rows)), at]
            live = best < NEVER
            rows, at, best = rows[live], at[live], best[live]
            new, gone = best & 0xFFFFFFFF, after[rows, at]
            right = after[rows, gone]
            sym[rows, at], sym[rows, gone] = new, -1
            after[rows, at], before[rows, right] = right, at
            pairs[rows, gone] = NEVER
            pairs[rows, at] = self._rank(new, sym[rows, right])
            left = before[rows, at]
            some = left >= 0
            pairs[rows[some], left[some]] = self._rank(sym[rows[some], left[some]], new[some])
        kept = (sym[:, :width] >= 0) & inside
        flat, ends = sym[:, :width][kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
        return (flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does."""
        return " ".join(map(self.names.__getitem__, ids))


def compile_lexicon(entries: dict[str, list[int]], path: str) -> None:
    """Write words and their ids as a minimal acyclic transducer.

    The automaton is built from sorted words; states with equal futures are shared. Each arc carries the number of
    words that sort before its branch, so the sum along a word's path is the word's place, and ids lie by place.
    """
    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...), words below)

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append((*key, int(final) + sum(states[t][2] for _, t in arcs)))
        return register[key]

    open_: list[list] = [[False, []]]  # the states of the last word's path that may still grow
    last = b""
    for word, _ in [*words, (b"", None)]:
        same = len(os.path.commonprefix([last, word]))
        while len(open_) > same + 1:
            final, arcs = open_.pop()
            open_[-1][1].append((last[len(open_) - 1], freeze(final, arcs)))
        for _ in word[same:]:
            open_.append([False, []])
        if word:
            open_[-1][0] = True
        last = word
    root = freeze(*open_[0])
    keys, targets, places = [], [], []
    for s, (final, arcs, _) in enumerate(states):
        place = int(final)
        for byte, target in arcs:
            keys.append(s * 256 + byte)
            targets.append(target)
            places.append(place)
            place += states[target][2]
    lengths = [len(ids) for _, ids in words]
    parts = {
        "keys": np.array(keys, "<i8"), "targets": np.array(targets, "<i4"), "places": np.array(places, "<i4"),
        "final": np.array([s[0] for s in states], "u1"), "offsets": np.cumsum([0, *lengths]).astype("<i4"),
        "ids": np.array([i for _, ids in words for i in ids], "<u4"), "root": np.array([root], "<i4"),
    }
    with open(path, "wb") as f:
        head = json.dumps({k: [v.dtype.str, len(v)] for k, v in parts.items()}).encode()
        f.write(len(head).to_bytes(8, "little") + head)
        for v in parts.values():
            f.write(b"\0" * (-f.tell() % 8) + v.tobytes())


class Lexicon:
    """A compiled transducer, memory-mapped: processes of one machine share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
        n = int.from_bytes(bytes(raw[:8]), "little")
        at = 8 + n
        for name, (kind, length) in json.loads(bytes(raw[8:at])).items():
            at += -at % 8
            size = length * np.dtype(kind).itemsize
            setattr(self, f"before_{name}" if name == "places" else name, raw[at : at + size].view(kind))
            at += size

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word, -1 of a word that isn't in the lexicon. All words advance by a byte at a time."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.array([len(w) for w in words])
        order = np.argsort(-lengths, kind="stable")
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        live, state, place = order, np.full(len(words), self.root[0], np.int64), np.zeros(len(words), np.int64)
        for depth in range(int(lengths.max())):
            live = live[lengths[live] > depth]
            key = state[live] * 256 + flat[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            live, arc = live[found], arc[found]
            if not len(live):
                break
            state[live] = self.targets[arc]
            place[live] += self.before_places[arc]
            done = live[(lengths[live] == depth + 1) & (self.final[state[live]] == 1)]
            out[done] = place[done]
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Coder:
    """Encodes batches of texts: the lexicon first, the vocabulary's merges for other words."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None):
        self.bpe, self.lexicon, self.known = bpe, lexicon, {}

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if len(self.known) + len(new) > HELD:
            self.known.clear()
            new = words
        plain = [w for w in new if w not in self.bpe.special]
        if self.lexicon is not None and plain:
            places = self.lexicon.places([w.encode("utf-8", "surrogatepass") for w in plain])
            offsets, ids = self.lexicon.offsets, self.lexicon.ids
            for k in np.flatnonzero(places >= 0).tolist():
                p = places[k]
                self.known[plain[k]] = ids[offsets[p] : offsets[p + 1]].tobytes()
        rest = [w for w in plain if w not in self.known]
        self.known.update(zip(rest, self.bpe.merge_many(rest)))
        for w in new & self.bpe.special.keys():
            self.known[w] = _packed([self.bpe.special[w]])

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        found = [self.bpe.split(t or "") for t in texts]
        self.learn(set().union(*found))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in found]


_LOADED: dict = {}


def _once(key: tuple, make):
    """One object for each key and worker process; only the latest of a kind is kept."""
    if _LOADED.get(key[0], (None, None))[0] != key:
        _LOADED[key[0]] = (key, make())
    return _LOADED[key[0]][1]


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n): the words of all texts as the vocabulary splits them, special tokens left out."""
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _once(("bpe", vocabulary), lambda: Bpe(source.value))
        held: Counter = Counter()

        def out() -> pd.DataFrame:
            plain = {w: n for w, n in held.items() if w not in bpe.special}
            return pd.DataFrame({"word": list(plain), "n": pd.Series(list(plain.values()), dtype="int64")})

        for batch in batches:
            for text in batch["text"]:
                held.update(bpe.split(text or ""))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return in_slices(docs.select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON) -> str:
    """Compile the most frequent words of the corpus, at most so many, and hand the file to the executors.

    The least frequency that fits is found from a histogram of all counts, so the driver sees no more words than it
    compiles. Returns the file's name on the executors.
    """
    counts = written(word_counts(docs, vocabulary), "word-counts")
    bucket = F.floor(F.log2("n") * 16).cast("int")  # at most 1024 of them
    sizes = sorted(((r.b, r.words) for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for b, n in sizes:
        total += n
        if total > words:
            break
        least = b
    top = counts.filter(bucket >= least).select("word").collect() if least is not None else []
    bpe = Bpe(open(vocabulary, encoding="utf-8").read())
    name = f"lexicon-{uuid.uuid4().hex}.fst"
    path = os.path.join(tempfile.mkdtemp(prefix="ravelin-"), name)
    compile_lexicon({r.word: bpe.merge(r.word) for r in top}, path)
    docs.sparkSession.sparkContext.addFile(path)
    del bpe, top
    trimmed()
    return name


def encode(docs: DataFrame, vocabulary: str | None = None, words: int = LEXICON, decoded: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Token ids of every whole text: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), carried columns.

    ``decoded`` adds the text that the ids decode to, in the same pass.

    * null or empty text, or white space only: no ids.
    * a special token's string in a text is that token.
    * one row for each input row, repeated ones too; null doc_id stays null; empty table: no rows.
    * a very long word is merged in n log n; texts are never cut.
    """
    vocabulary = vocabulary or default_vocabulary()
    lexicon = build_lexicon(docs, vocabulary, words)
    source = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    rows = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    kept = [f for f in rows.schema.fields if f.name != "t"]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.StringType())] * decoded])

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _once(("bpe", vocabulary), lambda: Bpe(source.value))
        coder = Coder(bpe, _once(("lexicon", lexicon), lambda: Lexicon(SparkFiles.get(lexicon))))
        for batch in batches:
            ids = coder.encode(batch["t"].tolist())
            out = batch.drop(columns="t").assign(n_tokens=pd.Series([len(x) // 4 for x in ids], index=batch.index, dtype="int64"), ids=pd.Series(ids, index=batch.index, dtype=object))
            yield out.assign(decoded=_decoded(bpe, out["ids"])) if decoded else out

    out = in_slices(rows, code, schema)
    return out.select(F.col("d").alias("doc_id"), "n_tokens", "ids", *["decoded"] * decoded, *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])


def _decoded(bpe: Bpe, ids: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], index=ids.index, dtype=object)


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """coded with a further column ``decoded``: the tokens of ``ids`` joined by spaces; null ids give null."""
    vocabulary = vocabulary or default_vocabulary()
    source = coded.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    schema = T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())])

    def text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _once(("bpe", vocabulary), lambda: Bpe(source.value))
        for batch in batches:
            yield batch.assign(decoded=_decoded(bpe, batch["ids"]))

    return in_slices(coded, text, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    coded = encode(docs, vocabulary, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
