import random
import re
from collections import Counter

import numpy as np
import pytest

from ravelin.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least, longest=5):
    """Every phrase counted in a dictionary, every cut and every longer phrase looked at."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = set()
    for (lang, p), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(o == lang and b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in found.items())
        out.add((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score, inside))
    return out


def got(docs, **options):
    rows = [tuple(r) for r in phrases.collocations(docs, **options).select("lang", "phrase", "a", "l", "r", "n", "score", "inside").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def texts(seed, n):
    rnd = random.Random(seed)
    common = ["New York", "new york City", "of the", "a b a b a", "über die Brücke", "x"]
    return [(rnd.choice(["en", "de", None, ""]), rnd.choice([". ", " ", "\t", ",\n", " \x1c ", "\x85"]).join(rnd.choice(common) for _ in range(rnd.randint(0, 12)))) for _ in range(n)]


def test_random_texts(spark):
    rows = texts(3, 300)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert got(docs, least=12) == by_hand(rows, 12)


@pytest.mark.parametrize("slots", [7])
def test_candidates_in_blocks_and_words_in_files(spark, slots, monkeypatch):
    """More candidates than slots and more words than a file holds give the same phrases."""
    monkeypatch.setattr(phrases, "SLOTS", slots)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 3)
    rows = texts(4, 120)
    assert got(spark.createDataFrame(rows, "lang string, text string"), least=9, longest=3) == by_hand(rows, 9, 3)


def test_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert got(odd, least=2) == by_hand(rows, 2)
    assert got(none, least=2) == set()
    assert got(odd, least=10**6) == set()


def test_scores_pass_64_bits(spark):
    a = 9 * 10**14
    row = spark.range(1).select(phrases._scores(*[phrases.F.lit(x).cast("long") for x in (a, 9 * 10**15, a + 1, a + 2)]).alias("s")).first()
    assert row.s == 1000 * a * 9 * 10**15 // ((a + 1) * (a + 2))


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype="uint64"))
    stored = phrases.StoredKeys(keys)
    assert sorted(stored.hash.slots(keys).tolist()) == list(range(len(keys)))
    assert (stored.keys[stored.find(keys)] == keys).all()
    assert (stored.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert phrases.StoredKeys(keys[:0]).find(keys).tolist() == [-1] * len(keys)


def test_squeezed():
    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.choice([-1, -1, 3, 4]) for _ in range(rnd.randint(0, 12))]
        runs = [[int(x) for x in r.split()] for r in " ".join(map(str, ids)).split("-1")]
        out = phrases.squeezed(np.array(ids, "int32")).tolist()
        assert [[int(x) for x in r.split()] for r in " ".join(map(str, out)).split("-1") if r.strip()] == [r for r in runs if len(r) > 1]


def test_tokens():
    assert phrases.tokens("A,b\x0bC d\x1ce") == [b"a", b"\xff", b"b", b"\xff", b"c", b"d\x1ce"]
    assert phrases.tokens(None) == phrases.tokens("") == []


def test_a_task_holds_the_counters_of_its_rows_alone(monkeypatch):
    """A sketch for 6 GB has 2^27 counters; a task's memory follows its rows, and sums are exact over all its parts."""
    import tracemalloc

    rng = np.random.default_rng(1)
    blobs = [rng.integers(0, 1 << 27, 5_000).astype("int64") for _ in range(40)]
    blobs.append(np.repeat(blobs[0], 300))
    tracemalloc.start()
    got = {}
    for frame in phrases._counted(iter(blobs), lambda x: x, most=60_000):
        for chunk, width, at, counts in zip(frame["chunk"], frame["width"], frame["places"], frame["counts"]):
            for a, n in zip(np.frombuffer(at, "<u2").tolist(), np.frombuffer(counts, f"<u{width}").tolist()):
                got[chunk * phrases.CHUNK + a] = got.get(chunk * phrases.CHUNK + a, 0) + n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at, n = np.unique(np.concatenate(blobs), return_counts=True)
    assert got == dict(zip(at.tolist(), n.tolist()))
    assert peak < 128 << 20
    assert phrases.SKETCH[1] >= 27
