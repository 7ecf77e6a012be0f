import hashlib
import math
import random
import re
from collections import Counter

import numpy as np

from ravelin.llm import quality
from ravelin.llm._common import WHITE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(five)
    covered = {i + k for i, x in enumerate(five) if times[x] > 1 for k in range(5)}
    lines = t.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def grams(text):
    h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in WORD.findall(text or "")]
    return [(0, x % quality.BUCKETS) for x in h], [(1, (x * quality.MULTIPLIER + y) % quality.BUCKETS) for x, y in zip(h, h[1:], strict=False)]


def by_hand(docs, labels):
    """Scores and verdicts from counts in dictionaries."""
    rows = docs.collect()
    marks = {}
    for m in labels.collect():
        marks.setdefault(m.doc_id, []).append(m)
    good = [i for i, ms in marks.items() if i is not None and min((m.quality for m in ms if m.quality is not None), default=0) == 1 and max((m.toxic for m in ms if m.toxic is not None), default=0) == 0]
    rank = sorted(good, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[: quality.TRUSTED]
    held = {i for i in rank if int(hashlib.md5(str(i).encode()).hexdigest()[:4], 16) % quality.HELD_OUT == 0}
    corpus, trusted = [Counter(), Counter()], [Counter(), Counter()]
    for r in rows:
        for half, g in enumerate(grams(r.text)):
            corpus[half].update(g)
            if r.doc_id in set(rank) - held:
                trusted[half].update(g)
    weight = {}
    for half in range(2):
        n, m = sum(corpus[half].values()), sum(trusted[half].values())
        for b, c in corpus[half].items():
            mixed = (1 - quality.CORPUS_SHARE) * trusted[half][b] / m + quality.CORPUS_SHARE * c / n if m else c / n
            weight[b] = round(math.log(mixed / (c / n)) * 10**6)
    scores = []
    for r in rows:
        g = [weight[b] for half in grams(r.text) for b in half]
        scores.append(sum(g) // len(g) if g else 0)
    known = sorted(s for r, s in zip(rows, scores, strict=True) if r.doc_id in held and not base(r.text)[-1])
    least = (known[len(known) // quality.ONE_IN] if known else 0) - int(quality.MARGIN * 10**6)
    return [(r.doc_id, *base(r.text), not base(r.text)[-1] and s >= least, s) for r, s in zip(rows, scores, strict=True)]


def got(docs, labels):
    return [tuple(r) for r in quality.scored(docs, quality.fit(docs, labels)).collect()]


def same(docs, labels):
    order = lambda rows: sorted(rows, key=repr)
    assert order(got(docs, labels)) == order(by_hand(docs, labels))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 0, 0), (3, 1, 0), (7, 1, 0), (8, 1, 1), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    same(odd, labels)
    same(odd, labels.filter("false"))
    assert got(none, labels) == []


def test_windows_that_repeat():
    rnd = random.Random(11)
    for size in (0, 1, 4, 5, 6, 9, 30, 200):
        for kinds in (1, 2, 3, 30):
            text = " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöüßéñíóABCD"[:kinds]) for _ in range(size))
            assert quality.repeated(quality.words_of(text)) == base(text)[4]


def test_words_and_lines_of_odd_characters():
    text = "a\x1cb \x85c d\x0be\nx\x1f\n x\x1f\nx\x1f\n\n \n　\n　"
    words = quality.words_of(text)
    assert [w.decode() for w in words] == WORD.findall(text)
    assert (len(words), *quality.rules(text, words)) == base(text)[:5]
    assert WHITE == " \t\n\x0b\x0c\r"


def test_junk_goes_and_clean_texts_stay(spark):
    """Prose and texts of symbols of the same words; a fifth of either is labelled. All prose stays, whatever its length."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    prose = [" ".join(rnd.choices(vocabulary, k=rnd.choice([12, 40, 300]))) for _ in range(400)]
    junk = [" ".join(w + rnd.choice(["###", "$$$"]) for w in rnd.choices(vocabulary, k=80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(prose)), 0) for i in range(0, len(prose + junk), 5)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.scored(docs, quality.fit(docs, labels)).collect() if r.kept}
    assert kept == set(range(len(prose)))


def test_no_trust_weighs_nothing():
    corpus = np.arange(2 * quality.BUCKETS)
    assert not quality.log_ratios(corpus, np.zeros_like(corpus)).any()


def test_clean_documents_of_the_tables_stay(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = quality.op11_quality(spark, sf_dir).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed")
    assert told.count() > 20 and told.filter("NOT kept").count() == 0 and docs.count() == quality.op11_quality(spark, sf_dir).count()
