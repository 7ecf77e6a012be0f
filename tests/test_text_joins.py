"""Edit-similarity joins, best windows, stems, model boundaries, pooled sparse weights and table functions."""

import itertools
import math
import random
import tempfile
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ravelin.functions.stem import porter, stemmed
from ravelin.operators import models, sparse
from ravelin.operators import retrieval as R
from ravelin.operators import similarity as S
from ravelin.sources.blocks import blocks


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i = rnd.randrange(len(t) + 1)
        if rnd.random() < 0.4 and t:
            del t[min(i, len(t) - 1)]
        else:
            t.insert(i, rnd.choice("abcdé "))
    return "".join(t)


@pytest.mark.parametrize("least", [97, 90, 75])
def test_similar_texts_are_all_pairs(spark, least):
    """Copies, edited copies, chains, a passage that all texts of a group hold, one letter repeated, texts outside the
    basic plane, empty and null ones."""
    rnd = random.Random(least)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 130))) for _ in range(10)]
    texts = [edited(rnd, rnd.choice(base), rnd.randint(0, 12)) for _ in range(90)]
    texts += ["common passage of all of these texts " + edited(rnd, base[0], 30) for _ in range(15)]
    texts += ["a" * 60, "a" * 63, "😀é" * 40, "😀é" * 40 + "x", "", None, "x"] + texts[:4]
    got = S.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), least).collect()
    first = {}
    for i, x in enumerate(texts):
        if x:
            first.setdefault(x, i)
    want = {(min(i, j), max(i, j)): round(r, 4) for (x, i), (y, j) in itertools.combinations(first.items(), 2) if (r := S.ratio(x, y)) >= least - 1e-9}
    assert len(want) > 10 and {(r.a, r.b): r.ratio for r in got} == want and len(got) == len(want)


def test_text_classes_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, ""), (4, None), (1, "x")], "id int, text string")
    assert sorted(map(tuple, S.text_classes(df).collect())) == [(1, 1, 3), (1, 1, 3), (2, 2, 1), (3, 1, 3)]
    assert S.similar_texts(df.filter("false"), 90).count() == 0
    with pytest.raises(ValueError):
        S.similar_texts(df, 50)


def every_window(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    sides = [(short, long), (long, short)] if len(a) == len(b) else [(short, long)]
    return max(S.ratio(x, y[max(0, k) : k + len(x)]) for x, y in sides for k in range(1 - len(x), len(y)))


def test_best_window_is_the_best_of_all_windows(spark):
    rnd = random.Random(6)
    pairs = []
    for _ in range(150):
        long = "".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 150)))
        at = rnd.randrange(len(long) + 1)
        pairs.append((edited(rnd, long[at : at + rnd.randint(0, 50)], rnd.randint(0, 6)), long))
    pairs += [("", ""), ("", "a"), ("ab", "b"), ("abc", "xxabcxx"), ("aaaa", "aaaabaaaa")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.best_window_ratio(F.col("a"), F.col("b")).alias("r"), S.best_window_ratio(F.col("b"), F.col("a"), 80.0).alias("cut")).collect()
    for r in got:
        want = round(every_window(r.a, r.b), 4)
        assert r.r == want and r.cut == (want if want >= 80 else 0.0)


def test_long_texts_are_scanned_and_not_aligned_everywhere(monkeypatch):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    long = " ".join(rnd.choices(words, k=4000))
    short = edited(rnd, long[9000:9400], 8)
    calls = []
    monkeypatch.setattr(S, "ratio", lambda a, b, of=S.ratio: calls.append(1) or of(a, b))
    assert S.partial_ratio(short, long, 95.0) > 95 and len(calls) < 50
    calls.clear()
    assert S.partial_ratio(" ".join(rnd.choices(words, k=80)), long, 95.0) == 0.0 and not calls


def test_matching_passages(spark):
    rows = [(1, 1, 7, "the passage itself", "before the passage itself after"), (1, 2, 8, "the passage itself", "the passage itself"), (2, 1, 9, "other words", "nothing of them"), (3, 1, 9, None, "x")]
    got = S.matching_passages(spark.createDataFrame(rows, "query_id int, rank int, doc_id int, q string, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 7, 100.0)]


# Pairs of the published description.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit
conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil is is a a y y"""


def test_stems(spark):
    pairs = STEMS.split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]
    rows = spark.createDataFrame([(1, "cats"), (2, "cats"), (3, None), (4, "")], "id int, term string")
    assert sorted(map(tuple, stemmed(rows).collect())) == [(1, "cat"), (2, "cat"), (3, None), (4, "")]


def test_encoders_load_once_and_batch_by_length(spark):
    folder = tempfile.mkdtemp()

    def load():
        import uuid

        (Path(folder) / f"load-{uuid.uuid4().hex}").touch()

        def encode(texts):
            (Path(folder) / f"batch-{uuid.uuid4().hex}-{len(texts)}-{max(map(len, texts)) - min(map(len, texts))}").touch()
            return [[len(t), sum(map(ord, t))] for t in texts]

        return encode

    rnd = random.Random(2)
    texts = ["x" * rnd.randint(1, 300) for _ in range(200)] + [None, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    for _ in range(3):  # further tasks in the same workers
        got = {r.id: r.v for r in models.encoded(rows, "t", "v", folder, load, batch=16).collect()}
    assert got == {i: None if t is None else [float(len(t)), float(len(t) * ord("x"))] for i, t in enumerate(texts)}
    names = [p.name.split("-") for p in Path(folder).iterdir()]
    loads, batches = [n for n in names if n[0] == "load"], [n for n in names if n[0] == "batch"]
    assert len(loads) <= 8 and len(batches) >= 3 * len(set(texts)) / 16 - 3
    assert sum(int(b[2]) for b in batches) == 3 * (len(set(texts)) - 1)  # each distinct text once a run
    assert sum(int(b[3]) for b in batches) / len(batches) < 150  # texts of like length go together


def test_pair_scores_keep_rows_and_order(spark):
    rows = [(i, "q" * (i % 7), None if i % 10 == 3 else "p" * (i * 13 % 50)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, q string, p string")
    out = models.pair_scored(df, "q", "p", "s", "pairs", lambda: lambda pairs: [10 * len(a) + len(b) for a, b in pairs], batch=7)
    assert {r.id: r.s for r in out.collect()} == {i: None if p is None else 10.0 * len(q) + len(p) for i, q, p in rows}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="1 results for"):
        models.pair_scored(df, "q", "p", "s", "short", lambda: lambda pairs: [1]).collect()


def test_pooled_weights(spark):
    rnd = random.Random(9)
    tokens = ["[CLS]", "<s>", "a.b", "##ing", "ing", "déjà", "x_y", "u-v", "...", "#", "cat"] + [f"t{i}" for i in range(30)]
    rows = [(d, p, rnd.choice(tokens), rnd.uniform(-2, 3)) for d in range(5) for p in range(60)] + [(9, 0, "t1", -1.0), (9, 1, None, 2.0), (9, 2, "t2", None)]
    got = defaultdict(dict)
    for r in sparse.pooled(spark.createDataFrame(rows, "doc_id int, position int, token string, logit double"), most=12).collect():
        got[r.doc_id][r.token] = r.weight
    want = defaultdict(dict)
    for d in range(5):
        best = defaultdict(float)
        for x, _, t, v in rows:
            if x == d and v is not None and v > 0:
                best[t] = max(best[t], math.log1p(v))
        for t, w in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:12]:
            if t[0] not in "[<" and "." not in t and (bare := "".join(c for c in t if c.isalnum() or c in "_-")):
                want[d][bare] = max(want[d].get(bare, 0), w)
    assert {d: {t: round(w, 9) for t, w in x.items()} for d, x in got.items()} == {d: {t: round(w, 9) for t, w in x.items()} for d, x in want.items()}


def test_impacts_are_stored_in_order(spark):
    w = spark.createDataFrame([(d, f"t{d % 5}", 0.01 + d % 17) for d in range(200)], "doc_id int, token string, weight double")
    path = tempfile.mkdtemp() + "/impacts"
    sparse.stored(w, path, parts=3)
    held = spark.read.parquet(path)
    assert held.count() == 200 and held.agg(F.min("impact"), F.max("impact")).first() == (1, 255)
    for f in Path(path).rglob("*.parquet"):
        own = [(r.token, -r.impact, r.doc_id) for r in spark.read.parquet(str(f)).collect()]
        assert own == sorted(own)
    query = spark.createDataFrame([("q", "t1", 2), ("q", "t2", 3)], "query_id string, token string, impact int")
    want = Counter()
    for r in held.collect():
        want[r.doc_id] += {"t1": 2, "t2": 3}.get(r.token, 0) * r.impact
    assert {r.doc_id: r.score for r in sparse.impact_scores(held, query).collect()} == {d: n for d, n in want.items() if n}


def test_blocks_of_lines(spark):
    files = {"a": ["stray", "QID: 1", "x", "y", "", "QID:no", "QID: 2", "QID: 3", "z "], "b": ["", None, "QID: 4", "", "tail"], "c": ["none"]}
    rows = [(p, i, x) for p, lines in files.items() for i, x in enumerate(lines)]
    random.Random(1).shuffle(rows)
    got = blocks(spark.createDataFrame(rows, "path string, line_no int, line string"), "QID").collect()
    assert sorted(map(tuple, got)) == [("a", 0, "1", "x\ny"), ("a", 1, "2", ""), ("a", 2, "3", "z"), ("b", 0, "4", "")]


def test_passages_of_any_length_in_documents(spark):
    rnd = random.Random(4)
    words = ["ab", "b", "abc", "c", "aé", "d"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 14)))) for i in range(80)] + [(99, None)]
    passages = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(700)]  # over two blocks of short ones
    passages += [(900 + i, t[rnd.randrange(5) : 30]) for i, t in docs[:40] if len(t) > 12]
    got = R.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "query_id long, passage string"))
    assert {(r.query_id, r.doc_id) for r in got.collect()} == {(q, i) for q, p in passages for i, t in docs if t is not None and p in t}


@pytest.mark.parametrize("k", [None, 3])
def test_nearest_vectors_in_blocks(spark, k, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "NEAR_BLOCKS", 2 if k else 64)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, size=(300, 3)).astype(float)  # many ties, some of length 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    out = R.knn(df, queries, k, block=4)
    got = {(r.query_id, r.vec_id): round(r.score, 9) for r in out.collect()}
    norm = np.sqrt((x * x).sum(1))
    want = {}
    for i in range(0, 300, 10):
        if norm[i]:
            own = sorted(((-round(float(x[i] @ x[j] / norm[i] / norm[j]), 9) + 0.0, j) for j in range(300) if norm[j]))
            want |= {(i, j): -s + 0.0 for s, j in (own if k is None else own[:k])}
    if k is None:
        assert got == want
    else:  # equal scores may differ in their last digit, so the ids of the last place are free
        assert sorted((q, s) for (q, _), s in got.items()) == sorted((q, s) for (q, _), s in want.items())


def test_places_and_sums_in_groups_of_any_size(spark):
    from ravelin.operators.order import placed

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", None, "b"]), i, rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, c int").repartition(6)
    got = {r.i: (r.place, r.used) for r in placed(df, ["i"], ["g"], F.col("c")).collect()}
    seen, spent = Counter(), Counter()
    for g, i, c in sorted(rows, key=lambda r: r[1]):
        seen[g] += 1
        spent[g] += c
        assert got[i] == (seen[g], spent[g])
    assert [r.place for r in placed(df, ["i"]).orderBy("i").collect()] == list(range(1, 501))
    assert placed(df.filter("false"), ["i"], ["g"]).count() == 0


def test_near_ratio_is_the_ratio_or_nothing():
    rnd = random.Random(8)
    for _ in range(400):
        a = "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 400)))
        b = edited(rnd, a, rnd.randint(0, 30)) if rnd.random() < 0.9 else a[::-1]
        b = rnd.choice([b, b[20:], b[100:] + b[:100], "zz" + b])
        for least in (97.0, 90.0, 60.0):
            r = S.ratio(a, b)
            assert S.near_ratio(a, b, least) == (r if r >= least - 1e-9 else 0.0)


@pytest.mark.parametrize("most", [1 << 20, 1 << 28])
def test_similar_texts_join_what_can_match_only(spark, monkeypatch, most):
    """Texts of common syllables: substrings of other texts are no rows, few pairs are compared; in one pass and several."""
    monkeypatch.setattr(S, "FILTER_MOST", most)
    rnd = random.Random(5)
    syllables = ["".join(rnd.choice("aeiou lnrst") for _ in range(2)) for _ in range(60)]
    texts = ["".join(rnd.choices(syllables, k=500)) for _ in range(120)]
    texts += [edited(rnd, t, 20) for t in texts[:30]] + ["ab" * 20_000, "ab" * 19_900 + "c"]
    made = {}
    monkeypatch.setattr(S, "written", lambda df, name, of=S.written: made.setdefault((name, len(made)), of(df, name)))
    got = S.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 97.0).collect()
    rows = {name: sum(df.count() for (n, _), df in made.items() if n == name) for name, _ in made}
    assert {(r.a, r.b) for r in got} == {(i, 120 + i) for i in range(30)} | {(150, 151)}
    assert rows["met"] < 10_000 and rows["text-pairs"] < 200 < sum(map(len, texts)) / 500


def test_texts_that_share_a_passage_are_no_candidates(spark, monkeypatch):
    """A few pieces in common don't make a pair to align; texts are looked up in the filters of their lengths only."""
    monkeypatch.setattr(S, "FILTER_BITS", 128)
    monkeypatch.setattr(S, "FILTER_MOST", 1 << 20)
    rnd = random.Random(11)
    some = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    texts = []
    for n in (700, 1000, 1400, 2000):
        for _ in range(5):
            passage = some(60)
            texts += [some(n // 2) + passage + some(n // 2 + k) for k in range(10)]
    texts += [edited(rnd, t, len(t) // 50) for t in texts[::10]]
    made = []
    monkeypatch.setattr(S, "written", lambda df, name, of=S.written: made.append((name, of(df, name))) or made[-1][1])
    got = S.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 97.0).collect()
    assert {(r.a, r.b) for r in got} == {(10 * k, 200 + k) for k in range(20)}
    assert sum(df.count() for n, df in made if n == "text-pairs") == 20
    passes = [df.select("id").distinct().count() for n, df in made if n == "met"]
    assert len(passes) > 2 and sum(passes) <= 2 * len(texts)
