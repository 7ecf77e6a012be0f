import random
import re

import pytest

from ravelin.llm import substring


def by_hand(rows, window=50):
    words = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    order = lambda d: -(2**63) if d is None else d
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(df, **options).collect()), key=repr)


def made(seed, n=40):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randint(0, 60))
    shared = [[word() for _ in range(rnd.choice([49, 50, 51, 70, 130]))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = [word() for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            p = list(rnd.choice(shared))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = "edited"
            at = rnd.randint(0, len(w))
            w[at:at] = p[rnd.randint(0, 5) :]
        rows.append((d, rnd.choice([" ", "\n", " \t"]).join(w)))
    rows += [(n, "same " * 200), (n + 1, "same " * 120), (n + 2, rows[3][1]), (3, rows[3][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "batches", "fanout"), [(1, 1, 2), (2, 2, 2), (3, 4, 2)])
def test_against_every_window(spark, seed, batches, fanout):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, batches=batches, fanout=fanout) == by_hand(rows)


def test_segments_of_a_long_text(spark, monkeypatch):
    rows = made(7, 12)
    whole = sorted((fp, a, b) for x in rows for part in substring.Words(x[1]).cells() for fp, a, b in zip(*[p.tolist() for p in part]))
    monkeypatch.setattr(substring, "SEGMENT", 16)
    cut = sorted((fp, a, b) for x in rows for part in substring.Words(x[1]).cells() for fp, a, b in zip(*[p.tolist() for p in part]))
    assert {(fp, k) for fp, a, b in whole for k in range(a, b + 1)} == {(fp, k) for fp, a, b in cut for k in range(a, b + 1)}


def test_odd_rows(odd, none):
    assert got(odd) == by_hand([(r.doc_id, r.text) for r in odd.collect()])
    assert substring.remove_repeats(none).count() == 0


def test_runs_are_kept_sorted_and_compacted_by_tiers(spark):
    rows = made(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = substring.SubstringIndex(spark, fanout=2)
    parts = [df.filter(f"doc_id >= {a} AND doc_id < {b}") for a, b in ((0, 10), (10, 20), (20, 30), (30, 99))]
    lows = {}
    covers = []
    for part in parts:
        cut = substring.cells(part)
        index.add(cut)
        for r in cut.collect():
            lows[r.fp, r.cell] = min(lows.get((r.fp, r.cell), r.o), r.o)
        index.compact()
        covers.append([run[4:21] for run in index.runs()])
    assert covers == [["00000001-00000001"], ["00000001-00000002"], ["00000001-00000002", "00000003-00000003"], ["00000001-00000004"]]
    got = index.entries().collect()
    assert {(r.fp, r.cell): r.low for r in got} == lows and len(got) == len(lows)
    assert "Exchange" not in index.table(index.runs()[0]).groupBy("fp", "cell").count()._jdf.queryExecution().executedPlan().toString().split("isFinalPlan")[-1]


def test_a_batch_meets_a_stored_index(spark):
    """The index is opened again by its path; a new batch gets the results that all documents together would give."""
    rows = sorted(made(4), key=lambda r: r[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, second = df.filter("doc_id < 25"), df.filter("doc_id >= 25")
    index = substring.SubstringIndex(spark)
    assert got(first, index=index) == by_hand([r for r in rows if r[0] < 25])
    path, runs = index.path, index.runs()
    again = substring.SubstringIndex(spark, path)
    assert again.runs() == runs and runs
    want = [r for r in by_hand(rows) if r[0] >= 25]
    assert got(second, index=again, history=first) == want
    assert sum(int(r[13:21]) - int(r[4:12]) + 1 for r in again.runs()) == 4  # two batches each, compacted or not


def test_an_unfinished_run_does_not_count(spark):
    df = spark.createDataFrame(made(5), "doc_id long, text string")
    index = substring.SubstringIndex(spark, fanout=9)
    index.add(substring.cells(df.filter("doc_id < 15")))
    index.add(substring.cells(df.filter("doc_id >= 15")))
    runs = index.runs()
    substring.removed(spark, f"{index.path}/{runs[1]}/_SUCCESS")
    assert index.runs() == runs[:1]


def test_query(spark, sf_dir, texts):
    import hashlib

    want = sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in by_hand(list(texts.items())))
    assert sorted(map(tuple, substring.op7_substring(spark, sf_dir).collect())) == want


@pytest.mark.parametrize("bits", [1, 8])
def test_digests_that_collide_are_found_out(spark, bits):
    """Cells of one anchor whose digests are equal and whose words aren't: a common passage whose ends differ."""
    rnd = random.Random(bits)
    words = [f"w{i}" for i in range(3000)]
    core = rnd.sample(words, 40)
    rows = [(d, " ".join([*rnd.sample(words, 30), *core, *rnd.sample(words, 30)])) for d in range(40)] + made(9, 20)
    rows += [(100 + d, " ".join([*core, *words[: 20 + d]])) for d in range(6)] + [(200 + d, rows[d][1]) for d in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, bits=bits) == by_hand(rows)
