import random

import numpy as np
import pytest
import xxhash

from ravelin.llm import simhash
from ravelin.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    out = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    return out - (1 << 64) if out >> 63 else out


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 2


@pytest.mark.parametrize("small", [2, 64])
def test_links_have_the_components_of_all_pairs(spark, small):
    rnd = random.Random(small)
    prints = set()
    for _ in range(25):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 12])):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), small).collect()
    assert all(near(r.a, r.b) for r in got)
    pairs = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if near(a, b)]
    assert roots(prints, [(r.a, r.b) for r in got]) == roots(prints, pairs)


def test_components(spark):
    rnd = random.Random(5)
    chain = list(range(60))
    rnd.shuffle(chain)
    linked = [*zip(chain, chain[1:]), *[(100, k) for k in range(101, 130)], (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(linked, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(60)}, **{k: 100 for k in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf_dir, texts):
    fps = {d: by_hand(t) for d, t in texts.items()}
    ids = sorted(fps)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(fps[a], fps[b])])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{fps[d] & (1 << 64) - 1:016x}", want[d]) for d in ids}


def test_odd_rows(odd, none):
    got = simhash.near_groups(odd, carry=["text"]).collect()
    assert len(got) == odd.count()
    assert all(r.fp == by_hand(r.text) for r in got)
    assert {r.component_id for r in got if not (r.text or "").split()} == {4}
    assert {r.component_id for r in got if r.text and r.text.startswith("word")} | {r.component_id for r in got if r.text and r.text.startswith("WORD")} == {7}
    assert simhash.near_groups(none).count() == 0


def test_one_of_each_group_stays(odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    left = simhash.near_groups(odd).select("component_id").distinct().count()
    assert kept.count() == left
    assert simhash.drop_near_duplicates(none).count() == 0


def test_blocks_of_a_long_text(monkeypatch):
    text = " ".join(str(k % 977) for k in range(5000))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == by_hand(text)


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = "edited" + str(rnd.random())
    return " ".join(out)


def jaccard_roots(texts):
    """The groups of texts by all pairs of their sets of five-word shingles."""
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    return roots(range(len(sets)), pairs)


@pytest.mark.parametrize("small", [4, 64])
def test_similar_texts_go_and_others_stay(spark, small):
    """Groups of an original and its edited copies among texts of their own."""
    rnd = random.Random(small)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(8):
        words = [word() for _ in range(300)]
        rows += [" ".join(words), " ".join(words).upper()] + [edited(rnd, words, rnd.randint(0, 9)) for _ in range(6)]
    rows += [" ".join(word() for _ in range(rnd.randint(3, 200))) for _ in range(60)]
    words = rows[0].split()
    rows.append(" ".join(words[:100] + [word() for _ in range(300)]))  # a passage in common is no copy
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_similar(df, small=small).collect()}
    assert kept == {*jaccard_roots(rows).values()}


@pytest.mark.parametrize("edits", [4, 8, 14])
def test_a_large_group_of_copies(spark, edits):
    """300 copies, each edited apart, around the limit of similarity to their original: the groups of all pairs."""
    rnd = random.Random(edits)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = [edited(rnd, words, edits + k % 4) for k in range(300)] + ["something else of its own"]
    kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), small=16).collect()}
    assert kept == {*jaccard_roots(rows).values()}


@pytest.mark.parametrize("small", [2, 8])
def test_large_buckets_lose_no_link(spark, small):
    """Chains of edits, copies of copies, texts cut short, two groups with a passage in common, strangers with it."""
    rnd = random.Random(small)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = [" ".join([word() for _ in range(120)] + passage)]
    for _ in range(30):
        rows.append(edited(rnd, rows[-1].split(), 3))
    for _ in range(2):
        words = passage + [word() for _ in range(150)]
        rows += [edited(rnd, words, rnd.randint(0, 8)) for _ in range(20)]
        rows += [" ".join(words[: rnd.randint(100, len(words))]) for _ in range(20)]
        far = edited(rnd, words, 9).split()
        rows += [edited(rnd, far, rnd.randint(0, 4)) for _ in range(8)]
    rows += [" ".join([word() for _ in range(rnd.randint(5, 200))] + passage) for _ in range(20)]
    rows += [" ".join(passage + [word() for _ in range(rnd.randint(0, 9))]) for _ in range(20)]
    rnd.shuffle(rows)
    kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), small=small).collect()}
    assert kept == {*jaccard_roots(rows).values()}


def test_any_choice_of_common_hashes_gives_the_same_links():
    rnd = random.Random(2)
    whole = np.array(sorted(rnd.sample(range(1 << 40), 400)), np.uint64)
    for _ in range(200):
        a, b = (np.sort(np.array(rnd.sample(whole.tolist(), rnd.randint(150, 400)), np.uint64)) for _ in "ab")
        both = len(np.intersect1d(a, b))
        common = np.sort(np.array(rnd.sample(whole.tolist(), rnd.choice([1, 20, 200])), np.uint64))
        if both >= 0.8 * (len(a) + len(b) - both):
            assert len(np.intersect1d(simhash.first_hashes(a, 0.8, common), simhash.first_hashes(b, 0.8, common)))


def test_exact_similarity_decides(spark):
    """Short and long texts with edits around a similarity of 0.8: the groups are those of the exact similarities."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for n in [*range(8, 28), *range(30, 330, 10)]:
        words = [word() for _ in range(n)]
        rows += [" ".join(words), " ".join([*words, word()]), edited(rnd, words, max(1, n // 45)), edited(rnd, words, max(1, n // 40))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    assert any(len(a & b) * 5 == len(a | b) * 4 for a in sets for b in sets)  # 0.8 itself
    for small in (2, 64):
        kept = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), small=small).collect()}
        assert kept == {*jaccard_roots(rows).values()}


def test_similar_of_odd_rows(odd, none):
    kept = simhash.drop_similar(odd)
    assert kept.columns == odd.columns
    words = lambda rows: sorted(" ".join((r.text or "").lower().split()) for r in rows)
    assert words(kept.collect()) == sorted({*words(odd.collect())})
    assert simhash.drop_similar(none).count() == 0


def test_estimated_distance():
    assert simhash.largest_distance(0.8) == 77 and simhash.largest_distance(1.0) == 0


def test_nothing_of_the_corpus_is_broadcast(spark, sf_dir):
    """Tables that grow with the corpus are merged, though they are far under the size that a session broadcasts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = simhash.fingerprinted(docs.select(docs.text.alias("t"))).selectExpr("__fp AS fp").distinct()
    for out in (simhash.links(prints), simhash.near_groups(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
