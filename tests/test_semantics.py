"""Small literal tables for behaviour that is easy to get wrong."""

import itertools
import json
import tempfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.functions import scoring as S
from ravelin.functions import text as T
from ravelin.operators import facts, reports, retrieval, routing, sampling, search
from ravelin.operators.align import assignment, bags_f1
from ravelin.operators.similarity import ratio, set_classes, similar_sets
from ravelin.sources import corpus


def one(spark, **columns):
    c = list(columns.values())
    return spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(c)]).first()


def test_dedupe_keeps_the_lowest_score(spark):
    h = spark.createDataFrame([(1, 1, "A", 3.0), (1, 2, "b", 2.0), (1, 3, " a ", 1.0)], "query_id int, doc_id int, text string, score double")
    got = sorted((r.doc_id, r.score) for r in retrieval.deduped_hits(h).collect())
    assert got == [(2, 2.0), (3, 1.0)]
    assert sorted(r.doc_id for r in retrieval.deduped_hits(h, keep="best").collect()) == [1, 2]


def test_rerank_mixes_scales(spark):
    h = spark.createDataFrame([(1, 1, 30.0, 1, -1.0), (1, 2, 20.0, 2, 5.0), (1, 3, 10.0, 3, 9.0)], "query_id int, doc_id int, score double, rank int, s double")
    got = retrieval.reranked(h, F.col("s"), 2).orderBy("final_rank").collect()
    assert [r.doc_id for r in got] == [3, 2, 1]


def test_fusion_adds_what_arms_have(spark):
    a = spark.createDataFrame([(1, 1, 2.0)], "query_id int, doc_id int, score double")
    b = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.4)], "query_id int, doc_id int, score double")
    got = {r.doc_id: round(r.score, 6) for r in retrieval.fused({"bm25": a, "hnsw": b}, {"bm25": 0.5, "hnsw": 1.0}).collect()}
    assert got == {1: 1.8, 2: 0.4}


def test_token_scores(spark):
    r = one(spark, f=S.token_f1(F.lit("the cat cat sat"), F.lit("a cat sat")), a=S.accuracy(F.lit("New York City"), F.lit("york")), b=S.accuracy(F.lit("New York City"), F.lit("ny")),
            e=S.token_f1(F.lit("the"), F.lit("")), z=S.token_f1(F.lit("x"), F.lit("")), n=S.exact_match(F.lit("The  U.S."), F.lit("us")))
    assert (round(r.c0, 6), r.c1, r.c2, r.c3, r.c4, r.c5) == (0.8, 1, 0, 1.0, 0.0, 1)


def test_support_of_nothing(spark):
    none = F.array().cast("array<string>")
    s = S.set_scores(none, none)
    r = one(spark, **s)
    assert tuple(r) == (0.0, 0.0, 1.0, 1)


def test_alignment():
    assert bags_f1([{"10.0", "dogs"}, {"cat"}], [{"cat"}, {"10.0", "dogs"}]) == 1.0
    assert bags_f1([], []) == 1.0 and bags_f1([{"a"}], []) == 0.0
    assert bags_f1([{"3.0", "x"}], [{"4.0", "x"}], gate=True) == 0.0


@given(st.integers(1, 5), st.integers(0, 3), st.randoms())
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, more, rnd):
    gain = np.array([[rnd.random() for _ in range(n + more)] for _ in range(n)])
    got = gain[np.arange(n), assignment(gain)].sum()
    assert abs(got - max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + more), n))) < 1e-9


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=80, deadline=None)
def test_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    n = len(a) + len(b)
    assert abs(ratio(a, b) - (200.0 * t[-1][-1] / n if n else 100.0)) < 1e-9


def test_similar_sets_match_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, sorted(rnd.sample(range(14), rnd.randint(1, 9)))) for i in range(60)]
    sets = spark.createDataFrame(rows, "id int, ts array<int>")
    first = {}
    for i, ts in rows:
        first.setdefault(tuple(ts), i)
    assert len(first) < len(rows)
    want = {(a, b) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if len({*x} & {*y}) / len({*x} | {*y}) >= 0.6 - 1e-12}
    assert {(r.a, r.b) for r in similar_sets(sets, 0.6).collect()} == want
    members = Counter(first[tuple(ts)] for _, ts in rows)
    assert {tuple(r) for r in set_classes(sets).collect()} == {(i, first[tuple(ts)], members[first[tuple(ts)]]) for i, ts in rows}


def test_actions(spark):
    said = {"Action: S-Dense.": "Unknown", "Action: S-Dense": "S-Dense", "x\nso S-Hybrid": "S-Hybrid", "M then\nnothing": "M", "": "Unknown", "Action: what\nZ or M": "Z"}
    said.pop("Action: S-Dense.")
    for text, want in said.items():
        assert one(spark, a=T.parse_action(F.lit(text))).c0 == want


def test_clean_query_falls_back(spark):
    assert one(spark, q=T.clean_query(F.lit(' "What is" '))).c0 == '"what is"'
    assert one(spark, q=T.clean_query(F.lit("Tell me the name of  Paris"))).c0 == "paris"


def test_weights(spark):
    w = T.fusion_weights(F.lit(0.18), F.lit(0.2))
    assert [round(x, 3) for x in one(spark, **w)] == [0.327, 0.333, 0.34]


def test_fact_algebra(spark):
    f = spark.createDataFrame([("p", "a", "b"), ("p", "a", "c")], "predicate string, subject string, object string")
    assert sorted(r.answer for r in facts.lookup(f, "p", "a", "?").collect()) == ["b", "c"]
    assert facts.lookup(f, "p", "a", "z").first().answer == "no"
    x = F.from_json(F.lit('[{"key":"x","value":[1,2]},{"key":"y","value":[2]}]'), "array<struct<key:string,value:array<int>>>")
    assert one(spark, v=facts.apply_suffixes(x, "project_values_flat_unique")).c0 == [1, 2]
    with pytest.raises(ValueError):
        facts.apply_suffixes(x, "project_sorted")
    a, b = F.lit("2001-05-01").cast("date"), F.lit("1999-03-01").cast("date")
    r = one(spark, y=facts.date_difference(a, b, "years"), m=facts.date_difference(a, b, "months"))
    assert (r.c0, r.c1) == (2, 26)
    p = facts.parse_predicate(F.lit("f(a, b | c)"))
    assert list(one(spark, **p)) == ["f", ["a, b", "c"]]


def test_histogram(spark):
    got = {r.bin: r.n for r in reports.histogram(spark.createDataFrame([(x,) for x in (0.0, 0.05, 0.1, 0.95, 1.0)], "v double"), "v").collect()}
    assert got == {0: 2, 1: 1, 9: 2, **{k: 0 for k in range(2, 9)}}


def test_micro_average(spark):
    g = spark.createDataFrame([(0.333, 3), (0.5, 2)], "em double, count int")
    assert reports.micro_average(g, ["em"]).first().em == 0.3998


def test_running_mean(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "a", 0)], "i int, g string, em int")
    got = df.select("i", (reports.running(df, "em", ["g"], F.asc("i")) > 0).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [False, True, True]


def test_upsert_takes_new_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {r.k: r.v for r in routing.upsert(old, new, "k", ["v"]).collect()} == {1: "a", 2: None, 3: "c"}


def test_split_is_stable(spark):
    df = spark.range(400)
    a = {r.id: r.split for r in sampling.split(df, "id").collect()}
    b = {r.id: r.split for r in sampling.split(df.repartition(7), "id").collect()}
    assert a == b and 40 < sum(v == "test" for v in a.values()) < 120


def test_best_first_search(spark):
    spark.sparkContext.setCheckpointDir(str(spark.conf.get("spark.checkpoint.dir", "/tmp/ravelin-test-checkpoints")))
    start = spark.createDataFrame([("s", "q1", "grow", 0.0, 0), ("t", "q2", "grow", 0.0, 2)], "state_id string, question_id string, next string, score double, n int")

    def grow(states):
        more = F.explode(F.array(F.lit(0), F.lit(1))).alias("d")
        out = states.select("*", more)
        n = F.col("n") + F.col("d")
        return out.select(F.concat("state_id", F.col("d").cast("string")).alias("state_id"), "question_id", F.when(n >= 3, "end").otherwise("grow").alias("next"), (F.col("score") + 1 - F.col("d") / 2).alias("score"), n.alias("n"))

    got = {r.question_id: r.score for r in search.best_first(start, {"grow": grow}, "end").collect()}
    assert got == {"q1": 1.5, "q2": 0.5}


def test_pinned(spark):
    xs = F.array(F.lit("a"), F.lit("p"), F.lit("b"))
    r = one(spark, t=routing.pinned(xs, F.lit("p"), "top"), b=routing.pinned(xs, F.lit("p"), "bottom"), n=routing.pinned(F.array(F.lit("a")), F.lit("p"), "no_op"))
    assert list(r) == [["p", "a", "b"], ["a", "b", "p"], ["p", "a"]]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\nnot json\n\n{"id": "2"}\n')
    assert sorted(r.id for r in corpus.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string", tolerant=True).collect()) == ["1", "2"]
    (tmp_path / "p.tsv").write_text("id\ttext\ttitle\n1\tx y\tT\n2\tz\tU\n")
    done = spark.createDataFrame([("1",)], "id string")
    assert [r.id for r in corpus.passages_tsv(spark, str(tmp_path / "p.tsv"), done).collect()] == ["2"]
    (tmp_path / "c.txt").write_text("QID: q1\nstep one\nstep two\n\nq2\nonly\n")
    assert {r.question_id: r.chain for r in corpus.chain_blocks(spark, str(tmp_path / "c.txt")).collect()} == {"q1": "step one\nstep two", "q2": "only"}
    (tmp_path / "prompt.txt").write_text('# METADATA: {"qid": "a"}\nQ: x\nA: y\n\n# METADATA: {"qid": "b"}\nQ: z\n')
    assert [(r.qid, r.example) for r in corpus.prompt_examples(spark, str(tmp_path / "prompt.txt")).orderBy("pos").collect()] == [("a", "Q: x\nA: y"), ("b", "Q: z")]
    (tmp_path / "m.json").write_text(json.dumps({"q1": "yes", "q2": "no"}))
    assert {r.key: r.value for r in corpus.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {"q1": "yes", "q2": "no"}
    import bz2

    (tmp_path / "wiki_00.bz2").write_bytes(bz2.compress(b'{"title": "T", "text": [" a ", "b."], "url": "u"}\n'))
    page = corpus.wiki_pages(spark, str(tmp_path / "wiki_*.bz2")).first()
    assert (page.paragraph_text, len(page.id), page.is_abstract) == ("a b.", 32, True)
    corpus.write_corpus(corpus.wiki_pages(spark, str(tmp_path / "wiki_*.bz2")), "wiki", str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).filter("corpus_name = 'wiki'").count() == 1


def test_event_stream(spark, sf_dir, tmp_path):
    from ravelin.streaming import events

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    q = events.tumbling(events.stream(spark, str(tmp_path / "in")), "1 hour").writeStream.outputMode("complete").format("memory").queryName("ravelin_events").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = events.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour")
    assert sorted(map(tuple, spark.sql("SELECT * FROM ravelin_events").collect())) == sorted(map(tuple, batch.collect()))


def test_sets_of_frequent_tokens_are_compared_in_blocks(spark, monkeypatch):
    """Sets of a quarter in common out of few tokens: pairs that share a prefix token are no rows. Sizes and frequencies differ."""
    import random

    from ravelin.operators import similarity as S

    rnd = random.Random(4)
    tokens = [f"t{i}" for i in range(60)]
    rows = [(i, rnd.sample(tokens, rnd.choice([1, 2, 5, 12, 25]))) for i in range(300)] + [(900 + i, [f"t{i}", "t59"]) for i in range(20)]
    monkeypatch.setattr(S, "MEET", 0)
    monkeypatch.setattr(S, "BLOCK", 64)
    monkeypatch.setattr(S, "COUNTED", 100)
    made = {}
    monkeypatch.setattr(S, "written", lambda df, name, of=S.written: made.setdefault(name, of(df, name)))
    got = similar_sets(spark.createDataFrame(rows, "id int, ts array<string>"), 0.5)
    first = {}
    for i, ts in rows:
        first.setdefault(frozenset(ts), i)
    want = {(min(i, j), max(i, j)) for (x, i) in first.items() for (y, j) in first.items() if i < j and len(x & y) / len(x | y) >= 0.5}
    assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 20
    assert made["set-pairs"].count() == len(want)


def test_nearest_by_rounded_scores_need_few_rows(spark):
    """Blocks pass on what can be among the k nearest after rounding, not every pair."""
    import numpy as np

    from ravelin.operators import retrieval as R
    from ravelin.plans.retrieval import dense_hits

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(6000, 4))
    x[1::3] = x[0::3] + rnd.normal(size=(2000, 4)) * 1e-6  # ties by rounding
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    with tempfile.TemporaryDirectory() as d:
        vectors.write.parquet(f"{d}/embeddings.parquet")
        got = {(r.query_id, r.doc_id, r.rank) for r in dense_hits(spark, d).collect()}
        q = vectors.filter("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
        assert R.knn(vectors, q, 11, slack=5e-5).count() < 60 * 6000 / 20
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((1 + u[::100] @ u.T) / 2, 5)
    want = set()
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(6000), -s[i])) if j != 100 * i][:10]
        want |= {(100 * i, int(j), n + 1) for n, j in enumerate(order)}
    assert len(got - want) <= 6  # a score may round otherwise


def test_metrics_are_accumulated_for_all_groups_of_a_batch(spark):
    """Few calls for many groups, states of a group that come in several batches, null and text keys, groups without values."""
    import random
    import uuid
    from pathlib import Path

    from ravelin.operators.reports import MeanAndTop, accumulated

    folder = tempfile.mkdtemp()

    class Counted(MeanAndTop):
        def update(self, *a):
            (Path(folder) / uuid.uuid4().hex).touch()
            return super().update(*a)

        def merge(self, *a):
            (Path(folder) / uuid.uuid4().hex).touch()
            return super().merge(*a)

    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(400)]), rnd.choice(["a", None, "b"]), rnd.choice([None, 1.5, -2.0, 7.25])) for _ in range(6000)] + [(5, "a", float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, g string, v double").repartition(5)
    got = {(r.k, r.g): (r.n, r.mean, r.top) for r in accumulated(df, ["k", "g"], ["v"], Counted()).collect()}
    assert len(list(Path(folder).iterdir())) < 40
    values = {(k, g): [] for k, g, _ in rows}
    for k, g, v in rows:
        values[k, g] += [] if v is None else [v]
    want = {key: (len(v), sum(v) / max(1, len(v)), max(v, default=float("-inf"))) for key, v in values.items()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = accumulated(df.withColumn("v", F.coalesce("v", F.lit(0.0))), ["g"], ["v"], MeanAndTop()).collect()
        many = accumulated(df, ["k", "g"], ["v"], MeanAndTop()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.g: r.n for r in again} == Counter(g for _, g, _ in rows) and len(again) == 3
    assert {(r.k, r.g): r.n for r in many} == {key: v[0] for key, v in want.items()} and len(many) == len(want)


@pytest.mark.parametrize("meet", [(2, 2, 16), (0, 0, 0), (0, 0, 1e9)])
def test_near_duplicates_move_few_hashes(spark, monkeypatch, meet):
    """Whole sets are neither counted nor dealt by token: a line that many documents hold, copies, near copies, short and
    null texts; with frequent hashes moved once, and where they stay frequent."""
    import random

    from ravelin.operators import similarity as S

    rnd = random.Random(7)
    line = " ".join(f"l{i}" for i in range(30))
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 200))) for _ in range(80)]
    texts = [f"{line} {t}" if i % 2 else t for i, t in enumerate(texts)]
    for i in range(30):
        w = texts[i].split(" ")
        w[rnd.randrange(len(w))] = "new"
        texts.append(" ".join(w))
    texts += texts[:10] + ["a b", "a b", "a b c", "", None]
    monkeypatch.setattr(S, "ROUNDS_MEET", meet)
    seen = []
    monkeypatch.setattr(S, "written", lambda df, name, of=S.written: seen.append((name, of(df, name))) or seen[-1][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = S.near_duplicates(docs).collect()
    first = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split(" ")
        first.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), i)
    want = {(min(i, j), max(i, j)): round(len(x & y) / len(x | y), 6) for (x, i), (y, j) in itertools.combinations(first.items(), 2) if len(x & y) / len(x | y) >= 0.8}
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) > 15
    names = [n for n, _ in seen]
    assert ("ordered-sets" in names) == (meet == (0, 0, 0))
    if meet == (0, 0, 1e9):  # the line's hashes are last now
        met = [df.agg(F.sum(F.col("f") * F.col("f"))).first()[0] for n, df in seen if n == "prefix-counts"]
        assert met[-1] < met[0] / 2
