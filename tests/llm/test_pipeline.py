"""Each stage against a plain version on its own input."""

import random

import corpus_pipeline as C
from compare import plain
from test_lines_exact import by_hand as lines_by_hand
from test_simhash import by_hand, edited, jaccard_roots, near, roots

from ravelin.llm import langid, mixing


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df.collect()))


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["language", "line_dedup", "near_dedup", "mix_sources", "encode"]
    inputs = {}
    for name, stage in C.STAGES:
        inputs[name] = docs
        if name != "encode":
            assert docs.columns == C.COLUMNS
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    done = {n: spark.read.parquet(str(tmp_path / n)) for n in names}

    start = {r.doc_id: r for r in inputs["language"].collect()}
    told = {}
    for r in langid.identify(inputs["language"], langid.fit(inputs["language"])).collect():
        short = len((start[r.doc_id].text or "").encode()) < langid.WINDOW
        if r.lang_pred != "und" and r.confidence >= (C.MIN_CONFIDENCE_SHORT if short else C.MIN_CONFIDENCE):
            told[r.doc_id] = r.lang_pred
    assert {r.doc_id: (r.lang, r.text, r.source) for r in done["language"].collect()} == {d: (lang, start[d].text, start[d].source) for d, lang in told.items()}
    clean = [d for d, r in start.items() if len((r.text or "").split()) >= 5]
    assert len([d for d in clean if d in told]) >= 0.99 * len(clean)

    want = {d: t for d, _, _, t in lines_by_hand([(r.doc_id, r.text) for r in inputs["line_dedup"].collect()])}
    assert {r.doc_id: (r.text, r.n_chars) for r in done["line_dedup"].collect()} == {d: (t, len(t)) for d, t in want.items()}

    texts = sorted((r.doc_id, r.text) for r in inputs["near_dedup"].collect())
    firsts = {texts[k][0] for k in set(jaccard_roots([t or "" for _, t in texts]).values())}
    assert {r.doc_id for r in done["near_dedup"].collect()} == firsts

    kept = {r.doc_id for r in mixing.mix(inputs["mix_sources"]).collect() if r.kept}
    assert {r.doc_id for r in done["mix_sources"].collect()} == kept and 0 < len(kept) < inputs["mix_sources"].count()

    assert {r.doc_id for r in done["encode"].collect()} == kept


def test_empty_and_odd_input(spark, odd, none, tmp_path):
    for name, start in (("none", none), ("odd", odd)):
        docs = start.select(*C.COLUMNS)
        for stage_name, stage in C.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / name / stage_name))
            docs = spark.read.parquet(str(tmp_path / name / stage_name))
        assert docs.count() <= start.count()


def test_run(spark, sf_dir):
    assert C.run(spark, sf_dir).count() > 0


def test_run_writes_each_stage_for_the_next(spark, sf_dir, monkeypatch):
    read = {}

    def stage(name):
        def f(spark, docs, sf_dir):
            read[name] = docs.inputFiles()
            return docs

        return f

    monkeypatch.setattr(C, "STAGES", [(n, stage(n)) for n in ("one", "two", "three")])
    assert C.run(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all("documents.parquet" in f for f in read["one"])
    assert read["two"] and all("/stage-one-" in f for f in read["two"])
    assert read["three"] and all("/stage-two-" in f for f in read["three"])


def test_near_dedup_has_the_links_of_fingerprints_and_of_shingles(spark):
    """A chain: one phrase over and over with other ends has one fingerprint, edited copies of such a text are similar."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    phrase, other = [word() for _ in range(31)], [word() for _ in range(200)]
    texts = [" ".join(phrase * 40 + [word() for _ in range(20)]) for _ in range(3)]
    texts += [" ".join(other), edited(rnd, other, 3), "one of its own", None, ""]
    texts.append(" ".join([*texts[1].split(), word()]))
    prints, sets = [by_hand(t) for t in texts], jaccard_roots([t or "" for t in texts])
    ids = range(len(texts))
    assert near(prints[0], prints[1]) and sets[0] != sets[1] and sets[3] == sets[4] and not near(prints[3], prints[4])
    want = roots(ids, [(a, b) for a in ids for b in range(a) if near(prints[a], prints[b]) or sets[a] == sets[b]])
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.near_dedup(spark, docs, "").collect()} == {*want.values()} == {0, 3, 5, 6}
