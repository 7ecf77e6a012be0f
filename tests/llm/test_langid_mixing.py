import zlib

import numpy as np
import pytest

from ravelin.llm import langid, licenses, mixing


def plainly(text, model):
    """The network's forward pass, byte by byte: every filter at every place of every window."""
    raw = text.encode("utf-8", "replace")
    mean, top, total = np.zeros(len(model.labels)), 0.0, 0
    for at in range(0, len(raw), langid.WINDOW):
        part = raw[at : at + langid.WINDOW]
        classes = [int(langid.CLASSES[b]) for b in part] + [0] * (langid.WINDOW - len(part) + 8)
        hidden = []
        for f, w in zip(model.filters, langid.WIDTHS):
            for k in range(langid.FILTERS):
                hidden.append(max(sum(float(f[o][classes[p + o]][k]) for o in range(w)) for p in range(langid.WINDOW)))
        logits = np.maximum(np.array(hidden) + model.bias, 0) @ model.weights + model.shift
        p = np.exp(logits - logits.max())
        p /= p.sum()
        mean, top, total = mean + p * len(part), top + p.max() * len(part), total + len(part)
    return model.labels[int(mean.argmax())], mean.max() / total, top / total


def test_training_learns_and_ignores_padding():
    rng = np.random.default_rng(0)
    text = {"aa": "tha the tho thu", "bb": "oui eau aux que", "cc": "sch ung ein ich"}
    blocks, labels = [], []
    for k, words in text.items():
        for _ in range(60):
            w, _ = langid.windows(" ".join(rng.choice(words.split(), 40)))
            blocks.append(w[0])
            labels.append(k)
    model = langid.train(np.stack(blocks), labels)
    got, scores, sure = langid.predict(["the tho tha", "eau oui que aux", "ich ung sch ein " * 500, None, "", "12 34 !!", "的"], model)
    assert got[:3] == ["aa", "bb", "cc"] and got[3:6] == ["und"] * 3 and scores[3:6] == [0.0] * 3
    assert all(0 <= s <= c + 1e-9 <= 1 + 1e-9 for s, c in zip(scores, sure)) and got[6] in text
    mixed = "the tho tha thu " * 64 + "eau oui que aux " * 64
    _, (score,), (confidence,) = langid.predict([mixed], model)
    assert score < 0.6 and confidence > 0.9  # two languages are told window by window
    for t in ["the tho tha", mixed, "x", "é的 " * 200]:
        label, score, confidence = plainly(t, model)
        got, scores, sure = langid.predict(["other words", t], model)
        assert (got[1], round(scores[1], 4), round(sure[1], 4)) == (label, round(score, 4), round(confidence, 4))


def test_pair_tables_are_the_convolution():
    rng = np.random.default_rng(1)
    model = langid.Model(["x"], [rng.normal(size=(w, langid.SIZE, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS], np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    block = rng.integers(0, langid.SIZE, (2, langid.WINDOW)).astype(np.uint8)
    wide = np.pad(block, ((0, 0), (0, 8)))
    for f, w, r in zip(model.filters, langid.WIDTHS, langid._responses(block, model.pairs())):
        want = sum(f[o][wide[:, o : o + langid.WINDOW]] for o in range(w))
        assert np.allclose(r, want, atol=1e-4)


def test_windows_cover_the_whole_text():
    text = "é" * 1000
    got, sizes = langid.windows(text)
    assert sizes.sum() == 2000 and (got > 0).sum() == 2000


def test_query(spark, sf_dir):
    rows = langid.op9_language(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, none):
    model = langid.fit(odd)
    got = langid.identify(odd, model, carry=["text", "n", "score"]).collect()
    assert len(got) == odd.count() and {r.n for r in got} == {2}
    for r in got:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r[3]) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de"}
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert langid.fit(none) is None
    assert langid.identify(none, None).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}


def test_raking_meets_the_margins():
    rng = np.random.default_rng(3)
    w = rng.uniform(1, 9, 24)
    codes = [np.repeat(np.arange(2), 12), np.tile(np.arange(3), 8), np.tile(np.repeat(np.arange(4), 3), 2)]
    targets = []
    for c in codes:
        t = rng.uniform(1, 3, c.max() + 1)
        targets.append(t / t.sum() * w.sum())
    x, gap = mixing.rake(w, codes, targets, 60)
    assert gap <= mixing.TOLERANCE
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, x), t, rtol=1e-6)


@pytest.mark.parametrize("budget", [0.05, 0.5, 0.9, 1.0])
def test_probabilities_meet_the_budget(budget):
    rng = np.random.default_rng(int(budget * 100))
    w, want = rng.uniform(1, 9, 30), rng.uniform(0.1, 9, 30)
    p = mixing.calibrated(w, want, budget)
    assert (p >= 0).all() and (p <= 1).all() and abs((p * w).sum() - budget * w.sum()) < 1e-6 * w.sum()
    free = p < 1
    assert np.allclose(p[free] / (want / w)[free], (p[free] / (want / w)[free])[0]) if free.any() else True


def test_mixing_of_odd_rows(odd, none):
    got = mixing.mix(odd, carry=["text", "n"]).collect()
    assert len(got) == odd.count() and {r.n for r in got} == {2}
    assert {r.topic for r in got if not (r.text or "").split()} == {"empty"}
    assert all(0 <= r.probability <= 1 and r.kept is not None for r in got)
    assert {r.source for r in got} >= {"(none)"}
    assert mixing.mix(none).count() == 0


def test_cells_beyond_the_driver_get_the_same_chances(spark, sf_dir, odd):
    targets = {"lang": {"en": 0.4, "de": 0.3, "xx": 0.2}, "source": {"src0": 0.1}}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df, kind in ((docs, {}), (docs, {"targets": targets}), (odd, {})):
        told = lambda d: sorted((r.doc_id or -1, r.source, r.topic, round(r.probability, 7), r.kept) for r in d.collect())
        assert told(mixing.mix(df, max_cells=2, **kind)) == told(mixing.mix(df, **kind))


def test_given_targets_are_met(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, targets={"lang": {"en": 0.4, "de": 0.3}}, budget=0.2, rounds=200).collect()
    tokens = {}
    for r in rows:
        tokens[r.lang] = tokens.get(r.lang, 0) + r.probability * r.n_tokens
    total = sum(tokens.values())
    assert abs(tokens["en"] / total - 0.4) < 0.02 and abs(tokens["de"] / total - 0.3) < 0.02
    assert abs(total / sum(r.n_tokens for r in rows) - 0.2) < 1e-6


def test_shares_of_values():
    natural = {"a": 0.5, "b": 0.3, "c": 0.2}
    assert mixing.wanted_shares(natural, 1.0, None) == pytest.approx(natural)
    assert mixing.wanted_shares(natural, 0.5, {"a": 0.2}) == pytest.approx({"a": 0.2, "b": 0.48, "c": 0.32})
    assert mixing.wanted_shares(natural, 0.5, {"a": 2, "z": 5}) == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.0})
    with pytest.raises(ValueError):
        mixing.wanted_shares(natural, 0.5, {"a": 0, "b": 0, "c": 0})


def test_licences(spark, none, odd):
    rows = [
        (1100, "src/a text\nReleased under the MIT License.\nmore of the text follows here and goes on for a while longer, so that the notice is only a header of it and no licence file of its directory", "s", "en"), (1101, "Licensed under the Apache License, Version 2.0.", "s", "en"),
        (1102, "nothing to see", "s", "en"), (1250, "nothing here", "s", "en"), (1199, "This work is licensed under the GNU General Public License, version 3.", "s", "en"),
        (2500, "the license of his driver was lost in the woods and never found by anyone at all", "s", None), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: (r.license, r.via, r.depth) for r in licenses.scan(df).collect()}
    assert got[1100][:2] == ("MIT", "header") and got[1101][:2] == ("Apache-2.0", "header") and got[1199][0] == "GPL-3.0"
    assert got[1102] == ("Apache-2.0", "directory", 3)  # of two files of cosine 1 the smallest doc_id counts
    assert got[1250] == (None, "none", None)  # no ancestor directory holds a file
    assert got[2500][1] == "none" and got[None][1] == "none"
    assert licenses.scan(none).count() == 0 and licenses.scan(odd).count() == odd.count()
