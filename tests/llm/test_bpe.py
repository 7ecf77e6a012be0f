import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ravelin.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = bpe.default_vocabulary()
PIECES = st.sampled_from(["a", "B", "é", "é", "Σ", "ΑΣ", "\x1c", "\x85", " ", " ", "'s", "'LL", "12", "٣", "<|endoftext|>", "<|startoftext|>", "漢字", "😀", "İ", "ß", "\n\t", "!!", "_", "Ⅷ", "the", "thing"])


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocab():
    return bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())


@pytest.fixture(scope="module")
def coder(vocab, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fst") / "words.fst")
    words = ["the", "thing", "thinking", "a", "b", "ß", "漢字", "nation", "nations", "notation"]
    bpe.compile_lexicon({w: vocab.merge(w) for w in words}, path)
    return bpe.Coder(vocab, bpe.Lexicon(path))


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_and_text_are_the_library_s(coder, vocab, library, text):
    ids = np.frombuffer(coder.encode([text])[0], "<u4").tolist()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert vocab.decode(ids) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text("abcdeé漢", min_size=1, max_size=70), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_words_merge_alike_alone_and_side_by_side(vocab, words):
    assert vocab.merge_many(words) == [bpe._packed(vocab.merge(w)) for w in words]


@given(st.dictionaries(st.text("abc", min_size=1, max_size=8), st.lists(st.integers(0, 50_000), min_size=1, max_size=4), max_size=40), st.lists(st.text("abc", min_size=1, max_size=9), max_size=20))
@settings(max_examples=80, deadline=None)
def test_the_transducer_is_the_dictionary(tmp_path_factory, entries, others):
    path = str(tmp_path_factory.mktemp("fst") / "x.fst")
    bpe.compile_lexicon(entries, path)
    lex = bpe.Lexicon(path)
    asked = [*entries, *others]
    for w, p in zip(asked, lex.places([w.encode() for w in asked]).tolist()):
        assert (p >= 0) == (w in entries)
        if p >= 0:
            assert lex.ids[lex.offsets[p] : lex.offsets[p + 1]].tolist() == entries[w]


def test_suffixes_are_shared(tmp_path):
    bpe.compile_lexicon({a + "ation": [1] for a in "bcdfg"}, str(tmp_path / "s.fst"))
    assert len(bpe.Lexicon(str(tmp_path / "s.fst")).final) == 7  # one path for the common end


def test_very_long_words(coder, library):
    text = "abcab" * 20_000
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, sf_dir, texts, library):
    got = {r.doc_id: r for r in bpe.op3_bpe(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        e = library.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(e)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, none, library):
    coded = bpe.encode(odd, words=5, carry=["lang", "text", "n"])
    rows = bpe.decode(coded).collect()
    assert len(rows) == odd.count() and {r.n for r in rows} == {2}
    for r in rows:
        e = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (len(e), e)
        assert r.decoded == library.decode(e, skip_special_tokens=False)
    assert bpe.digests(none).count() == 0
    assert bpe.decode(coded.limit(1).withColumn("ids", F.lit(None).cast("binary"))).first().decoded is None


def test_large_ids_with_nulls_stay_exact(spark):
    df = spark.createDataFrame([(2**62 + 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r.doc_id for r in bpe.digests(df).collect()} == {2**62 + 1, None}
