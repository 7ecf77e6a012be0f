import hashlib

from ravelin.llm import exact, lines
from ravelin.llm._common import WHITE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_chars=20, min_docs=3):
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(WHITE).translate(LOWER)
            if len(k) >= min_chars:
                held.setdefault(k, set()).add(d)
    order = lambda d: (d is not None, d or 0)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(held.get(k := x.strip(WHITE).translate(LOWER), ())) < min_docs or d == max(held[k], key=order)]
        out.append((d, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return out


def sort(rows):
    return sorted(rows, key=repr)


def test_lines_of_odd_rows(odd, none):
    got = lines.drop_frequent_lines(odd)
    assert sort((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == sort(by_hand([(r.doc_id, r.text) for r in odd.collect()]))
    assert lines.drop_frequent_lines(none).count() == 0
    carried = lines.drop_frequent_lines(odd, carry=["lang", "line"]).collect()
    assert {r.line for r in carried} == {"x"} and len(carried) == odd.count()


def test_one_document_never_reaches_the_threshold(spark):
    df = spark.createDataFrame([(1, "\n".join(["a line that is repeated often"] * 9))], "doc_id long, text string")
    assert lines.drop_frequent_lines(df).first().n_dropped == 0


def test_many_lines(spark):
    text = "\n".join(f"this is line number {k} of many" for k in range(5000))
    df = spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_dropped) for r in lines.drop_frequent_lines(df).collect()) == [(0, 5000), (1, 5000), (2, 0)]


def check_groups(docs, **options):
    rows = [(r.doc_id, (r.text or "").translate(LOWER)) for r in docs.collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    top = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    want = [(d, top[t], len(groups[t]), d == top[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    got = exact.exact_groups(docs, **options).collect()
    cut = 4 if options else 5
    assert sort(tuple(r)[:cut] for r in got) == sort(w[:cut] for w in want)


def test_exact_groups_of_odd_rows(odd, none):
    check_groups(odd)
    assert exact.exact_groups(none).count() == 0


def test_a_weak_digest_gives_the_same_groups(odd):
    """Full contents are compared: a digest of few values only costs time."""
    from pyspark.sql import functions as F

    check_groups(odd, digest=lambda c: (F.length(c) % 2).cast("string"))
