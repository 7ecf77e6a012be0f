import re
from itertools import permutations

from ravelin.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The filters that each row fails, one row at a time."""
    out = []
    for r in rows:
        t = r.text or ""
        w = WORD.findall(t)
        f = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "")
        f += ("C" if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else "") + ("D" if re.search(r"[#$%&*|]", t) else "")
        smaller = r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in rows)
        out.append(set(f + "E" * smaller))
    return out


def by_hand(docs, labels):
    rows, marks = docs.collect(), labels.collect()
    failed = fails(rows)
    says = lambda r, c: r.doc_id is not None and any(m.doc_id == r.doc_id and m[c] == 1 for m in marks)
    out, totals = {}, {}
    for p in {r.source or "" for r in rows}:
        own = [(f, says(r, "quality"), says(r, "toxic")) for r, f in zip(rows, failed, strict=True) if (r.source or "") == p]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [o for o in left if x in o[0]]
                left = [o for o in left if x not in o[0]]
                out[p, order, step] = (len(left), len(gone), sum(x in o[0] for o in own) - len(gone), sum(o[0] == {x} for o in own), sum(o[1] for o in gone), sum(o[2] for o in gone))
                totals[p, x] = totals.get((p, x), 0) + len(gone)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    rows = df.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1, "x"), (2, 1, 0, "x"), (2, 0, None, "x"), (3, None, 1, "x"), (7, 1, None, "x"), (8, 1, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, source string")
    assert got(audit.filter_audit(odd, labels)) == by_hand(odd, labels)
    assert got(audit.filter_audit(odd, labels.filter("false"))) == by_hand(odd, labels.filter("false"))
    assert audit.filter_audit(none, labels).count() == 0


def test_every_pattern_of_failures(spark):
    """Texts for each combination of the text filters, some of them several times over parts, ids in no order."""
    rows, k = [], 0
    for m in range(16):
        words = [f"w{i}" for i in range(20 if m & 1 else 60)]
        words = [w if i % 4 == 0 or not m & 2 else "w0" for i, w in enumerate(words)]
        text = " ".join(words) + (" " + "X" * 40 if m & 4 else "") + (" #" if m & 8 else "")
        for copy in range(1 + m % 3):
            rows.append(((k * 37) % 101, text, f"src{(m + copy) % 2}"))
            k += 1
    rows += [(200, rows[5][1], None), (200, rows[5][1], "src0"), (None, rows[5][1], "src0"), (None, rows[5][1], "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(210)], "doc_id long, quality int, toxic int")
    assert len({frozenset(f) for f in fails(docs.collect())}) > 20
    assert got(audit.filter_audit(docs, labels)) == by_hand(docs, labels)


def test_joint_failures_are_products_of_flags(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    failed = fails(odd.collect())
    total = [0] * 32
    for r in audit.joint_failures(odd, labels).collect():
        total = [a + b for a, b in zip(total, r.n, strict=True)]
    assert total == [sum(all(x in f for k, x in enumerate("ABCDE") if m >> k & 1) for f in failed) for m in range(32)]
