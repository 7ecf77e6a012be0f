"""Tree search over retrieval against one question at a time."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.operators import tree


def by_hand(question, plan, docs, find, width, depth, branches, first, hits):
    words = lambda x: set(x.lower().split())
    qw = words(question)
    parts = [p.strip() for p in plan.lower().split("->")]
    beam, asked = [("0", question, 0.0, 0, find(question, first))], {question.lower()}

    def done(n):
        if n[3] < 1 or len(n[4]) < 2:
            return False
        met = set().union(*(words(docs[i][1]) for i in n[4]))
        covered = sum(bool(words(p)) and len(words(p) & met) >= max(1, len(words(p)) // 2) for p in parts)
        return n[3] >= depth - 1 or (len(parts) > 1 and covered >= len(parts) * 0.7)

    def gain(new, path):
        total = 0.0
        for i in new:
            title, own = docs[i][0].lower(), words(docs[i][1])
            rel = len(qw & own) / len(qw) if qw and own else 0.0
            if not path:
                nov = 1.0
            elif not own:
                nov = 0.0
            else:
                fresh = title != "" and title not in {docs[j][0].lower() for j in path}
                close = max((len(own & words(docs[j][1])) / len(own | words(docs[j][1])) for j in path), default=0)
                nov = 0.4 * (1.0 if fresh else 0.3) + 0.6 * (1 - close)
            total += 0.7 * rel + 0.3 * nov
        return total / len(new)

    for level in range(1, depth + 1):
        ready, fresh, new_asked = [n for n in beam if done(n)], [], set()
        if len(ready) == len(beam):
            break
        for n in beam:
            if done(n):
                continue
            titles = list(dict.fromkeys(docs[i][0].lower() for i in n[4][:5] if docs[i][0]))
            queries = parts + [f"{t} {w}" for t in titles for w in [w for w in question.lower().split() if len(w) > 3][:3]]
            queries = [q for q in dict.fromkeys(queries) if len(q) >= 2 and q not in asked][:branches]
            for place, q in enumerate(queries, 1):
                new_asked.add(q)
                if got := find(q, hits):
                    fresh.append((f"{n[0]}.{place}", q, round(n[2] + gain(got, n[4]), 6), level, n[4] + got))
        asked |= new_asked
        if ready or fresh:
            beam = sorted(ready + fresh, key=lambda n: (-n[2], n[0]))[:width]
    return [(*n, done(n), k) for k, n in enumerate(sorted(beam, key=lambda n: (-n[2], n[0])), 1)]


def test_tree_search(spark):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    docs = {i: (rnd.choice(["Ada", "Bo", "", "Cy", "Dee"]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 9)))) for i in range(50)}
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    asked = {f"q{i}": (say(rnd.randint(1, 5)), rnd.choice([" -> ".join(say(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 4))), "", say(2)])) for i in range(12)}
    asked |= {"none": ("zzzz", "yyyy -> xxxx"), "empty": ("", "")}

    def find(q, k):
        score = {i: len(set(q.lower().split()) & set(t.lower().split())) for i, (_, t) in docs.items()}
        return [i for i in sorted(score, key=lambda i: (-score[i], i)) if score[i]][:k]

    held = spark.createDataFrame([(i, a, b) for i, (a, b) in docs.items()], "doc_id long, title string, text string")

    def retrieve(asks, k):
        terms = asks.select("query_id", F.explode(tree.words(F.col("q"))).alias("w"))
        own = held.select("doc_id", F.explode(tree.words(F.col("text"))).alias("w"))
        n = terms.join(own, "w").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        return n.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "doc_id"))).filter(F.col("rank") <= k)

    questions = spark.createDataFrame([(i, q, p) for i, (q, p) in asked.items()], "question_id string, question string, plan string")
    got = {}
    for r in tree.tree_search(questions, retrieve, held, depth=3, first=3, hits=2).collect():
        got.setdefault(r.question_id, []).append((r.node, r.q, r.score, r.depth, r.docs, r.done, r.place))
    want = {i: by_hand(q, p, docs, find, 3, 3, 3, 3, 2) for i, (q, p) in asked.items()}
    assert {i: sorted(x, key=lambda n: n[-1]) for i, x in got.items()} == want
    assert tree.tree_search(questions.filter("false"), retrieve, held).count() == 0


def test_only_documents_that_were_found_are_read_as_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "Ada", f"w{i} x") for i in range(40)] + [(3, "Bo", "w3 y")], "doc_id long, title string, text string")
    held, kept = [], tree.written
    monkeypatch.setattr(tree, "written", lambda df, name: (out := kept(df, name), held.append([r.doc_id for r in out.collect()]) if name == "tree-docs" else None)[0])
    retrieve = lambda asks, k: asks.select("query_id", F.when(F.col("q").contains("->") | (F.col("q") == "w3"), 3).otherwise(5).cast("long").alias("doc_id"), F.lit(1).alias("rank"))
    questions = spark.createDataFrame([("q", "w3", "w3 -> w5")], "question_id string, question string, plan string")
    assert tree.tree_search(questions, retrieve, docs, depth=2).count() > 0
    assert max(map(len, held)) <= 2 and {i for x in held for i in x} <= {3, 5}
