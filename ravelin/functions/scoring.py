"""Scoring functions over columns of answers, sets and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.text import answer_tokens, normalize_answer


def _divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def exact_match(gold: Column, pred: Column) -> Column:
    return (normalize_answer(gold) == normalize_answer(pred)).cast("int")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common elements, repeats included: the smaller of both counts of each distinct element. Both arrays are bound once,
    so that they aren't made again for each element."""
    count = lambda xs, x: F.size(xs) - F.size(F.array_remove(xs, x))
    both = F.array(F.struct(a.alias("a"), b.alias("b")))
    common = F.transform(both, lambda s: F.aggregate(F.array_intersect(s.a, s.b), F.lit(0), lambda n, x: n + F.least(count(s.a, x), count(s.b, x))))
    return F.get(common, F.lit(0))


def token_f1(gold: Column, pred: Column) -> Column:
    """Multiset F1 of normalised tokens; both empty 1, one empty 0."""
    g, p = answer_tokens(gold), answer_tokens(pred)
    same = multiset_overlap(g, p)
    return F.when((F.size(g) == 0) | (F.size(p) == 0), (F.size(g) == F.size(p)).cast("double")).otherwise(
        _divide(2.0 * same, F.size(g) + F.size(p))
    )


def contained(gold: Column, pred: Column) -> Column:
    """One answer within the other (a prediction of over three characters), or all gold tokens predicted."""
    g, p = normalize_answer(gold), normalize_answer(pred)
    return F.contains(p, g) | ((F.length(p) > 3) & F.contains(g, p)) | (F.size(F.array_except(answer_tokens(gold), answer_tokens(pred))) == 0)


def accuracy(gold: Column, pred: Column) -> Column:
    return contained(gold, pred).cast("int")


def recall(gold: Column, pred: Column) -> Column:
    g, p = answer_tokens(gold), answer_tokens(pred)
    return F.when(contained(gold, pred) | (F.size(g) == 0), 1.0).otherwise(_divide(multiset_overlap(g, p).cast("double"), F.size(g)))


def set_scores(gold: Column, pred: Column) -> dict[str, Column]:
    """Precision, recall, F1 and exact match of two arrays as sets; both empty: F1 and exact match 1."""
    hit = F.size(F.array_intersect(gold, pred)).cast("double")
    n_gold, n_pred = F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    p, r = _divide(hit, n_pred), _divide(hit, n_gold)
    none = (n_gold == 0) & (n_pred == 0)
    return {
        "precision": p, "recall": r, "f1": F.when(none, 1.0).otherwise(_divide(2 * p * r, p + r)),
        "em": F.when(none | ((hit == n_gold) & (hit == n_pred)), 1).otherwise(0),
    }


def bag_f1(gold: Column, pred: Column) -> Column:
    """F1 of token sets: an empty prediction has precision 1, an empty gold recall 1."""
    hit = F.size(F.array_intersect(gold, pred)).cast("double")
    n_gold, n_pred = F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    p = F.when(n_pred == 0, 1.0).otherwise(_divide(hit, n_pred))
    r = F.when(n_gold == 0, 1.0).otherwise(_divide(hit, n_gold))
    return F.when(p + r == 0, 0.0).otherwise(_divide(2 * p * r, p + r))


def jaccard(a: Column, b: Column) -> Column:
    return _divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def answer_type(spans: Column, number: Column, date: Column) -> Column:
    """SPANS, SPAN, NUMBER or DATE, the first that an answer has; null for none."""
    return F.when(F.size(spans) > 1, "SPANS").when(F.size(spans) == 1, "SPAN").when(number != "", "NUMBER").when(date != "", "DATE")


def gold_titles(contexts: Column, facts: Column) -> Column:
    """Distinct titles of both fields, trimmed and in lower case, without empty ones."""
    plain = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.filter(F.array_union(plain(contexts), plain(facts)), lambda x: x != "")


def training_label(label: Column) -> dict[str, Column]:
    """Complexity, index strategy, action and reason of an outcome label; unknown labels count as the hardest."""
    pick = lambda z, s, m: F.when(label == "Z", z).when(label == "S", s).otherwise(m)
    return {"complexity": pick("L0", "L1", "L2"), "index_strategy": pick("None", "BM25", "BM25"), "action": label, "reason": pick("knowledge", "one retrieval", "several steps")}


def retrieval_advice(recall_100: Column, recall_5: Column, overlap: Column) -> Column:
    """What to improve, by recall far down and at the top, and by overlap with gold contexts."""
    main = (
        F.when(recall_100 < 0.5, "better recall: more candidates, rewritten queries, hybrid search").when((recall_100 >= 0.8) & (recall_5 < 0.4), "better ranking: another reranker, more documents for the reader")
        .when((recall_100 >= 0.8) & (recall_5 >= 0.6), "retrieval is good: improve the reader")
    )
    return F.array_compact(F.array(main, F.when(overlap < 0.5, "contexts miss the gold ones: check rewritten queries")))


def reader_advice(em: Column, empties: Column, extracted: Column, errors: Column) -> Column:
    """What to improve, by exact match with gold contexts and by shares among the errors."""
    main = F.when(em >= 0.7, "the reader is good: improve retrieval").when(em >= 0.5, "improve prompts, then retrieval").when(em >= 0.3, "improve prompts or tune the model").otherwise("take a stronger model")
    return F.array_compact(F.array(main, F.when(empties > 0.3 * errors, "many empty answers: prompt for one"), F.when(extracted > 0.5 * errors, "many wrong extractions: reason step by step")))
