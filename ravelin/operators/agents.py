"""Participants of an inference graph over tables of states, and searches through them.

A state is a row: state_id, question_id, question, score, next (the participant that comes), step, titles, paras,
sentences, valid_titles, answer. Each participant takes all states that wait for it and returns their successors, so an
iteration is a fixed number of joins whatever the number of questions. Generators map lists of prompts to as many texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ravelin.functions.text import extract_answer, first_words, is_reasoning, numbered_list, without_wh_words
from ravelin.operators.execution import Model, Step, json_or_text, run_steps
from ravelin.operators.models import generated
from ravelin.operators.routing import pinned
from ravelin.operators.similarity import ratio
from ravelin.shipping import shipped
from ravelin.storage import written

Generate = Callable[[Sequence[str]], Sequence[str]]
#: (queries: query_id, q, rerank_q) -> (query_id, title, paragraph_text, score).
Retrieve = Callable[[DataFrame], DataFrame]
END = "[EOQ]"
#: Words of a paragraph that is too long to be held; what a document that is held counts; the ratio of a duplicate.
LONG, HELD, DUPLICATE = 600, 0.6, 90.0
STATE = (
    "state_id string, question_id string, question string, score double, next string, step int, titles array<string>, paras array<string>, sentences array<string>, "
    "valid_titles array<string>, answer string"
)


def started(questions: DataFrame, first: str) -> DataFrame:
    """questions (question_id, question) as states that wait for the participant ``first``."""
    none = F.array().cast("array<string>")
    return questions.select(
        F.col("question_id").cast("string").alias("state_id"), F.col("question_id").cast("string").alias("question_id"), "question", F.lit(0.0).alias("score"), F.lit(first).alias("next"), F.lit(0).alias("step"),
        none.alias("titles"), none.alias("paras"), none.alias("sentences"), none.alias("valid_titles"), F.lit(None).cast("string").alias("answer"),
    )


def _moved(states: DataFrame, then: str | Column, **changes: Column) -> DataFrame:
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    changes = {"next": F.lit(then) if isinstance(then, str) else then, "step": F.col("step") + 1, **changes}
    return states.select(*[changes[n].alias(n) if n in changes else F.col(n) for n in names])


def closely_matching(title: str, para: str, held: Sequence[tuple[str, str]], least: float = DUPLICATE) -> bool:
    """Whether a document is among the held ones, or its title and paragraph are both nearly those of one."""
    if any(title == t for t, _ in held) and any(para == p for _, p in held):
        return True
    return any(ratio(t, title) >= least and ratio(p, para) >= least for t, p in held)


def evicted(held: Sequence[tuple[str, str]], new: Sequence[tuple[str, str, float]], most: int, words: int | None = LONG) -> list[tuple[str, str]]:
    """The best documents of held ones, which count HELD, and new ones, which count their score, in order of that; of
    equal scores the earlier. New ones that are too long or duplicates are left out."""
    pool = [(t, p, HELD) for t, p in held]
    for title, para, score in new:
        if words is not None and len(para.split(" ")) > words or closely_matching(title, para, [(t, p) for t, p, _ in pool]):
            continue
        pool.append((title, para, score))
    return [(t, p) for t, p, _ in sorted(pool, key=lambda d: -d[2])[:most]]


def retrieve_and_reset(retrieve: Retrieve, then: str, source: str = "question_or_last_sentence", most: int = 15, cumulate: bool = True, lexical: bool = True,
                       returns: str = "titles", only_valid: bool = False, sets_valid: bool = False, words: int | None = LONG) -> Callable[[DataFrame], DataFrame]:
    """Retrieve for each state by its question, its last answer, or its last sentence that states a fact, and hold the
    best documents, of those held before as well if ``cumulate``. Reranking sees the question and all held titles.

    ``returns``: the answer is a JSON list of titles, of pids or of paragraphs. ``only_valid`` keeps hits whose titles
    the state allows; ``sets_valid`` makes the found titles the allowed ones. A state whose query is empty keeps what it
    holds.
    """

    def participant(states: DataFrame) -> DataFrame:
        facts = F.filter("sentences", lambda s: ~is_reasoning(s))
        last = F.trim(F.coalesce(F.get(facts, F.size(facts) - 1), F.lit("")))
        query = {"question": F.col("question"), "last_answer": F.coalesce("answer", F.lit("")), "question_or_last_sentence": F.when(last == "", F.col("question")).otherwise(last)}[source]
        asks = states.select(F.col("state_id").alias("query_id"), (without_wh_words(query) if lexical else query).alias("q"), F.concat_ws(" ", "question", F.array_join("titles", " ")).alias("rerank_q"))
        hits = retrieve(asks.filter(F.trim("q") != "")).select(F.col("query_id").alias("__s"), "title", "paragraph_text", F.col("score").cast("double").alias("score"))
        if only_valid:
            plain = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
            allowed = states.select(F.col("state_id").alias("__a"), F.explode("valid_titles").alias("v")).select("__a", plain(F.col("v")).alias("v")).distinct()
            hits = hits.join(allowed, (F.col("__s") == F.col("__a")) & (plain(F.col("title")) == F.col("v")), "left_semi")
        # hits of a state are bounded by the retriever's k
        found = hits.groupBy("__s").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "title", "paragraph_text"))), lambda x: F.struct(x.title, x.paragraph_text, (-x.o).alias("score"))).alias("new"))
        none = F.array().cast("array<string>")
        rows = states.join(found, F.col("state_id") == F.col("__s"), "left").withColumn("ht", F.col("titles") if cumulate else none).withColumn("hp", F.col("paras") if cumulate else none)

        def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                kept = [
                    evicted(list(zip(t, p)), [(x["title"], x["paragraph_text"], x["score"]) for x in (new if new is not None else [])], most, words)
                    for t, p, new in zip(frame["ht"], frame["hp"], frame["new"])
                ]
                yield pd.DataFrame({"__k": frame["state_id"], "kt": [[t for t, _ in k] for k in kept], "kp": [[p for _, p in k] for k in kept]})

        shipped(states.sparkSession)
        best = rows.select("state_id", "ht", "hp", "new").mapInPandas(select, "__k string, kt array<string>, kp array<string>")
        done = states.join(best, F.col("state_id") == F.col("__k"))
        docs = F.arrays_zip(F.col("kt").alias("title"), F.col("kp").alias("paragraph_text"))
        answer = {"titles": F.to_json("kt"), "pids": F.to_json(F.transform(docs, lambda x: pid(x.title, x.paragraph_text))), "paras": F.to_json(docs)}[returns]
        return _moved(done, then, titles=F.col("kt"), paras=F.col("kp"), answer=answer, **({"valid_titles": F.col("kt")} if sets_valid else {}))

    return participant


def map_titles(retrieve: Retrieve, then: str, most: int = 15, words: int | None = LONG) -> Callable[[DataFrame], DataFrame]:
    """Titles that the last answer names (a JSON list, or parted by commas) as titles of the corpus: each is looked up,
    hits are held in order, titles once; they become the allowed titles."""

    def participant(states: DataFrame) -> DataFrame:
        text = F.coalesce("answer", F.lit(""))
        loose = F.transform(F.split(F.translate(text, '"[]', ""), ","), lambda x: F.trim(x))
        named = F.filter(F.coalesce(F.from_json(F.when(text.startswith("["), text), "array<string>"), loose), lambda x: x != "")
        asks = states.select("state_id", F.posexplode(named).alias("pos", "q")).select(F.concat_ws("\x01", "state_id", F.lpad(F.col("pos").cast("string"), 4, "0")).alias("query_id"), "q", F.col("q").alias("rerank_q"))
        hits = retrieve(asks)
        if words is not None:
            hits = hits.filter(F.size(F.split("paragraph_text", " ")) <= words)
        hits = hits.select(F.substring_index("query_id", "\x01", 1).alias("__s"), F.struct("query_id", (-F.col("score")).alias("o"), "title").alias("at"), "title", "paragraph_text")
        once = hits.groupBy("__s", "title").agg(F.min("at").alias("at"), F.min_by("paragraph_text", "at").alias("p"))
        held = once.groupBy("__s").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "title", "p"))), 1, most).alias("x"))
        none = F.array().cast("array<string>")
        done = states.join(held, F.col("state_id") == F.col("__s"), "left")
        titles, paras = F.coalesce(F.transform("x", lambda x: x.title), none), F.coalesce(F.transform("x", lambda x: x.p), none)
        return _moved(done, then, titles=titles, paras=paras, valid_titles=titles, answer=F.to_json(titles))

    return participant


def pid(title: Column, paragraph: Column) -> Column:
    """A paragraph's name: its title and its text without a line that repeats the title."""
    title, text = F.trim(title), F.trim(paragraph)
    for head in ("Wikipedia Title: ", "Title: "):
        for end in ("\n", " \n"):
            line = F.concat(F.lit(head), title, F.lit(end))
            text = F.when(F.startswith(text, line), F.trim(F.replace(text, line, F.lit("")))).otherwise(text)
    return F.concat(title, F.lit(" "), text)


def copy_question(then: str, end: str = END, calls: int = 1) -> Callable[[DataFrame], DataFrame]:
    """The question itself as the next one, ``calls`` times; then the end. step counts a state's turns."""

    def participant(states: DataFrame) -> DataFrame:
        ends = (F.col("step") + 1) % (calls + 1) == 0
        return _moved(states, F.when(ends, end).otherwise(then), answer=F.when(ends, end).otherwise(F.trim("question")))

    return participant


def context_of(titles: Column, paras: Column, words: int) -> Column:
    """Paragraphs of so many words, each below its title, unless it begins with a line of it."""

    def doc(title: Column, para: Column) -> Column:
        text = F.trim(first_words(para, words))
        return F.when(F.startswith(text, F.lit("Wikipedia Title: ")), text).otherwise(F.concat(F.lit("Wikipedia Title: "), title, F.lit("\n"), text))

    return F.array_join(F.zip_with(titles, paras, doc), "\n\n")


def generate_titles(generate: Generate, then: str, prompt: str = "", words: int = 350, context: str = "no") -> Callable[[DataFrame], DataFrame]:
    """Titles that a generator names for a question, from the question alone or with what is held ("para", "title");
    the answer is a JSON list, of distinct ones in order."""

    def participant(states: DataFrame) -> DataFrame:
        held = {"no": F.lit(""), "title": F.array_join("titles", "\n"), "para": context_of(F.col("titles"), F.col("paras"), words)}[context]
        asks = states.withColumn("__prompt", F.concat_ws("\n\n", F.lit(prompt), held, F.concat(F.lit("Q: "), "question", F.lit("\nA: "))))
        said = generated(asks, "__prompt", "__said", generate)
        items = json_or_text(F.col("__said"))
        names = F.when(F.size(items) == 1, F.transform(F.split(F.translate("__said", '"[]', ""), ","), lambda x: F.trim(x))).otherwise(items)
        return _moved(said, then, answer=F.to_json(F.array_distinct(F.filter(names, lambda x: x != ""))))

    return participant


def step_by_step(generate: Generate, then: str, end: str = END, most: int = 10, pattern: str = r"(?i).*answer is:? (.*)", prompt: str = "", words: int = 350, pin: tuple[str, str] | None = None,
                 keep_on: bool = False) -> Callable[[DataFrame], DataFrame]:
    """One more sentence of reasoning for each state, the first of what the generator says after the context, the
    question and the sentences so far. A sentence that has the pattern, no sentence, or ``most`` of them end it, with the
    pattern's answer or EMPTY; without an end (or with ``keep_on``) the answer is the reasoning so far. ``pin`` places a
    column of a pinned paragraph among those shown."""

    def participant(states: DataFrame) -> DataFrame:
        full = F.size("sentences") >= most
        paras = pinned(F.col("paras"), F.col(pin[0]), pin[1]) if pin else F.col("paras")
        shown = F.array_join(F.transform(paras, lambda p: first_words(F.trim(p), words)), "\n\n") if pin else context_of(F.col("titles"), F.col("paras"), words)
        text = F.concat_ws("\n\n", F.lit(prompt), shown, F.concat(F.lit("Q: "), "question", F.lit("\nA: "), F.array_join("sentences", " ")))
        said = generated(states.withColumn("__prompt", F.when(~full, F.trim(text))), "__prompt", "__said", generate)
        new = F.trim(F.coalesce("__said", F.lit("")))
        sentence = F.when(new != "", F.get(F.split(new, r"(?<=[.!?])\s+"), F.lit(0)))
        answers = sentence.rlike(pattern)
        ends = F.lit(False) if keep_on else full | sentence.isNull() | F.coalesce(answers, F.lit(False))
        sentences = F.when(sentence.isNotNull(), F.concat("sentences", F.array(sentence))).otherwise(F.concat("sentences", F.array(F.lit(""))) if keep_on else F.col("sentences"))
        final = F.when(answers, F.regexp_replace(F.regexp_extract(sentence, pattern, 1), r"\.$", "")).otherwise("EMPTY")
        return _moved(said, F.when(ends, end).otherwise(then), sentences=sentences, answer=F.when(ends, final).otherwise(F.array_join(sentences, " ")))

    return participant


def key_information(sentences: Column) -> Column:
    """Sentences that don't give the answer, as a suffix of a context."""
    kept = F.filter(F.transform(sentences, lambda x: F.trim(x)), lambda s: ~F.contains(F.lower(s), F.lit("answer is")))
    return F.concat(F.lit("\n\nKey Information: "), F.trim(F.array_join(kept, " ")))


def answer_question(generate: Generate, then: str, words: int = 350, key_info: bool = False, listed: bool = False, pattern: str | None = None, prefix: str = "") -> Callable[[DataFrame], DataFrame]:
    """A generator's answer to the question over the held paragraphs; of a numbered list its distinct items as JSON, of
    an answer that has the pattern what it extracts."""

    def participant(states: DataFrame) -> DataFrame:
        suffix = key_information(F.col("sentences")) if key_info else F.lit("")
        text = F.concat(context_of(F.col("titles"), F.col("paras"), words), suffix, F.lit(f"\n\nQ: {prefix}"), F.col("question"), F.lit("\nA:"))
        said = generated(states.withColumn("__prompt", text), "__prompt", "__said", generate)
        got = extract_answer(F.col("__said"), pattern) if pattern else F.col("__said")
        return _moved(said, then, answer=F.to_json(numbered_list(got)) if listed else got)

    return participant


def execute_steps(steps: Sequence[Step], models: Mapping[str, Model], then: str, end: str = END) -> Callable[[DataFrame], DataFrame]:
    """Run a question's steps; the question is the variable $1. The answer is a JSON list; a question whose steps fail
    ends without one."""

    def participant(states: DataFrame) -> DataFrame:
        done = run_steps(states.select(F.col("state_id").alias("qid"), F.col("question").alias("v1")), steps, models, lenient=True)
        got = done.select(F.col("qid").alias("__q"), "status", F.to_json("answer").alias("__a"))
        return _moved(states.join(got, F.col("state_id") == F.col("__q")), F.when(F.col("status") == "ok", then).otherwise(end), answer=F.when(F.col("status") == "ok", F.col("__a")))

    return participant


def dispatched(questions: DataFrame, action: str, strategies: Mapping[str, Callable[[DataFrame], DataFrame]], skip: Sequence[str] = ("Unknown",)) -> DataFrame:
    """Each strategy over the questions routed to it, and all their results; actions to skip and those without a
    strategy have none."""
    parts = [run(questions.filter(F.col(action) == name)) for name, run in strategies.items() if name not in skip]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def beam_search(roots: DataFrame, expand: Callable[[DataFrame], DataFrame], done: Column, width: int = 3, depth: int = 4, cut: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """roots (question_id, node, score, depth, further columns) -> the beams at the end, best first (column place).

    At each depth the nodes that aren't ``done`` are expanded, all questions at once: ``expand`` returns children with
    the columns of roots and their gain added to score. Children and finished nodes compete for ``width`` places; ties go
    to the lesser node. A question without candidates keeps its beam; when no node is open the search ends.
    """
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("node"))
    beam = cut(roots)
    for level in range(1, depth + 1):
        ready, open_ = beam.filter(done), beam.filter(~done)
        if open_.isEmpty():
            break
        found = cut(ready.unionByName(expand(open_).withColumn("depth", F.lit(level).cast(roots.schema["depth"].dataType)).select(*roots.columns)))
        stuck = beam.join(found.select("question_id").distinct(), "question_id", "left_anti")
        best = found.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= width).drop("__n")
        beam = cut(best.unionByName(stuck))
    return beam.withColumn("place", F.row_number().over(order))


def sequence_ratio(a: Column, b: Column) -> Column:
    """The ratio of matching blocks, as difflib finds them, between 0 and 1."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


def config_key(*parts: object) -> str:
    """The name of a shared result: data set, action, port and mode."""
    return "_".join(str(p) for p in parts)


def cached(spark, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The result that an earlier run left under the key, or a new one, left there for later runs."""
    from ravelin.storage import exists

    path = f"{folder.rstrip('/')}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
