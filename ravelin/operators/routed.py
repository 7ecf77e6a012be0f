"""Programs as data: each question has steps of its own, texts of the form "(operation) [model] question".

    (select) [kb] supplies_from(s1, ?)
    (project_values_flat_unique) [kb] in_region(#1, ?)

All questions advance by one step a round. A round makes the tasks of its steps as rows, one for each item that an
operation goes over, asks each model once for all of its tasks, and merges the answers. What a question has answered is
written after each round, so plans don't grow with the length of programs, and a program's list is rows, not one value.

Values are JSON texts. "#1" stands for the answer of step 1, "#C" for the question's paragraphs PARA_0, PARA_1, ....
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators.execution import lookup_each, math_answer
from ravelin.operators.facts import TRUE, parse_predicate
from ravelin.storage import written

#: asks (qid, task, q) -> (qid, task, answer): a JSON text, null for no valid answer.
Model = Callable[[DataFrame], DataFrame]
ITEM = "qid {qid}, step int, pos array<int>, item string"
#: Tokens of nested JSON lists of texts and numbers.
_LEAVES = r'("(?:[^"\\]|\\.)*"|[^\[\],\s"]+)'
_PIECES = r"(#\d+|#C|[^#]+|#)"


@dataclass
class Routed:
    """results: qid, status, steps_done, answer (JSON). tasks: what was asked and merged: qid, step, task, question, model,
    answer. A stack of tasks gives them up in the order of step and task, the place of the item asked about; a step's last
    task is its merge, whose place is null."""

    results: DataFrame
    tasks: DataFrame


def parsed(text: Column) -> dict[str, Column]:
    """operation, model and question of a step's text; null where it hasn't that form."""
    form = r"^\((.+)\) \[([^\]]+)\] (.*)"
    return {name: F.when(text.rlike(form), F.regexp_extract(text, form, k)) for k, name in enumerate(("operation", "model", "question"), 1)}


def as_text(item: Column) -> Column:
    """A JSON value as it stands in a question: a text without its quotes, anything else as it is."""
    return F.when(F.substring(item, 1, 1) == '"', F.try_variant_get(F.try_parse_json(item), "$", "string")).otherwise(item)


def is_list(item: Column) -> Column:
    return F.substring(item, 1, 1) == "["


def element(item: Column, k: int) -> Column:
    """The k-th value of a JSON list, null if it has none."""
    return F.when(is_list(item), F.to_json(F.try_variant_get(F.try_parse_json(item), f"$[{k}]", "variant")))


def _is_pair(item: Column) -> Column:
    return element(item, 1).isNotNull() & element(item, 2).isNull()


def kb_model(facts: DataFrame) -> Model:
    """Questions that are predicates over facts (predicate, subject, object): a list where one argument is "?", else yes
    or no."""

    def ask(asks: DataFrame) -> DataFrame:
        p = parse_predicate(F.col("q"))
        name, a, b = (F.coalesce(c, F.lit("")) for c in (p["name"], F.get(p["args"], F.lit(0)), F.get(p["args"], F.lit(1))))
        patterns = asks.select("q", name.alias("name"), a.alias("a"), b.alias("b")).distinct()
        got = lookup_each(patterns, facts, ["q", "a", "b"])
        listed = (F.col("a") == "?") | (F.col("b") == "?")
        answer = F.when(listed, F.to_json("answers")).otherwise(_quoted(F.get("answers", F.lit(0))))
        return asks.join(got.select(F.col("q").alias("__q"), answer.alias("answer")), F.col("q") == F.col("__q"), "left").select("qid", "task", "answer")

    return ask


def math_model() -> Model:
    return text_model(math_answer)


def text_model(f: Callable[[Column], Column]) -> Model:
    """A function of the question's text; its result is a text."""
    return lambda asks: asks.select("qid", "task", _quoted(f(F.col("q"))).alias("answer"))


def _quoted(text: Column) -> Column:
    """A text as a JSON text; null stays null."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def _whole(items: DataFrame, heads: DataFrame) -> DataFrame:
    """(qid, step, text): an answer as it stands in a question."""
    lists = items.groupBy("qid", "step").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), ", ").alias("inner"))
    inner = F.coalesce("inner", F.lit(""))
    return heads.join(lists, ["qid", "step"], "left").select("qid", "step", F.when(F.col("listed"), F.concat(F.lit("["), inner, F.lit("]"))).otherwise(as_text(inner)).alias("text"))


def _head(operation: Column) -> Column:
    return F.regexp_extract(operation, r"^([^_(]*)", 1)


def _planned(steps: DataFrame, answers: DataFrame) -> DataFrame:
    """steps of one round with ``over``, the reference whose items are gone over (null for select), ``refs``, the others,
    and ``sound``: whether the operation fits its question. answers: (qid, step, listed) so far."""
    found = F.regexp_extract_all("question", F.lit(r"#(\d+)"), 1)
    named = F.regexp_extract_all("operation", F.lit(r"#(\d+)"), 1)
    head = _head(F.col("operation"))
    project, each = head.startswith("project"), head.isin("project", "projectValues", "projectKeys", "filter", "filterValues", "filterKeys")
    context = project & (F.size(found) == 0) & F.contains("question", F.lit("#C"))
    over = F.when(context, "C").when(F.size(found) == 1, found[0]).when(~project & (F.size(found) > 1) & (F.size(named) == 1), named[0])
    told = steps.withColumn("head", head).withColumn("over", F.when(each, over))
    refs = F.array_distinct(F.filter(found, lambda x: ~x.eqNullSafe(F.col("over"))))
    told = told.withColumn("refs", refs).withColumn("fits", (head == "select") | (each & F.col("over").isNotNull()))
    known = answers.groupBy("qid").agg(F.collect_set(F.col("step").cast("string")).alias("known"), F.collect_set(F.when(F.col("listed"), F.col("step").cast("string"))).alias("lists"))
    out = told.join(known, "qid", "left")
    empty = F.array().cast("array<string>")
    known_, lists = F.coalesce("known", empty), F.coalesce("lists", empty)
    there = F.size(F.array_except("refs", known_)) == 0
    gone_over = F.col("over").isNull() | (F.col("over") == "C") | F.array_contains(lists, F.col("over"))
    return out.withColumn("sound", F.coalesce(F.col("fits") & there & gone_over, F.lit(False))).drop("known", "lists")


def _filled(question: Column, values: Column) -> Column:
    """References replaced by their values in one pass: what a value holds isn't looked at again."""
    pieces = F.regexp_extract_all(question, F.lit(_PIECES), 1)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(values, p), p)), "")


def run_programs(programs: DataFrame, models: Mapping[str, Model], contexts: DataFrame | None = None) -> Routed:
    """``_run`` over different programs: questions with the same steps, and as many paragraphs where a step names them, are
    answered by the one of the least qid, so that what they go over isn't held once for each question."""
    programs = written(programs.select("qid", F.col("step").cast("int").alias("step"), "text").filter("qid IS NOT NULL").distinct().groupBy("qid", "step").agg(F.max("text").alias("text")), "programs")
    told = programs.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("step", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("none"))))).alias("steps"))
    if contexts is not None:
        many = contexts.filter("qid IS NOT NULL AND paras > 0").groupBy("qid").agg(F.max("paras").cast("int").alias("paras"))
        told = told.join(many, "qid", "left").withColumn("paras", F.when(F.contains("steps", F.lit("#C")), F.coalesce("paras", F.lit(0))))
    else:
        told = told.withColumn("paras", F.lit(None).cast("int"))
    told = told.select("qid", F.sha2(F.concat_ws("|", F.col("paras").cast("string"), "steps"), 256).alias("program"))
    first = told.groupBy(F.col("program").alias("p")).agg(F.min("qid").alias("first"))
    classes = written(told.join(first, F.col("program") == F.col("p")).select("qid", "first"), "program-classes")
    chosen = classes.filter("qid = first").select("qid")
    ran = _run(programs.join(chosen, "qid"), models, contexts)

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("qid", "first").join(classes, "first").select("qid", *[c for c in df.columns if c != "qid"])

    return Routed(spread(ran.results), spread(ran.tasks))


def _run(programs: DataFrame, models: Mapping[str, Model], contexts: DataFrame | None = None) -> Routed:
    """programs (qid, step: 1, 2, ... without gaps, text) run over all questions at once.

    contexts (qid, paras: how many paragraphs the question has) is what "#C" goes over. select asks its question once;
    project and filter go over the items of a list, project's variants and filterValues and filterKeys over pairs, which
    are lists of two. Suffixes _flat, _unique, _keys and _values change the answer in turn. A question ends as "failed"
    at a step of another form, of an unknown operation or model, whose references don't fit, that has a null answer, or
    whose suffix doesn't fit; its later steps aren't asked. Else it is "ok".

    * a null text is of another form; a null qid is left out; repeated rows of a step are one.
    * a question without steps isn't in the result; an empty table gives no rows.
    """
    programs = written(programs.select("qid", F.col("step").cast("int").alias("step"), "text").filter("qid IS NOT NULL").distinct().groupBy("qid", "step").agg(F.max("text").alias("text")), "programs")
    spark = programs.sparkSession
    qid = programs.schema["qid"].dataType.simpleString()
    rounds = programs.agg(F.max("step")).first()[0] or 0
    state = programs.select("qid").distinct().select("qid", F.lit("ok").alias("status"), F.lit(0).alias("steps_done"))
    heads = spark.createDataFrame([], f"qid {qid}, step int, listed boolean")
    items = spark.createDataFrame([], ITEM.format(qid=qid))
    tasks = spark.createDataFrame([], f"qid {qid}, step int, task array<int>, question string, model string, answer string")
    if contexts is not None:
        c = contexts.filter("qid IS NOT NULL AND paras > 0").groupBy("qid").agg(F.max("paras").cast("int").alias("paras"))
        para = c.select("qid", F.explode(F.sequence(F.lit(0), F.col("paras") - 1)).alias("p")).select("qid", F.lit("C").alias("over"), F.array("p").alias("pos"), F.format_string('"PARA_%d"', "p").alias("item"))
    for k in range(1, rounds + 1):
        live = programs.filter(F.col("step") == k).join(state.filter("status = 'ok'").select("qid"), "qid")
        plan = written(_planned(live.select("qid", *[c.alias(n) for n, c in parsed(F.col("text")).items()]), heads), "plan")
        # the items of each question's list, a null one for select
        source = items.select("qid", F.col("step").cast("string").alias("over"), "pos", "item")
        if contexts is not None:
            source = source.unionByName(para)
        sound = plan.filter("sound")
        whole = sound.select("qid", F.explode("refs").alias("ref")).join(_whole(items, heads).select("qid", F.col("step").cast("string").alias("ref"), "text"), ["qid", "ref"])
        values = whole.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("#"), "ref"), "text"))).alias("refs_told"))
        one = sound.filter("over IS NULL").withColumn("pos", F.array(F.lit(0))).withColumn("item", F.lit(None).cast("string"))
        many = sound.filter("over IS NOT NULL").join(source, ["qid", "over"])
        rows = one.unionByName(many).join(values, "qid", "left")
        keyed = F.col("head").isin("projectKeys", "filterKeys")
        paired = F.col("head").isin("projectKeys", "projectValues", "filterKeys", "filterValues")
        own = F.when(paired, as_text(F.when(keyed, element(F.col("item"), 0)).otherwise(element(F.col("item"), 1)))).otherwise(as_text(F.col("item")))
        fits = F.col("over").isNull() | F.when(paired, _is_pair(F.col("item"))).otherwise(~is_list(F.col("item")))
        none = F.create_map().cast("map<string,string>")
        told = F.when(F.col("over").isNotNull(), F.map_concat(F.coalesce("refs_told", none), F.create_map(F.concat(F.lit("#"), F.col("over")), own))).otherwise(F.coalesce("refs_told", none))
        asked = rows.select("qid", "pos", F.col("pos").alias("task"), "head", "operation", "model", "item", F.coalesce(fits, F.lit(False)).alias("fits"), _filled(F.col("question"), told).alias("q"))
        asked = written(asked, "asked")
        parts = [model(asked.filter((F.col("model") == name) & F.col("fits")).select("qid", "task", "q")) for name, model in models.items()]
        got = asked.select("qid", "task").limit(0).withColumn("answer", F.lit(None).cast("string"))
        for p in parts:
            got = got.unionByName(p)
        merged = written(asked.join(got, ["qid", "task"], "left"), "merged")
        state, heads, items, own_tasks = _merged(k, state, heads, items, plan, merged)
        tasks = tasks.unionByName(own_tasks)
    text = _whole(items, heads).select("qid", "step", "text")
    raw = items.groupBy("qid", "step").agg(F.min("item").alias("raw"))
    last = heads.join(text, ["qid", "step"]).join(raw, ["qid", "step"], "left").select("qid", F.col("step").alias("steps_done"), F.when(F.col("listed"), F.col("text")).otherwise(F.col("raw")).alias("answer"))
    ok = state.join(last, ["qid", "steps_done"], "left")
    return Routed(ok.select("qid", "status", "steps_done", F.when(F.col("status") == "ok", F.col("answer")).alias("answer")), tasks)


def _merged(k: int, state: DataFrame, heads: DataFrame, items: DataFrame, plan: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a round's answers make of the questions: their state, answers (heads and items) and tasks."""
    head, answer, item = F.col("head"), F.col("answer"), F.col("item")
    filters = head.startswith("filter")
    truth = F.when(is_list(answer), F.lit(None).cast("boolean")).otherwise(F.lower(as_text(answer)).isin(*TRUE))
    good = F.col("fits") & answer.isNotNull() & (~filters | truth.isNotNull())
    pair = lambda a, b: F.concat(F.lit("["), a, F.lit(", "), b, F.lit("]"))
    plain = F.when(is_list(item) | (F.substring(item, 1, 1) == '"'), item).otherwise(F.concat(F.lit('"'), item, F.lit('"')))  # numbers become texts
    new = F.when(head == "projectValues", pair(element(item, 0), answer)).when(head == "projectKeys", pair(answer, element(item, 1))).when(head == "project", pair(plain, answer)).otherwise(plain)
    sound = merged.groupBy("qid").agg(F.bool_and(good).alias("all_good"))
    base = plan.select("qid", "operation", "head", "sound").join(sound, "qid", "left").withColumn("good", F.col("sound") & F.coalesce("all_good", F.lit(True)))
    base = base.withColumn("suffixes", F.slice(F.split("operation", "_"), 2, 1000)).join(merged.filter("head = 'select'").select("qid", F.col("answer").alias("selected")), "qid", "left")
    base = written(base.withColumn("listed", (F.col("head") != "select") | is_list(F.coalesce("selected", F.lit("")))).select("qid", "head", "suffixes", "good", "listed"), "base")
    leaves = F.posexplode(F.transform(F.try_parse_json(answer).cast("array<variant>"), lambda x: F.to_json(x)))
    chosen = merged.filter((head == "select") & is_list(answer)).select("qid", leaves.alias("p", "item")).select("qid", F.array("p").alias("pos"), "item")
    chosen = chosen.unionByName(merged.filter((head == "select") & ~is_list(answer)).select("qid", "pos", answer.alias("item")))
    chosen = chosen.unionByName(merged.filter((head != "select") & (~filters | truth)).select("qid", "pos", new.alias("item")))
    rows = chosen.join(base.filter("good").select("qid", "suffixes"), "qid")
    bad = base.filter("NOT good").select("qid")
    most = base.agg(F.max(F.size("suffixes"))).first()[0] or 0
    for j in range(most):
        rows = written(rows, "suffixed")
        name = F.get("suffixes", F.lit(j))
        own = base.filter("good").filter(name.isNotNull())
        unknown = own.filter(~name.isin("flat", "unique", "keys", "values") | ~F.col("listed")).select("qid")
        part = F.when(name == "keys", element(F.col("item"), 0)).otherwise(element(F.col("item"), 1))
        taken = rows.filter(name.isin("keys", "values")).withColumn("item", part)
        bad = bad.unionByName(unknown).unionByName(taken.filter("item IS NULL").select("qid"))
        flat = rows.filter(name == "flat").select("qid", "suffixes", "pos", F.posexplode(F.regexp_extract_all("item", F.lit(_LEAVES), 1)).alias("p", "item"))
        flat = flat.select("qid", F.concat("pos", F.array("p")).alias("pos"), "item", "suffixes")
        once = rows.filter(name == "unique").groupBy("qid", "item").agg(F.min("pos").alias("pos"), F.first("suffixes").alias("suffixes"))
        rest = rows.filter(name.isNull() | ~name.isin("flat", "unique", "keys", "values"))
        rows = rest.unionByName(taken).unionByName(flat).unionByName(once)
    failed = bad.distinct().withColumn("bad", F.lit(True))
    done = written(plan.select("qid").join(failed, "qid", "left").select("qid", F.coalesce("bad", F.lit(False)).alias("bad")), "done")
    now = state.join(done, "qid", "left").select("qid", F.when(F.col("bad"), "failed").otherwise(F.col("status")).alias("status"), F.when(F.col("bad").isNotNull(), k).otherwise(F.col("steps_done")).alias("steps_done"))
    good_ones = done.filter("NOT bad").select("qid")
    heads = heads.unionByName(written(base.join(good_ones, "qid").select("qid", F.lit(k).alias("step"), "listed"), "heads"))
    items = items.unionByName(written(rows.join(good_ones, "qid").select("qid", F.lit(k).alias("step"), "pos", "item"), "items"))
    # popped from a stack: a step's questions in the order of their items, then the merge
    asked = merged.filter("fits").select("qid", "pos", F.col("q").alias("question"), "model", "answer")
    own = plan.filter("sound").select("qid", F.lit(None).cast("array<int>").alias("pos"), F.concat(F.lit("("), "operation", F.lit(")")).alias("question"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("answer"))
    tasks = asked.unionByName(own).select("qid", F.lit(k).alias("step"), F.col("pos").alias("task"), "question", "model", "answer")
    return written(now, "state"), heads, items, tasks
