"""String functions over columns: normalisation, parsing of model output, queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, articles, question words, and phrases that results depend on.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
WH_WORDS = ("who", "what", "when", "where", "why", "which", "how", "does", "is")
REASONING_STARTERS = ("thus ", "thus,", "so ", "so,", "that is,", "therefore", "hence")
QUERY_FILLERS = (
    "i need to find", "i need to identify", "we need to", "try to find", "search for", "looking for", "find out", "figure out", "tell me", "what is", "who is",
    "where is", "when was", "the name of", "information about", "details regarding", "associated with", "related to", "step 1", "next step", "first step",
    "bridge entity", "logical step",
)
REFUSALS = ("not found", "no information", "didn't find", "unable to find", "doesn't mention", "no mention", "unknown", "can't answer", "i don't know")
SUM = r"(\d[\d,]*\.?\d+|\d+) [+-] (\d[\d,]*\.?\d+|\d+) = (\d[\d,]*\.?\d+|\d+)"
ABSTRACT = (
    "how", "why", "relationship", "significance", "reason", "effect", "impact", "influence", "consequence", "meaning", "purpose", "explain", "describe",
    "compare", "contrast", "analyze", "evaluate", "discuss", "difference", "similarity", "connection",
)
CONCRETE = ("who", "what", "when", "where", "which", "name", "date", "year", "location", "place", "person", "title")
ABSTRACT_PHRASES, BOOSTED_PHRASES = ("how does", "why does", "what is the relationship"), ("how does", "why does")
CONCRETE_PHRASES = ("what is the name", "who is", "when did")
ACTIONS = ("Z", "S-Sparse", "S-Dense", "S-Hybrid", "M")


def words(c: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


#: An article that no letter, digit or underscore touches.
WHOLE_ARTICLE = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"


def normalize_answer(c: Column) -> Column:
    """Lower case, punctuation deleted, articles dropped as whole words (also beside signs that aren't ASCII punctuation),
    white space collapsed."""
    plain = F.translate(F.lower(c), PUNCTUATION, "")
    return F.array_join(F.filter(F.split(F.regexp_replace(plain, WHOLE_ARTICLE, " "), r"\s+"), lambda w: w != ""), " ")


def answer_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9: the default analyzer of the lexical index."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Lower-case letters, digits and underscores of any script; everything between is one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def float_text(d: Column) -> Column:
    """A double in the shortest form that reads back: with an exponent below 1e-4 and from 1e16 on, else in full."""
    s = d.cast("string")
    form = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, whole, part = (F.regexp_extract(s, form, k) for k in (1, 2, 3))
    part = F.when(part == "0", "").otherwise(part)
    power = F.nullif(F.regexp_extract(s, form, 4), F.lit("")).cast("int")
    digits, n = F.concat(whole, part), F.length(part)
    large = F.when(n <= power, F.concat(digits, F.repeat(F.lit("0"), power - n), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(whole, F.when(n > 0, F.concat(F.lit("."), part)).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    plain = F.when(F.isnan(d), "nan").when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").otherwise(s)
    return F.when(power.isNull(), plain).otherwise(F.concat(sign, F.when((power >= 16) | (power < -4), exponent).when(power >= 0, large).otherwise(small)))


def number_normalize(c: Column) -> Column:
    """Tokens at spaces and hyphens; numbers as doubles, other tokens without punctuation and articles."""
    def one(w: Column) -> Column:
        plain = F.translate(w, PUNCTUATION, "")
        return F.coalesce(float_text(w.try_cast("double")), F.when(plain.isin(*ARTICLES), "").otherwise(plain))

    return F.array_join(F.filter(F.transform(F.split(F.lower(c), "[ -]"), one), lambda w: w != ""), " ")


def without_wh_words(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, " "), lambda w: ~F.lower(w).isin(*WH_WORDS)), " ")


def is_reasoning(c: Column) -> Column:
    """A sentence that draws a conclusion or does a sum."""
    low = F.lower(c)
    starts = F.lit(False)
    for w in REASONING_STARTERS:
        starts = starts | low.startswith(w)
    return starts | c.rlike(SUM)


def clean_query(c: Column) -> Column:
    """Quotes and brackets stripped at the ends, fillers deleted one after the other; the trimmed query in lower case if
    under two characters are left."""
    whole = F.lower(F.trim(c))
    out = F.lower(F.btrim(F.btrim(c), F.lit("\"'[]")))
    for phrase in QUERY_FILLERS:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) < 2, whole).otherwise(out)


def until_action(c: Column) -> Column:
    """The text through the first line that holds "Action:", or all of it."""
    cut = F.regexp_extract(c, r"(?s)^(.*?Action:[^\n]*)", 1)
    return F.when(cut == "", c).otherwise(cut)


def evidence_supports(answer: Column, n_docs: Column) -> Column:
    """False without documents, or where a refusal isn't followed up by a contrast."""
    low = F.lower(answer)
    refused = F.greatest(*[F.contains(low, F.lit(p)) for p in REFUSALS])
    return (n_docs > 0) & ~(refused & ~(F.contains(low, F.lit("but")) | F.contains(low, F.lit("however"))))


def parse_action(c: Column) -> Column:
    """The action after "Action:" if it is one, else the first of ACTIONS in the last line, else in the text, else Unknown.

    Single letters match anywhere, in the order of ACTIONS, so a stray Z wins.
    """
    def first_in(text: Column) -> Column:
        return F.coalesce(*[F.when(F.contains(text, F.lit(a)), a) for a in ACTIONS])

    named = F.rtrim(F.regexp_extract(c, r"Action:\s*([A-Za-z0-9\-]+)", 1))
    last = F.substring_index(F.trim(c), "\n", -1)
    return F.coalesce(F.when(named.isin(*ACTIONS), named), first_in(last), first_in(c), F.lit("Unknown"))


def coarse(action: Column) -> Column:
    return F.when(action.startswith("S-"), "S").otherwise(action)


def hybrid_rule(complexity: Column, index: Column, action: Column) -> Column:
    """Complexity and index strategy to an action; a single-hop question without strategy goes hybrid."""
    single = F.when(index == "Lexical", "S-Sparse").when(index == "Semantic", "S-Dense").otherwise("S-Hybrid")
    return F.when(complexity == "L0", "Z").when(complexity == "L2", "M").when(complexity == "L1", single).otherwise(action)


def json_text(c: Column) -> Column:
    """The text of a model's reply, whichever of four layouts it has."""
    paths = ("$.text", "$.generated_texts[0]", "$.choices[0].text", "$.choices[0].message.content")
    return F.coalesce(*[F.get_json_object(c, p) for p in paths], F.lit(""))


def extract_answer(c: Column, pattern: str = r"(?i).*answer is:? ?(.*?)\.?$") -> Column:
    got = F.regexp_extract(c, pattern, 1)
    return F.when(got == "", F.regexp_replace(c, r"\.$", "")).otherwise(got)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def numbered_list(c: Column) -> Column:
    """Lines without their numbers, blank ones dropped, distinct in order."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^ *\d+\. *", "")))
    return F.array_distinct(F.filter(lines, lambda x: x != ""))


def question_type(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = F.lit("other")
    for w in reversed(("what", "who", "when", "where", "why", "how", "which")):
        out = F.when(low.startswith(w), w).otherwise(out)
    return out


def entities(c: Column) -> Column:
    """Quoted strings, runs of capitalised words and years, distinct in that order."""
    quoted = F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))
    named = F.regexp_extract_all(c, F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1))
    years = F.regexp_extract_all(c, F.lit("([12][0-9]{3})"), F.lit(1))
    return F.array_distinct(F.concat(quoted, named, years))


def lexical_specificity(c: Column) -> Column:
    """Share of a query's words that stand in entities, and the entities' mean length; 0.5 for an empty query."""
    n = F.size(words(c))
    found = entities(c)
    sizes = F.transform(found, lambda e: F.size(words(e)))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    mean = F.when(F.size(found) == 0, 0.0).otherwise(total / F.greatest(F.size(found), F.lit(1)))
    score = 0.7 * F.least(total / F.greatest(n, F.lit(1)), F.lit(1.0)) + 0.3 * F.least(mean / 3, F.lit(1.0))
    return F.when(n == 0, 0.5).otherwise(F.least(score, F.lit(1.0)))


def semantic_abstractness(c: Column) -> Column:
    """Abstract keywords among abstract and concrete ones, raised by some phrases; phrases decide where there are none."""
    low = F.lower(c)
    distinct = F.array_distinct(words(low))
    count = lambda keys: F.size(F.array_intersect(distinct, F.array(*[F.lit(k) for k in keys])))
    holds = lambda phrases: F.greatest(*[F.contains(low, F.lit(p)) for p in phrases])
    a, b = count(ABSTRACT), count(CONCRETE)
    ratio = a / F.greatest(a + b, F.lit(1))
    boosted = F.when(holds(BOOSTED_PHRASES), F.least(ratio + 0.2, F.lit(1.0))).otherwise(ratio)
    return F.when(a + b > 0, boosted).otherwise(F.when(holds(ABSTRACT_PHRASES), 0.8).when(holds(CONCRETE_PHRASES), 0.2).otherwise(0.5))


def fusion_weights(lexical: Column, semantic: Column, temperature: float = 1.0) -> dict[str, Column]:
    """Softmax over lexical, balanced and semantic logits."""
    logits = {"bm25": 2 * lexical / temperature, "splade": (lexical + semantic) / temperature, "hnsw": 2 * semantic / temperature}
    top = F.greatest(*logits.values())
    parts = {k: F.exp(v - top) for k, v in logits.items()}
    total = sum(parts.values(), F.lit(0.0))
    return {k: v / total for k, v in parts.items()}


def support_normal(c: Column) -> Column:
    """A supporting title or paragraph: lower case, without spaces."""
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def single_spaced(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), " +", " ")


def supported(text: Column, answer: Column) -> Column:
    """Whether a text holds an answer, in lower case with single spaces, or normalised."""
    return F.contains(single_spaced(text), single_spaced(answer)) | F.contains(normalize_answer(text), normalize_answer(answer))


def looks_like_title(c: Column) -> Column:
    """Predictions that are titles rather than answers."""
    low = F.lower(c)
    return F.contains(low, F.lit("wikipedia title")) | F.contains(low, F.lit("the great")) | low.startswith("ipedia") | low.startswith("ikipedia")


def singular(w: Column) -> Column:
    """A light stem: plural endings of a word of over three letters go."""
    return (
        F.when(F.length(w) <= 3, w).when(w.rlike("(?<![ea])ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(?<![aeo])es$"), F.regexp_replace(w, "es$", "e"))
        .when(w.rlike("(?<![us])s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    )


STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")


def analyzed(c: Column, stop: Sequence[str] = STOP_WORDS, stem=singular) -> Column:
    """Tokens without stop words, stemmed: another analyzer for the lexical index."""
    kept = F.filter(tokens(c), lambda w: ~w.isin(*stop))
    return F.transform(kept, stem) if stem else kept


def without_prompt(text: Column, prompt: Column, end: str | None = None) -> Column:
    """A generation without the prompt that it repeats: all of it, or a common beginning of over half of the prompt; cut
    at the end mark."""
    same = F.zip_with(F.split(text, ""), F.split(prompt, ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    common = F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(F.array_position(same, False) - 1)
    out = F.when(F.startswith(text, prompt) | (common > 0.5 * F.length(prompt)), F.regexp_replace(F.substr(text, common.cast("int") + 1), r"^\s+", "")).otherwise(text)
    return F.when(F.contains(out, F.lit(end)), F.substring_index(out, end, 1)).otherwise(out) if end else out


PLAN_FILLERS = ("convert", "break it down", "step by step", "logical path", "here's", "let me", "i'll", "to answer")
LINE_FILLERS = ("convert", "break it down", "step by step", "here's the", "here is the", "let me", "i'll")


def plan_line(c: Column) -> Column:
    """The first line of a plan that has an arrow and no filler, else the first line that has no filler, else the first."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    free = lambda x, fillers: ~F.greatest(*[F.contains(F.lower(x), F.lit(p)) for p in fillers])
    first = lambda found: F.get(found, F.lit(0))
    arrows = F.filter(lines, lambda x: F.contains(x, F.lit("->")) & free(x, PLAN_FILLERS))
    return F.coalesce(first(arrows), first(F.filter(lines, lambda x: (x != "") & free(x, LINE_FILLERS))), first(lines))


def first_sentence(c: Column) -> Column:
    """A text through its first full stop, question or exclamation mark before white space; all of it if there is none."""
    got = F.regexp_extract(c, r"(?s)^(.*?[.!?])\s", 1)
    return F.when(got == "", c).otherwise(got)


def first_prediction(c: Column) -> Column:
    """A list of predictions as its first, an empty one as the empty answer."""
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))
