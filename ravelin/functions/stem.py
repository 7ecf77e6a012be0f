"""The stemming algorithm that M. F. Porter published in 1980, over the distinct terms of a table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes and their replacements by step, in the order of the publication.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_MEASURE = re.compile("v+c+")


def _shape(word: str) -> str:
    """A letter v or c for each letter: y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _m(stem: str) -> int:
    return len(_MEASURE.findall(_shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant, the last one not w, x or y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    else:
        cut = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
        if cut is not None and _vowel(cut):
            if cut.endswith(("at", "bl", "iz")) or (not _double(cut) and _m(cut) == 1 and _short_end(cut)):
                cut += "e"
            elif _double(cut) and cut[-1] not in "lsz":
                cut = cut[:-1]
            word = cut
    if word.endswith("y") and _vowel(word[:-1]):
        word = word[:-1] + "i"
    for step in (STEP_2, STEP_3):
        s = _longest(word, step)
        if s and _m(word[: -len(s)]) > 0:
            word = word[: -len(s)] + step[s]
    s = _longest(word, STEP_4)
    if s and _m(word[: -len(s)]) > 1 and (s != "ion" or word[: -len(s)].endswith(("s", "t"))):
        word = word[: -len(s)]
    if word.endswith("e") and (_m(word[:-1]) > 1 or (_m(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _m(word) > 1 else word


def stemmed(rows: DataFrame, term: str = "term") -> DataFrame:
    """rows with each term replaced by its stem. Each distinct term is stemmed once and joined back; null stays null."""

    def stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__t": b["__t"], "__stem": [porter(w) for w in b["__t"]]})

    once = rows.select(F.col(term).alias("__t")).filter("__t IS NOT NULL").distinct().mapInPandas(stems, "__t string, __stem string")
    return rows.join(once, F.col(term) == F.col("__t"), "left").withColumn(term, F.col("__stem")).drop("__t", "__stem")
