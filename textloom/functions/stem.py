"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980.

Three known departures from the paper hold: words of one or two letters stay as they are, ``bli``
becomes ``ble`` (not only ``abli``, ``able``), and ``logi`` becomes ``log``. Words are lower case.

A word is judged by its shape, a string of c and v for consonants and vowels: the measure of a stem
is the number of times its shape passes from v to c.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The suffix rules of the paper's steps 2 to 4, with the departures.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _longest(suffixes) -> re.Pattern:
    return re.compile("(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$")


_FIND_2, _FIND_3, _FIND_4 = _longest(STEP_2), _longest(STEP_3), _longest(STEP_4)
_PASSAGE = re.compile("vc")


def shape(word: str) -> str:
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    return len(_PASSAGE.findall(shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and shape(stem)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    stem = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if stem is None or "v" not in shape(stem):
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if measure(stem) == 1 and _short(stem) else stem


def _mapped(word: str, find: re.Pattern, rules: dict[str, str]) -> str:
    found = find.search(word)
    return word[: found.start()] + rules[found[1]] if found and measure(word[: found.start()]) > 0 else word


def _residual(word: str) -> str:
    found = _FIND_4.search(word)
    if not found:
        return word
    stem = word[: found.start()]
    if found[1] == "ion" and not stem.endswith(("s", "t")):
        return word
    return stem if measure(stem) > 1 else word


def _final(word: str) -> str:
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@lru_cache(1 << 18)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _mapped(word, _FIND_2, STEP_2)
    word = _mapped(word, _FIND_3, STEP_3)
    return _final(_residual(word))


def _stem_series(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """term, stem: each distinct term is stemmed once."""
    return terms.select("term").distinct().withColumn("stem", F.pandas_udf(_stem_series, "string")("term"))


def register(spark: SparkSession) -> None:
    """Makes porter_stem(term) a SQL function of the session."""
    spark.udf.register("porter_stem", F.pandas_udf(_stem_series, "string"))
