"""Stop words: a default list, and loading of a list from a file."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frequent English function words. Any other list can be given by path or as words.
_FUNCTION_WORDS = """
about above after again against all also an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers herself him himself
his how if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with would you
your yours yourself yourselves
""".split()


def default_stop_words(filter_a: bool = False) -> list[str]:
    """The default words and every single letter. The letter a survives, unless it is asked for."""
    letters = [c for c in string.ascii_lowercase if c != "a" or filter_a]
    return sorted({*letters, *_FUNCTION_WORDS})


def load_stop_words(spark: SparkSession, path: str, filter_a: bool = False) -> DataFrame:
    """term: the words of a file, one to a line, trimmed and lower-cased, blank lines skipped.

    The file is read whole, so that a byte-order mark stays with the first word, as in a plain
    UTF-8 read; a list that begins with a marked ``a`` therefore doesn't stop ``a``. filter_a drops
    the mark.
    """
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r\n|\r|\n")).alias("line"))
    word = F.lower(F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    if filter_a:
        word = F.regexp_replace(word, "^﻿", "")
    return lines.select(word.alias("term")).where("term <> ''").distinct()


def stop_table(spark: SparkSession, words: list[str] | None = None) -> DataFrame:
    """term: a table of stop words."""
    return spark.createDataFrame([(w,) for w in (default_stop_words() if words is None else words)], "term string")
