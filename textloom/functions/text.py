"""Tokenisers and query preprocessing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def raw_tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters, case kept. Null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z]+"), "")


def alpha_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters; runs are found first, so letters that fold to ASCII don't join them."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " ")), " "), "")


def basic_tokens(text: Column) -> Column:
    """Words between white space, lower-cased, without possessives and without ASCII punctuation; digits and accents stay."""
    form = F.translate(F.lower(F.coalesce(text, F.lit(""))), "’", "'")
    form = F.regexp_replace(form, r"(?U)'s?\b", "")
    form = F.translate(form, PUNCTUATION, "")
    return F.filter(F.split(form, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def tokens(text: Column, tokenizer: str = "alpha") -> Column:
    return {"alpha": alpha_tokens, "basic": basic_tokens, "raw": raw_tokens}[tokenizer](text)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words among the distinct words of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(F.array_distinct(a), b)) / union).otherwise(F.lit(0.0))
