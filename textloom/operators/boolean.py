"""Boolean retrieval: set operations on document lists, and a small query language.

The language is read from left to right, without precedence or parentheses. ``and`` and ``or``
stand between terms, terms side by side mean AND, and ``not t`` removes the postings of t, also
after ``or``. Whenever the result so far is empty, the next operand replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def complement(universe: DataFrame, a: DataFrame) -> DataFrame:
    return universe.select("doc_id").distinct().join(a.select("doc_id"), "doc_id", "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_anti")


@dataclass(frozen=True)
class Step:
    """One operand: its term, whether it is negated, and whether it is added (or) rather than intersected."""

    term: str
    negated: bool
    added: bool


def parse(query: str) -> list[Step]:
    words = query.lower().split()
    steps, previous, at = [], None, 0
    while at < len(words):
        word = words[at]
        if word == "not":
            if at + 1 == len(words):
                raise ValueError("not needs a term after it")
            steps.append(Step(words[at + 1], True, False))
            previous, at = words[at + 1], at + 2
            continue
        if word not in ("and", "or"):
            steps.append(Step(word, False, previous == "or"))
        previous, at = word, at + 1
    return steps


def evaluate(index: Index, query: str) -> DataFrame:
    """doc_id of the documents that answer the query; sort for the printed list.

    Each document is reduced to the pattern of query terms that it holds. Whether a result is empty
    is a question about patterns, of which there are at most 2 to the number of terms, so the steps
    are decided in one row that holds the patterns that occur, and the documents are filtered by it, all
    in one job.
    """
    steps = parse(query)
    terms = list(dict.fromkeys(s.term for s in steps))
    if len(terms) > 62:
        raise ValueError("a query can have 62 terms")
    if not terms:
        return index.docs.select("doc_id").limit(0)
    bit = F.lit(0).cast("long")
    for k, term in enumerate(terms):
        bit = F.when(F.col("term") == term, F.lit(1 << k).cast("long")).otherwise(bit)
    held = index.postings.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.bit_or(bit).alias("pattern"))
    docs = index.docs.select("doc_id").join(held, "doc_id", "left").select("doc_id", F.coalesce("pattern", F.lit(0).cast("long")).alias("pattern"))
    result = F.array().cast("array<bigint>")
    decided = docs.agg(F.collect_set("pattern").alias("every")).withColumn("result", result)  # one row
    for step in steps:
        one = F.lit(1 << terms.index(step.term)).cast("long")
        operand = _having("every", one, step.negated)
        combined = F.array_union("result", operand) if step.added else F.array_intersect("result", operand)
        decided = decided.withColumn("result", F.when(F.size("result") == 0, operand).otherwise(combined))
    return docs.join(F.broadcast(decided.select("result"))).where(F.array_contains("result", F.col("pattern"))).select("doc_id")


def _having(patterns: str, bit, negated: bool):
    """The patterns with that bit, or without it."""
    if negated:
        return F.filter(patterns, lambda p: p.bitwiseAND(bit) == 0)
    return F.filter(patterns, lambda p: p.bitwiseAND(bit) != 0)


def explain_query(index: Index, query: str) -> DataFrame:
    """part, doc_id: the universe if the query begins with not, the postings of each term, then the result."""
    steps = parse(query)
    parts = [index.postings.where(F.col("term") == term).select(F.lit(term).alias("part"), "doc_id") for term in dict.fromkeys(s.term for s in steps)]
    if steps and steps[0].negated:
        parts.insert(0, index.docs.select(F.lit("universe").alias("part"), "doc_id"))
    return reduce(DataFrame.unionByName, [*parts, evaluate(index, query).select(F.lit("result").alias("part"), "doc_id")])
