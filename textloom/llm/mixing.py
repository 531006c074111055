"""Mixing sources to target weights by hierarchical budgeting.

Weights belong to the nodes of a tree, here domain, language and source. A token budget goes down
the tree: siblings share it in proportion to their weights, but none gets more than its subtree can
supply in the allowed number of epochs. What one sibling cannot take goes to its siblings, and only
what a whole family cannot take goes back to be shared by the family's own siblings. That is
water-filling from the root with the subtrees' capacities, in exact integers.

A leaf repeats its documents for as many whole epochs as its budget holds and takes a prefix of one
more, counted in tokens, in an order seeded by epoch. The prefix is found from token sums over
ranges of the order, so that only the one range in which the prefix ends is put in order.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Documents without tokens (null or empty text) supply
nothing and are never selected. A null level is the node ``(null)``; a null doc_id orders as the
empty string. Columns other than doc_id, text and those of the levels are carried, whatever their
names. Repeated rows supply their tokens each time; equal ones are interchangeable. An
empty table gives an empty selection.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import Scratch
from .words import split_words, text_chunks

RANGE_ROWS = 1024
#: Up to so many leaves the plan, one row of about 100 bytes each, is broadcast; beyond the second number there is no plan, but an error.
BROADCAST_LEAVES, LEAVES = 50_000, 1_000_000
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """weights[level][node] is a whole number, 1 where it is not given; the budget is a share of all tokens, or a number of them."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    share: tuple[int, int] = (1, 2)
    tokens: int | None = None
    max_epochs: int = 2
    seed: int = 17


#: The weights, budget and epochs of the registered query.
PRODUCTION = Mix(weights={"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 1}})


def share_out(budget: int, children: list[tuple[str, int, int]]) -> dict[str, int]:
    """children: name, weight, capacity. What each gets; all of the budget unless every capacity is used up."""
    got = {name: 0 for name, _, _ in children}
    live = sorted((c for c in children if c[1] > 0 and c[2] > 0), key=lambda c: (Fraction(c[2], c[1]), c[0]))
    weight = sum(w for _, w, _ in live)
    for k, (name, w, capacity) in enumerate(live):
        if capacity * weight <= budget * w:
            got[name] = capacity
            budget, weight = budget - capacity, weight - w
            continue
        upto = 0
        for other, v, _ in live[k:]:
            got[other] = budget * (upto + v) // weight - budget * upto // weight
            upto += v
        break
    return got


def allocate(supply: dict[tuple[str, ...], int], mix: Mix, levels: tuple[str, ...] = LEVELS) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf (a path of nodes) from the tokens that it has."""
    capacity: dict[tuple[str, ...], int] = defaultdict(int)
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
    weight = lambda path: mix.weights.get(levels[len(path) - 1], {}).get(path[-1], 1)
    for path, tokens in supply.items():
        if all(weight(path[:k]) > 0 for k in range(1, len(path) + 1)):
            for k in range(len(path) + 1):
                capacity[path[:k]] += tokens * mix.max_epochs
                if k:
                    children[path[: k - 1]].add(path[:k])
    total = mix.tokens if mix.tokens is not None else sum(supply.values()) * mix.share[0] // mix.share[1]
    got = {(): min(total, capacity[()])}
    for _ in levels:
        got = {path + (name,): n for path, budget in got.items() for name, n in share_out(budget, [(c[-1], weight(c), capacity[c]) for c in children[path]]).items()}
    return got


def _counter(text, names: list[str]):
    """Adds n_tokens, the words of the text that ``text`` finds in a batch, and keeps rows that have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [split_words(buf, offsets).counts for _, _, buf, offsets in text_chunks(text(batch))]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64())], [*names, "n_tokens"]).filter(pa.array(n > 0))

    return count


class _Budget:
    """The plan of a mix over some documents: tokens of each, whole epochs and the rest of each leaf, and where the rest ends."""

    def __init__(self, docs: DataFrame, levels: dict[str, Column], mix: Mix):
        spark = docs.sparkSession
        scratch = Scratch(spark)
        self.mix, self.names = mix, list(levels)
        self.base = [F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit("(null)")).alias(n) for n, c in levels.items()]]
        names = self.names
        texts = docs.select(*self.base, F.col("text").cast("string").alias("text_"))
        held = texts.columns[:-1]
        self.schema = StructType([*texts.schema.fields[:-1], StructField("n_tokens", LongType())])
        self.counted = scratch.write(texts.mapInArrow(_counter(lambda batch: batch.column("text_"), held), self.schema), "counted")
        n_leaves = self.counted.select(*names).distinct().count()
        if n_leaves > LEAVES:
            raise ValueError(f"{n_leaves} leaves: the levels have to name at most {LEAVES}")
        # One row for each leaf of the tree, whose nodes the caller weighs: at most LEAVES.
        leaves = self.counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()
        supply = {tuple(x[n] for n in names): x["tokens"] for x in leaves}
        got = allocate(supply, mix, tuple(names))
        plan = [(*path, int(got.get(path, 0) // supply[path]), int(got.get(path, 0) % supply[path]), max(1, -(-x["docs"] // RANGE_ROWS))) for x in leaves for path in [tuple(x[n] for n in names)] if got.get(path, 0)]
        self.small = F.broadcast if len(plan) <= BROADCAST_LEAVES else lambda df: df
        self.plan = self.small(spark.createDataFrame(plan, ", ".join(f"`{n}` string" for n in names) + ", whole_ long, rest_ long, ranges_ long"))
        sums = self._placed(self.counted).where("rest_ > 0").groupBy(*names, "range_").agg(F.sum("n_tokens").alias("t"), F.first("rest_").alias("rest_"))
        before = Window.partitionBy(*names).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
        edge = sums.withColumn("before_", F.coalesce(F.sum("t").over(before), F.lit(0))).where("before_ < rest_ and before_ + t >= rest_").select(*names, F.col("range_").alias("edge_"), "before_")
        self.edge = scratch.write(edge, "edge")  # one row for each leaf

    def _placed(self, rows: DataFrame) -> DataFrame:
        key = F.md5(F.concat(F.lit(f"{self.mix.seed}:"), F.col("whole_").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        rows = rows.join(self.plan, self.names).withColumn("key_", key)
        return rows.withColumn("range_", F.floor(F.conv(F.substring("key_", 1, 8), 16, 10).cast("double") * F.col("ranges_") / float(1 << 32)))

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows with base's columns get the whole epochs of their leaf, the place in its order, and the range in which the rest ends."""
        return self._placed(rows).join(self.small(self.edge), self.names, "left")

    def full(self, marked: DataFrame) -> DataFrame:
        """A row for each epoch that takes a document whole."""
        epochs = F.col("whole_") + (F.col("range_") < F.coalesce("edge_", F.lit(-1))).cast("long")
        return marked.where(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))

    def last(self, marked: DataFrame) -> DataFrame:
        """marked rows of the ranges in which a rest ends, with n_tokens: those within the rest, with epoch and tokens_taken."""
        order = Window.partitionBy(*self.names).orderBy("key_", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
        rows = marked.withColumn("start_", F.col("before_") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where("start_ < rest_")
        return rows.withColumn("epoch", F.col("whole_")).withColumn("tokens_taken", F.least("n_tokens", F.col("rest_") - F.col("start_")))


def select(docs: DataFrame, levels: dict[str, Column], mix: Mix) -> DataFrame:
    """doc_id, the levels, epoch, n_tokens, tokens_taken of each document and epoch. Texts are read once, for their tokens."""
    budget = _Budget(docs, levels, mix)
    marked = budget.marked(budget.counted)
    out = ["doc_id", *budget.names, "epoch", "n_tokens", "tokens_taken"]
    full = budget.full(marked).withColumn("tokens_taken", F.col("n_tokens"))
    return full.select(*out).unionAll(budget.last(marked.where("range_ = edge_")).select(*out))


def _prefix(names: list[str]):
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            taken, size = batch.column("tokens_taken").to_numpy(), batch.column("n_tokens").to_numpy()
            short = np.flatnonzero(taken < size)
            if len(short):
                texts = columns[text_at].to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at is not None else None
                for i in short:
                    raw = texts[i].encode()
                    words = split_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
                    texts[i] = raw[: words.end[taken[i] - 1]].decode()
                    if chars:
                        chars[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def mix_documents(docs: DataFrame, levels: dict[str, Column], mix: Mix) -> DataFrame:
    """The selected documents with their columns, once for each epoch; a leaf's last document is cut where its budget ends.

    Only the documents of the ranges in which a budget ends are counted again; the others pass as they are.
    """
    budget = _Budget(docs, levels, mix)
    rows = budget.marked(docs.select(*budget.base, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    full = budget.full(rows.where(F.col("row")["text"].cast("string").rlike(r"[^\x20\x09-\x0D]"))).select("row.*")
    ends = rows.where("range_ = edge_")
    text_at = docs.columns.index("text")
    counted = ends.mapInArrow(_counter(lambda batch: batch.column("row").field(text_at).cast(pa.string()), ends.columns), StructType([*ends.schema.fields, StructField("n_tokens", LongType())]))
    last = budget.last(counted).select("row", "tokens_taken", "n_tokens").mapInArrow(_prefix(docs.columns), StructType(docs.schema.fields))
    return full.unionAll(last)


def document_levels() -> dict[str, Column]:
    """Of the documents table: four domains by the number in a source's name, then language, then source."""
    number = F.coalesce(F.nullif(F.regexp_extract("source", r"(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))
    return {"domain": F.concat(F.lit("d"), F.pmod(number, F.lit(4)).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet"), document_levels(), PRODUCTION)


def _level(name: str, level: int, keys: list[str], weights: str) -> str:
    """Water-filling of one level in SQL: budget table g{level-1}, capacities from s."""
    parent = ", ".join(keys[:-1])
    over = f"PARTITION BY {parent} " if parent else ""
    cols = ", ".join(keys)
    using = f"JOIN g{level - 1} USING ({parent})" if parent else f"CROSS JOIN g{level - 1}"
    return f"""
c{level} AS (SELECT {cols}, CAST({weights} AS HUGEINT) AS w, CAST(2 * sum(tokens) AS HUGEINT) AS c FROM s GROUP BY {cols}),
o{level} AS (SELECT c{level}.*, g{level - 1}.b,
   CAST(sum(w) OVER ({over}) AS HUGEINT) AS tw,
   CAST(coalesce(sum(w) OVER ({over}ORDER BY c::DOUBLE / w::DOUBLE, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS bw,
   CAST(coalesce(sum(c) OVER ({over}ORDER BY c::DOUBLE / w::DOUBLE, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS bc
   FROM c{level} {using}),
f{level} AS (SELECT *, c * (tw - bw) <= (b - bc) * w AS sat FROM o{level}),
h{level} AS (SELECT *, b - CAST(coalesce(sum(c) FILTER (sat) OVER ({over}), 0) AS HUGEINT) AS rb,
   tw - CAST(coalesce(sum(w) FILTER (sat) OVER ({over}), 0) AS HUGEINT) AS rw,
   CAST(coalesce(sum(w) FILTER (NOT sat) OVER ({over}ORDER BY c::DOUBLE / w::DOUBLE, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS u FROM f{level}),
g{level} AS (SELECT {cols}, CASE WHEN sat THEN c ELSE rb * (u + w) // rw - rb * u // rw END AS b FROM h{level}),"""


ORACLE = (
    r"""
WITH d AS (SELECT doc_id, 'd' || (coalesce(CAST(nullif(regexp_extract(source, '(\d+)$', 1), '') AS BIGINT), 0) % 4) AS domain,
   coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
t AS (SELECT * FROM d WHERE n_tokens > 0),
s AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY ALL),
g0 AS (SELECT CAST(sum(tokens) AS HUGEINT) // 2 AS b FROM s),"""
    + _level("domain", 1, ["domain"], "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")
    + _level("lang", 2, ["domain", "lang"], "CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END")
    + _level("source", 3, ["domain", "lang", "source"], "1")
    + r"""
l AS (SELECT domain, lang, source, CAST(b // tokens AS BIGINT) AS whole, CAST(b % tokens AS BIGINT) AS rest FROM g3 JOIN s USING (domain, lang, source)),
x AS (SELECT t.*, whole, rest, md5('17:' || whole || ':' || doc_id) AS k FROM t JOIN l USING (domain, lang, source)),
p AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM x)
SELECT doc_id, domain, lang, source, CAST(unnest(range(0, whole)) AS BIGINT) AS epoch, n_tokens, n_tokens AS tokens_taken FROM x
UNION ALL SELECT doc_id, domain, lang, source, whole, n_tokens, least(n_tokens, rest - start) FROM p WHERE start < rest
"""
)
