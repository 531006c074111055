"""Ranked retrieval and batch runs.

Scores are rounded to six digits before they are compared, so that the order in which a sum was
taken never shows; equal scores follow doc_id.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..config import BM25, Analyzer
from ..functions.runs import profiler, vocabulary_counter
from ..functions.stem import stem
from ..functions.text import alpha_tokens
from .index import Index, build_index, stop_words
from .weights import SCHEMES, bm25, ltn, rsv, term_weight, weights, weights_by_scheme

DIGITS = 6
#: Terms, stems among them, whose df a batch broadcasts.
OFTEN = 200_000


def query_terms(query: str, config: Analyzer) -> list[str]:
    """The sorted distinct terms of a query, under the index's configuration. Query terms have weight 1."""
    import re

    words = [w.lower() for w in re.findall("[A-Za-z]+", query)]
    if config.stop:
        stops = set(stop_words(config))
        words = [w for w in words if w not in stops]
    return sorted({stem(w) if config.stem else w for w in words})


def query_table(queries: DataFrame, config: Analyzer) -> DataFrame:
    """query_id, term: as query_terms, for a table (query_id, query)."""
    from .index import analyzed

    docs = queries.select(F.col("query_id").alias("doc_id"), F.col("query").alias("text"))
    rows = analyzed(docs, config).select(F.col("doc_id").alias("query_id"), F.explode("terms").alias("term"))
    if config.stem:
        from ..functions.stem import stem_vocabulary

        rows = rows.join(stem_vocabulary(rows), "term").select("query_id", F.col("stem").alias("term"))
    return rows.distinct()


def search(index: Index, query: str, scheme: str = "ltn", k: int = 10, p: BM25 = BM25(), norms: DataFrame | None = None) -> DataFrame:
    """doc_id, score of the k best documents, best first. The top is taken without a full sort."""
    rows = weights(index, scheme, query_terms(query, index.config), p, norms)
    scores = rows.groupBy("doc_id").agg(F.round(F.sum("weight"), DIGITS).alias("score")).where("score > 0")
    return scores.orderBy(F.desc("score"), "doc_id").limit(k)


def ranked_by_scheme(index: Index, queries: DataFrame, schemes=SCHEMES, k: int = 1500, p: BM25 = BM25(), norms: DataFrame | None = None) -> DataFrame:
    """scheme, query_id, rank, doc_id, score above 0: the k best of every query of a table (query_id, query)."""
    terms = query_table(queries, index.config)
    rows = weights_by_scheme(index, schemes, terms, p, norms).join(terms, "term")
    scores = rows.groupBy("scheme", "query_id", "doc_id").agg(F.round(F.sum("weight"), DIGITS).alias("score")).where("score > 0")
    order = Window.partitionBy("scheme", "query_id").orderBy(F.desc("score"), "doc_id")
    best = scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return best.select("scheme", "query_id", "rank", "doc_id", "score")


def ranked(index: Index, queries: DataFrame, scheme: str, k: int = 1500, p: BM25 = BM25(), norms: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_id, score, as ranked_by_scheme."""
    return ranked_by_scheme(index, queries, (scheme,), k, p, norms).drop("scheme")


def batch(docs: DataFrame, queries: DataFrame, configs: list[Analyzer], schemes=SCHEMES, k: int = 1500) -> DataFrame:
    """config, scheme, query_id, rank, doc_id, score: all rankings of a batch; the terms of its queries are held on the driver.

    Configurations of letter runs share two passes over the texts, and postings are not moved: the first pass
    counts documents for each term, the second sums up what norms need from the terms of most documents, which
    are broadcast. Only postings of the other, rare terms are joined with their df.
    """
    plain = [c for c in configs if c.tokenizer == "alpha"]
    runs = [ranked_by_scheme(build_index(docs, c), queries, schemes, k).select(F.lit(c.name).alias("config"), "*") for c in configs if c.tokenizer != "alpha"]
    return reduce(DataFrame.unionByName, ([_shared_batch(docs, queries, plain, schemes, k)] if plain else []) + runs)


def _shared_batch(docs: DataFrame, queries: DataFrame, configs: list[Analyzer], schemes, k: int, often: int = OFTEN, p: BM25 = BM25()) -> DataFrame:
    spark, every = docs.sparkSession, range(len(configs))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    stops, stems = [stop_words(c) if c.stop else [] for c in configs], [c.stem for c in configs]
    counted = docs.mapInArrow(vocabulary_counter(stops, stems), "stemmed boolean, term string, " + ", ".join(f"n{c} long" for c in every))
    counted = counted.groupBy("stemmed", "term").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in every]).withColumn("most", F.greatest(*[f"n{c}" for c in every]) if len(configs) > 1 else F.col("n0")).persist()
    # The least df that leaves so many terms to be broadcast, from the numbers of terms by df.
    at_least, held, n_docs = 1, 0, 0
    for row in counted.groupBy(F.col("term").isNull().alias("all"), "most").agg(F.count("*").alias("terms")).orderBy(F.desc("most")).collect():
        if row["all"]:
            n_docs = row["most"]
        elif at_least == 1:
            held += row["terms"]
            at_least = row["most"] + 1 if held > often else 1
    table = spark.sparkContext.broadcast(counted.where("term is not null").where(F.col("most") >= at_least).drop("most").toArrow())
    counted.unpersist()

    asked = reduce(DataFrame.unionByName, [query_table(queries, c).withColumn("config", F.lit(n)) for n, c in enumerate(configs)])
    wanted: list[list[str]] = [[] for _ in configs]
    for row in asked.select("config", "term").distinct().collect():
        wanted[row["config"]].append(row["term"])
    schema = StructType([docs.schema["doc_id"], StructField("stemmed", BooleanType()), StructField("term", StringType()), StructField("hits", ArrayType(StructType([StructField("config", IntegerType()), StructField("term", StringType()), StructField("tf", LongType())])))])
    for name, kind in (("tf", LongType()), ("dl", LongType()), ("sq", DoubleType())):
        for c in every:
            schema = schema.add(f"{name}{c}", kind)
    rows = docs.mapInArrow(profiler(stops, stems, table, n_docs, wanted), schema).persist()

    whole = F.lit(n_docs).cast("long")
    own = Window.partitionBy("stemmed", "term")  # a rare term has fewer documents than any that is broadcast
    rare = rows.where("term is not null").select("doc_id", "stemmed", "term", *[f"tf{c}" for c in every]).withColumns({f"n{c}": F.count(F.when(F.col(f"tf{c}") > 0, 1)).over(own) for c in every})
    weight = lambda c: F.when(F.col(f"tf{c}") > 0, ltn(F.col(f"tf{c}"), F.col(f"n{c}"), whole)).otherwise(F.lit(0.0))
    rest = rare.groupBy("doc_id").agg(*[F.sum(weight(c) * weight(c)).alias(f"rest{c}") for c in every])
    # Documents are dealt by doc_id, so that scores are summed up where they are.
    each = rows.where("term is null").select("doc_id", "hits", *[f"dl{c}" for c in every], *[f"sq{c}" for c in every]).repartition("doc_id").join(rest, "doc_id", "left")
    total = rows.where("term is null").agg(*[F.coalesce(F.avg(f"dl{c}"), F.lit(0.0)).alias(f"avg{c}") for c in every])
    pick = lambda make: F.element_at(F.array(*[make(c) for c in every]), F.col("hit.config") + 1)
    norm = lambda c: F.sqrt(F.col(f"sq{c}") + F.coalesce(F.col(f"rest{c}"), F.lit(0.0)))
    hits = each.join(F.broadcast(total)).select("*", F.explode("hits").alias("hit")).select("doc_id", "hit.*", pick(lambda c: F.col(f"dl{c}")).alias("dl"), pick(lambda c: F.col(f"avg{c}")).alias("avgdl"), pick(norm).alias("norm"))
    df = rows.where("term is null").select(F.explode("hits").alias("hit")).groupBy("hit.config", "hit.term").agg(F.count("*").alias("df"))
    terms = F.broadcast(asked.join(df, ["config", "term"]))
    tf, plain = F.col("tf"), ltn(F.col("tf"), F.col("df"), whole)
    score = {"ltn": plain, "ltc": plain / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0)), "bm25": bm25(tf, F.col("df"), whole, F.col("dl"), F.col("avgdl"), p)}
    sums = hits.join(terms, ["config", "term"]).groupBy("config", "query_id", "doc_id").agg(*[F.round(F.sum(score[s]), DIGITS).alias(s) for s in schemes])
    scored = sums.select("config", "query_id", "doc_id", F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("score")) for s in schemes])).alias("s")).select("config", "s.scheme", "query_id", "doc_id", "s.score").where("score > 0")
    # Each task's rows are cut to its own k best before they move, if the planner's bound admits k.
    bound = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(bound, str(max(k, int(spark.conf.get(bound)))))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("config", "scheme", "query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    names = F.element_at(F.array(*[F.lit(c.name) for c in configs]), F.col("config") + 1)
    return best.select(names.alias("config"), "scheme", "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def weighting_experiment(index: Index, query: str, doc_id, scheme: str, k: int = 10) -> dict:
    """The weight of the query's second term (in sorted order) in a document, the document's score, the top k, and the seconds taken."""
    began = time.perf_counter()
    terms = query_terms(query, index.config)
    if len(terms) < 2:
        raise IndexError("the experiment needs a query of two terms")
    weight = term_weight(index, terms[1], doc_id, scheme).first()[0]
    score = rsv(index, dict.fromkeys(terms, 1.0), scheme).where(F.col("doc_id") == doc_id).select("score").first()
    top = search(index, query, scheme, k).collect()
    return {"term": terms[1], "weight": weight, "rsv": score[0] if score else 0.0, "top": [(r.doc_id, r.score) for r in top], "seconds": time.perf_counter() - began}


def jaccard_pairs(queries: DataFrame, docs: DataFrame, least: float = 0.0) -> DataFrame:
    """query_id, doc_id, jaccard of every query with every document that shares a word with it, or reaches ``least``.

    An inverted-index join on words: only pairs with a common word are formed. With a threshold, only
    the rarest words are joined: of two sets that reach it, each has a common word among its first
    n - ceil(least * n) + 1 in an order that both follow. So a word that all texts hold forms no pairs.
    """
    q = queries.select("query_id", F.array_distinct(alpha_tokens(F.col("query"))).alias("q_words"))
    d = docs.select("doc_id", F.array_distinct(alpha_tokens(F.col("text"))).alias("d_words"))
    if least <= 0:
        left = q.select("query_id", F.size("q_words").alias("nq"), F.explode("q_words").alias("word"))
        right = d.select("doc_id", F.size("d_words").alias("nd"), F.explode("d_words").alias("word"))
        both = left.join(right, "word").groupBy("query_id", "doc_id", "nq", "nd").agg(F.count("*").alias("k"))
        return both.select("query_id", "doc_id", (F.col("k") / (F.col("nq") + F.col("nd") - F.col("k"))).alias("jaccard"))
    often = d.select(F.explode("d_words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))

    def first(rows: DataFrame, key: str, words: str) -> DataFrame:
        listed = rows.select(key, F.explode(words).alias("word")).join(often, "word", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word")))
        n = F.size("words")
        short = listed.groupBy(key).agg(order.alias("words")).select(key, F.explode(F.slice("words", F.lit(1), n - F.ceil(n * (least - 1e-9)).cast("int") + 1)).alias("w"))
        return short.select(key, F.col("w.word").alias("word"))

    met = first(q, "query_id", "q_words").join(first(d, "doc_id", "d_words"), "word").select("query_id", "doc_id").distinct()
    k = F.size(F.array_intersect("q_words", "d_words"))
    pairs = met.join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", (k / (F.size("q_words") + F.size("d_words") - k)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= least)
