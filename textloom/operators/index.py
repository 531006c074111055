"""The inverted index as tables: docs(doc_id, dl), postings(term, doc_id, tf), terms(term, df)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..config import Analyzer
from ..functions.runs import counter, measurer
from ..functions.stem import stem_vocabulary
from ..functions.stopwords import default_stop_words
from ..functions.text import tokens


def stop_words(config: Analyzer) -> list[str]:
    """The stop words of a configuration: its own, or the default ones."""
    return list(config.words) if config.words is not None else default_stop_words()


def analyzed(docs: DataFrame, config: Analyzer) -> DataFrame:
    """The documents with terms, an array: tokenised, without stop words, not stemmed yet.

    Stop words are tested before stemming, so stems are never stopped.
    """
    terms = tokens(F.col("text"), config.tokenizer)
    if config.stop:
        stops = F.array(*map(F.lit, stop_words(config)))
        terms = F.filter(terms, lambda t: ~F.array_contains(stops, t))
    return docs.withColumn("terms", terms)


def occurrences(docs: DataFrame, config: Analyzer) -> DataFrame:
    """doc_id, term: a row for each occurrence, not stemmed yet. Stop words go by a broadcast anti join."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.explode(tokens(F.col("text"), config.tokenizer)).alias("term"))
    if config.stop:
        stops = spark.createDataFrame([(w,) for w in stop_words(config)], "term string")
        rows = rows.join(F.broadcast(stops), "term", "left_anti")  # the list is part of the configuration
    return rows.select("doc_id", "term")


def term_frequencies(docs: DataFrame, config: Analyzer) -> DataFrame:
    """term, doc_id, tf. doc_id is unique, so alphabetic terms are counted where a text is read, without a shuffle.

    Stemming happens once for each distinct term, after the first count.
    """
    if config.tokenizer == "alpha":
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        schema = StructType([StructField("term", StringType()), rows.schema["doc_id"], StructField("tf", LongType())])
        counted = rows.mapInArrow(counter(stop_words(config) if config.stop else []), schema)
    else:
        counted = occurrences(docs, config).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return stemmed(counted) if config.stem else counted


def stemmed(counted: DataFrame) -> DataFrame:
    """term, doc_id, tf of the stems, from those of the words."""
    stems = stem_vocabulary(counted.select("term"))
    return counted.join(stems, "term").groupBy(F.col("stem").alias("term"), "doc_id").agg(F.sum("tf").alias("tf"))


@dataclass
class Index:
    """An index of one collection under one configuration; doc_id identifies a document.

    docs has doc_id and dl, postings term, doc_id and tf. A kept or saved index has df and dl with each
    posting and the collection's scalars as numbers, so that a query is a scan of its terms' postings.
    """

    docs: DataFrame
    postings: DataFrame
    config: Analyzer
    kept: list[DataFrame] = field(default_factory=list)
    parts: int | None = None
    totals: tuple[int, int] | None = None

    def postings_for(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; of a saved index only the folders that can hold them are read."""
        rows = self.postings
        if self.parts:
            spark = rows.sparkSession
            found = spark.createDataFrame([(t,) for t in terms], "term string").select(_part(self.parts)).distinct().collect()
            rows = rows.where(F.col("part").isin([r.part for r in found]))
        return rows.where(F.col("term").isin(terms))

    @property
    def terms(self) -> DataFrame:
        """term, df."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def scalars(self) -> DataFrame:
        """One row: doc_count, total_terms, avg_doc_length (0 if there are no documents)."""
        total = F.coalesce(F.sum("dl"), F.lit(0)).cast("long")
        return self.docs.agg(F.count("*").alias("doc_count"), total.alias("total_terms")).withColumn(
            "avg_doc_length", F.when(F.col("doc_count") > 0, F.col("total_terms") / F.col("doc_count")).otherwise(F.lit(0.0))
        )

    def with_scalars(self, rows: DataFrame) -> DataFrame:
        """rows with doc_count and avg_doc_length: numbers if they are known, else a broadcast of one row."""
        if self.totals is None:
            return rows.join(F.broadcast(self.scalars.select("doc_count", "avg_doc_length")))
        n, total = self.totals
        return rows.withColumns({"doc_count": F.lit(n).cast("long"), "avg_doc_length": F.lit(total / n if n else 0.0)})

    def complete(self) -> DataFrame:
        """The postings with df and dl."""
        return self.postings.join(self.terms, "term").join(self.docs, "doc_id").select("term", "doc_id", "tf", "df", "dl")

    def persist(self) -> "Index":
        """Keep docs and postings, for several queries over one index.

        Postings are kept by document, so that scores are summed up where they are; within a partition
        they are ordered by term, so that a query passes over the blocks without its terms. All is
        computed here, as only then does a plan know how the postings lie.
        """
        n = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs = self.docs.persist()
        row = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long")).first()
        self.totals = (row[0], row[1])
        plain, self.docs = self.postings, docs
        self.postings = Index(docs, plain, self.config).complete().repartition(n, "doc_id").sortWithinPartitions("term").persist()
        self.postings.count()
        self.kept = [docs, self.postings]
        return self

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept = []


def document_lengths(docs: DataFrame, config: Analyzer) -> DataFrame:
    """doc_id, dl: the number of terms; documents without terms have 0."""
    if config.tokenizer == "alpha":
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(measurer(stop_words(config) if config.stop else []), StructType([rows.schema["doc_id"], StructField("dl", LongType())]))
    return analyzed(docs, config).select("doc_id", F.size("terms").cast("long").alias("dl"))


def build_index(docs: DataFrame, config: Analyzer = Analyzer()) -> Index:
    """docs: doc_id (unique) and text. Documents without terms count in N and in the average length."""
    return Index(document_lengths(docs, config), term_frequencies(docs, config), config)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part")


def save_index(index: Index, path: str, parts: int = 256) -> None:
    """Writes docs, scalars and postings (with df and dl) as Parquet, the postings in folders by the hash of their term.

    Rebalancing sends a part's postings to as many files as its size asks for, so that a term that is
    in every document takes no single task.
    """
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    docs = index.docs.sparkSession.read.parquet(f"{path}/docs")
    index.scalars.write.mode("overwrite").parquet(f"{path}/scalars")
    rows = Index(docs, index.postings.select("term", "doc_id", "tf"), index.config).complete().withColumn("part", _part(parts))
    rows.hint("rebalance", "part").sortWithinPartitions("part", "term", "doc_id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str, config: Analyzer = Analyzer(), parts: int = 256) -> Index:
    """A saved index; config and parts are those that it was saved with."""
    row = spark.read.parquet(f"{path}/scalars").first()
    return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), config, parts=parts, totals=(row["doc_count"], row["total_terms"]))


def add_documents(index: Index, docs: DataFrame) -> Index:
    """The index with further documents, whose ids are new."""
    more = build_index(docs, index.config)
    return Index(index.docs.unionByName(more.docs), index.postings.select("term", "doc_id", "tf").unionByName(more.postings), index.config)


def lookup(index: Index, term: str) -> Column:
    return F.col("term") == F.lower(F.lit(term))


def postings_of(index: Index, term: str) -> DataFrame:
    """doc_id of a term, ascending; no rows for an unknown term."""
    return index.postings.where(lookup(index, term)).select("doc_id").orderBy("doc_id")


def document_frequency(index: Index, term: str) -> DataFrame:
    """One row, df, 0 for an unknown term."""
    return index.postings.where(lookup(index, term)).agg(F.count("*").alias("df"))


def postings_lists(index: Index) -> DataFrame:
    """term, doc_ids: an ascending array."""
    return index.postings.groupBy("term").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def dictionary(index: Index) -> DataFrame:
    """term, postings: a map from doc_id to tf."""
    entries = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    return index.postings.groupBy("term").agg(F.map_from_entries(entries).alias("postings"))


def dump(index: Index, with_tf: bool = False) -> DataFrame:
    """line_no within term, line: the printed form of the index, a heading for each term and a line for each posting."""
    df = index.terms
    heads = df.select("term", F.lit(0).cast("long").alias("line_no"), F.concat(F.col("df").cast("string"), F.lit("=df("), F.col("term"), F.lit(")")).alias("line"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("doc_id")).cast("long")
    body = F.format_string("    %s %s", F.col("tf"), F.col("doc_id")) if with_tf else F.format_string("    %s", F.col("doc_id"))
    return heads.unionAll(index.postings.select("term", nth.alias("line_no"), body.alias("line")))


def token_sequence(docs: DataFrame, config: Analyzer = Analyzer()) -> DataFrame:
    """term, doc_id for each occurrence; sort by both for the printed sequence."""
    return occurrences(docs, config).select("term", "doc_id")


def incidence_matrix(index: Index, terms: list[str], doc_ids: list) -> DataFrame:
    """term and a 0/1 column for each document."""
    rows = index.postings.where(F.col("term").isin(terms) & F.col("doc_id").isin(doc_ids))
    return rows.groupBy("term").agg(*[F.max((F.col("doc_id") == d).cast("int")).alias(f"doc_{d}") for d in doc_ids])


def count_matrix(index: Index, terms: list[str], doc_ids: list) -> DataFrame:
    """doc_id, a tf column for each term, and dl."""
    rows = index.postings.where(F.col("term").isin(terms) & F.col("doc_id").isin(doc_ids))
    counts = rows.groupBy("doc_id").agg(*[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{t}") for t in terms])
    docs = index.docs.where(F.col("doc_id").isin(doc_ids))
    return docs.join(counts, "doc_id", "left").select("doc_id", *[F.coalesce(f"tf_{t}", F.lit(0)).cast("long").alias(f"tf_{t}") for t in terms], "dl")
