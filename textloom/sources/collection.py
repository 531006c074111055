"""Readers of document collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: The tags of a collection file.
_OPEN, _CLOSE = "<doc><docno>", "</doc>"
_STRICT = r"<doc><docno>([^<]+)</docno>([^<]+)</doc>"
_FREE = r"(?s)<doc><docno>([^<]+)</docno>(.*?)</doc>"


def read_tagged(spark: SparkSession, path: str, inner_tags: bool = True) -> DataFrame:
    """doc_pos, doc_id, text of tagged documents; compressed files are read by their extension.

    inner_tags=False takes only documents with a body of one character or more that has no ``<``.
    Each file is read whole; for large plain files see read_tagged_split.
    """
    pattern = F.lit(_FREE if inner_tags else _STRICT)
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.posexplode(F.arrays_zip(F.regexp_extract_all("value", pattern, 1).alias("id"), F.regexp_extract_all("value", pattern, 2).alias("body"))).alias("doc_pos", "doc"))
    return rows.select("doc_pos", trimmed(F.col("doc.id")).alias("doc_id"), trimmed(F.col("doc.body")).alias("text"))


def read_tagged_split(spark: SparkSession, path: str) -> DataFrame:
    """As read_tagged with inner tags, but files are cut at closing tags, so one file is read by many tasks.

    doc_pos increases in file order but has gaps. The last document of a file must be closed.
    """
    chunks = spark.read.option("lineSep", _CLOSE).text(path)
    pattern = r"(?s)<doc><docno>([^<]+)</docno>(.*)$"
    rows = chunks.where(F.col("value").contains(_OPEN) & F.col("value").rlike(pattern))
    return rows.select(F.monotonically_increasing_id().alias("doc_pos"), trimmed(F.regexp_extract("value", pattern, 1)).alias("doc_id"), trimmed(F.regexp_extract("value", pattern, 2)).alias("text"))


def list_files(spark: SparkSession, folder: str, pattern: str = "*.gz") -> DataFrame:
    """label, path of the files of a folder, sorted by name and labelled file1, file2, ...; none if the folder is missing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    names = sorted(str(s.getPath().toString()) for s in found)
    return spark.createDataFrame([(f"file{k}", n) for k, n in enumerate(names, 1)], "label string, path string")


def read_series(spark: SparkSession, folder: str, pattern: str = "*.gz") -> dict[str, DataFrame]:
    """The documents of each file of a folder, by label, in the order of names."""
    files = list_files(spark, folder, pattern).orderBy("path").collect()
    return {f.label: read_tagged(spark, f.path) for f in sorted(files, key=lambda f: f.path)}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text of a Parquet table; only these columns are read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def query_set(spark: SparkSession, queries: dict[int, str]) -> DataFrame:
    """query_id, query."""
    return spark.createDataFrame([(int(k), q) for k, q in queries.items()], "query_id long, query string")
